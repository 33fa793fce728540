"""DuckDB twins of the task views, the noise profile and the policy compiler."""

from __future__ import annotations

from tessera.functions import constants as K
from tessera.operators.corrupt import NOISE_PROFILES, OUTLIER_DECIMALS
from tessera.sources import tasks as TK
from tessera.plans import sqlkit as S
from tessera.plans.sqlkit import Sql, hpick, pick, q, sround, uni

SEQ = 1 << 40


def task_view_sql(task: str) -> str:
    if task == "ecommerce_mobile":
        return f"""SELECT o_orderkey AS _seq, o_orderkey AS session_id, {pick(TK.DEVICE_OS, 'o_orderkey % 3')} AS device_os,
            CAST(o_custkey AS VARCHAR) AS customer_id, {pick(TK.COUNTRIES, 'o_custkey % 5')} AS country,
            CAST((o_orderkey * 7) % 10 AS DOUBLE) AS items_in_cart, o_totalprice / 1000 AS order_value,
            strftime(o_orderdate, '%Y-%m-%d') AS event_date,
            CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS converted FROM orders"""
    if task == "subscription_churn":
        return f"""SELECT c_custkey AS _seq, concat('C', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS customer_key,
            CAST(18 + (c_custkey * 7) % 52 AS DOUBLE) AS age, abs(c_acctbal) + 50 AS monthly_spend,
            {pick(TK.PLAN_TYPES, 'c_custkey % 2')} AS plan_type, CAST((c_custkey * 5) % 36 AS DOUBLE) AS tenure_months,
            {pick(TK.PAYMENT_METHODS, 'c_nationkey % 4')} AS payment_method,
            CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS churned FROM customer"""
    return f"""SELECT l_orderkey * 8 + l_linenumber AS _seq, concat('R', l_orderkey, '-', l_linenumber) AS route_id,
            {pick(TK.CITIES, 'l_suppkey % 4')} AS city, 3 + (l_partkey % 21) / 10.0::DOUBLE AS driver_rating,
            CAST(5 + (l_orderkey * 3 + l_linenumber) % 36 AS DOUBLE) AS delivery_distance_km,
            CAST((l_partkey + l_linenumber) % 5 AS DOUBLE) AS late_deliveries_last_30d,
            {pick(TK.VEHICLES, '(l_suppkey * 7) % 3')} AS vehicle_type,
            10 + l_quantity AS delivery_time_minutes FROM lineitem"""


def task_columns(task: str) -> list[str]:
    return list(TK.TASK_SPECS[task]["expected_types"])


def _initial_types(task: str) -> dict[str, str]:
    """'num' / 'str' kinds of the clean view's columns."""
    out = {}
    for c, t in TK.TASK_SPECS[task]["expected_types"].items():
        out[c] = "num" if t in ("bigint", "double") else "str"
    # event_date is text in the view; it becomes a timestamp only when cast
    return out


def text_of(c: str, kind: str) -> str:
    return S.number_text(c) if kind == "dbl" else f"CAST({c} AS VARCHAR)"


def noise_ctes(task: str, prefix: str, profile: str = "medium", seed: int = 42) -> tuple[list, str]:
    """CTE chain from the clean view to the dirty view; returns (ctes, last)."""
    spec = TK.TASK_SPECS[task]
    key, target = spec["key"], spec["target"]
    cols = task_columns(task)
    pm, pi, pd_, po, pdr, pj = NOISE_PROFILES[profile]
    skip = set(spec["skip_missing"]) | {target, key}
    cat = [c for c in spec["categorical"] if c != target]
    num = [c for c in spec["numeric"] if c != target]
    k = Sql(key)
    ctes = [(f"{prefix}0", task_view_sql(task))]

    def sel(exprs: dict, rel: str, extra: str = "") -> str:
        return "SELECT _seq" + extra + ", " + ", ".join(f"{exprs.get(c, c)} AS {c}" for c in cols) + f" FROM {rel}"

    miss = {c: f"CASE WHEN {uni(k, seed, c, 'missing')} < {pm} THEN NULL ELSE {c} END" for c in cols if c not in skip}
    ctes.append((f"{prefix}1", sel(miss, f"{prefix}0")))
    inv = {c: f"CASE WHEN {uni(k, seed, c, 'invalid')} < {pi} THEN {hpick(uni(k, seed, c, 'token'), K.INVALID_TOKENS)} "
              f"ELSE CAST({c} AS VARCHAR) END" for c in cat}
    ctes.append((f"{prefix}2", sel(inv, f"{prefix}1")))
    ctes.append((f"{prefix}3", f"SELECT *, concat_ws('#', CAST({key} AS VARCHAR), CAST(_copy AS VARCHAR)) AS _rk FROM "
                               f"({S.with_duplicates(f'{prefix}2', key, ['_seq', *cols], pd_, seed)})"))
    rk = Sql("_rk")
    types = _initial_types(task)
    qsel = ", ".join(f"quantile_cont({S.parse_double(c, types[c] == 'num')}, 0.25) AS q1_{c}, "
                     f"quantile_cont({S.parse_double(c, types[c] == 'num')}, 0.75) AS q3_{c}" for c in num)
    ctes.append((f"{prefix}q", f"SELECT {qsel} FROM {prefix}3"))
    out = {}
    for c in num:
        v = S.parse_double(c, types[c] == "num")
        q1, q3 = f"q1_{c}", f"q3_{c}"
        hi, lo = (sround(x, OUTLIER_DECIMALS) for x in (f"{q3} + 10 * ({q3} - {q1})", f"{q1} - 10 * ({q3} - {q1})"))
        side = f"(CASE WHEN {uni(rk, seed, c, 'side')} < 0.5 THEN {hi} ELSE {lo} END)"
        out[c] = f"CASE WHEN ({q3} - {q1}) > 0 AND {uni(rk, seed, c, 'outlier')} < {po} THEN {side} ELSE {v} END"
    ctes.append((f"{prefix}4", sel(out, f"{prefix}3, {prefix}q", ", _copy, _rk")))
    drift = {}
    for c in cat:
        s = f"CAST({c} AS VARCHAR)"
        kind = uni(rk, seed, c, "drift_kind")
        d = (f"(CASE WHEN {kind} < 0.25 THEN '  ' || {s} || '  ' WHEN {kind} < 0.5 THEN upper({s}) "
             f"WHEN {kind} < 0.75 THEN lower({s}) ELSE {s} || ' ' END)")
        drift[c] = f"CASE WHEN {uni(rk, seed, c, 'drift')} < {pdr} THEN {d} ELSE {s} END"
    ctes.append((f"{prefix}5", sel(drift, f"{prefix}4", ", _copy, _rk")))
    junk = {c: f"CASE WHEN {uni(rk, seed, c, 'junk')} < {pj} THEN {hpick(uni(rk, seed, c, 'junk_pick'), K.NUMERIC_JUNK)} "
               f"ELSE {text_of(c, 'dbl')} END" for c in num}
    ctes.append((f"{prefix}6", sel(junk, f"{prefix}5", ", _copy, _rk")))
    ctes.append((f"{prefix}", f"SELECT CAST(_copy AS BIGINT) * {SEQ} + _seq AS _seq, {', '.join(cols)} FROM {prefix}6"))
    return ctes, prefix


def dirty_types(task: str) -> dict[str, str]:
    """Column kinds after the noise profile: numerics and categoricals are text."""
    spec = TK.TASK_SPECS[task]
    t = _initial_types(task)
    for c in spec["numeric"] + spec["categorical"]:
        if c != spec["target"]:
            t[c] = "str"
    return t


def policy_ctes(rel: str, cols: list[str], types: dict[str, str], steps: list, prefix: str = "p") -> tuple[list, str]:
    """SQL twin of ``compile_policy``: one CTE per step, statistics as scalar
    subqueries over the step's input."""
    ctes = []
    types = dict(types)
    cur = rel
    for i, step in enumerate(steps):
        op, col = step[0], step[1]
        strategy = step[2] if len(step) > 2 else "median"
        name = f"{prefix}{i}"
        if op == "drop_duplicates":
            ctes.append((name, f"SELECT min(_seq) AS _seq, {', '.join(cols)} FROM {cur} GROUP BY ALL"))
            cur = name
            continue
        kind = types[col]
        if op == "replace_invalid_with_null":
            e = S.invalid_null(col) if kind == "str" else col
        elif op == "cast_numeric":
            e, types[col] = S.parse_double(col, kind == "num"), "num"
        elif op == "cast_datetime":
            e, types[col] = (S.to_datetime(col) if kind == "str" else f"CAST({col} AS TIMESTAMP)"), "ts"
        elif op == "normalize_categories":
            e, types[col] = S.normalize(col), "str"
        elif op == "impute_numeric":
            v = S.parse_double(col, kind == "num")
            agg = f"avg({v})" if strategy == "mean" else f"quantile_cont({v}, 0.5)"
            e, types[col] = f"coalesce({v}, (SELECT {agg} FROM {cur}))", "num"
        elif op == "clip_outliers_iqr":
            v = S.parse_double(col, kind == "num")
            q1, q3 = f"(SELECT quantile_cont({v}, 0.25) FROM {cur})", f"(SELECT quantile_cont({v}, 0.75) FROM {cur})"
            e, types[col] = S.clip(v, q1, q3), "num"
        elif op == "impute_categorical":
            e = f"coalesce(CAST({col} AS VARCHAR), {S.mode_of(f'CAST({col} AS VARCHAR)', cur)}, 'unknown')"
            types[col] = "str"
        else:
            raise ValueError(op)
        sel = ", ".join(f"{e} AS {c}" if c == col else c for c in cols)
        ctes.append((name, f"SELECT _seq, {sel} FROM {cur}"))
        cur = name
    return ctes, cur
