"""Corruption / noise queries and the three scripted cleaning policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import corrupt as CR
from tessera.plans import sql_tasks as ST
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.policy import TASK_POLICIES, compile_policy
from tessera.plans.sqlkit import Sql, hpick, h52, uni
from tessera.sources import fixtures as X
from tessera.sources import tasks as TK

SEED = 42
RATE = 0.15
DOMAIN_KEYS = {"hr": "EmployeeID", "sales": "DealID", "pm": "TaskID", "it_ops": "TicketID"}
# kinds of the numeric domain columns in the fixture views ('dbl' prints via decimal)
NUM_KIND = {"Age": "int", "MonthlyIncome": "dbl", "YearsAtCompany": "int", "DistanceFromHome": "int",
            "Amount": "dbl", "DaysInStage": "int", "Probability": "dbl", "EstimatedHours": "dbl",
            "ActualHours": "dbl", "CompletionPct": "dbl", "SLATarget": "dbl", "EscalationLevel": "int"}


# ------------------------------------------------------------- task tables
def _task_sql(task: str, dirty: bool, profile: str = "medium") -> str:
    if not dirty:
        return f"WITH v AS ({ST.task_view_sql(task)}) SELECT * FROM v"
    ctes, last = ST.noise_ctes(task, "n", profile)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + f"\nSELECT * FROM {last}"


def _policy_sql(task: str) -> str:
    ctes, last = ST.noise_ctes(task, "n")
    pctes, plast = ST.policy_ctes(last, ST.task_columns(task), ST.dirty_types(task), TASK_POLICIES[task])
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes + pctes) + f"\nSELECT * FROM {plast}"


_SHORT = {"ecommerce_mobile": "ecommerce", "subscription_churn": "churn", "delivery_eta": "delivery"}

for _task, _short in _SHORT.items():
    register(f"synth_tables_{_short}", lambda t=_task: _task_sql(t, False))(
        lambda spark, sf, t=_task: TK.TASK_VIEWS[t](spark, sf))
    register(f"noise_profile_{_short}", lambda t=_task: _task_sql(t, True))(
        lambda spark, sf, t=_task: TK.dirty_task(spark, sf, t))
    for _profile in ("light", "heavy"):
        register(f"noise_profile_{_short}_{_profile}", lambda t=_task, p=_profile: _task_sql(t, True, p))(
            lambda spark, sf, t=_task, p=_profile: TK.dirty_task(spark, sf, t, p))
    register(f"clean_policy_{_short}", lambda t=_task: _policy_sql(t))(
        lambda spark, sf, t=_task: compile_policy(TK.dirty_task(spark, sf, t), TASK_POLICIES[t]))


# ----------------------------------------------------- single noise steps
_EC = TK.TASK_SPECS["ecommerce_mobile"]
_ECV = ST.task_view_sql("ecommerce_mobile")
_ECK = Sql("session_id")


def _ec(spark, sf):
    return TK.task_ecommerce(spark, sf)


@register("noise_missing", lambda: (
    f"WITH v AS ({_ECV}) SELECT _seq, session_id, " + ", ".join(
        f"CASE WHEN {uni(_ECK, SEED, c, 'missing')} < 0.05 THEN NULL ELSE {c} END AS {c}"
        for c in ["device_os", "country", "items_in_cart", "order_value"]) + " FROM v"))
def noise_missing(spark, sf):
    df = CR.noise_missing(_ec(spark, sf), "session_id", ["device_os", "country", "items_in_cart", "order_value"], 0.05)
    return df.select("_seq", "session_id", "device_os", "country", "items_in_cart", "order_value")


@register("noise_invalid_tokens", lambda: (
    f"WITH v AS ({_ECV}) SELECT _seq, " + ", ".join(
        f"CASE WHEN {uni(_ECK, SEED, c, 'invalid')} < 0.04 THEN "
        f"{hpick(uni(_ECK, SEED, c, 'token'), K.INVALID_TOKENS)} ELSE {c} END AS {c}"
        for c in _EC["categorical"]) + " FROM v"))
def noise_invalid_tokens(spark, sf):
    return CR.noise_invalid_tokens(_ec(spark, sf), "session_id", _EC["categorical"], 0.04).select(
        "_seq", *_EC["categorical"])


@register("noise_duplicates", lambda: (
    f"WITH v AS ({_ECV}) " + S.with_duplicates("v", "session_id", ["_seq", *ST.task_columns("ecommerce_mobile")], 0.03, SEED)))
def noise_duplicates(spark, sf):
    return CR.noise_duplicates(_ec(spark, sf), "session_id", 0.03)


def _outliers_sql() -> str:
    sel = []
    for c in _EC["numeric"]:
        q1, q3 = f"q1_{c}", f"q3_{c}"
        hi, lo = (S.sround(x, CR.OUTLIER_DECIMALS) for x in (f"{q3} + 10 * ({q3} - {q1})", f"{q1} - 10 * ({q3} - {q1})"))
        side = f"(CASE WHEN {uni(_ECK, SEED, c, 'side')} < 0.5 THEN {hi} ELSE {lo} END)"
        sel.append(f"CASE WHEN ({q3} - {q1}) > 0 AND {uni(_ECK, SEED, c, 'outlier')} < 0.02 THEN {side} "
                   f"ELSE {c} END AS {c}")
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in _EC["numeric"])
    return f"WITH v AS ({_ECV}), b AS (SELECT {qs} FROM v) SELECT _seq, {', '.join(sel)} FROM v, b"


@register("noise_outliers", _outliers_sql)
def noise_outliers(spark, sf):
    return CR.noise_outliers(_ec(spark, sf), "session_id", _EC["numeric"], 0.02).select("_seq", *_EC["numeric"])


def _drift_sql() -> str:
    sel = []
    for c in _EC["categorical"]:
        kind = uni(_ECK, SEED, c, "drift_kind")
        d = (f"(CASE WHEN {kind} < 0.25 THEN '  ' || {c} || '  ' WHEN {kind} < 0.5 THEN upper({c}) "
             f"WHEN {kind} < 0.75 THEN lower({c}) ELSE {c} || ' ' END)")
        sel.append(f"CASE WHEN {uni(_ECK, SEED, c, 'drift')} < 0.06 THEN {d} ELSE {c} END AS {c}")
    return f"WITH v AS ({_ECV}) SELECT _seq, {', '.join(sel)} FROM v"


@register("noise_category_drift", _drift_sql)
def noise_category_drift(spark, sf):
    return CR.noise_category_drift(_ec(spark, sf), "session_id", _EC["categorical"], 0.06).select(
        "_seq", *_EC["categorical"])


@register("noise_string_in_numeric", lambda: (
    f"WITH v AS ({_ECV}) SELECT _seq, " + ", ".join(
        f"CASE WHEN {uni(_ECK, SEED, c, 'junk')} < 0.03 THEN {hpick(uni(_ECK, SEED, c, 'junk_pick'), K.NUMERIC_JUNK)} "
        f"ELSE {S.number_text(c)} END AS {c}" for c in _EC["numeric"]) + " FROM v"))
def noise_string_in_numeric(spark, sf):
    return CR.noise_string_in_numeric(_ec(spark, sf), "session_id", _EC["numeric"], 0.03).select(
        "_seq", *_EC["numeric"])


# --------------------------------------------------- domain corruption
def _text(c: str) -> str:
    return S.number_text(c) if NUM_KIND.get(c) == "dbl" else f"CAST({c} AS VARCHAR)"


def _kexpr(share: float, n: str = "n") -> str:
    return f"greatest(1, floor(CAST({n} AS DOUBLE) * {RATE}::DOUBLE * {share}::DOUBLE))::BIGINT"


def _null_sel(d: str, cols: list[str]) -> str:
    k = Sql(DOMAIN_KEYS[d])
    num = K.DOMAIN_NUMERIC[d]
    return ", ".join(f"CASE WHEN {uni(k, SEED, c, 'null')} < {RATE} THEN NULL ELSE {c} END AS {c}" if c in num else c
                     for c in cols)


def _kth_sql(h: str, rel: str, k: str) -> str:
    """k-th smallest value of ``h`` over ``rel`` (rows with h <= it are the
    chosen ones, ties included -- the same rule as the Spark threshold)."""
    return f"(SELECT max(h) FROM (SELECT h, row_number() OVER (ORDER BY h) AS rn FROM (SELECT {h} AS h FROM {rel})) WHERE rn <= {k})"


def _type_ctes(d: str, rel: str, out: str) -> list[tuple[str, str]]:
    k = Sql(DOMAIN_KEYS[d])
    num = K.DOMAIN_NUMERIC[d]
    th = {c: _kth_sql(h52(k, SEED, c, "type"), rel, _kexpr(0.3, f"(SELECT count(*) FROM {rel})")) for c in num}
    sel = ", ".join(
        f"CASE WHEN {h52(k, SEED, c, 'type')} <= {th[c]} THEN {hpick(uni(k, SEED, c, 'type_tok'), K.TYPE_MISMATCH_TOKENS)} "
        f"ELSE {_text(c)} END AS {c}" if c in num else c for c in K.DOMAIN_COLUMNS[d])
    return [(out, f"SELECT {sel} FROM {rel}")]


def _typo_sql(t: str, k: Sql, c: str) -> str:
    n = f"length({t})"
    idx = f"least(floor({uni(k, SEED, c, 'typo_idx')} * {n})::BIGINT, {n} - 1)"
    kind = hpick(uni(k, SEED, c, "typo_kind"), CR.TYPO_KINDS)
    ch = hpick(uni(k, SEED, c, "typo_char"), CR.LETTERS)
    at = f"substr({t}, {idx} + 1, 1)"
    swap = f"(CASE WHEN upper({at}) = {at} THEN lower({at}) ELSE upper({at}) END)"
    return (f"CASE WHEN {t} IS NULL OR {n} < 2 THEN {t} "
            f"WHEN {kind} = 'swap' AND {idx} < {n} - 1 THEN substr({t}, 1, {idx}) || substr({t}, {idx} + 2, 1) || "
            f"{at} || substr({t}, {idx} + 3) "
            f"WHEN {kind} = 'delete' THEN substr({t}, 1, {idx}) || substr({t}, {idx} + 2) "
            f"WHEN {kind} = 'insert' THEN substr({t}, 1, {idx}) || {ch} || substr({t}, {idx} + 1) "
            f"ELSE substr({t}, 1, {idx}) || {swap} || substr({t}, {idx} + 2) END")


def _typo_ctes(d: str, rel: str, out: str, n_rel: str) -> list[tuple[str, str]]:
    k = Sql(DOMAIN_KEYS[d])
    cat = K.DOMAIN_CATEGORICAL[d]
    th = {c: _kth_sql(h52(k, SEED, c, "typo"), rel, _kexpr(0.2, f"(SELECT count(*) FROM {n_rel})")) for c in cat}
    sel = ", ".join(f"CASE WHEN {h52(k, SEED, c, 'typo')} <= {th[c]} THEN {_typo_sql(f'CAST({c} AS VARCHAR)', k, c)} "
                    f"ELSE CAST({c} AS VARCHAR) END AS {c}" if c in cat else c for c in K.DOMAIN_COLUMNS[d])
    return [(out, f"SELECT {sel} FROM {rel}")]


def _dupws_ctes(d: str, rel: str, out: str, n_rel: str) -> list[tuple[str, str]]:
    k = Sql(DOMAIN_KEYS[d])
    cols = K.DOMAIN_COLUMNS[d]
    ws = K.DOMAIN_CATEGORICAL[d][:2]
    rk = Sql("_rk")
    n = f"(SELECT count(*) FROM {n_rel})"
    kd = _kexpr(0.1, n)
    kws = f"least({_kexpr(0.2, n)}, {n} + {kd})"
    th_d = _kth_sql(h52(k, SEED, "dup"), rel, kd)
    th = {c: _kth_sql(h52(rk, SEED, c, "ws"), f"{out}_b", kws) for c in ws}
    sel = ", ".join(f"CASE WHEN {h52(rk, SEED, c, 'ws')} <= {th[c]} THEN '  ' || CAST({c} AS VARCHAR) || '  ' ELSE {c} END AS {c}"
                    if c in ws else c for c in cols)
    return [
        (f"{out}_b", f"SELECT *, concat_ws('#', CAST({DOMAIN_KEYS[d]} AS VARCHAR), CAST(_copy AS VARCHAR)) AS _rk "
                     f"FROM (SELECT *, unnest(range(0, CASE WHEN {h52(k, SEED, 'dup')} <= {th_d} THEN 2 ELSE 1 END)) AS _copy "
                     f"FROM {rel})"),
        (out, f"SELECT {sel}, _copy FROM {out}_b"),
    ]


def _wrap(d: str, ctes: list[tuple[str, str]], last: str) -> str:
    return S.with_fixtures([f"dom_{d}"], f"SELECT * FROM {last}", ctes)


def _dom(spark, sf, d):
    return X.domain_table(spark, sf, d)


for _d in ["hr", "sales", "pm", "it_ops"]:
    _key = DOMAIN_KEYS[_d]
    register(f"corrupt_nulls_{_d}", lambda d=_d: S.with_fixtures(
        [f"dom_{d}"], f"SELECT {_null_sel(d, K.DOMAIN_COLUMNS[d])} FROM dom_{d}"))(
        lambda spark, sf, d=_d, key=_key: CR.corrupt_nulls(_dom(spark, sf, d), key, K.DOMAIN_NUMERIC[d], RATE, SEED)
        .select(*K.DOMAIN_COLUMNS[d]))
    register(f"corrupt_type_mismatch_{_d}", lambda d=_d: _wrap(d, _type_ctes(d, f"dom_{d}", "t"), "t"))(
        lambda spark, sf, d=_d, key=_key: CR.corrupt_type_mismatch(
            _dom(spark, sf, d), key, K.DOMAIN_NUMERIC[d], RATE, SEED).select(*K.DOMAIN_COLUMNS[d]))
    register(f"corrupt_typos_{_d}", lambda d=_d: _wrap(d, _typo_ctes(d, f"dom_{d}", "t", f"dom_{d}"), "t"))(
        lambda spark, sf, d=_d, key=_key: CR.corrupt_typos(
            _dom(spark, sf, d), key, K.DOMAIN_CATEGORICAL[d], RATE, SEED).select(*K.DOMAIN_COLUMNS[d]))
    register(f"corrupt_duplicates_whitespace_{_d}",
             lambda d=_d: _wrap(d, _dupws_ctes(d, f"dom_{d}", "t", f"dom_{d}"), "t"))(
        lambda spark, sf, d=_d, key=_key: CR.corrupt_duplicates_whitespace(
            _dom(spark, sf, d), key, K.DOMAIN_CATEGORICAL[d], RATE, SEED).select(*K.DOMAIN_COLUMNS[d], "_copy"))


def corrupted_domain_ctes(d: str) -> tuple[list[tuple[str, str]], str]:
    """CTE chain dom_<d> -> corrupted table; the composition twin."""
    ctes = [("c1", f"SELECT {_null_sel(d, K.DOMAIN_COLUMNS[d])} FROM dom_{d}")]
    ctes += _type_ctes(d, "c1", "c2")
    ctes += _typo_ctes(d, "c2", "c3", f"dom_{d}")
    ctes += _dupws_ctes(d, "c3", "c4", f"dom_{d}")
    return ctes, "c4"


def corrupted_domain(spark, sf, d):
    return CR.corrupt_domain(_dom(spark, sf, d), DOMAIN_KEYS[d], K.DOMAIN_NUMERIC[d], K.DOMAIN_CATEGORICAL[d],
                             RATE, SEED).select(*K.DOMAIN_COLUMNS[d], "_copy")


for _d in ["hr", "sales", "pm", "it_ops"]:
    register(f"corrupt_domain_{_d}", lambda d=_d: _wrap(d, *corrupted_domain_ctes(d)))(
        lambda spark, sf, d=_d: corrupted_domain(spark, sf, d))


for _d in ["hr", "sales", "pm", "it_ops"]:
    register(f"view_dom_{_d}", lambda d=_d: S.with_fixtures([f"dom_{d}"], f"SELECT * FROM dom_{d}"))(
        lambda spark, sf, d=_d: _dom(spark, sf, d))
