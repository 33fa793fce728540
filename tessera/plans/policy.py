"""Compile a cleaning policy (a list of tool operations) into one plan.

Row-local steps compose into one expression per column. Steps that need a
statistic (median/mean imputation, IQR clipping, mode imputation) register a
request at "stat level" = 1 + the level of the expression they read; all
requests of a level are answered together (one quantile job family, one
means job, one modes job), then the next level. The final projection inlines
every statistic as a literal, so the cleaned table is a single scan +
projection. ``drop_duplicates`` is a boundary: statistics after it are taken
on the deduplicated rows.
"""

from __future__ import annotations

from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import stats
from tessera.operators.clean import (clip_expr, datetime_expr, drop_duplicates, invalid_to_null_expr,
                                     iqr_bounds, normalize_expr)
from tessera.functions.exprs import parse_double
from tessera.session import stored

Step = tuple  # (operation, column[, strategy])

# The scripted policies of the three cleaning tasks.
TASK_POLICIES = {
    "ecommerce_mobile": [
        ("replace_invalid_with_null", "country"),
        ("replace_invalid_with_null", "items_in_cart"),
        ("replace_invalid_with_null", "device_os"),
        ("cast_numeric", "items_in_cart"),
        ("cast_numeric", "order_value"),
        ("impute_numeric", "items_in_cart"),
        ("impute_numeric", "order_value"),
        ("clip_outliers_iqr", "items_in_cart"),
        ("clip_outliers_iqr", "order_value"),
        ("normalize_categories", "device_os"),
        ("normalize_categories", "country"),
        ("impute_categorical", "device_os"),
        ("impute_categorical", "country"),
        ("cast_datetime", "event_date"),
        ("drop_duplicates", None),
    ],
    "subscription_churn": [
        ("replace_invalid_with_null", "monthly_spend"),
        ("replace_invalid_with_null", "age"),
        ("replace_invalid_with_null", "tenure_months"),
        ("replace_invalid_with_null", "payment_method"),
        ("cast_numeric", "age"),
        ("cast_numeric", "monthly_spend"),
        ("cast_numeric", "tenure_months"),
        ("impute_numeric", "age"),
        ("impute_numeric", "monthly_spend"),
        ("impute_numeric", "tenure_months"),
        ("clip_outliers_iqr", "monthly_spend"),
        ("normalize_categories", "plan_type"),
        ("normalize_categories", "payment_method"),
        ("impute_categorical", "plan_type"),
        ("impute_categorical", "payment_method"),
        ("drop_duplicates", None),
    ],
    "delivery_eta": [
        ("replace_invalid_with_null", "driver_rating"),
        ("replace_invalid_with_null", "late_deliveries_last_30d"),
        ("replace_invalid_with_null", "city"),
        ("replace_invalid_with_null", "vehicle_type"),
        ("cast_numeric", "driver_rating"),
        ("cast_numeric", "delivery_distance_km"),
        ("cast_numeric", "late_deliveries_last_30d"),
        ("impute_numeric", "driver_rating"),
        ("impute_numeric", "late_deliveries_last_30d"),
        ("impute_numeric", "delivery_distance_km"),
        ("clip_outliers_iqr", "delivery_distance_km"),
        ("normalize_categories", "city"),
        ("normalize_categories", "vehicle_type"),
        ("impute_categorical", "city"),
        ("impute_categorical", "vehicle_type"),
        ("drop_duplicates", None),
    ],
}

# The minimum slice: the same operator sequence over the dirty orders view.
ORDERS_POLICY = [
    ("replace_invalid_with_null", "priority"),
    ("replace_invalid_with_null", "price"),
    ("cast_numeric", "price"),
    ("impute_numeric", "price"),
    ("clip_outliers_iqr", "price"),
    ("normalize_categories", "priority"),
    ("impute_categorical", "priority"),
    ("cast_datetime", "order_date"),
    ("drop_duplicates", None),
]

#: Operations that need a statistic of the whole table.
STATISTICS = {"impute_numeric", "clip_outliers_iqr", "impute_categorical"}

ExprFn = Callable[[dict], Column]


def _segment(df: DataFrame, steps: list[Step], is_stored: bool) -> DataFrame:
    """The table is stored first if the steps need statistics: every pass and the
    projection read its rows, and none of them computes these anew."""
    if not is_stored and any(s[0] in STATISTICS for s in steps):
        df, is_stored = stored(df), True
    return compile_projection(df, steps, is_stored)(df)


def compile_projection(df: DataFrame, steps: list[Step], is_stored: bool = False):
    """Statistics of ``df`` (batched per level) frozen into a function that
    applies the row-local projection to any DataFrame with df's schema --
    including a streaming one. ``is_stored``: df is read from files as it is."""
    state: dict[str, tuple[ExprFn, int]] = {c: ((lambda st, c=c: F.col(c)), 0) for c in df.columns}
    types: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
    requests: list[tuple[int, str, str, ExprFn]] = []  # (level, kind, key, expr)

    for i, step in enumerate(steps):
        op, col = step[0], step[1]
        strategy = step[2] if len(step) > 2 else "median"
        if col not in state:
            raise ValueError(f"Unknown column '{col}'.")
        fn, lvl = state[col]
        dt = types[col]
        key = f"s{i}"
        if op == "replace_invalid_with_null":
            state[col] = ((lambda st, fn=fn, dt=dt: invalid_to_null_expr(fn(st), dt)), lvl)
        elif op == "cast_numeric":
            state[col] = ((lambda st, fn=fn, dt=dt: parse_double(fn(st), dt)), lvl)
            types[col] = T.DoubleType()
        elif op == "cast_datetime":
            state[col] = ((lambda st, fn=fn, dt=dt: datetime_expr(fn(st), dt)), lvl)
            types[col] = T.TimestampNTZType()
        elif op == "normalize_categories":
            state[col] = ((lambda st, fn=fn: normalize_expr(fn(st))), lvl)
            types[col] = T.StringType()
        elif op == "impute_numeric":
            v = (lambda st, fn=fn, dt=dt: parse_double(fn(st), dt))
            requests.append((lvl + 1, "mean" if strategy == "mean" else "median", key, v))
            state[col] = ((lambda st, v=v, key=key: F.coalesce(v(st), F.lit(st[key]).cast("double"))), lvl + 1)
            types[col] = T.DoubleType()
        elif op == "clip_outliers_iqr":
            v = (lambda st, fn=fn, dt=dt: parse_double(fn(st), dt))
            requests.append((lvl + 1, "iqr", key, v))
            state[col] = ((lambda st, v=v, key=key: clip_expr(v(st), *iqr_bounds(*st[key]))), lvl + 1)
            types[col] = T.DoubleType()
        elif op == "impute_categorical":
            requests.append((lvl + 1, "mode", key, fn))
            state[col] = ((lambda st, fn=fn, key=key: F.coalesce(
                fn(st).cast("string"), F.lit(st[key] if st[key] is not None else "unknown"))), lvl + 1)
            types[col] = T.StringType()
        else:
            raise ValueError(f"Unsupported operation '{op}'.")

    st: dict = {}
    src = df
    if requests and not is_stored:
        # every statistics pass re-reads df: keep it (spilling to disk) for
        # the duration of the passes, then release it
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    for level in sorted({r[0] for r in requests}):
        batch = [r for r in requests if r[0] == level]
        q = {key: fn(st) for _, kind, key, fn in batch if kind in ("median", "iqr")}
        if q:
            res = stats.exact_quantiles(df, q, [0.25, 0.5, 0.75])
            for _, kind, key, _ in batch:
                if kind == "median":
                    st[key] = res[key][1]
                elif kind == "iqr":
                    st[key] = (res[key][0], res[key][2])
        m = {key: fn(st) for _, kind, key, fn in batch if kind == "mean"}
        st.update(stats.means(df, m))
        md = {key: fn(st) for _, kind, key, fn in batch if kind == "mode"}
        st.update(stats.modes(df, md))
    if requests and not is_stored:
        df.unpersist()
    cols = list(src.columns)
    return lambda other: other.select(*[state[c][0](st).alias(c) for c in cols])


def compile_policy(df: DataFrame, steps: list[Step], is_stored: bool = False) -> DataFrame:
    """``df`` cleaned by the steps. ``is_stored``: it is read from files as it is."""
    seg: list[Step] = []
    for step in steps:
        if step[0] == "drop_duplicates":
            if seg:
                df = _segment(df, seg, is_stored)
                seg = []
            df, is_stored = drop_duplicates(df), False
        else:
            seg.append(step)
    if seg:
        df = _segment(df, seg, is_stored)
    return df
