"""Cleaning operators. Each is ``DataFrame -> DataFrame`` on built-in
expressions; statistics (median, mean, mode, quartiles) come from one small
distributed job each and enter the plan as literals.

Two families are kept side by side because their semantics differ:
tool-style operators (token-to-null, casts, imputers, category normalisation,
IQR clipping, whole-row dedup) and domain-style operators (fill_null,
fix_type, key-subset dedup, standardize, trim, correct_typo).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import constants as K
from tessera.functions.exprs import bound, dtype_of, is_numeric_type, literal_map, parse_double, py_title, ws_trim
from tessera.operators import stats
from tessera.session import stored

# Date layouts tried, in order, when coercing text to timestamps.
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy"]


def _require(df: DataFrame, column: str | None, op: str) -> str:
    if column is None:
        raise ValueError(f"Operation '{op}' requires a column.")
    if column not in df.columns:
        raise ValueError(f"Unknown column '{column}'.")
    return column


def data_columns(df: DataFrame) -> list[str]:
    """Columns that carry data; names starting with '_' are bookkeeping."""
    return [c for c in df.columns if not c.startswith("_")]


def replace_col(df: DataFrame, name: str, expr: Column) -> DataFrame:
    return df.withColumn(name, expr)


# ------------------------------------------------------------- expressions
def invalid_to_null_expr(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return F.when(c.isin(K.INVALID_TOKENS), F.lit(None).cast("string")).otherwise(c)
    return c


def normalize_expr(c: Column) -> Column:
    canon = literal_map(K.CATEGORY_ALIASES)
    return bound(F.lower(ws_trim(c.cast("string"))), lambda v: F.coalesce(F.try_element_at(canon, v), v))


def datetime_expr(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    s = c.cast("string")

    def first_of(formats: list[str]) -> Column:
        return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats], F.lit(None))

    # a layout is only tried on texts that have its separators, since failed parses cost most
    clock = [f for f in DATETIME_FORMATS if ":" in f]
    slash = [f for f in DATETIME_FORMATS if "/" in f and f not in clock]
    return F.when(F.contains(s, F.lit(":")), first_of(clock)).when(F.contains(s, F.lit("/")), first_of(slash)).otherwise(
        first_of([f for f in DATETIME_FORMATS if f not in clock + slash])).cast("timestamp_ntz")


def clip_expr(v: Column, lo: float | None, hi: float | None) -> Column:
    if lo is None or hi is None:
        return v
    return F.when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(v)


#: Decimals of the bounds that outliers are clipped to.
BOUND_DECIMALS = 9


def iqr_bounds(q1: float | None, q3: float | None, k: float = 1.5) -> tuple[float | None, float | None]:
    if q1 is None or q3 is None:
        return None, None
    iqr = q3 - q1
    # rounded, so that the last place does not depend on the engine's order of operations
    return round(q1 - k * iqr, BOUND_DECIMALS), round(q3 + k * iqr, BOUND_DECIMALS)


# ------------------------------------------------------ tool-style operators
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row dedup, NULLs equal. With a ``_seq`` order column the first
    copy's position is kept. One hash aggregation: duplicates are merged
    map-side before the shuffle, so a hot row does not land on one task."""
    cols = data_columns(df)
    if "_seq" not in df.columns:
        return df.select(*cols).dropDuplicates()
    return df.groupBy(*cols).agg(F.min("_seq").alias("_seq")).select(*df.columns)


def replace_invalid_with_null(df: DataFrame, column: str) -> DataFrame:
    _require(df, column, "replace_invalid_with_null")
    return replace_col(df, column, invalid_to_null_expr(F.col(column), dtype_of(df, column)))


def cast_numeric(df: DataFrame, column: str) -> DataFrame:
    _require(df, column, "cast_numeric")
    return replace_col(df, column, parse_double(F.col(column), dtype_of(df, column)))


def cast_datetime(df: DataFrame, column: str) -> DataFrame:
    _require(df, column, "cast_datetime")
    return replace_col(df, column, datetime_expr(F.col(column), dtype_of(df, column)))


def impute_numeric(df: DataFrame, column: str, strategy: str = "median") -> DataFrame:
    _require(df, column, "impute_numeric")
    v = parse_double(F.col(column), dtype_of(df, column))
    if strategy == "mean":
        fill = stats.means(df, {column: v})[column]
    else:
        fill = stats.exact_quantiles(df, {column: v}, [0.5])[column][0]
    return replace_col(df, column, F.coalesce(v, F.lit(fill).cast("double")))


def impute_categorical(df: DataFrame, column: str) -> DataFrame:
    _require(df, column, "impute_categorical")
    mode = stats.modes(df, {column: F.col(column)})[column]
    fill = mode if mode is not None else "unknown"
    return replace_col(df, column, F.coalesce(F.col(column).cast("string"), F.lit(fill)))


def normalize_categories(df: DataFrame, column: str) -> DataFrame:
    _require(df, column, "normalize_categories")
    return replace_col(df, column, normalize_expr(F.col(column)))


def clip_outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    _require(df, column, "clip_outliers_iqr")
    v = parse_double(F.col(column), dtype_of(df, column))
    q1, q3 = stats.exact_quantiles(df, {column: v}, [0.25, 0.75])[column]
    lo, hi = iqr_bounds(q1, q3)
    return replace_col(df, column, clip_expr(v, lo, hi))


def clip_report(df: DataFrame, column: str) -> DataFrame:
    """One row: IQR bounds and how many values fall outside them (NULLs are
    not counted as clipped)."""
    _require(df, column, "clip_outliers_iqr")
    v = parse_double(F.col(column), dtype_of(df, column))
    q1, q3 = stats.exact_quantiles(df, {column: v}, [0.25, 0.75])[column]
    lo, hi = iqr_bounds(q1, q3)
    if lo is None:
        return df.agg(F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
                      F.lit(0).cast("long").alias("n_clipped"))
    return df.agg(F.round(F.lit(lo), 4).alias("lower"), F.round(F.lit(hi), 4).alias("upper"),
                  F.count_if((v < lo) | (v > hi)).alias("n_clipped"))


# ---------------------------------------------------- domain-style operators
def _typed_mode(df: DataFrame, column: str):
    c = F.col(column)
    row = (df.where(c.isNotNull()).groupBy(c.alias("v")).count()
           .agg(F.min_by("v", F.struct((-F.col("count")).alias("nc"), F.col("v").alias("vv"))).alias("m"))
           .first())
    return row["m"] if row else None


def fill_null(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """``median`` (of the coerced column; the column itself is not coerced),
    ``mode`` (ties -> smallest) or a literal (default empty string)."""
    if column not in df.columns:
        return df
    dt = dtype_of(df, column)
    c = F.col(column)
    if value == "median":
        fill = stats.exact_quantiles(df, {column: parse_double(c, dt)}, [0.5])[column][0]
        if is_numeric_type(dt):
            return replace_col(df, column, F.coalesce(c.cast("double"), F.lit(fill).cast("double")))
        text = None if fill is None else repr(float(fill))
        return replace_col(df, column, F.coalesce(c, F.lit(text).cast("string")))
    if value == "mode":
        fill = _typed_mode(df, column)
        return replace_col(df, column, F.coalesce(c, F.lit(fill).cast(dt)))
    fill = value if value is not None else ""
    if is_numeric_type(dt):
        try:
            return replace_col(df, column, F.coalesce(c.cast("double"), F.lit(float(fill))))
        except ValueError:
            pass
    return replace_col(df, column, F.coalesce(c.cast("string"), F.lit(fill)))


def fix_type(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        return df
    return cast_numeric(df, column)


def remove_duplicate_subset(df: DataFrame, key_columns: list[str]) -> DataFrame:
    """Keep the first row per key (by ``_seq`` when present, else by the
    smallest row). ``min_by`` is an aggregate with partial aggregation, so a
    key that holds a third of the rows is combined map-side; no window sort of
    a hot partition."""
    keys = [c for c in key_columns if c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    payload = F.struct(*[F.col(c) for c in rest])
    if "_seq" in df.columns:
        agg = F.min_by(payload, F.col("_seq"))
    else:
        agg = F.min(payload)
    return df.groupBy(*keys).agg(agg.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def standardize(df: DataFrame, column: str, mode: str | None = None) -> DataFrame:
    if column not in df.columns:
        return df
    v = ws_trim(F.col(column).cast("string"))
    if mode == "lower":
        v = F.lower(v)
    elif mode == "title":
        v = py_title(v)
    return replace_col(df, column, v)


def trim(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        return df
    return replace_col(df, column, ws_trim(F.col(column).cast("string")))


def correct_typo(df: DataFrame, column: str, value: str | None, wrong: str | None = None) -> DataFrame:
    """Exact replace of ``wrong``; without it, the least frequent value (ties:
    smallest) is replaced when the column has more than one distinct value."""
    if column not in df.columns or value is None:
        return df
    c = F.col(column)
    if not wrong:
        row = (df.where(c.isNotNull()).groupBy(c.cast("string").alias("v")).count()
               .agg(F.count("*").alias("n"), F.min_by("v", F.struct("count", "v")).alias("rare")).first())
        if row is None or row["n"] <= 1:
            return df
        wrong = row["rare"]
    return replace_col(df, column, F.when(c.cast("string") == wrong, F.lit(value)).otherwise(c))


# ------------------------------------------------------------- dispatchers
def apply_tool_operation(df: DataFrame, operation: str, column: str | None = None,
                         strategy: str = "median") -> DataFrame:
    if operation == "drop_duplicates":
        return drop_duplicates(df)
    ops = {
        "replace_invalid_with_null": replace_invalid_with_null,
        "cast_numeric": cast_numeric,
        "cast_datetime": cast_datetime,
        "impute_categorical": impute_categorical,
        "normalize_categories": normalize_categories,
        "clip_outliers_iqr": clip_outliers_iqr,
    }
    if operation == "impute_numeric":
        return impute_numeric(df, _require(df, column, operation), strategy)
    if operation not in ops:
        raise ValueError(f"Unsupported operation '{operation}'.")
    return ops[operation](df, _require(df, column, operation))


def apply_domain_operation(df: DataFrame, operation: str, column: str | None, value: str | None = None,
                           params: dict | None = None, key_columns: list[str] | None = None) -> DataFrame:
    """Unknown operations and columns are ignored (the domain family's rule)."""
    params = params or {}
    if operation == "fill_null":
        return fill_null(df, column, value)
    if operation == "fix_type":
        return fix_type(df, column)
    if operation == "remove_duplicate":
        return remove_duplicate_subset(df, (key_columns or data_columns(df))[:5])
    if operation == "standardize":
        return standardize(df, column, value)
    if operation == "trim":
        return trim(df, column)
    if operation == "correct_typo":
        return correct_typo(df, column, value, params.get("wrong"))
    return df


def gold_table(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Whole-row dedup, numeric columns coerced and median-filled (medians of
    all numeric columns in one stats job family), categorical text stripped.
    The deduplicated rows feed several statistics passes and the result, so
    they are written once."""
    deduped = stored(drop_duplicates(df))
    nums = [c for c in numeric if c in deduped.columns]
    vals = {c: parse_double(F.col(c), dtype_of(deduped, c)) for c in nums}
    med = stats.exact_quantiles(deduped, vals, [0.5])
    out = {c: F.coalesce(vals[c], F.lit(med[c][0]).cast("double")) for c in nums}
    out.update({c: ws_trim(F.col(c).cast("string")) for c in categorical if c in deduped.columns})
    return deduped.withColumns(out)
