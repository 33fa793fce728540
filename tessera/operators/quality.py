"""Profiles, data-quality scores and quality gates.

Every profile is one aggregation over the table (``count_if`` per column,
then ``stack`` to long form), so a profile costs one scan regardless of the
number of columns.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import constants as K
from tessera.functions.exprs import dtype_of, is_numeric_like, is_numeric_type, parse_double
from tessera.operators import stats
from tessera.operators.clean import data_columns


def _stack(pairs: list[tuple[str, Column]], name_col: str, value_col: str) -> Column:
    """``stack`` of (literal name, value) pairs into two columns."""
    args = ", ".join(f"'{n}', `{alias}`" for n, alias in [(n, f"_v{i}") for i, (n, _) in enumerate(pairs)])
    return F.expr(f"stack({len(pairs)}, {args}) AS ({name_col}, {value_col})")


def _long(df: DataFrame, pairs: list[tuple[str, Column]], name_col: str, value_col: str) -> DataFrame:
    wide = df.agg(*[c.alias(f"_v{i}") for i, (_, c) in enumerate(pairs)])
    return wide.select(_stack(pairs, name_col, value_col))


# ------------------------------------------------------------------ profiles
def profile_missing(df: DataFrame) -> DataFrame:
    cols = data_columns(df)
    return _long(df, [(c, F.count_if(F.col(c).isNull())) for c in cols], "column_name", "n_missing")


def profile_invalid_tokens(df: DataFrame) -> DataFrame:
    cols = data_columns(df)
    pairs = []
    for c in cols:
        if isinstance(dtype_of(df, c), T.StringType):
            pairs.append((c, F.count_if(F.col(c).isin(K.INVALID_TOKENS))))
        else:
            pairs.append((c, F.lit(0).cast("long")))
    return _long(df, pairs, "column_name", "n_invalid")


def profile_duplicates(df: DataFrame) -> DataFrame:
    cols = data_columns(df)
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*cols))).alias("n_duplicates"))


def profile_types(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), (expected is None) or (f.name in expected))
            for f in df.schema.fields if not f.name.startswith("_")]
    schema = "column_name string, dtype string, expected boolean"
    return spark.createDataFrame(rows, schema)


def profile_schema_info(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """name, type, null count, expected/extra: one scan + the schema."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nulls = profile_missing(df)
    exp = expected or data_columns(df)
    return nulls.select(
        "column_name",
        F.element_at(_literal_map(types), F.col("column_name")).alias("dtype"),
        F.col("n_missing").alias("n_nulls"),
        F.when(F.col("column_name").isin(exp), "expected").otherwise("extra").alias("role"))


def _literal_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def profile_numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column (text
    columns are coerced first)."""
    vals = {c: parse_double(F.col(c), dtype_of(df, c)) for c in columns}
    quart = stats.exact_quantiles(df, vals, [0.25, 0.5, 0.75])
    items = [F.struct(F.lit(c).alias("column_name"), v.alias("v")) for c, v in vals.items()]
    long = df.select(F.explode(F.array(*items)).alias("x")).select("x.column_name", "x.v")
    agg = long.groupBy("column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    qmap = {k: i for i, k in enumerate(columns)}
    arrs = F.array(*[F.array(*[F.lit(x).cast("double") for x in quart[c]]) for c in columns])
    idx = F.element_at(_literal_map(qmap), F.col("column_name")) + 1
    qs = F.element_at(arrs, idx.cast("int"))
    return agg.select("column_name", "count", "mean", "std", "min",
                      F.element_at(qs, 1).alias("q25"), F.element_at(qs, 2).alias("q50"),
                      F.element_at(qs, 3).alias("q75"), "max")


def profile_top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """Top-k value counts of ``columns`` (default: all non-numeric; ties: value ascending).

    ``row_number() <= k`` lets Spark insert a per-partition group limit before
    the shuffle, so each map task forwards at most k rows per column."""
    from pyspark.sql import Window as W
    cols = columns or [c for c in data_columns(df) if not is_numeric_type(dtype_of(df, c))]
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    counted = (df.select(F.explode(F.array(*items)).alias("x")).select("x.column_name", "x.value")
               .where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n")))
    w = W.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc())
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def profile_columns(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """What a reader of the table is told of each column: ``column_name, item,
    value, number``. Numeric columns have one row for each of count, mean, std,
    min, 25%, 50%, 75% and max (in ``number``), the others their ``k`` most
    frequent values (items "top 1", ...; ``number`` counts their rows; ties:
    value ascending)."""
    cols = columns or data_columns(df)
    numeric = [c for c in cols if is_numeric_type(dtype_of(df, c))]
    parts = []
    if numeric:
        items = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "q25", "50%": "q50",
                 "75%": "q75", "max": "max"}
        parts.append(profile_numeric_summary(df, numeric).select("column_name", F.inline(F.array(*[
            F.struct(F.lit(i).alias("item"), F.lit(None).cast("string").alias("value"),
                     F.round(F.col(c).cast("double"), 6).alias("number")) for i, c in items.items()]))))
    if text := [c for c in cols if c not in numeric]:
        parts.append(profile_top_values(df, text, k).select(
            "column_name", F.concat(F.lit("top "), F.col("rank").cast("string")).alias("item"), "value",
            F.col("n").cast("double").alias("number")))
    return reduce(DataFrame.unionByName, parts)


# ----------------------------------------------------------------- DQ score
def dq_scores(df: DataFrame, columns: list[str], numeric_columns: list[str]) -> DataFrame:
    """completeness, consistency, uniqueness and their 0.40/0.35/0.25 blend,
    each rounded to 4 places, in one aggregation."""
    avail = [c for c in columns if c in df.columns]
    nums = [c for c in numeric_columns if c in df.columns]
    key = avail[:5]
    aggs = [F.count(F.lit(1)).alias("n")]
    null_terms = [F.count_if(F.col(c).isNull()) for c in avail]
    aggs.append(sum(null_terms[1:], null_terms[0]).alias("nulls") if null_terms else F.lit(0).alias("nulls"))
    for i, c in enumerate(nums):
        ok = is_numeric_like(F.col(c), dtype_of(df, c))
        aggs.append(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias(f"c{i}"))
    aggs.append(F.count_distinct(F.struct(*key)).alias("d") if key else F.lit(0).alias("d"))
    row = df.agg(*aggs)
    n = F.col("n")
    completeness = (F.lit(1.0) - F.col("nulls") / (n * len(avail))) if avail else F.lit(1.0)
    if nums:
        cons = F.col("c0")
        for i in range(1, len(nums)):
            cons = cons + F.col(f"c{i}")
        consistency = cons / len(nums)
    else:
        consistency = F.lit(1.0)
    uniqueness = F.when(n > 0, F.lit(1.0) - (n - F.col("d")) / n).otherwise(F.lit(1.0))
    w = K.DQ_WEIGHTS
    return row.select(
        F.round(completeness, 4).alias("completeness"),
        F.round(consistency, 4).alias("consistency"),
        F.round(uniqueness, 4).alias("uniqueness"),
        F.round(w[0] * completeness + w[1] * consistency + w[2] * uniqueness, 4).alias("overall"),
    )


# --------------------------------------------------- tool-family score/gates
def _logical_ok(dt: T.DataType, expected: str) -> bool:
    return dt.simpleString() == expected


def quality_score_expr(n_rows: Column, raw_rows: Column, type_match: float, missing: Column,
                       dups: Column) -> Column:
    retention = n_rows / F.greatest(raw_rows, F.lit(1))
    score = 1.2 * retention + 0.7 * type_match - 0.08 * missing - 0.2 * dups
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), score))


def table_stats(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: rows, missing cells outside the target, duplicate rows."""
    cols = data_columns(df)
    miss = [F.count_if(F.col(c).isNull()) for c in cols if c != target]
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  (sum(miss[1:], miss[0]) if miss else F.lit(0)).alias("n_missing"),
                  (F.count(F.lit(1)) - F.count_distinct(F.struct(*cols))).alias("n_duplicates"))


def quality_score(df: DataFrame, raw_rows: int | Column, spec: dict) -> DataFrame:
    exp = spec["expected_types"]
    present = {f.name: f.dataType for f in df.schema.fields}
    matched = sum(1 for c, t in exp.items() if c in present and _logical_ok(present[c], t))
    type_match = matched / max(len(exp), 1)
    st = table_stats(df, spec["target"])
    raw = raw_rows if isinstance(raw_rows, Column) else F.lit(raw_rows)
    return st.select("*", F.round(quality_score_expr(F.col("n_rows"), raw, type_match, F.col("n_missing"),
                                                      F.col("n_duplicates")), 4).alias("quality_score"))


def type_match(df: DataFrame, expected: dict[str, str]) -> float:
    present = {f.name: f.dataType for f in df.schema.fields}
    matched = sum(1 for c, t in expected.items() if c in present and _logical_ok(present[c], t))
    return matched / max(len(expected), 1)


def _gates(df: DataFrame, raw: DataFrame, spec: dict, min_retention: float, stability: dict | None) -> list[tuple]:
    """(gate, passed, detail) as columns over ``_counted``."""
    consistent = data_columns(df) == data_columns(raw) and spec["target"] in df.columns
    tm = type_match(df, spec["expected_types"])
    retention = F.col("n_rows") / F.greatest(F.col("raw_rows"), F.lit(1))
    gates = [
        ("test_missing_values", F.col("n_missing") == 0, F.col("n_missing")),
        ("test_duplicated_rows", F.col("n_duplicates") == 0, F.col("n_duplicates")),
        ("test_data_consistency", F.lit(consistent), F.lit(1.0 if consistent else 0.0)),
        ("test_data_retention", retention >= min_retention, F.round(retention, 4)),
        ("test_dtype_alignment", F.lit(tm == 1.0), F.lit(round(tm, 4))),
    ]
    if stability is not None:
        gates.append(("test_stability_probe", F.lit(stability["score_std"] <= 0.15), F.lit(stability["score_std"])))
    return gates


def _counted(df: DataFrame, raw: DataFrame, spec: dict) -> DataFrame:
    """``table_stats`` of ``df`` beside the number of raw rows."""
    return table_stats(df, spec["target"]).withColumn("raw_rows", raw.agg(F.count(F.lit(1))).scalar())


def _gate_rows(gates: list[tuple]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(g).alias("gate"), passed.alias("passed"), value.cast("double").alias("detail_value"))
        for g, passed, value in gates])).alias("g")


def _all_passed(gates: list[tuple]) -> Column:
    return reduce(and_, [passed for _, passed, _ in gates])


def gate_report(df: DataFrame, raw: DataFrame, spec: dict, min_retention: float = K.MIN_RETENTION,
                stability: dict | None = None) -> DataFrame:
    """One row per gate: (gate, passed, detail_value). Counts come from one
    aggregation of each table, and nothing runs before the result is read;
    schema gates are plan-time checks.

    detail_value: missing cells outside the target, duplicate rows, 1/0 for
    same columns + target kept, retention ratio, share of expected types, and,
    if the probe's result is given, its spread."""
    gates = _gates(df, raw, spec, min_retention, stability)
    return _counted(df, raw, spec).select(_gate_rows(gates)).select("g.*")


def full_gate_report(df: DataFrame, raw: DataFrame, spec: dict, stability: dict,
                     min_retention: float = K.MIN_RETENTION) -> DataFrame:
    """All six gates, with the overall result, the shape of the table and its
    retention on every row: ``gate, passed, detail_value, all_passed, n_rows,
    n_columns, retention_ratio``. ``stability`` is what ``stability_probe`` returns."""
    gates = _gates(df, raw, spec, min_retention, stability)
    return _counted(df, raw, spec).select(
        _gate_rows(gates), _all_passed(gates).alias("all_passed"), "n_rows",
        F.lit(len(data_columns(df))).cast("long").alias("n_columns"),
        F.round(F.col("n_rows") / F.greatest(F.col("raw_rows"), F.lit(1)), 4).alias("retention_ratio")).select(
        "g.*", "all_passed", "n_rows", "n_columns", "retention_ratio")


def submission_reward(df: DataFrame, raw: DataFrame, spec: dict, coverage: float,
                      stability: dict | None = None, min_retention: float = K.MIN_RETENTION) -> DataFrame:
    """The terminal reward of handing in ``df``: one row ``quality_score,
    gates_passed, coverage, final_reward``. The quality score is that of the
    table itself, ``coverage`` the share of the required operations that ran."""
    from tessera.operators.trajectory import final_reward
    gates = _gates(df, raw, spec, min_retention, stability)
    score = F.round(quality_score_expr(F.col("n_rows"), F.col("raw_rows"), type_match(df, spec["expected_types"]),
                                       F.col("n_missing"), F.col("n_duplicates")), 4)
    row = _counted(df, raw, spec).select(score.alias("quality_score"), _all_passed(gates).alias("gates_passed"),
                                         F.lit(coverage).alias("coverage"))
    return row.withColumn("final_reward", F.round(final_reward(
        F.col("quality_score"), F.col("gates_passed"), F.col("coverage")), 6))


def snapshot(df: DataFrame, spec: dict) -> DataFrame:
    """rows, columns, missing cells, duplicate rows, unparseable cells in the
    expected-numeric columns, and schema consistency (share of expected
    columns present with the expected type) -- one aggregation."""
    cols = data_columns(df)
    numeric = [c for c, t in spec["expected_types"].items() if t in ("double", "bigint") and c in df.columns]
    miss = [F.count_if(F.col(c).isNull()) for c in cols]
    bad = [F.count_if(F.col(c).isNotNull() & parse_double(F.col(c), dtype_of(df, c)).isNull()) for c in numeric]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_columns"),
        sum(miss[1:], miss[0]).alias("n_missing_cells"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*cols))).alias("n_duplicate_rows"),
        (sum(bad[1:], bad[0]) if bad else F.lit(0).cast("long")).alias("n_invalid_type_cells"),
        F.lit(round(type_match(df, spec["expected_types"]), 4)).alias("schema_consistency"))


# ------------------------------------------------------- stability probe
ORDINAL_EPOCH = 719163  # date.toordinal() of 1970-01-01


def encode_features(df: DataFrame, target: str) -> DataFrame:
    """Model-ready numbers: numeric NULL -> 0, dates -> ordinal day, text ->
    index in the sorted distinct values (NULL read as 'missing').

    The label index is computed without collecting labels to the driver:
    distinct values per column are ranked with the range-partitioned prefix
    and joined back, so high-cardinality text columns stay distributed."""
    from tessera.operators.trajectory import ordered_prefix
    out = df
    for f in df.schema.fields:
        c = f.name
        if c == target or c.startswith("_"):
            continue
        if is_numeric_type(f.dataType):
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            days = F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) + ORDINAL_EPOCH
            out = out.withColumn(c, F.coalesce(days, F.lit(0)).cast("double"))
        else:
            text = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
            vals = out.select(text.alias("_v")).distinct()
            ranked = ordered_prefix(vals, [], ["_v"], {}).select("_v", F.col("idx").cast("double").alias("_i"))
            out = (out.withColumn("_v", text).join(ranked, "_v", "left").drop("_v", c)
                   .withColumnRenamed("_i", c))
    return out.select(*df.columns)


def stability_probe(df: DataFrame, target: str, task_type: str, key: str, folds: int = 3,
                    seed: int = 42) -> dict:
    """Spread of a 25-tree random forest's held-out score over hash-assigned
    folds (accuracy, or max(0, 1 - MAE / mean|y|) for regression). Fewer
    than 8 rows, or no target, fails with std 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from tessera.functions.exprs import hash52
    if target not in df.columns:
        return {"score_mean": 0.0, "score_std": 1.0, "n_folds": 0}
    n = df.count()
    if n < 8:
        return {"score_mean": 0.0, "score_std": 1.0, "n_folds": 0}
    enc = encode_features(df, target)
    feats = [c for c in enc.columns if c != target and not c.startswith("_")]
    data = VectorAssembler(inputCols=feats, outputCol="features").transform(enc).select(
        "features", F.col(target).cast("double").alias("label"),
        F.pmod(hash52(F.col(key), seed, "fold").cast("long"), F.lit(folds)).alias("fold"))
    from tessera.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    data = data.checkpoint(eager=True)  # folds re-read the same encoded table
    scores = []
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        if task_type == "classification":
            model = RandomForestClassifier(numTrees=25, seed=seed).fit(train)
            pred = model.transform(test)
            scores.append(pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0)
        else:
            model = RandomForestRegressor(numTrees=25, seed=seed).fit(train)
            pred = model.transform(test)
            row = pred.agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"),
                           F.avg(F.abs("label")).alias("m")).first()
            scores.append(max(0.0, 1.0 - (row["mae"] or 0.0) / max(row["m"] or 0.0, 1e-6)))
    mean = sum(scores) / len(scores)
    std = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
    return {"score_mean": round(mean, 4), "score_std": round(std, 4), "n_folds": len(scores)}
