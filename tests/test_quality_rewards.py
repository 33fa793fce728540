"""Exact duplicate sampling, ranks of uniform draws, gates and rewards from the quality score."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.exprs import hash52
from tessera.operators import corrupt as CR
from tessera.operators import quality as Q
from tessera.operators import stats
from tessera.operators import trajectory as T

SPEC = {"target": "y", "expected_types": {"id": "bigint", "x": "double", "y": "bigint"}}


def _copies(df, p, seed=42):
    return Counter(r["id"] for r in CR.noise_duplicates(df, "id", p, seed).where("_copy > 0").collect())


def test_duplicates_are_exactly_k_drawn_with_replacement(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2.0)
    drawn = _copies(df, 0.9)
    assert sum(drawn.values()) == 900 and max(drawn.values()) > 1
    assert drawn == _copies(df.repartition(13), 0.9) == _copies(df.orderBy(F.desc("id")).coalesce(1), 0.9)
    want = Counter()
    for h in spark.range(900).select(hash52(F.col("id"), 42, "dup")).collect():
        want[min(int(h[0] / 2.0 ** 52 * 1000.0), 999)] += 1
    assert drawn == want
    rows = CR.noise_duplicates(df, "id", 0.9).collect()
    assert len(rows) == 1900 and all(r["x"] == 2.0 * r["id"] for r in rows)
    assert all(sorted(r["_copy"] for r in rows if r["id"] == i) == list(range(drawn[i] + 1)) for i in range(20))


@pytest.mark.parametrize("n, k", [(1, 1), (7, 1), (40, 1), (200, 6)])
def test_at_least_one_duplicate(spark, n, k):
    assert sum(_copies(spark.range(n), 0.03).values()) == k


def test_duplicates_of_empty_null_and_repeated_keys(spark):
    assert CR.noise_duplicates(spark.createDataFrame([], "id long, x string"), "id", 0.5).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "a"), (1, "b")] * 20, "id long, x string")
    first = sorted(map(str, CR.noise_duplicates(rows, "id", 0.5).collect()))
    assert len(first) == 150
    assert first == sorted(map(str, CR.noise_duplicates(rows.repartition(7), "id", 0.5).collect()))


def test_ranks_of_uniform_draws_are_exact(spark):
    df = spark.range(5000)
    cols = {t: hash52(F.col("id"), 1, t) for t in "abc"}
    ranks = {"a": 0, "b": 2500, "c": 4999}
    drawn = {t: sorted(r[0] for r in df.select(c).collect()) for t, c in cols.items()}
    want = {t: drawn[t][ranks[t]] for t in cols}
    assert stats.kth_of_uniform(df, cols, ranks, 5000) == want
    assert stats.kth_of_uniform(df, cols, ranks, 5000, max_local=50) == want


def test_ranks_of_draws_that_are_not_uniform(spark):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") < 400, 3.0).otherwise(7.0))
    for rank, value in ((0, 3.0), (399, 3.0), (400, 7.0), (999, 7.0)):
        assert stats.kth_of_uniform(df, {"v": F.col("v")}, {"v": rank}, 1000) == {"v": value}
    assert stats.kth_of_uniform(df, {"v": F.col("v")}, {"v": 0}, 0) == {"v": None}


def test_rewards(spark):
    row = spark.range(1).select(
        T.step_reward(F.lit(0.5), F.lit(0.6)).alias("gain"), T.step_reward(F.lit(0.9), F.lit(0.1)).alias("loss"),
        T.final_reward(F.lit(1.0), F.lit(True), F.lit(1.0)).alias("best"),
        T.final_reward(F.lit(0.8), F.lit(False), F.lit(0.5)).alias("part")).first()
    assert [round(v, 9) for v in row] == [0.08, -0.15, 1.0, 0.485]


def _table(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y long")


def test_all_gates_shape_and_submission(spark):
    raw = _table(spark, [(i, float(i), i % 2) for i in range(10)])
    probe = {"score_mean": 0.9, "score_std": 0.1, "n_folds": 3}
    report = Q.full_gate_report(raw, raw, SPEC, probe).collect()
    assert len(report) == 6 and all(r["passed"] and r["all_passed"] for r in report)
    assert {(r["n_rows"], r["n_columns"], r["retention_ratio"]) for r in report} == {(10, 3, 1.0)}
    loose = Q.full_gate_report(raw, raw, SPEC, {**probe, "score_std": 0.2}).collect()
    assert [r["gate"] for r in loose if not r["passed"]] == ["test_stability_probe"]
    assert not any(r["all_passed"] for r in loose)
    best = Q.submission_reward(raw, raw, SPEC, 1.0).first()
    assert tuple(best) == (1.9, True, 1.0, round(0.45 * 1.9 + 0.30 + 0.25, 6))
    dirty = _table(spark, [(0, None, 0), (1, 1.0, 1), (1, 1.0, 1), (3, None, 1)])
    failed = {r["gate"] for r in Q.gate_report(dirty, raw, SPEC).where("NOT passed").collect()}
    assert failed == {"test_missing_values", "test_duplicated_rows", "test_data_retention"}
    got = Q.submission_reward(dirty, raw, SPEC, 0.5).first()
    quality = round(1.2 * 0.4 + 0.7 - 0.08 * 2 - 0.2, 4)
    assert tuple(got) == (quality, False, 0.5, round(0.45 * quality + 0.125, 6))


def test_gates_of_an_empty_table(spark):
    empty = _table(spark, [])
    got = {r["gate"]: r["passed"] for r in Q.gate_report(empty, empty, SPEC).collect()}
    assert got["test_missing_values"] and not got["test_data_retention"]


def test_failed_episodes_are_zero_rows(spark):
    eps = spark.createDataFrame(
        [(1, 2.5, 4, 1, True, True, 0.9, None), (2, 3.0, 5, 2, True, True, 1.0, "boom")],
        "episode_id long, total_return double, steps long, invalid_actions long, success boolean, "
        "quality_gate_passed boolean, retention_ratio double, error string")
    got = {r["episode_id"]: tuple(r)[1:] for r in T.zero_failed(eps).collect()}
    assert got == {1: (2.5, 4, 1, True, True, 0.9, None), 2: (0.0, 0, 0, False, False, None, "boom")}


def test_profile_of_numeric_and_text_columns(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b"), (4.0, None)], "x double, s string")
    got = {(r["column_name"], r["item"]): (r["value"], r["number"]) for r in Q.profile_columns(df).collect()}
    assert got[("x", "count")] == (None, 3.0) and got[("x", "50%")] == (None, 2.0) and got[("x", "max")] == (None, 4.0)
    assert got[("s", "top 1")] == ("a", 2.0) and got[("s", "top 2")] == ("b", 1.0) and len(got) == 10
