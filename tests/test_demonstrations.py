"""Step results as VARIANT, inferred arguments and step history on small tables."""

import json

from pyspark.sql import functions as F

from tessera.operators import demonstrations as D


def test_result_summary(spark):
    texts = ['{"b": 1, "a": {"x": [1]}, "list": [1, 2], "preview": {"y": 1}, "data": 3}', '{"a": null, "é\\"": "q\\"uote"}', "{}", "[1, 2]", "3", "not json", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, result string")
    got = [json.loads(r[0]) for r in rows.orderBy("i").select(D.result_summary(F.col("result"))).collect()]
    assert got[0] == {"a": {"x": [1]}, "b": 1} and got[1] == {"a": None, 'é"': 'q"uote'} and got[2:] == [{}] * 6
    (kept,) = rows.where("i = 0").select(D.result_summary(F.col("result"), ["b"])).first()
    assert json.loads(kept) == {"a": {"x": [1]}, "preview": {"y": 1}, "data": 3}


def test_inferred_arguments(spark):
    rows = spark.createDataFrame([
        ("apply_cleaning_operation", '{"applied_operation": "trim", "column": "c"}'), ("apply_cleaning_operation", '{"applied_operation": "trim", "column": ""}'),
        ("apply_cleaning_operation", '{"column": "c"}'), ("profile_data", '{"applied_operation": "trim"}'), ("apply_cleaning_operation", "broken"), ("apply_cleaning_operation", None)],
        "tool string, result string")
    got = [r[0] and tuple(r[0]) for r in rows.select(D.inferred_arguments(F.col("tool"), F.col("result"))).collect()]
    assert got == [("trim", "c"), ("trim", None), None, None, None, None]
    calls = [json.loads(r[0]) for r in rows.select(D.action_json(F.col("tool"), D.inferred_arguments(F.col("tool"), F.col("result")))).collect()]
    assert calls[0] == {"tool": "apply_cleaning_operation", "arguments": {"operation": "trim", "column": "c"}}
    assert calls[1]["arguments"] == {"operation": "trim"} and calls[3] == {"tool": "profile_data", "arguments": {}}


def test_step_history_of_a_long_episode(spark):
    """Linear output, whatever the length; empty and null results."""
    steps = spark.range(50_000).select((F.col("id") % 3 == 0).cast("int").alias("e"), "id", F.lit("apply_cleaning_operation").alias("tool"),
                                       F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"applied_operation":"o'), F.col("id"), F.lit('"}'))).alias("result"))
    rows = D.step_history(steps, "e", ["id"], "tool", "result").collect()
    assert len(rows) == 50_000
    for e in (0, 1):
        own = sorted((r for r in rows if r.e == e), key=lambda r: r.id)
        assert [r.step_idx for r in own] == list(range(len(own)))
        assert own[0].previous_completion is None and own[0].previous_observation is None
        assert all(b.previous_completion == a.completion for a, b in zip(own, own[1:]))
        assert all(json.loads(b.previous_observation) == ({"applied_operation": f"o{a.id}"} if a.id % 2 == 0 else {}) for a, b in zip(own, own[1:]))
    assert D.step_history(steps.limit(0), "e", ["id"], "tool", "result").count() == 0
