"""User functions: checked when registered, used by name in enrichments and votes."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators import enrich as E
from tessera.operators import weak
from tessera.operators.registry import FunctionRegistry


def test_each_kind(spark):
    functions = FunctionRegistry(spark, list(E.SOURCES))
    functions.column("twice", "x double", "double", lambda c: c["x"] * 2)
    functions.sql("size", "x double, s string", "string", "concat(s, CASE WHEN x > 1 THEN '+' ELSE '-' END)")
    functions.arrow("longest", "s string, x double", "long", lambda s, x: s.fillna("").str.len() + x.fillna(0).astype("int64"))
    rows = spark.createDataFrame([(1.5, "a"), (None, None), (0.5, "")], "x double, s string")
    got = [tuple(r) for r in E.enrich(rows, ["twice", "size", "longest"], functions=functions).select("twice", "size", "longest").collect()]
    assert got == [(3.0, "a+", 2), (None, None, 0), (1.0, "-", 0)]
    assert E.enrich(rows.limit(0), ["longest"], functions=functions).count() == 0


def test_what_does_not_fit_is_refused(spark):
    functions = FunctionRegistry(spark, list(E.SOURCES))
    with pytest.raises(ValueError):
        functions.sql("salary_band", "x int", "int", "x")
    with pytest.raises(ValueError):
        functions.sql("no name", "x int", "int", "x")
    with pytest.raises(TypeError):
        functions.sql("f", "x int", "string", "x + 1")
    with pytest.raises(AnalysisException):
        functions.sql("f", "x int", "int", "y + 1")
    functions.sql("f", "x int", "int", "x + 1")
    with pytest.raises(ValueError):
        functions.column("f", "x int", "int", lambda c: c["x"])
    with pytest.raises(ValueError):
        E.enrich(spark.range(1), ["f"], functions=functions)
    with pytest.raises(TypeError):
        E.enrich(spark.range(1).select(F.col("id").alias("x")), ["f"], functions=functions)
    with pytest.raises(ValueError):
        E.enrich(spark.range(1), ["unheard_of"], functions=functions)


def test_votes(spark):
    functions = FunctionRegistry(spark)
    functions.sql("lf_short_name", "Assignee string", "int", f"CASE WHEN length(Assignee) < 2 THEN {weak.BAD} ELSE {weak.GOOD} END")
    functions.sql("text", "Assignee string", "string", "Assignee")
    rows = spark.createDataFrame([("x",), ("long",)], "Assignee string")
    assert [r.lf_short_name for r in weak.apply_lfs(rows, "pm", functions, ["lf_short_name"]).collect()] == [weak.BAD, weak.GOOD]
    with pytest.raises(TypeError):
        weak.apply_lfs(rows, "pm", functions, ["text"])
