"""Queries that turn recorded steps into training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import demonstrations as D
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.sources import fixtures as X

# The result text of a step, in both engines: what its tool echoes, lists and row
# samples, and one field whose name depends on the row.
_PIECES = [
    """'"zone":' || CAST(event_id % 3 AS STRING)""",
    """'"applied_operation":"' || operation || '"'""",
    """'"column":"' || <col> || '"'""",
    """CASE WHEN operation IS NOT NULL AND <col> IS NULL THEN '"column":""' END""",
    """'"error":"' || error || '"'""",
    """'"passed":' || CAST(passed AS STRING)""",
    """CASE WHEN event_id % 2 = 0 THEN '"sample_rows":[{"id":' || CAST(event_id AS STRING) || '}]' END""",
    """CASE WHEN event_id % 4 = 1 THEN '"preview":{"first":' || CAST(event_id AS STRING) || '}' END""",
    """'"metric_' || CAST(event_id % 5 AS STRING) || '":' || CASE WHEN event_id % 7 = 0 THEN '[1,2]' ELSE '{"n":' || CAST(event_id AS STRING) || '}' END""",
]
_TEXT = "'{' || concat_ws(',', " + ", ".join(_PIECES) + ") || '}'"
_RESULT = f"CASE WHEN event_id % 11 = 0 THEN 'no json' WHEN event_id % 13 = 0 THEN NULL ELSE {_TEXT} END"


def _results(spark, sf):
    """The step log with each step's result as JSON text; some are broken or missing."""
    return X.steps(spark, sf).withColumn("result", F.expr(_RESULT.replace("<col>", "`column`")))


def _sql(body: str) -> str:
    result = _RESULT.replace("AS STRING", "AS VARCHAR").replace("<col>", '"column"')
    return S.with_fixtures(["steps"], body, [("results", f"SELECT *, {result} AS result FROM steps")])


_VALID = "CASE WHEN json_valid(result) THEN result END"
_SUMMARY = ("coalesce('{' || array_to_string(list_transform(list_sort(list_filter(json_keys(r), lambda k: k NOT IN ('preview', 'sample_rows', 'data') "
            "AND json_type(r, '$.' || k) <> 'ARRAY')), lambda k: '\"' || k || '\":' || json_extract(r, '$.' || k)::VARCHAR), ',') || '}', '{}')")
_ARGS = "tool_name = 'apply_cleaning_operation' AND json_extract_string(r, '$.applied_operation') IS NOT NULL"


@register("sft_result_summary", lambda: _sql(f"SELECT event_id, {_SUMMARY} AS summary FROM (SELECT event_id, {_VALID} AS r FROM results)"))
def sft_result_summary(spark, sf):
    """Observation text of every step result, without bulky fields and lists."""
    return _results(spark, sf).select("event_id", D.result_summary(F.col("result")).alias("summary"))


@register("sft_infer_args", lambda: _sql(
    f"SELECT event_id, tool_name, CASE WHEN {_ARGS} THEN json_extract_string(r, '$.applied_operation') END AS operation, "
    f"CASE WHEN {_ARGS} THEN nullif(json_extract_string(r, '$.column'), '') END AS col FROM (SELECT *, {_VALID} AS r FROM results)"))
def sft_infer_args(spark, sf):
    """Arguments of every recorded call, read back from its result."""
    rows = _results(spark, sf).withColumn("args", D.inferred_arguments(F.col("tool_name"), F.col("result")))
    return rows.select("event_id", "tool_name", F.col("args.operation").alias("operation"), F.col("args.column").alias("col"))


@register("sft_step_history", lambda: _sql(
    f"SELECT episode_id, event_id, row_number() OVER w - 1 AS step_idx, completion, lag(completion) OVER w AS previous_completion, "
    f"lag(summary) OVER w AS previous_observation FROM (SELECT *, {_SUMMARY} AS summary, '{{\"tool\":\"' || tool_name || '\",\"arguments\":' || "
    f"CASE WHEN {_ARGS} THEN '{{\"operation\":\"' || json_extract_string(r, '$.applied_operation') || '\"' || "
    "coalesce(',\"column\":\"' || nullif(json_extract_string(r, '$.column'), '') || '\"', '') || '}' ELSE '{}' END || '}' AS completion "
    f"FROM (SELECT *, {_VALID} AS r FROM results)) WINDOW w AS (PARTITION BY episode_id ORDER BY ts, event_id)"))
def sft_step_history(spark, sf):
    """Every step's call with the call and observation of the step before it."""
    found = D.step_history(_results(spark, sf), "episode_id", ["ts", "event_id"], "tool_name", "result")
    return found.drop("ts")
