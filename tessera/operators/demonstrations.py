"""Training examples from recorded episodes: step results of unknown shape, the
arguments of recorded calls, and each step's history.

Results are JSON objects whose keys aren't known in advance. They are parsed to
VARIANT values, so keys are read or dropped without a schema and without a
Python function: one projection, no shuffle.

The history of a step is not copied into the step (an episode of n steps would
take n * n of them). ``step_history`` gives a row per step that points to the
step before it; whoever needs a prompt follows the pointers, or takes the rows
of an episode up to an index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.trajectory import ordered_prefix

# Result fields that never go into an observation, and the tool with arguments.
BULKY_FIELDS = ["preview", "sample_rows", "data"]
CLEANING_TOOL = "apply_cleaning_operation"


def result_fields(result: Column) -> Column:
    """A JSON object's fields as ``map<string, variant>``, in order of their names;
    null for null, broken JSON or a value that is no object."""
    return F.try_variant_get(F.try_parse_json(result), "$", "map<string,variant>")


def result_summary(result: Column, drop: list[str] | None = None) -> Column:
    """A result's observation text: the JSON object without the fields in ``drop``
    and without lists; ``{}`` if there is no object. Fields come in order of name."""
    kept = F.map_filter(result_fields(result), lambda k, v: ~k.isin(drop if drop is not None else BULKY_FIELDS)
                        & ~F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("ARRAY"))
    return F.coalesce(F.to_json(kept), F.lit("{}"))


def inferred_arguments(tool: Column, result: Column) -> Column:
    """The arguments of a recorded call, ``struct<operation, column>``: read from the
    operation that a cleaning result echoes; null where nothing is echoed. An empty
    column is null."""
    v = F.try_parse_json(result)
    operation = F.try_variant_get(v, "$.applied_operation", "string")
    column = F.try_variant_get(v, "$.column", "string")
    return F.when((tool == CLEANING_TOOL) & operation.isNotNull(),
                  F.struct(operation.alias("operation"), F.when(column != "", column).alias("column")))


def action_json(tool: Column, arguments: Column) -> Column:
    """The call as the JSON text that a model should give; null arguments are ``{}``."""
    return F.concat(F.lit('{"tool":'), F.coalesce(F.to_json(F.array(tool)).substr(F.lit(2), F.length(F.to_json(F.array(tool))) - 2), F.lit("null")),
                    F.lit(',"arguments":'), F.coalesce(F.to_json(arguments), F.lit("{}")), F.lit("}"))


def step_history(steps: DataFrame, episode: str, order: list[str], tool: str, result: str) -> DataFrame:
    """A row per step: ``step_idx`` within its episode, ``completion`` (the call to
    learn), ``previous_completion`` and ``previous_observation`` of the step before
    (null for the first), whose index is one less. ``order`` must be unique within an
    episode.

    The step before is found by an equijoin on (episode, index), so an episode of any
    length is spread over tasks, and the output grows with the steps alone."""
    arguments = inferred_arguments(F.col(tool), F.col(result))
    rows = ordered_prefix(steps.select(episode, *order, tool, result), [episode], order, {})
    rows = rows.select(episode, *order, F.col("idx").alias("step_idx"), action_json(F.col(tool), arguments).alias("completion"),
                       result_summary(F.col(result)).alias("_observation"))
    before = rows.select(F.col(episode).alias("_episode"), (F.col("step_idx") + 1).alias("_next"),
                         F.col("completion").alias("previous_completion"), F.col("_observation").alias("previous_observation"))
    return rows.drop("_observation").join(before, (F.col(episode) == F.col("_episode")) & (F.col("step_idx") == F.col("_next")), "left").drop("_episode", "_next")
