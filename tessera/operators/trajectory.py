"""Trajectory analytics over step logs: reward extraction, ordered step
indexes and running returns, per-episode metrics, aggregates, curriculum
promotion, SFT example rows and training-curve processing.

Ordered per-group prefixes (step index, running return, series index) use a
range-partitioned prefix sum instead of one window per group: the table is
range-partitioned on (group, order) -- so a group holding a third of all rows
is spread over many tasks -- and checkpointed (the range bounds are sampled,
so the partitioning must be fixed before it is read twice). Each task then
computes local prefixes, a small (partition, group) totals table gives every
task its offset, and a join adds it. No task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.session import ensure_checkpoint_dir, stored


def reward_extract(df: DataFrame) -> Column:
    """reward, else final_reward, else 0."""
    return F.coalesce(F.col("reward"), F.col("final_reward"), F.lit(0.0))


#: Groups' first rows up to which ``ordered_prefix`` sends them to every task.
BROADCAST_STARTS = 100_000


def sent_if_small(groups: DataFrame) -> DataFrame:
    """A checkpointed table of one row for each group, marked for broadcast unless it has very
    many rows: a join by few keys would deal all rows to as few tasks."""
    return F.broadcast(groups) if groups.limit(BROADCAST_STARTS + 1).count() <= BROADCAST_STARTS else groups


def ordered_prefix(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column],
                   partitions: int | None = None) -> DataFrame:
    """Adds ``idx`` (0-based position in group order) and, for each value,
    a running sum up to and including the row (``<name>``).

    ``order`` must make rows unique within a group (e.g. (ts, event_id)).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()], F.lit(1).alias("_one"))
    ranged = base.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    ranged = ranged.withColumns({"_pid": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    if not values:
        ranged = stored(ranged)  # later passes read only the columns that they use
        # rows of a partition are numbered as they were written: a group's first number there and its
        # rows in the partitions before give the index, so the rows are neither dealt nor sorted again
        first = ranged.groupBy("_pid", *group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))
        start = first.select("_pid", *group, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start")).checkpoint(eager=True)
        # a row for each partition and each group, so only many groups make it large
        j = ranged.join(sent_if_small(start), ["_pid", *group])
        return j.select(*df.columns, (F.col("_row") + F.col("_start")).alias("idx"))
    ranged = ranged.checkpoint(eager=True).drop("_row")
    sums = ["_one"] + [f"_v_{k}" for k in values]
    w_local = W.partitionBy("_pid", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(w_local).alias(f"_l{c}") for c in sums])
    totals = ranged.groupBy("_pid", *group).agg(*[F.sum(c).alias(f"_t{c}") for c in sums])
    w_off = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group, *[F.coalesce(F.sum(f"_t{c}").over(w_off), F.lit(0)).alias(f"_o{c}")
                                              for c in sums])
    j = local.join(offsets, ["_pid", *group])
    out = j.withColumn("idx", (F.col("_l_one") + F.col("_o_one") - 1).cast("long"))
    for k in values:
        out = out.withColumn(k, F.col(f"_l_v_{k}") + F.col(f"_o_v_{k}"))
    drop = [c for c in out.columns if c.startswith("_l") or c.startswith("_o") or c.startswith("_v_")]
    return out.drop(*drop, "_one", "_pid")


#: Steps of one block of a discounted sum, and blocks looked ahead.
DISCOUNT_BLOCK, DISCOUNT_AHEAD = 512, 8


def discounted_returns(df: DataFrame, group: list[str], order: list[str], reward: str, gamma: float) -> DataFrame:
    """Adds ``g``, the discounted sum of this and all later rewards of the group.

    Powers are taken within blocks of the group, so they never underflow, and a
    group of any length is spread over tasks. What lies beyond the blocks looked
    ahead weighs less than ``gamma ** (512 * 8)`` (1e-18 for 0.99). Rows must be
    unique by (group, order)."""
    rows = ordered_prefix(df, group, order, {})
    rows = rows.withColumns({"_block": F.expr(f"idx div {DISCOUNT_BLOCK}"), "_off": F.col("idx") % DISCOUNT_BLOCK})
    weighted = F.coalesce(F.col(reward), F.lit(0.0)) * F.pow(F.lit(gamma), F.col("_off"))
    inside = F.sum(weighted).over(W.partitionBy(*group, "_block").orderBy("_off").rowsBetween(0, W.unboundedFollowing))
    blocks = rows.groupBy(*group, "_block").agg(F.sum(weighted).alias("_sum"))
    ahead = W.partitionBy(*group).orderBy("_block")
    later = sum((F.coalesce(F.lead("_sum", m).over(ahead), F.lit(0.0)) * gamma ** (DISCOUNT_BLOCK * (m - 1))
                 for m in range(2, DISCOUNT_AHEAD + 1)), F.coalesce(F.lead("_sum", 1).over(ahead), F.lit(0.0)))
    joined = rows.withColumn("_in", inside).join(blocks.select(*group, "_block", later.alias("_later")), [*group, "_block"])
    g = F.col("_in") / F.pow(F.lit(gamma), F.col("_off")) + F.pow(F.lit(gamma), DISCOUNT_BLOCK - F.col("_off")) * F.col("_later")
    return joined.withColumn("g", g).drop("idx", "_block", "_off", "_in", "_later")


def episode_metrics(steps: DataFrame, episode: str = "episode_id", order: tuple = ("ts", "event_id"),
                    extra: list[Column] | None = None) -> DataFrame:
    """Per episode: total return, steps, invalid actions, and gate pass /
    retention read from the last step's result (a nested report overrides).

    One aggregation with partial aggregation: ``max_by`` picks the last
    result without sorting the episode."""
    key = F.struct(*[F.col(c) for c in order])
    last = F.max_by(F.struct("passed", "retention_ratio", "report_passed", "report_retention"), key)
    agg = steps.groupBy(episode).agg(
        F.sum(F.coalesce(F.col("reward"), F.lit(0.0))).alias("total_return"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("error").isNotNull()).alias("invalid_actions"),
        last.alias("_last"), *(extra or []))
    passed = F.coalesce(F.col("_last.report_passed"), F.col("_last.passed"))
    extra_names = [c for c in agg.columns if c not in (episode, "total_return", "steps", "invalid_actions", "_last")]
    return agg.select(
        episode, *extra_names, F.round("total_return", 6).alias("total_return"), "steps", "invalid_actions",
        passed.alias("quality_gate_passed"),
        F.coalesce(F.col("_last.report_retention"), F.col("_last.retention_ratio")).alias("retention_ratio"),
        F.coalesce(passed, F.lit(False)).alias("success"))


def zero_failed(episodes: DataFrame) -> DataFrame:
    """Episodes with an ``error`` count as failed ones without steps: zero
    return, steps and invalid actions, no gate, no retention."""
    ok = F.col("error").isNull()
    zero = {"total_return": F.lit(0.0), "steps": F.lit(0).cast("long"), "invalid_actions": F.lit(0).cast("long"),
            "success": F.lit(False), "quality_gate_passed": F.lit(False), "retention_ratio": F.lit(None).cast("double")}
    return episodes.withColumns({c: F.when(ok, F.col(c)).otherwise(z) for c, z in zero.items()})


def step_reward(before: Column, after: Column) -> Column:
    """Gain of the quality score less the margin, bounded from below."""
    return F.greatest(F.lit(K.STEP_MAX_NEGATIVE), after - before - K.STEP_IMPROVEMENT_MARGIN)


def final_reward(quality: Column, passed: Column, coverage: Column) -> Column:
    """Table quality, the gates and the share of the required operations."""
    return 0.45 * quality + 0.30 * F.when(passed, 1.0).otherwise(0.0) + 0.25 * coverage


def aggregate_metrics(episodes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """episodes, success rate and mean return / steps / invalid actions;
    zeros for an empty input."""
    aggs = [F.count(F.lit(1)).alias("episodes"),
            F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"),
            F.coalesce(F.avg("total_return"), F.lit(0.0)).alias("avg_return"),
            F.coalesce(F.avg("steps"), F.lit(0.0)).alias("avg_steps"),
            F.coalesce(F.avg("invalid_actions"), F.lit(0.0)).alias("avg_invalid_actions")]
    out = episodes.groupBy(*group).agg(*aggs) if group else episodes.agg(*aggs)
    return out.select(*(group or []), "episodes", *[F.round(c, 6).alias(c) for c in
                                                     ["success_rate", "avg_return", "avg_steps", "avg_invalid_actions"]])


# --------------------------------------------------------------- curriculum
# Difficulty levels (name, rows, max steps, threshold, window).
LEVELS = [("easy", 100, 22, 0.70, 10), ("medium", 500, 18, 0.65, 15), ("hard", 1000, 15, 1.01, 20)]


def promote(episodes, level: int = 0, window: list[bool] | None = None):
    """The promotion rule over one run's (episode_no, success) in order, from a
    level and its window on: rows of episodes, and the state after them."""
    window, rows = list(window or []), []
    for ep, ok in episodes:
        name, _, _, threshold, size = LEVELS[level]
        window = [*window, bool(ok)][-size:]
        rate = sum(window) / len(window)
        promoted = level < len(LEVELS) - 1 and len(window) >= size and rate >= threshold
        if promoted:
            level, window = level + 1, []
        rows.append((int(ep), name, LEVELS[level][0], round(rate, 4), promoted))
    return rows, level, window


def promotion_frame(run_id: int, rows: list[tuple]):
    import pandas as pd
    return pd.DataFrame([(int(run_id), *r) for r in rows], columns=[
        "run_id", "episode_no", "difficulty", "next_difficulty", "window_success_rate", "promoted"])


def promotion_state(pdf):
    """All episodes of ONE run (pandas, in a task).

    A run is a handful of episodes (one per day here), so the group is small
    by construction; runs are processed in parallel by ``applyInPandas``."""
    pdf = pdf.sort_values("episode_no")
    rows, _, _ = promote(zip(pdf["episode_no"], pdf["success"]))
    return promotion_frame(pdf["run_id"].iloc[0], rows)


PROMOTION_SCHEMA = ("run_id long, episode_no long, difficulty string, next_difficulty string, "
                    "window_success_rate double, promoted boolean")


def curriculum_promotion(episodes: DataFrame) -> DataFrame:
    """episodes(run_id, episode_no, success) -> per-episode level and
    promotions, one pandas group per run (clearing the window on promotion
    makes this state, not a rolling aggregate)."""
    return (episodes.select("run_id", "episode_no", "success").groupBy("run_id")
            .applyInPandas(promotion_state, PROMOTION_SCHEMA))


def round_robin_task(episode_no: Column, tasks: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in tasks]), (F.pmod(episode_no, F.lit(len(tasks))) + 1).cast("int"))


# ------------------------------------------------------------------ curves
CORE_METRICS = ["train/epoch", "train/reward", "train/loss", "train/kl", "train/reward_std"]
# The swapped task labels of the exported runs.
RELABEL = {"cleaning": "answering", "enrichment": "enrichment", "answering": "cleaning"}


def curve_reset_trim(series: DataFrame) -> DataFrame:
    """Per task: the last epoch reset (epoch drops by more than 0.5) starts
    the kept run; every series is cut to the shortest length after it and
    re-indexed from 0. ``lag`` is an equi-join on (task, idx - 1)."""
    ensure_checkpoint_dir(series.sparkSession)
    ep = series.where(F.col("metric") == "train/epoch")
    prev = ep.select("task", (F.col("idx") + 1).alias("idx"), F.col("value").alias("prev"))
    resets = (ep.join(prev, ["task", "idx"]).where(F.col("value") < F.col("prev") - 0.5)
              .groupBy("task").agg(F.max("idx").alias("reset_idx")))
    core = series.where(F.col("metric").isin(CORE_METRICS))
    lens = core.groupBy("task", "metric").agg(F.count(F.lit(1)).alias("len"))
    bounds = (lens.join(resets, "task", "left").withColumn("reset_idx", F.coalesce("reset_idx", F.lit(0)))
              .groupBy("task", "reset_idx").agg(F.min(F.col("len") - F.col("reset_idx")).alias("n")))
    j = series.join(sent_if_small(bounds.checkpoint(eager=True)), "task")
    kept = j.where((F.col("idx") >= F.col("reset_idx")) & (F.col("idx") < F.col("reset_idx") + F.col("n")))
    value = F.when(F.col("metric") == "train/epoch", F.round("value", 3)).otherwise(F.col("value"))
    return kept.select("task", "metric", (F.col("idx") - F.col("reset_idx")).alias("step"), value.alias("value"))


def curve_stats(series: DataFrame) -> DataFrame:
    return series.groupBy("task", "metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("mean"),
        F.max_by("value", "idx").alias("final"), F.count(F.lit(1)).alias("n_points"))


def curve_downsample(series: DataFrame, max_points: int = 100) -> DataFrame:
    """Keep index floor(i * n / max_points) for i < max_points when a series
    has more than max_points points (a sampling operator, by design)."""
    ensure_checkpoint_dir(series.sparkSession)
    lens = series.groupBy("task", "metric").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    j = series.join(sent_if_small(lens), ["task", "metric"])
    i = F.ceil(F.col("idx") * max_points / F.col("n"))
    hit = (F.col("n") <= max_points) | ((i < max_points) & (F.floor(i * F.col("n") / max_points) == F.col("idx")))
    return j.where(hit).select("task", "metric", "idx", "value")
