"""Streaming queries: each runs a Structured Streaming job over the Parquet
tables (availableNow) and returns its sink as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.trajectory import ordered_prefix
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.policy import ORDERS_POLICY, compile_projection
from tessera.plans.q_clean import _policy_ctes
from tessera.plans.q_trajectory import promotion_sql
from tessera.sources import fixtures as X
from tessera.sources.tables import read_table
from tessera.streaming import jobs as J


@register("stream_clean", lambda: S.with_fixtures(["dirty_orders"], "SELECT * FROM s2", _policy_ctes()[:4]))
def stream_clean(spark, sf):
    """Cleaning projection compiled on the batch table (statistics frozen)
    and applied to the order stream; dedup is left to the batch job."""
    steps = [s for s in ORDERS_POLICY if s[0] != "drop_duplicates"]
    projection = compile_projection(X.dirty_orders(spark, sf), steps)
    dirty = X.dirty_orders_from(J.stream_table(spark, sf, "orders"))
    return J.run_to_table(spark, J.clean_stream(dirty, projection), "clean")


def _dq_sql(starts: str, days: int = 1) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("user_id", "event_type", "value", "props"))
    return (f"SELECT w AS window_start, w + INTERVAL {days} DAY AS window_end, count(*) AS n, "
            f"round((1 - ({nulls}) / (count(*) * 4.0))::DECIMAL(38, 12), 4)::DOUBLE AS completeness, "
            "round((count(*) FILTER (WHERE value IS NOT NULL AND NOT isnan(value)) / count(*)::DOUBLE)::DECIMAL(38, 12), 4)::DOUBLE AS consistency "
            f"FROM (SELECT *, unnest({starts}) AS w FROM events) GROUP BY w")


def _plain_time(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _dq(spark, sf, name, *window):
    ev = J.event_time(J.stream_table(spark, sf, "events"))
    windows = J.run_updates(spark, J.dq_windows(ev, *window), name, ["window_start", "window_end"])
    return _plain_time(windows.drop("uniqueness"), "window_start", "window_end")  # the approximate column has no exact oracle


@register("stream_dq_window", lambda: _dq_sql("[date_trunc('day', ts)]"))
def stream_dq_window(spark, sf):
    """DQ per 1-day tumbling window of the event stream (watermark 1 hour)."""
    return _dq(spark, sf, "dq_window", "1 day")


@register("stream_dq_sliding", lambda: _dq_sql("[time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]"))
def stream_dq_sliding(spark, sf):
    """DQ per 1-day window sliding every 12 hours."""
    return _dq(spark, sf, "dq_sliding", "1 day", "12 hours")


@register("stream_dedup", "SELECT DISTINCT * FROM events")
def stream_dedup(spark, sf):
    """Whole-row duplicates dropped from an event stream in which every tenth
    event is delivered twice."""
    ev = J.event_time(J.stream_table(spark, sf, "events"))
    again = F.when(F.col("event_id") % 10 == 0, 2).otherwise(1)
    twice = ev.withColumn("_n", F.explode(F.sequence(F.lit(1), again))).drop("_n")
    return _plain_time(J.run_to_table(spark, J.dedup_stream(twice), "dedup"), "ts")


@register("stream_episode_metrics", lambda: S.with_fixtures(["steps"], (
    "SELECT run_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS steps, "
    "round(sum(coalesce(reward, 0.0))::DECIMAL(38, 12), 6)::DOUBLE AS total_return, count(*) FILTER (WHERE error IS NOT NULL) AS invalid_actions "
    "FROM (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS s FROM (SELECT *, "
    "CASE WHEN ts > lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM steps)) "
    "GROUP BY run_id, s")))
def stream_episode_metrics(spark, sf):
    """Episode totals per run, closed by 30 minutes of inactivity, each given out
    once (append mode); the replayed log ends with an end-of-input row."""
    log = J.closed_log(spark, read_table(spark, sf, "events"), "steps")
    events = spark.readStream.schema(read_table(spark, sf, "events").schema).parquet(log)
    found = J.run_to_table(spark, J.session_metrics(J.event_time(X.steps_from(events))), "sessions")
    return _plain_time(found, "session_start", "session_end")


def episode_log(spark, sf):
    """(run_id, episode_no, ts, success): a run's daily episodes, numbered in order."""
    from tessera.plans.q_trajectory import _episodes
    numbered = ordered_prefix(_episodes(spark, sf).select("run_id", "day", "success"), ["run_id"], ["day"], {})
    return numbered.select("run_id", F.col("idx").alias("episode_no"), F.timestamp_seconds((F.col("day") + 1) * 86400).alias("ts"), "success")


@register("stream_curriculum", lambda: promotion_sql("run_id, episode_no, difficulty, next_difficulty, window_success_rate, promoted"))
def stream_curriculum(spark, sf):
    """Promotion state per run over the replayed episode log, whatever the order in
    which its files come."""
    log = episode_log(spark, sf)
    path = J.closed_log(spark, log, "episodes", marks={"run_id": -1})
    stream = spark.readStream.schema(log.schema).parquet(path)
    with J.rocksdb_state(spark):
        return J.run_to_table(spark, J.curriculum_stream(stream), "curriculum")
