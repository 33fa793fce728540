"""Structured Streaming versions of the cleaning, DQ and episode jobs.

Sources are file streams over the Parquet tables (``pathGlobFilter`` picks
one table in a folder); sinks are Parquet folders under the session's
checkpoint directory (the shared folder named by ``spark.checkpoint.dir``),
with the streaming checkpoint beside them, so a restarted query resumes
exactly where it stopped. ``availableNow`` drains what is there and stops.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tessera.functions.exprs import is_numeric_like
from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import read_table


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    schema = read_table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to completion (availableNow) into a Parquet folder in the
    shared checkpoint directory and return the folder as a batch table."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint")
         .option("path", f"{base}/data").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_updates(spark: SparkSession, stream: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run an aggregating stream to completion and return its last row per key.

    Append mode would hold back every window that the watermark has not closed
    when the input ends. Here each micro-batch appends the rows that it changed
    (``update``) or all of them (``complete``), with its number, and the batch
    table keeps the newest row per key; a batch that is run again after a
    failure writes equal rows under its number."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{path}/data")

    q = (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/data")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("_batch").alias("_batch")), "_batch", "left_semi")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("r"))
    return newest.select(*keys, "r.*").select(*stream.columns)


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not NTZ); the session time zone is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def clean_stream(dirty_stream: DataFrame, projection) -> DataFrame:
    """Stateless: the batch-compiled cleaning projection applied per row."""
    return projection(dirty_stream)


def dq_windows(events: DataFrame, window: str = "1 day", slide: str | None = None,
               watermark: str = "1 hour") -> DataFrame:
    """Completeness / consistency / approximate uniqueness per event-time
    window; rows later than the watermark are dropped. Run it with
    ``run_updates``: append mode never emits the windows open at the end."""
    cols = ["user_id", "event_type", "value", "props"]
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    agg = (events.withWatermark("ts", watermark).groupBy(w.alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), nulls.alias("nulls"),
                F.avg(F.when(is_numeric_like(F.col("value")), 1.0).otherwise(0.0)).alias("consistency"),
                F.approx_count_distinct(F.struct(*cols)).alias("approx_distinct")))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                      F.round(1 - F.col("nulls") / (F.col("n") * len(cols)), 4).alias("completeness"),
                      F.round("consistency", 4).alias("consistency"),
                      F.round(F.least(F.lit(1.0), F.col("approx_distinct") / F.col("n")), 4).alias("uniqueness"))


def dedup_stream(events: DataFrame, keys: list[str] | None = None, delay: str = "7 days") -> DataFrame:
    """One row of each key (default: the whole row, with its event time ``ts``).

    Rows may come in any order that is late by ``delay`` at most. A key's state is
    forgotten once the watermark has passed its event time by that delay, so the state
    holds the keys of the last ``delay`` only; rows later than that are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys or events.columns)


def closed_log(spark: SparkSession, rows: DataFrame, name: str, time_col: str = "ts", after: str = "INTERVAL 400 DAYS",
               marks: dict[str, int] | None = None) -> str:
    """Writes a log for replay to the shared folder and, as its last file, an
    end-of-input row: nulls but for ``marks`` and an event time ``after`` the last one.
    The row moves the watermark past every window or session that is still open, so
    that append mode gives them out; its own window stays open. An empty log has no such row. Returns the folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/log-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    end = rows.agg(F.max(time_col).alias("_last")).where("_last IS NOT NULL")
    nulls = [F.lit((marks or {}).get(f.name)).cast(f.dataType).alias(f.name) if f.name != time_col
             else F.expr(f"_last + {after}").cast(f.dataType).alias(time_col) for f in rows.schema.fields]
    end.select(*nulls).coalesce(1).write.mode("append").parquet(path)
    return path


def session_metrics(steps: DataFrame, gap: str = "30 minutes", delay: str = "60 days") -> DataFrame:
    """Episode totals closed by inactivity, in append mode: a session is given out
    once, when the watermark (``delay`` behind the newest step) has passed its end,
    and its state is dropped. ``delay`` bounds how late a step may come. Sessions open
    at the end of a finite log need its end-of-input row (``closed_log``), whose own
    session never closes. (A filter on the run would be pushed below the watermark,
    which then would not see that row.)"""
    s = (steps.withWatermark("ts", delay).groupBy("run_id", F.session_window("ts", gap).alias("s"))
         .agg(F.count(F.lit(1)).alias("steps"), F.sum(F.coalesce("reward", F.lit(0.0))).alias("total_return"),
              F.count_if(F.col("error").isNotNull()).alias("invalid_actions")))
    return s.select(
        "run_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
        "steps", F.round("total_return", 6).alias("total_return"), "invalid_actions")


# ------------------------------------------------------------- curriculum
class Promotions(StatefulProcessor):
    """Per run: episodes wait in a buffer until the watermark has passed their event
    time, and are then promoted in that order (by number where times are equal). What
    comes late by less than the watermark's delay, or split over batches, thus changes
    nothing. One timer for each run, at its earliest waiting episode, gives out all
    that the watermark has passed, so the buffer is read once for each batch and not
    for each episode. State: the buffer (episodes of the last ``delay``), the timer,
    the level and its window."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "episode_no long, run_id long, ms long, success boolean")
        self.timer = handle.getValueState("timer", "ms long")
        self.level = handle.getValueState("level", "level int, window string")

    def handleInputRows(self, key, rows, timerValues):
        came = []
        for pdf in rows:
            pdf = pdf[pdf["episode_no"].notna()]  # the end-of-input row only moves the watermark
            for run_id, number, ts, success in zip(pdf["run_id"], pdf["episode_no"], pdf["ts"], pdf["success"]):
                came.append((int(number), int(run_id), int(pd.Timestamp(ts).value // 1_000_000), bool(success)))
        if came:
            self.waiting.appendList(came)
            first, at = min(ms for _, _, ms, _ in came), self.timer.get() if self.timer.exists() else None
            if at is None or first < at[0]:
                if at is not None:
                    self.handle.deleteTimer(at[0])
                self._wake(first)
        return iter([])

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from tessera.operators.trajectory import promote, promotion_frame
        now, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        held = {row[0]: tuple(row) for row in self.waiting.get()}  # of a number that came twice, the last
        due = sorted((ms, number, ok, run_id) for number, run_id, ms, ok in held.values() if ms <= now or ms < watermark)
        for _, number, _, _ in due:
            del held[number]
        if held:
            self.waiting.put(list(held.values()))
            self._wake(min(ms for _, _, ms, _ in held.values()))
        else:
            self.waiting.clear()
            self.timer.clear()
        if not due:
            return iter([])
        level, window = self.level.get() if self.level.exists() else (0, "")
        rows, level, window = promote([(number, ok) for _, number, ok, _ in due], int(level), [c == "1" for c in window])
        self.level.update((level, "".join("1" if ok else "0" for ok in window)))
        return iter([promotion_frame(due[0][3], rows)])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def curriculum_stream(episodes: DataFrame, delay: str = "60 days") -> DataFrame:
    """Promotion state per run over (run_id, episode_no, ts, success), with
    ``transformWithStateInPandas``. Episodes may come in any order that is late by
    ``delay`` at most; within a run, event times rise with the episode's number. Event
    times lie after 1970; rows without a run are left out. The last episodes need the
    log's end-of-input row, with a run of its own (a group of the null key confuses the
    timers of its partition) and no episode number. Run it with the RocksDB state
    store (``rocksdb_state``)."""
    from tessera.operators.trajectory import PROMOTION_SCHEMA
    return episodes.where("run_id IS NOT NULL").withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Promotions(), outputStructType=PROMOTION_SCHEMA, outputMode="append", timeMode="EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The session's state store is RocksDB inside, and what it was before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
