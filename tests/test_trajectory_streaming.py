"""Trajectory analytics: prefix sums vs windows, curriculum vs a plain loop,
and streaming results vs their batch equivalents."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import trajectory as T
from tessera.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_ordered_prefix_matches_window(spark):
    df = X.steps(spark, SF)
    got = T.ordered_prefix(df, ["episode_id"], ["ts", "event_id"], {"rr": F.coalesce("reward", F.lit(0.0))},
                           partitions=5)
    w = W.partitionBy("episode_id").orderBy("ts", "event_id")
    ref = df.select("event_id", (F.row_number().over(w) - 1).alias("idx"),
                    F.sum(F.coalesce("reward", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("rr"))
    a = {r["event_id"]: (r["idx"], round(r["rr"], 9)) for r in got.collect()}
    b = {r["event_id"]: (r["idx"], round(r["rr"], 9)) for r in ref.collect()}
    assert a == b


def _brute_promotion(successes):
    level, window, out = 0, [], []
    for ok in successes:
        name, _, _, thr, size = T.LEVELS[level]
        window.append(ok)
        window = window[-size:]
        rate = sum(window) / len(window)
        promoted = level < len(T.LEVELS) - 1 and len(window) >= size and rate >= thr
        if promoted:
            level, window = level + 1, []
        out.append((name, T.LEVELS[level][0], promoted))
    return out


def test_curriculum_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = [(r, i, rnd.random() < 0.85) for r in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "run_id long, episode_no long, success boolean")
    got = T.curriculum_promotion(df).orderBy("run_id", "episode_no").collect()
    for r in range(4):
        exp = _brute_promotion([ok for rr, _, ok in rows if rr == r])
        mine = [(x["difficulty"], x["next_difficulty"], x["promoted"]) for x in got if x["run_id"] == r]
        assert mine == exp
    assert any(x["promoted"] for x in got)


def test_stream_clean_equals_batch(spark):
    from tessera.plans.q_streaming import stream_clean
    from tessera.plans.policy import ORDERS_POLICY, compile_projection
    batch_proj = compile_projection(X.dirty_orders(spark, SF), [s for s in ORDERS_POLICY if s[0] != "drop_duplicates"])
    batch = batch_proj(X.dirty_orders(spark, SF))
    streamed = stream_clean(spark, SF)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, streamed.select(*batch.columns).collect()))


def test_stream_curriculum_equals_batch(spark):
    from tessera.plans.q_streaming import stream_curriculum
    from tessera.plans.q_trajectory import cur_promotion
    a = sorted(map(tuple, cur_promotion(spark, SF).select("run_id", "episode_no", "difficulty", "promoted").collect()))
    b = sorted(map(tuple, stream_curriculum(spark, SF).select("run_id", "episode_no", "difficulty", "promoted").collect()))
    assert a == b


def _replay(spark, rows, path, order):
    """Files of the log, written one after the other in the given order."""
    for part in order:
        rows.where(f"part = {part}").drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_curriculum_does_not_depend_on_files(spark, tmp_path):
    """Shuffled files, split episodes of a run and one file give equal rows."""
    import random

    from pyspark.sql import functions as F
    from tessera.operators.trajectory import promote
    from tessera.streaming import jobs as J
    rng = random.Random(4)
    runs = {r: [rng.random() < 0.8 for _ in range(30)] for r in range(5)}
    rows = spark.createDataFrame([(r, i, 86400 * (i + 1) + r, ok, (i * 7 + r) % 6) for r, oks in runs.items() for i, ok in enumerate(oks)],
                                 "run_id long, episode_no long, at long, success boolean, part int").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    end = spark.createDataFrame([(-1, None, None, 9)], "run_id long, episode_no long, success boolean, part int").withColumn("ts", F.timestamp_seconds(F.lit(10**8))).select(rows.columns)
    want = sorted((r, *row) for r, oks in runs.items() for row in promote(enumerate(oks))[0])
    for name, order in (("shuffled", [3, 0, 5, 1, 4, 2, 9]), ("one", None)):
        if order is None:
            rows.unionByName(end).drop("part").coalesce(1).write.parquet(f"{tmp_path}/one")
            stream = spark.readStream.schema(rows.drop("part").schema).parquet(f"{tmp_path}/one")
        else:
            stream = _replay(spark, rows.unionByName(end), f"{tmp_path}/{name}", order)
        with J.rocksdb_state(spark):
            got = J.run_to_table(spark, J.curriculum_stream(stream), "c")
        assert sorted(map(tuple, got.collect())) == want, name


def test_state_of_streams_shrinks(spark, tmp_path):
    """Deduplication and sessions forget what the watermark has passed."""
    from pyspark.sql import functions as F
    from tessera.streaming import jobs as J
    rows = spark.range(3000).select((F.col("id") % 7).alias("run_id"), F.timestamp_seconds(F.col("id") * 600 + 86400).alias("ts"), F.lit(1.0).alias("reward"),
                                    F.lit(None).cast("string").alias("error"), (F.col("id") / 300).cast("int").alias("part"))
    late = rows.where("part < 9").withColumn("part", F.col("part") + 1).sample(0.3, 5)  # again, one file later
    for name, build, want in (("dedup", lambda s: J.dedup_stream(s, delay="3 days"), 3000), ("sessions", lambda s: J.session_metrics(s, "2 hours", "3 days"), None)):
        both = rows.unionByName(late) if name == "dedup" else rows
        stream = _replay(spark, both, f"{tmp_path}/{name}", range(10))
        q = (build(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-c").option("path", f"{tmp_path}/{name}-out")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert len(sizes) >= 10 and max(sizes) < 1500, (name, sizes)
        if want:
            assert spark.read.parquet(f"{tmp_path}/{name}-out").count() == want


def test_end_of_input_closes_sessions(spark):
    from pyspark.sql import functions as F
    from tessera.streaming import jobs as J
    rows = spark.range(100).select((F.col("id") % 3).alias("run_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1.0).alias("reward"), F.lit(None).cast("string").alias("error"))
    for some in (rows, rows.limit(0)):
        path = J.closed_log(spark, some, "t")
        got = J.run_to_table(spark, J.session_metrics(spark.readStream.schema(rows.schema).parquet(path)), "t").collect()
        assert sum(r.steps for r in got) == some.count() and all(r.run_id is not None for r in got)


def test_discounted_returns_of_a_long_episode(spark):
    from pyspark.sql import functions as F
    from tessera.operators.trajectory import discounted_returns
    steps = spark.range(100_000).select(F.lit(1).alias("e"), "id", (F.col("id") % 7).cast("double").alias("r"))
    got = {r.id: r.g for r in discounted_returns(steps, ["e"], ["id"], "r", 0.99).collect()}
    g = 0.0
    for i in range(99_999, -1, -1):
        g = i % 7 + 0.99 * g
        assert abs(got[i] - g) < 1e-8


def test_streams_do_not_depend_on_files(spark, tmp_path):
    from pyspark.sql import functions as F
    from tessera.streaming import jobs as J
    events = J.event_time(spark.read.parquet(f"{SF}/events.parquet")).orderBy("ts")
    rows = events.union(events.where("event_id % 10 = 0")).repartitionByRange(30, "ts").sortWithinPartitions("ts")
    rows.write.parquet(f"{tmp_path}/many")
    rows.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/one")
    results = []
    for name in ("many", "one"):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 6).parquet(f"{tmp_path}/{name}")
        dedup = J.run_to_table(spark, J.dedup_stream(stream), "t")
        complete = J.run_updates(spark, J.dq_windows(stream, "1 day", watermark="60 days"), "t", ["window_start", "window_end"])
        results.append((sorted(map(str, dedup.collect())), sorted(map(str, complete.drop("uniqueness").collect()))))
        assert dedup.count() == events.count()
        assert complete.agg(F.sum("n")).first()[0] == rows.count()
    assert results[0] == results[1]


def test_untouched_numbers_read_back(spark):
    from pyspark.sql import functions as F
    from tessera.operators.corrupt import noise_string_in_numeric
    rows = spark.range(5000).select("id", (F.rand(3) * F.pow(F.lit(10.0), F.col("id") % 40 - 15)).alias("x"))
    out = noise_string_in_numeric(rows.select("id", "x", F.col("x").alias("y")), "id", ["x"], 0.1)
    assert out.where("try_cast(x as double) is not null and try_cast(x as double) <> y").count() == 0
    assert 300 < out.where("try_cast(x as double) is null").count() < 700


class _State:
    """Keyed state of one group in memory that counts the rows read from it; also the group's timers."""

    def __init__(self):
        self.rows, self.read, self.timers = {}, 0, set()

    def getListState(self, name, *schema):
        return _Held(self, name)

    getMapState = getValueState = getListState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Held:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def exists(self):
        return bool(self.state.rows.get(self.name))

    def get(self):
        held = self.state.rows.get(self.name, [])
        if isinstance(held, list):
            self.state.read += len(held)
            return iter(list(held))
        return held

    def appendList(self, rows):
        self.state.rows.setdefault(self.name, []).extend(rows)

    def put(self, rows):
        self.state.rows[self.name] = rows

    update = put

    def updateValue(self, key, row):
        self.state.rows.setdefault(self.name, {})[key] = row

    def iterator(self):
        held = self.state.rows.get(self.name, {})
        self.state.read += len(held)
        return iter(list(held.items()))

    def removeKey(self, key):
        del self.state.rows[self.name][key]

    def clear(self):
        self.state.rows.pop(self.name, None)


def test_buffered_episodes_are_read_once_for_each_batch():
    import random
    from types import SimpleNamespace

    import pandas as pd
    from tessera.operators.trajectory import promote, promotion_frame
    from tessera.streaming import jobs as J
    rng = random.Random(6)
    oks = [rng.random() < 0.8 for _ in range(300)]
    log = pd.DataFrame({"run_id": 7, "episode_no": range(300), "ts": pd.to_datetime([86400 * (i + 1) for i in range(300)], unit="s"), "success": oks})
    processor, state, out = J.Promotions(), _State(), []
    processor.init(state)
    for part, until in ((log[150:].sample(frac=1, random_state=1), 0), (log[:150], 200 * 86_400_000), (log[:0], 10**12)):
        processor.handleInputRows((7,), iter([part]), None)
        watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda until=until: until)
        for ms in sorted(t for t in state.timers if t <= until):
            state.timers.discard(ms)
            out += processor.handleExpiredTimer((7,), watermark, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))
    assert pd.concat(out).reset_index(drop=True).equals(promotion_frame(7, promote(enumerate(oks))[0]))
    assert state.read <= 2 * len(oks) and not state.timers
