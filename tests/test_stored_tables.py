"""Tables computed once and read many times, joins by few keys, and text searches."""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.exprs import ws_trim
from tessera.operators import answers as AN
from tessera.operators import clean as C
from tessera.operators import quality as Q
from tessera.operators import trajectory as T
from tessera.plans import q_quality
from tessera.plans.policy import ORDERS_POLICY, compile_policy
from tessera.session import ensure_checkpoint_dir, stored

SF = "/root/testdata/sf0.001"


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_stored_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, None, 2.5)], "k long, t string, v double") \
        .withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    got = stored(df)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert all("/stored-" in f for f in got.inputFiles())
    untyped = stored(df.withColumn("none", F.lit(None)))
    assert untyped.count() == 3


def test_gold_rows_are_read_back(spark):
    df = spark.createDataFrame([(1, " a ", "3"), (1, " a ", "3"), (2, "b", None), (3, "b", "5")], "k long, t string, v string")
    gold = C.gold_table(df, ["v"], ["t"])
    assert all("/stored-" in f for f in gold.inputFiles())
    assert sorted(map(tuple, gold.collect())) == [(1, "a", 3.0), (2, "b", 4.0), (3, "b", 5.0)]


def test_rewards_and_gates_read_stored_tables(spark, capsys, monkeypatch):
    assert "md5" not in _plan(q_quality.rew_final_quality(spark, SF), capsys)
    monkeypatch.setattr(Q, "stability_probe", lambda *a, **k: {"score_mean": 1.0, "score_std": 0.0, "n_folds": 3})
    assert "md5" not in _plan(q_quality.gate_report_full(spark, SF), capsys)


def test_curve_trim_is_not_dealt_by_task_alone(spark, capsys):
    rows = [(t, m, i, float(i % 5) if m == "train/epoch" else 1.0 * i) for t in "ab" for m in T.CORE_METRICS for i in range(12)]
    ensure_checkpoint_dir(spark)
    series = spark.createDataFrame(rows, "task string, metric string, idx long, value double").checkpoint()
    got = T.curve_reset_trim(series)
    plan = _plan(got, capsys)
    assert "BroadcastHashJoin [task" in plan and not re.search(r"SortMergeJoin \[task#\d+\]", plan)
    assert sorted(r["value"] for r in got.where("task = 'a' and metric = 'train/loss'").collect()) == [10.0, 11.0]
    assert T.curve_downsample(series, 3).count() == 2 * len(T.CORE_METRICS) * 3


def test_capitalised_words(spark):
    texts = ["Age, MonthlyIncome Age", "xAge Age9 Age_ _Age é Été Éa ÉAge Ab", "A Ab\nCd Ef \U0001F600Gh", "", None, "aA AaB"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(AN.capitalised_words(F.col("t"))).collect()]
    want = [re.findall(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z]+(?![A-Za-z0-9_])", t) if t is not None else None for t in texts]
    assert got == want
    long = spark.createDataFrame([("Ab" * 200_000 + "9 Cd",)], "t string")  # must not backtrack
    assert long.select(AN.capitalised_words(F.col("t"))).first()[0] == ["Cd"]


def test_datetime_layouts(spark):
    texts = ["2024-01-02", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "01/02/2024", "2024-01-02 03:04", "not a date", "1:2/3", "",
             "2024-01-02/", "2024/01/02", " 2024-01-02", "-2024-01-02", "2024-02-30", None, "01/02/2024 03:04:05", "99999-01-01"]
    c = F.col("t")
    every = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in C.DATETIME_FORMATS]).cast("timestamp_ntz")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for got, want in df.select(C.datetime_expr(c, df.schema["t"].dataType).cast("string"), every.cast("string")).collect():
        assert got == want


def test_sample_values_of_few_rows(spark):
    rows = [(None if i == 3 else f"k{i // 2:03d}", i, None if i < 300 else f"r{i % 7}", None if i % 3 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, a long, rare string, v double")
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns])
    long = df.select(F.col("id").alias("_k"), F.explode(items).alias("x")).select("_k", "x.*").where("value is not null")
    w = W.partitionBy("column_name").orderBy("_k", "value")
    want = {}
    for r in long.withColumn("rn", F.row_number().over(w)).where("rn <= 10").orderBy("column_name", "rn").collect():
        want.setdefault(r["column_name"], []).append(r["value"])
    for head in (1, 7, 60, 1000):
        got = AN.sample_values({"d": (df, "id")}, 10, head)
        assert {r["column_name"]: r["values"] for r in got.collect()} == want


def test_two_digits_and_short_texts(spark):
    texts = ["12", "a12", "12a", "x 12, y", "1 2", "_12", "é12é", "1.5%", "7 %", "3%", "", None, "1_2 34\n", "x" * 49 + " \u0085", "x" * 49 + "\u0085",
             " " * 60 + "x" * 50 + "\n", " " * 60 + "x" * 49 + " \u2028"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for new, old in df.select(t.rlike(AN.TWO_DIGITS_RUN), t.rlike(AN.TWO_DIGITS)).collect():
        assert new == old
    short = (F.length(F.btrim(t, F.lit(AN.MOST_BLANKS))) < 50) & (F.length(ws_trim(t)) < 50)
    for new, old in df.select(short, F.length(ws_trim(t)) < 50).collect():
        assert new == old


def test_policy_reads_the_rows_of_a_stored_table(spark):
    df = spark.createDataFrame([(1, "1-URGENT", "3"), (1, "1-URGENT", "3"), (2, None, "x"), (3, "5-LOW", "900")], "k long, priority string, price string")
    steps = [s for s in ORDERS_POLICY if s[1] in (None, "priority", "price")]
    cleaned = compile_policy(df, steps)
    assert cleaned.inputFiles() and all("/stored-" in f for f in cleaned.inputFiles())
    again = compile_policy(stored(df), steps, is_stored=True)
    assert cleaned.count() == 3 and sorted(map(tuple, cleaned.collect())) == sorted(map(tuple, again.collect()))
    assert not compile_policy(df, [("drop_duplicates", None)]).inputFiles()  # no statistics, nothing to store


def test_ranked_rows_are_read_back_by_column(spark):
    df = spark.createDataFrame([(k % 5, k) for k in range(100)], "g long, k long")
    ranked = T.ordered_prefix(df, ["g"], ["k"], {}, 7)
    assert any("/stored-" in f for f in ranked.inputFiles())
    assert sorted(map(tuple, ranked.collect())) == sorted((k % 5, k, k // 5) for k in range(100))
