"""Draws compared as hex text equal the numbers; heavy projections stay short enough to be compiled."""
import contextlib
import io
import re

from pyspark.sql import functions as F

from tessera.functions.exprs import hash52, hash_below, hash_hex, hash_uniform, hex_at_most
from tessera.operators import corrupt as CR
from tessera.operators import stats
from tessera.operators.trajectory import ordered_prefix


def test_hex_draws_equal_numbers(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("id"))
    for p in (0.0, 0.05, 0.5, 1.0):
        assert not df.where((hash_uniform(F.col("id"), 42, "c") < p) != hash_below(p, F.col("id"), 42, "c")).count()
    h = hash52(F.col("id"), 42, "c")
    most = sorted(r[0] for r in df.select(h).collect())[100]
    for m in (most, most - 1, most + 0.5, 2.0 ** 52):
        assert not df.where((h <= m) != hex_at_most(hash_hex(F.col("id"), 42, "c"), m)).count()


def test_kth_of_hex_draws(spark):
    df = spark.range(5000)
    numbers = {t: hash52(F.col("id"), 1, t) for t in "ab"}
    texts = {t: hash_hex(F.col("id"), 1, t) for t in "ab"}
    ranks = {"a": 0, "b": 2500}
    want = stats.kth_smallest(df, numbers, ranks, 5000)
    assert stats.kth_of_uniform(df, texts, ranks, 5000) == want
    assert stats.kth_of_uniform(df, texts, ranks, 5000, max_local=10) == want


def test_corruption_is_compiled(spark):
    """The JVM never compiles a method of more than 8,000 bytes; it ran interpreted before."""
    df = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1.5).alias("a"), F.lit(2.5).alias("b"),
                                 *[F.lit("word").alias(c) for c in "uvwxyz"])
    out = CR.corrupt_domain(df, "key", ["a", "b"], list("uvwxyz"))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000


def test_index_without_a_second_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"))
    out = ordered_prefix(df, ["g"], ["o"], {}, partitions=5)
    assert sorted((r["g"], r["o"], r["idx"]) for r in out.collect()) == sorted((o % 3, o, o // 3) for o in range(1000))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain()
    assert "Window" not in text.getvalue()
