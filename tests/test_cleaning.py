"""Cleaning operators: semantics, invariants and the policy compiler."""

from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.plans.policy import ORDERS_POLICY, compile_policy
from tessera.sources import fixtures as X

SF = "/root/testdata/sf0.001"

DEBUG_ROWS = [
    (1, "ios", "US", "3", "10.5", "2026-01-02", 1),
    (2, " Android ", "unknown", "?", "20.0", "2026-01-03", 0),
    (3, "WEB", "MX", "2", "n/a", "bad date", 1),
    (3, "WEB", "MX", "2", "n/a", "bad date", 1),
    (4, None, "N/A", "9", "5000", "2026-01-05", 0),
    (5, "ios", None, "1", "12.25", "2026-01-06", 1),
]
SCHEMA = ("session_id long, device_os string, country string, items_in_cart string, order_value string, "
          "event_date string, converted long")


def test_tool_operators_on_debug_table(spark):
    df = spark.createDataFrame(DEBUG_ROWS, SCHEMA)
    assert C.drop_duplicates(df).count() == 5
    r = C.replace_invalid_with_null(df, "country").select("country").collect()
    assert [x[0] for x in r] == ["US", None, "MX", "MX", None, None]
    v = C.cast_numeric(df, "order_value").select("order_value").collect()
    assert [x[0] for x in v] == [10.5, 20.0, None, None, 5000.0, 12.25]
    med = C.impute_numeric(C.cast_numeric(df, "order_value"), "order_value").collect()
    assert med[2]["order_value"] == 16.125  # median of 10.5, 12.25, 20, 5000
    norm = C.normalize_categories(df, "device_os").select("device_os").collect()
    assert [x[0] for x in norm] == ["ios", "android", "web", "web", None, "ios"]
    mode = C.impute_categorical(df, "device_os").select("device_os").collect()
    assert mode[4][0] == "WEB"  # WEB appears twice
    dt = C.cast_datetime(df, "event_date").select("event_date").collect()
    assert dt[2][0] is None and dt[0][0].year == 2026


def test_clip_outliers_iqr(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "v double")
    out = [r[0] for r in C.clip_outliers_iqr(df, "v").collect()]
    # q1=2, q3=4, iqr=2 -> bounds [-1, 7]
    assert out == [1.0, 2.0, 3.0, 4.0, 7.0]


def test_unknown_column_raises(spark):
    df = spark.createDataFrame(DEBUG_ROWS, SCHEMA)
    try:
        C.apply_tool_operation(df, "cast_numeric", "nope")
    except ValueError as e:
        assert "Unknown column" in str(e)
    else:
        raise AssertionError("expected ValueError")
    # the domain family ignores unknown columns
    assert C.apply_domain_operation(df, "trim", "nope").columns == df.columns


def test_policy_is_idempotent_and_partition_invariant(spark):
    raw = X.dirty_orders(spark, SF)
    once = compile_policy(raw, ORDERS_POLICY)
    twice = compile_policy(once, ORDERS_POLICY)
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    b = sorted(map(tuple, compile_policy(raw.repartition(5), ORDERS_POLICY).collect()))
    assert a == b
    assert once.where(F.col("price").isNull() | F.col("priority").isNull()).count() == 0


def test_remove_duplicate_subset_keeps_first(spark):
    df = spark.createDataFrame([(1, "a", "x", 0), (1, "a", "y", 1), (2, "b", "z", 0)], "k long, g string, v string, _seq long")
    out = sorted(map(tuple, C.remove_duplicate_subset(df, ["k", "g"]).collect()))
    assert out == [(1, "a", "x", 0), (2, "b", "z", 0)]


def test_correct_rarest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",)], "v string")
    out = [r[0] for r in C.correct_typo(df, "v", "z").collect()]
    assert out == ["a", "a", "z", "c", "c"]
