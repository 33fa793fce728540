"""The three cleaning-task tables, derived from the driver tables.

Same column names, roles and value ranges as the task specs (mobile
conversion, subscription churn, delivery ETA); values come from the TPC-H
style tables so each task table grows with the data. ``_seq`` carries the
row order used by keep-first operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.fixtures import _pick
from tessera.sources.tables import read_table

# Category values of the task tables.
DEVICE_OS = ["ios", "android", "web"]
COUNTRIES = ["US", "MX", "CA", "BR", "CO"]
PLAN_TYPES = ["monthly", "annual"]
PAYMENT_METHODS = ["credit_card", "paypal", "bank_transfer", "debit"]
CITIES = ["Monterrey", "CDMX", "GDL", "MTY"]
VEHICLES = ["bike", "car", "motorbike"]

TASK_SPECS = {
    "ecommerce_mobile": {
        "key": "session_id", "target": "converted",
        "numeric": ["items_in_cart", "order_value"], "categorical": ["device_os", "country"],
        "skip_missing": ["session_id", "customer_id", "event_date"],
        "expected_types": {"session_id": "bigint", "device_os": "string", "customer_id": "string",
                           "country": "string", "items_in_cart": "double", "order_value": "double",
                           "event_date": "timestamp_ntz", "converted": "bigint"},
    },
    "subscription_churn": {
        "key": "customer_key", "target": "churned",
        "numeric": ["age", "monthly_spend", "tenure_months"], "categorical": ["plan_type", "payment_method"],
        "skip_missing": ["customer_key"],
        "expected_types": {"customer_key": "string", "age": "double", "monthly_spend": "double",
                           "plan_type": "string", "tenure_months": "double", "payment_method": "string",
                           "churned": "bigint"},
    },
    "delivery_eta": {
        "key": "route_id", "target": "delivery_time_minutes",
        "numeric": ["driver_rating", "delivery_distance_km", "late_deliveries_last_30d"],
        "categorical": ["city", "vehicle_type"],
        "skip_missing": ["route_id"],
        "expected_types": {"route_id": "string", "city": "string", "driver_rating": "double",
                           "delivery_distance_km": "double", "late_deliveries_last_30d": "double",
                           "vehicle_type": "string", "delivery_time_minutes": "double"},
    },
}


def task_ecommerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                   "o_orderdate")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("_seq"), k.alias("session_id"),
        _pick(DEVICE_OS, F.pmod(k, F.lit(3))).alias("device_os"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        _pick(COUNTRIES, F.pmod(F.col("o_custkey"), F.lit(5))).alias("country"),
        F.pmod(k * 7, F.lit(10)).cast("double").alias("items_in_cart"),
        (F.col("o_totalprice") / 1000).alias("order_value"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("converted"),
    )


def task_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    k = F.col("c_custkey")
    return c.select(
        k.alias("_seq"), F.concat(F.lit("C"), F.lpad(k.cast("string"), 6, "0")).alias("customer_key"),
        (F.lit(18) + F.pmod(k * 7, F.lit(52))).cast("double").alias("age"),
        (F.abs(F.col("c_acctbal")) + 50).alias("monthly_spend"),
        _pick(PLAN_TYPES, F.pmod(k, F.lit(2))).alias("plan_type"),
        F.pmod(k * 5, F.lit(36)).cast("double").alias("tenure_months"),
        _pick(PAYMENT_METHODS, F.pmod(F.col("c_nationkey"), F.lit(4))).alias("payment_method"),
        F.when(F.pmod(k, F.lit(4)) == 0, 1).otherwise(0).cast("long").alias("churned"),
    )


def task_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                      "l_quantity")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        (ok * 8 + ln).alias("_seq"), F.concat(F.lit("R"), ok, F.lit("-"), ln).alias("route_id"),
        _pick(CITIES, F.pmod(F.col("l_suppkey"), F.lit(4))).alias("city"),
        (F.lit(3) + F.pmod(F.col("l_partkey"), F.lit(21)) / 10.0).alias("driver_rating"),
        (F.lit(5) + F.pmod(ok * 3 + ln, F.lit(36))).cast("double").alias("delivery_distance_km"),
        F.pmod(F.col("l_partkey") + ln, F.lit(5)).cast("double").alias("late_deliveries_last_30d"),
        _pick(VEHICLES, F.pmod(F.col("l_suppkey") * 7, F.lit(3))).alias("vehicle_type"),
        (F.lit(10) + F.col("l_quantity")).alias("delivery_time_minutes"),
    )


TASK_VIEWS = {"ecommerce_mobile": task_ecommerce, "subscription_churn": task_churn, "delivery_eta": task_delivery}


def dirty_task(spark: SparkSession, sf_dir: str, task: str, profile: str = "medium", seed: int = 42) -> DataFrame:
    from tessera.operators.corrupt import apply_noise_profile
    spec = TASK_SPECS[task]
    return apply_noise_profile(TASK_VIEWS[task](spark, sf_dir), spec["key"], spec["numeric"], spec["categorical"],
                               spec["target"], profile, seed, spec["skip_missing"])
