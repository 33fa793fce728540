"""Raw source tables in the shapes the domain mappings expect (a CRM
pipeline export, an incident log, a construction task list, a snake_case HR
export), derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.sources.fixtures import _pick, dom_hr
from tessera.sources.tables import read_table

INCIDENT_STATES = ["New", "Active", "Resolved", "Closed", "Awaiting"]
INCIDENT_PRIORITIES = ["1 - Critical", "2 - High", "3 - Moderate", "4 - Low", "5 - Planning"]
IMPACTS = ["1 - High", "2 - Medium", "3 - Low"]
RISK_LEVELS = ["High", "Medium", "Low", "Unknown"]
# snake_case / upper-case export names of the HR columns (two are missing)
HR_EXPORT = {"EmployeeID": "employee_id", "Age": "age", "Department": "department", "JobRole": "job_role",
             "MonthlyIncome": "monthly_income", "YearsAtCompany": "years_at_company", "Attrition": "attrition",
             "JobSatisfaction": "JOB_SATISFACTION", "OverTime": "over_time", "DistanceFromHome": "distance_from_home",
             "EmployeeCount": "employee_count"}


def crm_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    cats = K.DOMAIN_CATEGORIES["sales"]
    close = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), F.pmod(F.col("o_custkey"), F.lit(90)).cast("int")),
                          "yyyy-MM-dd")
    return j.select(
        F.concat(F.lit("OPP-"), k).alias("opportunity_id"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("account"),
        _pick(cats["Stage"], F.pmod(k, F.lit(6))).alias("deal_stage"), F.col("o_totalprice").alias("close_value"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("engage_date"),
        F.when(F.pmod(k, F.lit(9)) == 0, F.lit(None).cast("string")).otherwise(close).alias("close_date"),
        F.concat(F.lit("Agent "), F.pmod(F.col("o_custkey"), F.lit(20))).alias("sales_agent"),
        _pick(cats["Product"], F.pmod(k * 7, F.lit(5))).alias("product"))


def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e, u = F.col("event_id"), F.col("user_id")
    cats = K.DOMAIN_CATEGORIES["it_ops"]
    return ev.select(
        F.concat(F.lit("INC"), F.lpad(e.cast("string"), 7, "0")).alias("number"),
        _pick(INCIDENT_STATES, F.pmod(e, F.lit(5))).alias("incident_state"),
        _pick(cats["Category"], F.pmod(u, F.lit(5))).alias("category"),
        _pick(INCIDENT_PRIORITIES, F.pmod(e, F.lit(5))).alias("priority"),
        F.concat(F.lit("Agent "), F.pmod(u, F.lit(12))).alias("assigned_to"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("opened_at"),
        F.when(F.pmod(e, F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("resolved_at"),
        F.col("event_type").alias("cmdb_ci"), _pick(cats["ResolutionType"], F.pmod(e, F.lit(5))).alias("close_code"),
        _pick(IMPACTS, F.pmod(u + e, F.lit(3))).alias("impact"),
        F.when(F.pmod(e, F.lit(13)) == 0, F.lit("n/a")).otherwise(F.floor(F.col("value") / 40).cast("string"))
        .alias("reassignment_count"))


def construction_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return li.select(
        F.concat(F.lit("TASK-"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("Task_ID"),
        (F.col("l_quantity") / 4.0).alias("Task_Duration_Days"),
        _pick(RISK_LEVELS, F.pmod(F.col("l_partkey"), F.lit(4))).alias("Risk_Level"),
        (F.col("l_linenumber") - 1).alias("Dependency_Count"))


def hr_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_hr(spark, sf_dir).select(*[F.col(a).alias(b) for a, b in HR_EXPORT.items()])
