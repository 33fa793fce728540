"""Fixture views: business-shaped tables derived from the driver tables.

Every view is a pure projection/join of the Parquet inputs, so its size grows
with the data and Catalyst prunes columns into the scans. Noise is drawn from
``hash_uniform`` of the row key, never from a random stream, so a view is the
same on every run, every partitioning and every task retry. The DuckDB twins
live in ``tessera.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.exprs import bound, hash_below, hash_pick, hash_uniform
from tessera.sources.tables import read_table

SEQ_STRIDE = 1 << 40  # copy number * 2^40 + key keeps appended copies after originals


def _pick(options: list, idx: Column) -> Column:
    """``options[idx]`` for a 0-based integer expression."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx + 1).cast("int"))


def _text2(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _copies(key: Column, p: float, tag: str) -> Column:
    """0 for the original row, plus 1 when the row is chosen to be duplicated."""
    return F.explode(F.sequence(F.lit(0), F.when(hash_below(p, key, tag), 1).otherwise(0)))


# ---------------------------------------------------------------- dirty_orders
def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a messy operational table: nulls, invalid tokens and drifted
    case/padding in ``priority``, junk and outliers in the text ``price``, bad
    dates, and 3% appended duplicate rows (some of which drift apart)."""
    return dirty_orders_from(read_table(spark, sf_dir, "orders"))


def dirty_orders_from(orders: DataFrame) -> DataFrame:
    """The dirty_orders projection of an orders DataFrame (batch or stream)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    rows = o.select("*", _copies(F.col("o_orderkey"), 0.03, "dup").alias("_copy"))
    k, cp = F.col("o_orderkey"), F.col("_copy")
    pri = F.lower(F.substring(F.col("o_orderpriority"), 3, 100))
    drifted = bound(hash_uniform(k, cp, "priority_kind"), lambda kind: (
        F.when(kind < 0.25, F.concat(F.lit("  "), pri, F.lit("  ")))
        .when(kind < 0.5, F.upper(pri))
        .when(kind < 0.75, F.lower(pri))
        .otherwise(F.concat(pri, F.lit(" ")))))
    priority = (F.when(hash_below(0.05, k, "priority_missing"), F.lit(None).cast("string"))
                .when(hash_below(0.04, k, "priority_invalid"),
                      hash_pick(hash_uniform(k, "priority_token"), K.INVALID_TOKENS))
                .when(hash_below(0.06, k, cp, "priority_drift"), drifted)
                .otherwise(pri))
    price = (F.when(hash_below(0.05, k, "price_missing"), F.lit(None).cast("string"))
             .when(hash_below(0.02, k, cp, "price_outlier"), _text2(F.col("o_totalprice") * 20))
             .when(hash_below(0.03, k, cp, "price_junk"),
                   hash_pick(hash_uniform(k, cp, "price_pick"), K.NUMERIC_JUNK))
             .otherwise(_text2(F.col("o_totalprice"))))
    order_date = (F.when(hash_below(0.03, k, "date_bad"), F.lit("not a date"))
                  .when(hash_below(0.02, k, "date_missing"), F.lit(None).cast("string"))
                  .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return rows.select(
        (cp.cast("long") * SEQ_STRIDE + k).alias("_seq"),
        k.alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        priority.alias("priority"),
        price.alias("price"),
        order_date.alias("order_date"),
        F.col("o_orderstatus").alias("status"),
    )


DIRTY_ORDERS_SPEC = {
    "target": "status",
    "columns": ["order_id", "customer_id", "priority", "price", "order_date", "status"],
    "numeric": ["price"],
    "categorical": ["priority"],
    "expected_types": {"order_id": "bigint", "customer_id": "string", "priority": "string", "price": "double",
                       "order_date": "timestamp_ntz", "status": "string"},
}


# ------------------------------------------------------------- domain tables
def dom_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    k = F.col("c_custkey")
    cats = K.DOMAIN_CATEGORIES["hr"]
    return c.select(
        F.concat(F.lit("EMP-"), k).alias("EmployeeID"),
        (F.lit(18) + F.pmod(k * 7, F.lit(52))).alias("Age"),
        _pick(cats["Department"], F.pmod(F.col("c_nationkey"), F.lit(3))).alias("Department"),
        _pick(cats["JobRole"], F.pmod(k, F.lit(6))).alias("JobRole"),
        F.when(hash_below(0.05, k, "income_missing"), F.lit(None).cast("double"))
        .otherwise(F.round(F.col("c_acctbal") * 2, 2)).alias("MonthlyIncome"),
        (F.pmod(k * 13, F.lit(40)) - 1).alias("YearsAtCompany"),
        F.when(F.pmod(k, F.lit(5)) == 0, "Yes").otherwise("No").alias("Attrition"),
        F.pmod(k * 3, F.lit(5)).alias("JobSatisfaction"),
        F.when(F.pmod(k, F.lit(3)) == 0, "Yes").otherwise("No").alias("OverTime"),
        (F.pmod(k * 11, F.lit(29)) + 1).alias("DistanceFromHome"),
        (F.pmod(k, F.lit(5)) + 1).alias("Education"),
        (F.lit(3) + F.pmod(k, F.lit(2))).alias("PerformanceRating"),
        F.when(F.pmod(k, F.lit(97)) == 0, 2).otherwise(1).alias("EmployeeCount"),
        F.lit(80).alias("StandardHours"),
    )


def dom_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to customer (shuffle join on custkey at scale) and to the
    fixed 25-row nation / 5-row region dimensions (broadcast: size is fixed by
    the schema, not by the data volume)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    cats = K.DOMAIN_CATEGORIES["sales"]
    stage_idx = F.pmod(k, F.lit(6))
    product = _pick(cats["Product"], F.pmod(k * 7, F.lit(5)))
    return j.select(
        F.concat(F.lit("D-"), k).alias("DealID"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("AccountName"),
        _pick(cats["Stage"], stage_idx).alias("Stage"),
        F.col("o_totalprice").alias("Amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("CloseDate"),
        F.concat(F.lit("Rep "), F.pmod(F.col("o_custkey"), F.lit(20))).alias("Rep"),
        F.when(F.pmod(k, F.lit(50)) == 1, F.regexp_replace(product, " ", "")).otherwise(product).alias("Product"),
        F.col("r_name").alias("Region"),
        F.col("c_mktsegment").alias("LeadSource"),
        (F.pmod(F.col("o_custkey"), F.lit(120)) + 1).alias("DaysInStage"),
        _pick([10.0, 25.0, 50.0, 75.0, 100.0, 0.0], stage_idx).alias("Probability"),
        _pick(cats["ForecastCategory"], F.pmod(k, F.lit(4))).alias("ForecastCategory"),
    )


def dom_pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    cats = K.DOMAIN_CATEGORIES["pm"]
    status = _pick(cats["Status"], F.pmod(ok + ln, F.lit(5)))
    deps = F.array_join(
        F.transform(F.sequence(F.greatest(F.lit(1), ln - 3), ln - 1),
                    lambda i: F.concat(F.lit("T-"), ok, F.lit("-"), i)), ",")
    pct = (F.when(status == "Completed", F.when(F.pmod(ok, F.lit(11)) == 0, 90.0).otherwise(100.0))
           .when(status == "Not Started", F.when(F.pmod(ok, F.lit(13)) == 0, 5.0).otherwise(0.0))
           .otherwise(F.pmod(ok * 7 + ln * 13, F.lit(101)).cast("double")))
    return li.select(
        F.concat(F.lit("T-"), ok, F.lit("-"), ln).alias("TaskID"),
        F.concat(F.lit("Project "), F.pmod(ok, F.lit(50))).alias("ProjectName"),
        F.concat(F.lit("Eng "), F.pmod(F.col("l_suppkey"), F.lit(30))).alias("Assignee"),
        status.alias("Status"),
        _pick(cats["Priority"], F.pmod(F.col("l_partkey"), F.lit(4))).alias("Priority"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("DueDate"),
        F.col("l_quantity").alias("EstimatedHours"),
        (F.col("l_quantity") * (F.lit(5) + F.pmod(F.col("l_partkey"), F.lit(7)) * 4) / 10.0).alias("ActualHours"),
        F.when(ln == 1, F.lit(None).cast("string")).otherwise(deps).alias("Dependencies"),
        F.concat(F.lit("M"), F.pmod(ok, F.lit(8))).alias("Milestone"),
        _pick(cats["RiskFlag"], F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(4))).alias("RiskFlag"),
        pct.alias("CompletionPct"),
    )


def dom_it_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e, u = F.col("event_id"), F.col("user_id")
    cats = K.DOMAIN_CATEGORIES["it_ops"]
    status = _pick(cats["Status"], F.pmod(e * 3 + u, F.lit(5)))
    resolved = F.when(status.isin("Resolved", "Closed", "Pending") & (F.pmod(e, F.lit(9)) != 0),
                      F.date_format(F.date_add(F.col("ts").cast("date"), F.pmod(e, F.lit(5)).cast("int")),
                                    "yyyy-MM-dd"))
    sla = F.when((F.col("event_type") == "error") & (F.pmod(e, F.lit(10)) == 0), F.lit(-1.0)).otherwise(
        _pick([4.0, 8.0, 24.0, 48.0], F.pmod(e, F.lit(4))))
    return ev.select(
        F.concat(F.lit("INC-"), e).alias("TicketID"),
        _pick(cats["Category"], F.pmod(u, F.lit(5))).alias("Category"),
        _pick(cats["Priority"], F.pmod(e, F.lit(4))).alias("Priority"),
        status.alias("Status"),
        F.concat(F.lit("Agent "), F.pmod(u, F.lit(12))).alias("Assignee"),
        F.date_format("ts", "yyyy-MM-dd").alias("CreatedDate"),
        resolved.alias("ResolvedDate"),
        sla.alias("SLATarget"),
        F.floor(F.col("value") / 7).cast("long").alias("EscalationLevel"),
        F.col("event_type").alias("AffectedSystem"),
        _pick(cats["ResolutionType"], F.pmod(e, F.lit(5))).alias("ResolutionType"),
        _pick(["Low", "Medium", "High"], F.pmod(u + e, F.lit(3))).alias("CustomerImpact"),
    )


DOMAIN_VIEWS = {"hr": dom_hr, "sales": dom_sales, "pm": dom_pm, "it_ops": dom_it_ops}


def domain_table(spark: SparkSession, sf_dir: str, domain: str) -> DataFrame:
    return DOMAIN_VIEWS[domain](spark, sf_dir)


# ------------------------------------------------------------ answer tables
DOMAINS = ["hr", "sales", "pm", "it_ops"]
PERSONA_ROLES = ["executive", "manager", "ic"]
PERSONA_NAMES = ["Executive", "Manager", "Individual Contributor", "Analyst"]
VIEW_COLUMNS = {d: K.DOMAIN_COLUMNS[d] + (["EmployeeCount", "StandardHours"] if d == "hr" else [])
                for d in DOMAINS}


def domain_columns_map(columns: dict[str, list[str]] | None = None) -> Column:
    cols = columns or K.DOMAIN_COLUMNS
    return F.create_map(*[x for d in DOMAINS for x in (F.lit(d), F.array(*[F.lit(c) for c in cols[d]]))])


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per document: the whole document text is the answer;
    domain, persona, requested persona and cited columns are derived from the
    id; half the rows carry an external judge score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    domain = _pick(DOMAINS, F.pmod(i, F.lit(4)))
    cols = F.element_at(domain_columns_map(), domain)
    a = F.element_at(cols, (F.pmod(i, F.lit(12)) + 1).cast("int"))
    b = F.element_at(cols, (F.pmod(i * 5 + 1, F.lit(12)) + 1).cast("int"))
    cited = (F.when(F.pmod(i, F.lit(11)) == 0, F.array().cast("array<string>"))
             .when(F.pmod(i, F.lit(3)) == 0, F.array(a, b, F.lit("Revenue")))
             .otherwise(F.array(a, b)))
    return docs.select(
        "doc_id", domain.alias("domain"),
        _pick(PERSONA_ROLES, F.pmod(i, F.lit(3))).alias("persona_role"),
        _pick(PERSONA_NAMES, F.pmod(i * 7 + 3, F.lit(4))).alias("requested_persona"),
        F.col("text").alias("answer"), cited.alias("cited_columns"),
        F.when(F.pmod(i, F.lit(2)) == 0, F.floor(hash_uniform(i, "judge") * 10000) / 10000.0).alias("judge_score"),
    )


def action_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs built from the conversations: valid JSON actions, JSON
    with nested arguments, broken JSON, reasoning-wrapped prose and plain
    prose, chosen by (conv_id * 31 + turn) mod 7. Texts are kept whole."""
    from tessera.operators.actions import ALL_SOURCES
    cv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    c, t = F.col("conv_id"), F.col("turn")
    kind = F.pmod(c * 31 + t, F.lit(7))
    op = _pick(K.DOMAIN_OPERATIONS, F.pmod(c + t, F.lit(6)))
    col = _pick(K.DOMAIN_COLUMNS["hr"], F.pmod(t, F.lit(12)))
    src = _pick(ALL_SOURCES, F.pmod(c * 3 + t, F.lit(20)))
    tool = _pick(K.VALID_TOOLS + ["delete_table"], F.pmod(c + 2 * t, F.lit(8)))
    top = _pick(K.TOOL_OPERATIONS + ["explode"], F.pmod(c, F.lit(9)))
    txt = F.col("text")
    L = F.lit
    out = (F.when(kind == 0, F.concat(L('{"operation": "'), op, L('", "column": "'), col, L('", "value": "median"}')))
           .when(kind == 1, F.concat(L("<think>"), txt, L('</think> I will fix the type of "'), col, L('" now.')))
           .when(kind == 2, F.concat(L('{"operation": "trim", "column": '), txt))
           .when(kind == 3, txt)
           .when(kind == 4, F.concat(L('{"tool": "'), tool, L('", "arguments": {"operation": "'), top,
                                     L('", "column": "'), col, L('"}}')))
           .when(kind == 5, F.concat(L("Step 1: "), txt, L(' {"tool": "'), tool, L('"}')))
           .otherwise(F.concat(txt, L(' {"operation": "add_field", "field_name": "'), src, L('", "source": "'), src,
                               L('"} {"answer": "Attrition is highest in Sales", "cited_columns": ["Department", '
                                 '"Attrition"], "reasoning": "grouped by department"}'))))
    return cv.select("conv_id", "turn", _pick(DOMAINS, F.pmod(c, F.lit(4))).alias("domain"), out.alias("output"))


# --------------------------------------------------------------- step logs
TASK_IDS = ["ecommerce_mobile", "subscription_churn", "delivery_eta"]
AGENTS = ["heuristic", "random", "llm"]
# How an event becomes a tool call.
EVENT_TOOL = {"signup": "submit_solution", "view": "profile_data", "click": "apply_cleaning_operation",
              "purchase": "run_quality_gates", "error": "apply_cleaning_operation"}
STEP_COLUMNS = ["country", "items_in_cart", "device_os", "order_value", "event_date"]


def _day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent step log: one episode per (user, day), one run per user; the
    event type decides the tool; rewards, gate results and submit reports are
    derived from the event (errors are invalid actions)."""
    return steps_from(read_table(spark, sf_dir, "events"))


def steps_from(events: DataFrame) -> DataFrame:
    """The step-log projection of an events DataFrame (batch or stream)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    e, u, et, v = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value")
    tool = F.coalesce(*[F.when(et == k, F.lit(t)) for k, t in EVENT_TOOL.items()])
    is_op = tool == "apply_cleaning_operation"
    reward = (F.when(et == "error", F.lit(K.TOOL_ERROR_REWARD))
              .when(et == "click", F.floor(hash_uniform(e, "reward") * 3000) / 10000.0 - 0.1)
              .when(et == "purchase", F.when(v > 25, K.GATE_BONUS_PASS).otherwise(K.GATE_BONUS_FAIL)))
    return ev.select(
        (u * 100000 + _day(F.col("ts"))).alias("episode_id"), u.alias("run_id"), _day(F.col("ts")).alias("day"),
        "ts", "event_id",
        _pick(TASK_IDS, F.pmod(u, F.lit(3))).alias("task_id"),
        _pick(AGENTS, F.pmod(F.floor(u / 3), F.lit(3))).alias("agent"),
        tool.alias("tool_name"),
        F.when(is_op, _pick(K.TOOL_OPERATIONS, F.pmod(e, F.lit(8)))).alias("operation"),
        F.when(is_op & (F.pmod(e, F.lit(8)) != 0), _pick(STEP_COLUMNS, F.pmod(F.floor(e / 8), F.lit(5))))
        .alias("column"),
        F.when(et == "error", F.lit("Unknown column")).alias("error"),
        reward.alias("reward"),
        F.when(et == "signup", F.floor(hash_uniform(e, "final") * 10000) / 10000.0).alias("final_reward"),
        F.when(et == "purchase", v > 25).alias("passed"),
        F.when(et == "purchase", 1 - v / 1000).alias("retention_ratio"),
        F.when(et == "signup", v > 100).alias("report_passed"),
        F.when(et == "signup", 1 - v / 2000).alias("report_retention"),
    )


CURVE_TASKS = ["cleaning", "enrichment", "answering"]


def metric_series_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, metric, ts, event_id, value) training-curve points: every event
    is one logging step carrying epoch, reward, loss, kl, reward_std and one
    reward component. Epochs restart every 15 days, which plants a reset."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    e, ts, v = F.col("event_id"), F.col("ts"), F.col("value")
    secs = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    epoch = (F.pmod(_day(ts), F.lit(15)) * 86400 + secs) / 432000.0
    points = [("train/epoch", epoch), ("train/reward", v / 100.0), ("train/loss", 1.0 / (v + 1.0)),
              ("train/kl", v / 1000.0), ("train/reward_std", F.floor(hash_uniform(e, "std") * 1000) / 1000.0),
              ("train/rewards/format_reward/mean", F.floor(hash_uniform(e, "fmt") * 1000) / 1000.0)]
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), x.cast("double").alias("value")) for m, x in points])
    return ev.select(_pick(CURVE_TASKS, F.pmod(F.col("user_id"), F.lit(3))).alias("task"), "ts", "event_id",
                     F.explode(arr).alias("p")).select("task", "p.metric", "ts", "event_id", "p.value")
