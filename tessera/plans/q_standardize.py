"""Sources, sinks, sampling, schema standardization, source mappings, the
bronze/silver/gold pipeline and row augmentation."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import constants as K
from tessera.functions.exprs import hash_uniform
from tessera.operators import clean as C
from tessera.operators import standardize as STD
from tessera.operators import weak as WK
from tessera.operators.trajectory import ordered_prefix
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.q_trajectory import _episodes, episodes_sql
from tessera.plans.q_weak import SqlRow, lf_sql, majority_sql
from tessera.plans.q_enrich import TYPED
from tessera.plans.sqlkit import Sql, hpick, pick, q, uni
from tessera.session import ensure_checkpoint_dir
from tessera.sources import fixtures as X
from tessera.sources import raw_sources as RS
from tessera.sources import tables as TB

SEED = 42


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


# ------------------------------------------------------------ raw sources
def crm_sql() -> str:
    c = K.DOMAIN_CATEGORIES["sales"]
    close = "strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER), '%Y-%m-%d')"
    return f"""SELECT concat('OPP-', o_orderkey) AS opportunity_id,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_name END AS account, {pick(c['Stage'], 'o_orderkey % 6')} AS deal_stage,
        o_totalprice AS close_value, strftime(o_orderdate, '%Y-%m-%d') AS engage_date,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {close} END AS close_date, concat('Agent ', o_custkey % 20) AS sales_agent,
        {pick(c['Product'], '(o_orderkey * 7) % 5')} AS product FROM orders JOIN customer ON o_custkey = c_custkey"""


def incidents_sql() -> str:
    c = K.DOMAIN_CATEGORIES["it_ops"]
    return f"""SELECT concat('INC', lpad(CAST(event_id AS VARCHAR), 7, '0')) AS number,
        {pick(RS.INCIDENT_STATES, 'event_id % 5')} AS incident_state, {pick(c['Category'], 'user_id % 5')} AS category,
        {pick(RS.INCIDENT_PRIORITIES, 'event_id % 5')} AS priority, concat('Agent ', user_id % 12) AS assigned_to,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS opened_at,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS resolved_at, event_type AS cmdb_ci,
        {pick(c['ResolutionType'], 'event_id % 5')} AS close_code, {pick(RS.IMPACTS, '(user_id + event_id) % 3')} AS impact,
        CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) END AS reassignment_count
        FROM events"""


def tasks_sql() -> str:
    return f"""SELECT concat('TASK-', l_orderkey, '-', l_linenumber) AS Task_ID, l_quantity / 4.0 AS Task_Duration_Days,
        {pick(RS.RISK_LEVELS, 'l_partkey % 4')} AS Risk_Level, l_linenumber - 1 AS Dependency_Count FROM lineitem"""


def hr_export_sql() -> str:
    return "SELECT " + ", ".join(f"{a} AS {b}" for a, b in RS.HR_EXPORT.items()) + " FROM dom_hr"


# ----------------------------------------------------------- standardize
def _std_sql() -> str:
    present = set(RS.HR_EXPORT)
    sel = [f"{b} AS {a}" if a in K.DOMAIN_COLUMNS["hr"] else b for a, b in RS.HR_EXPORT.items()]
    sel += [f"CAST(NULL AS VARCHAR) AS {c}" for c in K.DOMAIN_COLUMNS["hr"] if c not in present]
    return S.with_fixtures(["dom_hr"], "SELECT " + ", ".join(sel) + " FROM hr_export", [("hr_export", hr_export_sql())])


@register("std_columns", _std_sql)
def std_columns(spark, sf):
    """snake_case / upper-case HR export -> domain names; missing columns
    added as NULL; unmatched columns kept."""
    return STD.standardize_columns(RS.hr_export(spark, sf), "hr")


def _map_sales_sql() -> str:
    k = Sql("opportunity_id")
    days = ("date_diff('day', CAST(try_strptime(engage_date, '%Y-%m-%d') AS DATE), "
            "CAST(try_strptime(close_date, '%Y-%m-%d') AS DATE))")
    fill = f"CAST(floor({uni(k, SEED, 'days')} * 119) + 1 AS BIGINT)"
    return f"""WITH crm AS ({crm_sql()})
        SELECT opportunity_id AS DealID, account AS AccountName, deal_stage AS Stage, close_value AS Amount,
        close_date AS CloseDate, sales_agent AS Rep, product AS Product, {hpick(uni(k, SEED, 'region'), STD.REGIONS)} AS Region,
        {hpick(uni(k, SEED, 'lead'), STD.LEAD_SOURCES)} AS LeadSource, greatest(coalesce({days}, {fill}), 1) AS DaysInStage,
        floor({uni(k, SEED, 'prob')} * 1000) / 10.0 AS Probability,
        {hpick(uni(k, SEED, 'forecast'), STD.FORECAST)} AS ForecastCategory FROM crm"""


@register("map_sales", _map_sales_sql)
def map_sales(spark, sf):
    return STD.map_sales(RS.crm_pipeline(spark, sf), SEED).withColumn("DaysInStage", F.col("DaysInStage").cast("long"))


def _map_it_sql() -> str:
    sla = "coalesce((CASE priority " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in STD.SLA_BY_PRIORITY.items()) + " END), 24)"
    esc = f"least(CAST(trunc(coalesce({S.parse_double('reassignment_count')}, 0.0)) AS BIGINT), 5)"
    return f"""WITH inc AS ({incidents_sql()})
        SELECT number AS TicketID, category AS Category, priority AS Priority, incident_state AS Status,
        assigned_to AS Assignee, opened_at AS CreatedDate, resolved_at AS ResolvedDate, {sla} AS SLATarget,
        {esc} AS EscalationLevel, cmdb_ci AS AffectedSystem, close_code AS ResolutionType, impact AS CustomerImpact FROM inc"""


@register("map_it_ops", _map_it_sql)
def map_it_ops(spark, sf):
    return STD.map_it_ops(RS.incident_log(spark, sf))


def _map_pm_sql() -> str:
    k = Sql("Task_ID")

    def u(tag):
        return uni(k, SEED, tag)
    est = "greatest(CAST(floor(Task_Duration_Days * 8) AS BIGINT), 2)"
    actual = f"greatest(CAST(floor({est} * (0.5 + {u('actual')})) AS BIGINT), 0)"
    dep = uni(k, SEED, "dep", Sql("i"))
    deps = (f"CASE WHEN Dependency_Count > 0 THEN array_to_string(list_transform(range(1, least(Dependency_Count, 3) + 1), "
            f"lambda i: printf('TASK-%04d', CAST(floor({dep} * ntask) AS BIGINT))), ',') ELSE '' END")
    risk = "coalesce((CASE Risk_Level " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in STD.RISK_MAP.items()) + " END), 'None')"
    return f"""WITH tasks AS ({tasks_sql()})
        SELECT Task_ID AS TaskID, concat('Project_', {hpick(u('project'), [chr(65 + i) for i in range(10)])}) AS ProjectName,
        concat('Dev_', CAST(CAST(floor({u('assignee')} * 20) + 1 AS BIGINT) AS VARCHAR)) AS Assignee,
        {hpick(u('status'), STD.PM_STATUSES)} AS Status, {hpick(u('priority'), STD.PM_PRIORITIES)} AS Priority,
        strftime(DATE '2024-01-01' + CAST(floor({u('due')} * 365) AS INTEGER), '%Y-%m-%d') AS DueDate,
        {est} AS EstimatedHours, {actual} AS ActualHours, {deps} AS Dependencies,
        {hpick(u('milestone'), STD.MILESTONES)} AS Milestone, {risk} AS RiskFlag,
        CAST(floor({u('pct')} * 101) AS BIGINT) AS CompletionPct FROM tasks, (SELECT count(*) AS ntask FROM tasks) c"""


@register("map_pm", _map_pm_sql)
def map_pm(spark, sf):
    tasks = RS.construction_tasks(spark, sf)
    return STD.map_pm(tasks, tasks.count(), SEED)


# ------------------------------------------------------- bronze / silver
def _pipeline_inputs(spark, sf):
    out = {"hr": STD.standardize_columns(RS.hr_export(spark, sf), "hr")}
    for d in ["sales", "pm", "it_ops"]:
        out[d] = STD.standardize_columns(X.domain_table(spark, sf, d), d)
    return out


@register("bronze_silver_pipeline", lambda: _pipeline_sql())
def bronze_silver_pipeline(spark, sf):
    """Per domain: standardize -> label rows (majority of the domain LFs)
    -> write the raw table -> gold (dedup, median fill, strip) -> write.
    Returns the written tables' row and label counts, read back."""
    base = scratch(spark, "bronze-silver")
    rows = []
    for d, df in _pipeline_inputs(spark, sf).items():
        labeled = WK.label_domain(df, d).withColumnRenamed("_dq_label", "dq_label")
        TB.write_parquet(labeled, f"{base}/raw/domain={d}")
        raw_back = spark.read.parquet(f"{base}/raw/domain={d}")
        gold = C.gold_table(raw_back, K.DOMAIN_NUMERIC[d], K.DOMAIN_CATEGORICAL[d])
        TB.write_parquet(gold, f"{base}/gold/domain={d}")
        n_gold = spark.read.parquet(f"{base}/gold/domain={d}").count()
        rows.append(raw_back.agg(F.lit(d).alias("domain"), F.count(F.lit(1)).alias("n_raw"),
                                 F.count_if(F.col("dq_label") == K.GOOD).alias("n_good"),
                                 F.count_if(F.col("dq_label") == K.BAD).alias("n_bad"),
                                 F.count_if(F.col("dq_label") == K.ABSTAIN).alias("n_abstain"),
                                 F.lit(n_gold).cast("long").alias("n_gold")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _pipeline_sql() -> str:
    parts, ctes = [], [("hr_export", hr_export_sql())]
    for d in ["hr", "sales", "pm", "it_ops"]:
        if d == "hr":
            present = set(RS.HR_EXPORT)
            sel = [f"{b} AS {a}" if a in K.DOMAIN_COLUMNS["hr"] else b for a, b in RS.HR_EXPORT.items()]
            sel += [f"CAST(NULL AS VARCHAR) AS {c}" for c in K.DOMAIN_COLUMNS["hr"] if c not in present]
            std = "SELECT " + ", ".join(sel) + " FROM hr_export"
            cols = [("employee_count" if a == "EmployeeCount" else a) for a in RS.HR_EXPORT] + \
                [c for c in K.DOMAIN_COLUMNS["hr"] if c not in present]
        else:
            std = f"SELECT * FROM dom_{d}"
            cols = K.DOMAIN_COLUMNS[d]
        ctes.append((f"std_{d}", std))
        r = SqlRow(cols, TYPED)
        label = majority_sql([lf_sql(r, lf.__name__) for lf in WK.DOMAIN_LFS[d]])
        ctes.append((f"lab_{d}", f"SELECT *, {label} AS dq_label FROM std_{d}"))
        parts.append(f"SELECT '{d}' AS domain, count(*) AS n_raw, CAST(count_if(dq_label = 1) AS BIGINT) AS n_good, "
                     f"CAST(count_if(dq_label = 0) AS BIGINT) AS n_bad, CAST(count_if(dq_label = -1) AS BIGINT) AS n_abstain, "
                     f"(SELECT count(*) FROM (SELECT DISTINCT * FROM lab_{d})) AS n_gold FROM lab_{d}")
    return S.with_fixtures(["dom_hr", "dom_sales", "dom_pm", "dom_it_ops"], " UNION ALL ".join(parts), ctes)


@register("sink_parquet_raw_gold", lambda: S.with_fixtures(["dom_it_ops"], (
    "SELECT *, " + majority_sql([lf_sql(SqlRow(K.DOMAIN_COLUMNS["it_ops"], TYPED), lf.__name__)
                                 for lf in WK.DOMAIN_LFS["it_ops"]]) + " AS dq_label FROM dom_it_ops")))
def sink_parquet_raw_gold(spark, sf):
    """Labeled raw it_ops table written as Parquet and read back."""
    path = scratch(spark, "raw-it_ops")
    df = WK.label_domain(X.dom_it_ops(spark, sf), "it_ops").withColumnRenamed("_dq_label", "dq_label")
    TB.write_parquet(df, path)
    return spark.read.parquet(path)


# ------------------------------------------------------ sources and sinks
HR_SCHEMA = T.StructType([T.StructField(c, t) for c, t in [
    ("EmployeeID", T.StringType()), ("Age", T.LongType()), ("Department", T.StringType()),
    ("JobRole", T.StringType()), ("MonthlyIncome", T.DoubleType()), ("YearsAtCompany", T.LongType()),
    ("Attrition", T.StringType()), ("JobSatisfaction", T.LongType()), ("OverTime", T.StringType()),
    ("DistanceFromHome", T.LongType()), ("Education", T.LongType()), ("PerformanceRating", T.LongType()),
    ("EmployeeCount", T.IntegerType()), ("StandardHours", T.IntegerType())]])


@register("src_csv", lambda: S.with_fixtures(["dom_hr"], "SELECT * FROM dom_hr"))
def src_csv(spark, sf):
    """Header CSV scan with a declared schema (no inference pass)."""
    path = scratch(spark, "csv-hr")
    TB.write_csv(X.dom_hr(spark, sf), path)
    return TB.read_csv(spark, path, HR_SCHEMA)


@register("src_csv_limit", lambda: S.with_fixtures(["dom_pm"], "SELECT * FROM dom_pm ORDER BY ALL LIMIT 50000"))
def src_csv_limit(spark, sf):
    """CSV scan capped at 50,000 rows (first rows in key order; the cap is
    the feature and bounds the final merge at 50,000 rows)."""
    df = X.dom_pm(spark, sf)
    path = scratch(spark, "csv-pm")
    TB.write_csv(df, path)
    back = TB.read_csv(spark, path, df.schema)
    return back.orderBy(*[F.col(c).asc_nulls_first() for c in back.columns]).limit(50000)


@register("src_parquet", lambda: (
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
    "WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_returnflag = 'R'"))
def src_parquet(spark, sf):
    """Parquet scan: the filter and the 3-column projection reach the scan
    (PushedFilters / ReadSchema)."""
    li = TB.read_table(spark, sf, "lineitem")
    return li.where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")) \
        .select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("json_results_io", lambda: S.with_fixtures(["steps"], "SELECT * FROM episodes", [("episodes", episodes_sql())]))
def json_results_io(spark, sf):
    """Episode results written as JSON and read back with their schema."""
    eps = _episodes(spark, sf)
    path = scratch(spark, "json-episodes")
    TB.write_json(eps, path)
    return TB.read_json(spark, path, eps.schema)


DEMO_SCHEMA = ("episode_id long, task_id string, steps array<struct<event_id:long, tool_name:string, "
               "reward:double, ts:timestamp_ntz>>")


@register("demo_json_io", lambda: S.with_fixtures(["steps"], (
    "SELECT episode_id, task_id, row_number() OVER (PARTITION BY episode_id ORDER BY ts, event_id) - 1 AS step_idx, "
    "event_id, tool_name, reward FROM steps")))
def demo_json_io(spark, sf):
    """Demonstrations as nested JSON (episode -> ordered steps), saved and
    loaded with an explicit nested schema, then flattened again."""
    st = X.steps(spark, sf)
    demo = st.groupBy("episode_id").agg(
        F.any_value("task_id").alias("task_id"),
        F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "tool_name", "reward"))),
                    lambda x: F.struct(x["event_id"].alias("event_id"), x["tool_name"].alias("tool_name"),
                                       x["reward"].alias("reward"), x["ts"].alias("ts"))).alias("steps"))
    path = scratch(spark, "json-demos")
    TB.write_json(demo, path)
    back = TB.read_json(spark, path, DEMO_SCHEMA)
    return back.select("episode_id", "task_id", F.posexplode("steps").alias("step_idx", "s")).select(
        "episode_id", "task_id", F.col("step_idx").cast("long").alias("step_idx"), "s.event_id", "s.tool_name",
        "s.reward")


@register("preview", lambda: S.with_fixtures(["dom_sales"], (
    "SELECT *, (SELECT count(*) FROM dom_sales) AS n_rows, 12 AS n_columns FROM dom_sales ORDER BY DealID LIMIT 5")))
def preview(spark, sf):
    """First 5 rows in key order plus the table's shape."""
    df = X.dom_sales(spark, sf)
    n = df.count()
    return df.orderBy("DealID").limit(5).select("*", F.lit(n).cast("long").alias("n_rows"),
                                                F.lit(len(df.columns)).alias("n_columns"))


@register("sample_fixed", lambda: S.with_fixtures(["dom_hr"], (
    "SELECT * FROM dom_hr ORDER BY md5(concat_ws('|', EmployeeID, '42')) LIMIT 100")))
def sample_fixed(spark, sf):
    """100 rows without replacement, seed 42: the rows with the smallest
    seeded hash (deterministic, partition independent; bounded top-k)."""
    df = X.dom_hr(spark, sf)
    return df.orderBy(F.md5(F.concat_ws("|", F.col("EmployeeID"), F.lit(str(SEED))))).limit(100)


_FIRST_COLS = ["operation", "column", "reward", "final_reward"]


@register("first_non_null_per_key", lambda: S.with_fixtures(["steps"], (
    "SELECT episode_id, " + ", ".join(f'arg_min({c if c != "column" else chr(34) + c + chr(34)}, (ts, event_id)) AS "{c}"'
                                      for c in _FIRST_COLS) + " FROM steps GROUP BY episode_id")))
def first_non_null_per_key(spark, sf):
    """Per episode, the first non-null value of every column (not the first
    row): min of (ts, event_id, value) over non-null values, one aggregation."""
    st = X.steps(spark, sf)
    return st.groupBy("episode_id").agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct("ts", "event_id", F.col(c).alias("v"))))["v"].alias(c)
        for c in _FIRST_COLS])


@register("project_drop_private", lambda: S.with_fixtures(["dirty_orders"], "SELECT * EXCLUDE (_seq) FROM dirty_orders"))
def project_drop_private(spark, sf):
    df = X.dirty_orders(spark, sf)
    return df.select([c for c in df.columns if not c.startswith("_")])


@register("eval_split", lambda: S.with_fixtures(["steps"], (
    f"SELECT episode_id, any_value(task_id) AS task_id, CASE WHEN {uni(Sql('episode_id'), 'split')} < 0.2 THEN 'eval' "
    "ELSE 'train' END AS split FROM steps GROUP BY episode_id")))
def eval_split(spark, sf):
    """Held-out split per episode from a seeded hash (stable across runs)."""
    st = X.steps(spark, sf)
    eps = st.groupBy("episode_id").agg(F.any_value("task_id").alias("task_id"))
    return eps.select("episode_id", "task_id", F.when(hash_uniform(F.col("episode_id"), "split") < 0.2, "eval")
                      .otherwise("train").alias("split"))


# ------------------------------------------------------------ augmentation
AUG_COLS = ["EstimatedHours", "ActualHours", "CompletionPct"]


def _normal(u1, u2):
    return F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * math.pi * u2)


@register("augment_rows", lambda: _augment_sql())
def augment_rows(spark, sf):
    """Bootstrap half as many new rows again: each new row copies a
    hash-chosen parent (join on the parent's position), perturbs numerics by
    N(0, 0.2 v) (or 1..19 when v <= 0), clamps at 0, caps percent at 100 and
    gets a new id."""
    base = X.dom_pm(spark, sf)
    n = base.count()
    need = n // 2
    idx = ordered_prefix(base.select("TaskID", *AUG_COLS), [], ["TaskID", *AUG_COLS], {}).select(
        F.col("idx").alias("parent"), *AUG_COLS)
    new = spark.range(need).select(F.col("id").alias("j"))
    j = F.col("j")
    new = new.select("j", F.floor(hash_uniform(j, SEED, "parent") * n).cast("long").alias("parent"))
    joined = new.join(idx, "parent")
    out = {}
    for c in AUG_COLS:
        v = F.col(c).cast("double")
        noise = F.when(v > 0, _normal(hash_uniform(j, SEED, c, "n1"), hash_uniform(j, SEED, c, "n2")) * (0.2 * v)) \
            .otherwise(F.floor(hash_uniform(j, SEED, c, "int") * 19) + 1)
        val = F.greatest(F.lit(0), (v + noise).cast("long"))
        out[c] = (F.least(val, F.lit(100)) if c == "CompletionPct" else val).cast("double")
    aug = joined.select(F.format_string("TASK-%04d", F.lit(n) + j).alias("TaskID"),
                        *[out[c].alias(c) for c in AUG_COLS])
    return base.select("TaskID", *AUG_COLS).unionByName(aug)


def _augment_sql() -> str:
    j = Sql("j")
    sel = []
    for c in AUG_COLS:
        v = f"CAST({c} AS DOUBLE)"
        z = (f"sqrt(-2.0 * ln(greatest({uni(j, SEED, c, 'n1')}, 1e-12))) * cos(2 * {math.pi!r} * {uni(j, SEED, c, 'n2')})")
        noise = f"(CASE WHEN {v} > 0 THEN {z} * (0.2 * {v}) ELSE floor({uni(j, SEED, c, 'int')} * 19) + 1 END)"
        val = f"greatest(0, CAST(trunc({v} + {noise}) AS BIGINT))"
        val = f"least({val}, 100)" if c == "CompletionPct" else val
        sel.append(f"CAST({val} AS DOUBLE) AS {c}")
    body = (f"SELECT TaskID, {', '.join(AUG_COLS)} FROM dom_pm UNION ALL "
            f"SELECT printf('TASK-%04d', n + j) AS TaskID, {', '.join(sel)} FROM "
            f"(SELECT j, CAST(floor({uni(j, SEED, 'parent')} * n) AS BIGINT) AS parent, n FROM "
            f"(SELECT unnest(range((SELECT count(*) FROM dom_pm) // 2)) AS j), (SELECT count(*) AS n FROM dom_pm)) x "
            f"JOIN (SELECT row_number() OVER (ORDER BY TaskID, {', '.join(AUG_COLS)}) - 1 AS parent, {', '.join(AUG_COLS)} FROM dom_pm) p "
            f"USING (parent)")
    return S.with_fixtures(["dom_pm"], body)


@register("x_schema_drift")
def x_schema_drift(spark, sf):
    """Detected drift between the HR view and its export (renames, a retype,
    dropped and added columns)."""
    old = X.dom_hr(spark, sf)
    new = RS.hr_export(spark, sf).withColumn("age", F.col("age").cast("double")).withColumn("badge", F.lit("x"))
    return spark.createDataFrame(STD.schema_drift(old, new), "old_column string, new_column string, change string, "
                                                             "old_type string, new_type string")
