"""Schema standardization and source mappings into the domain schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.exprs import hash_uniform, parse_double


def _norm(name: str) -> str:
    return name.lower().replace("_", "")


def standardize_columns(df: DataFrame, domain: str) -> DataFrame:
    """Rename columns that match a domain column ignoring case and '_' (the
    first matching column in table order wins), add missing domain columns
    as NULL, keep the rest. Plan-time only: one projection."""
    expected = K.DOMAIN_COLUMNS[domain]
    rename: dict[str, str] = {}
    for exp in expected:
        for actual in df.columns:
            if _norm(actual) == _norm(exp) and actual not in rename:
                rename[actual] = exp
                break
    cols = [F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns]
    present = set(rename.get(c, c) for c in df.columns)
    cols += [F.lit(None).cast("string").alias(c) for c in expected if c not in present]
    return df.select(*cols)


def _pick(options: list, u: Column) -> Column:
    idx = F.least(F.floor(u * len(options)).cast("int"), F.lit(len(options) - 1)) + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx)


# Categories synthesized for columns the sources lack.
REGIONS = ["East", "West", "Central", "North", "South"]
LEAD_SOURCES = ["Website", "Referral", "Partner", "Trade Show", "Cold Call"]
FORECAST = ["Pipeline", "Best Case", "Commit", "Closed"]
SLA_BY_PRIORITY = {"1 - Critical": 4, "2 - High": 8, "3 - Moderate": 24, "4 - Low": 48}
PM_STATUSES = ["Not Started", "In Progress", "Completed", "On Hold", "Cancelled"]
PM_PRIORITIES = ["Critical", "High", "Medium", "Low"]
MILESTONES = ["Planning", "Design", "Development", "Testing", "Deployment"]
RISK_MAP = {"High": "High", "Medium": "Medium", "Low": "Low"}


def map_sales(crm: DataFrame, seed: int = 42) -> DataFrame:
    """CRM pipeline -> sales schema; DaysInStage = max(1, close - engage
    days), filled from a seeded draw when a date is missing."""
    k = F.col("opportunity_id")
    engage = F.try_to_timestamp(F.col("engage_date"), F.lit("yyyy-MM-dd"))
    close = F.try_to_timestamp(F.col("close_date"), F.lit("yyyy-MM-dd"))
    days = F.datediff(close.cast("date"), engage.cast("date"))
    fill = (F.floor(hash_uniform(k, seed, "days") * 119) + 1).cast("int")
    return crm.select(
        k.alias("DealID"), F.col("account").alias("AccountName"), F.col("deal_stage").alias("Stage"),
        F.col("close_value").alias("Amount"), F.col("close_date").alias("CloseDate"), F.col("sales_agent").alias("Rep"),
        F.col("product").alias("Product"), _pick(REGIONS, hash_uniform(k, seed, "region")).alias("Region"),
        _pick(LEAD_SOURCES, hash_uniform(k, seed, "lead")).alias("LeadSource"),
        F.greatest(F.coalesce(days, fill), F.lit(1)).alias("DaysInStage"),
        (F.floor(hash_uniform(k, seed, "prob") * 1000) / 10.0).alias("Probability"),
        _pick(FORECAST, hash_uniform(k, seed, "forecast")).alias("ForecastCategory"))


def map_it_ops(incidents: DataFrame) -> DataFrame:
    """Incident log -> it_ops schema; SLA hours by priority (default 24),
    escalation = min(5, reassignment count) with unparseable -> 0."""
    sla = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in SLA_BY_PRIORITY.items()
                                                    for x in (F.lit(k), F.lit(v))]), F.col("priority")), F.lit(24))
    esc = F.least(F.coalesce(parse_double(F.col("reassignment_count")), F.lit(0.0)).cast("long"), F.lit(5))
    return incidents.select(
        F.col("number").alias("TicketID"), F.col("category").alias("Category"), F.col("priority").alias("Priority"),
        F.col("incident_state").alias("Status"), F.col("assigned_to").alias("Assignee"),
        F.col("opened_at").alias("CreatedDate"), F.col("resolved_at").alias("ResolvedDate"),
        sla.alias("SLATarget"), esc.alias("EscalationLevel"), F.col("cmdb_ci").alias("AffectedSystem"),
        F.col("close_code").alias("ResolutionType"), F.col("impact").alias("CustomerImpact"))


def map_pm(tasks: DataFrame, n_tasks: int, seed: int = 42) -> DataFrame:
    """Construction tasks -> pm schema; hours = max(2, int(days * 8)); up to
    three dependency ids drawn from the task count."""
    k = F.col("Task_ID")
    u = lambda tag: hash_uniform(k, seed, tag)
    est = F.greatest(F.floor(F.col("Task_Duration_Days") * 8).cast("long"), F.lit(2))
    actual = F.greatest(F.floor(est * (0.5 + u("actual"))).cast("long"), F.lit(0))
    cnt = F.col("Dependency_Count")
    dep_ids = F.transform(F.sequence(F.lit(1), F.least(cnt, F.lit(3)).cast("int")),
                          lambda i: F.format_string("TASK-%04d", F.floor(hash_uniform(k, seed, "dep", i) * n_tasks)
                                                    .cast("long")))
    deps = F.when(cnt > 0, F.array_join(dep_ids, ",")).otherwise(F.lit(""))
    return tasks.select(
        k.alias("TaskID"), F.concat(F.lit("Project_"), _pick([chr(65 + i) for i in range(10)], u("project")))
        .alias("ProjectName"), F.concat(F.lit("Dev_"), (F.floor(u("assignee") * 20) + 1).cast("string")).alias("Assignee"),
        _pick(PM_STATUSES, u("status")).alias("Status"), _pick(PM_PRIORITIES, u("priority")).alias("Priority"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(u("due") * 365).cast("int")), "yyyy-MM-dd")
        .alias("DueDate"), est.alias("EstimatedHours"), actual.alias("ActualHours"), deps.alias("Dependencies"),
        _pick(MILESTONES, u("milestone")).alias("Milestone"),
        F.coalesce(F.try_element_at(F.create_map(*[x for a, b in RISK_MAP.items() for x in (F.lit(a), F.lit(b))]),
                                    F.col("Risk_Level")), F.lit("None")).alias("RiskFlag"),
        F.floor(u("pct") * 101).cast("long").alias("CompletionPct"))


def schema_drift(old: DataFrame, new: DataFrame) -> list[tuple]:
    """Schema changes between two versions of a table: kept / retyped
    (same name), renamed (same name ignoring case and '_'), dropped, added.
    A plan-time comparison of the two schemas (no data is read)."""
    old_t = {f.name: f.dataType.simpleString() for f in old.schema.fields}
    new_t = {f.name: f.dataType.simpleString() for f in new.schema.fields}
    used, rows = set(), []
    for c, t in old_t.items():
        if c in new_t:
            used.add(c)
            rows.append((c, c, "kept" if new_t[c] == t else "retyped", t, new_t[c]))
            continue
        match = next((n for n in new_t if n not in used and _norm(n) == _norm(c)), None)
        if match is not None:
            used.add(match)
            rows.append((c, match, "renamed" if new_t[match] == t else "renamed+retyped", t, new_t[match]))
        else:
            rows.append((c, None, "dropped", t, None))
    rows += [(None, n, "added", None, t) for n, t in new_t.items() if n not in used]
    return rows
