"""Enrichment queries: each source over its domain view, all sources over
the corrupted domain tables, and coverage of the produced values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import enrich as E
from tessera.operators.registry import FunctionRegistry
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.q_corrupt import DOMAIN_KEYS, corrupted_domain, corrupted_domain_ctes
from tessera.sources import fixtures as X

DOMAIN_OF = {s: d for d, srcs in K.ENRICHMENT_SOURCES.items() for s in srcs}
# numeric-typed columns of the clean domain views
TYPED = {"Age", "MonthlyIncome", "YearsAtCompany", "JobSatisfaction", "DistanceFromHome", "Education",
         "PerformanceRating", "EmployeeCount", "StandardHours", "Amount", "DaysInStage", "Probability",
         "EstimatedHours", "ActualHours", "CompletionPct", "SLATarget", "EscalationLevel"}


def D(x) -> str:
    """Typed SQL literal matching Spark's literal types."""
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    if isinstance(x, int):
        return str(x)
    if x is None:
        return "NULL"
    return S.q(x)


class SqlInputs:
    def __init__(self, columns: list[str], typed: set[str], null_policy: str = "bad"):
        self.cols, self.typed, self.null_policy = columns, typed, null_policy

    def num(self, name: str, absent: float):
        if name not in self.cols:
            return D(float(absent)), None
        return S.parse_double(name, name in self.typed), name

    def text(self, name: str, absent: str) -> str:
        if name not in self.cols:
            return S.q(absent)
        return f"coalesce(CAST({name} AS VARCHAR), 'None')"

    def string_columns(self) -> list[str]:
        return [c for c in self.cols if c not in self.typed]


def banded(inp, name, absent, bands, last, bad) -> str:
    v, raw = inp.num(name, absent)
    whens = " ".join(f"WHEN {v} < {t} THEN {D(lab)}" for t, lab in bands)
    tail = f"WHEN {v} IS NOT NULL THEN {D(last)}"
    if raw is None:
        return f"(CASE {whens} {tail} END)"
    null_val = bad if inp.null_policy == "bad" else last
    return f"(CASE {whens} {tail} WHEN {raw} IS NULL THEN {D(null_val)} ELSE {D(bad)} END)"


def value_or(inp, name, absent, bad) -> str:
    v, raw = inp.num(name, absent)
    if raw is None:
        return v
    if inp.null_policy == "bad":
        return f"coalesce({v}, {D(float(bad))})"
    return f"(CASE WHEN {raw} IS NULL THEN NULL ELSE coalesce({v}, {D(float(bad))}) END)"


def lookup(inp, table: dict, default=None) -> str:
    hits = [f"(CASE CAST({c} AS VARCHAR) " + " ".join(f"WHEN {S.q(k)} THEN {D(v)}" for k, v in table.items())
            + " END)" for c in inp.string_columns()]
    if default is not None:
        hits.append(D(default))
    return "coalesce(" + ", ".join(hits) + ")"


def is_bad(inp, names) -> str:
    parts = []
    for n in names:
        v, raw = inp.num(n, 0)
        if raw is not None:
            parts.append(f"({raw} IS NOT NULL AND {v} IS NULL)")
    return "(" + (" OR ".join(parts) if parts else "FALSE") + ")"


def null_bad(inp, names) -> str:
    parts = [f"{raw} IS NULL" for n in names for v, raw in [inp.num(n, 0)] if raw is not None]
    return "((" + (" OR ".join(parts) if parts else "FALSE") + f") AND NOT {is_bad(inp, names)})"


R = S.sround


def sql_source(inp, s: str) -> str:
    if s == "salary_band":
        return banded(inp, "MonthlyIncome", 0, [(3000, "Entry"), (6000, "Mid"), (10000, "Senior")], "Executive",
                      "Unknown")
    if s == "tenure_risk":
        return banded(inp, "YearsAtCompany", 0, [(2, 0.8), (5, 0.4), (10, 0.2)], 0.3, 0.5)
    if s == "satisfaction_index":
        return R(f"{value_or(inp, 'JobSatisfaction', 3, 3)} / 4.0", 2)
    if s == "industry_benchmark":
        return f"CAST({lookup(inp, K.INDUSTRY_BENCHMARK)} AS BIGINT)"
    if s == "flight_risk_score":
        ot = f"(CASE WHEN lower({inp.text('OverTime', 'No')}) = 'yes' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"
        return R(f"0.4::DOUBLE * {sql_source(inp, 'tenure_risk')} + 0.4::DOUBLE * (1 - "
                 f"{sql_source(inp, 'satisfaction_index')}) + 0.2::DOUBLE * {ot}", 2)
    if s == "deal_size_category":
        return banded(inp, "Amount", 0, [(5000, "Small"), (25000, "Medium"), (100000, "Large")], "Enterprise",
                      "Unknown")
    if s == "velocity_score":
        return banded(inp, "DaysInStage", 0, [(15, 1.0), (30, 0.7), (60, 0.4)], 0.1, 0.5)
    if s == "win_probability_model":
        stage = ("coalesce((CASE " + inp.text("Stage", "") + " " + " ".join(
            f"WHEN {S.q(k)} THEN {D(v)}" for k, v in K.STAGE_PROBABILITY.items()) + " END), 0.3::DOUBLE)")
        return R(f"0.7::DOUBLE * {stage} + 0.3::DOUBLE * {sql_source(inp, 'velocity_score')}", 2)
    if s == "industry_code":
        return lookup(inp, K.INDUSTRY_CODE, K.INDUSTRY_CODE_DEFAULT)
    if s == "competitive_risk":
        return R(f"1.0::DOUBLE - {sql_source(inp, 'velocity_score')}", 2)
    if s == "schedule_risk_score":
        return R(f"1.0::DOUBLE - {value_or(inp, 'CompletionPct', 0, 0)} / 100.0::DOUBLE", 2)
    if s == "resource_utilization":
        names = ["EstimatedHours", "ActualHours"]
        est, act = inp.num("EstimatedHours", 1)[0], inp.num("ActualHours", 0)[0]
        val = f"(CASE WHEN {est} = 0 THEN 0.0::DOUBLE ELSE {R(f'{act} / {est}', 2)} END)"
        nv = "0.0::DOUBLE" if inp.null_policy == "bad" else "NULL"
        return f"(CASE WHEN {is_bad(inp, names)} THEN 0.0::DOUBLE WHEN {null_bad(inp, names)} THEN {nv} ELSE {val} END)"
    if s == "dependency_chain_depth":
        if "Dependencies" not in inp.cols:
            return "0"
        d = "CAST(Dependencies AS VARCHAR)"
        return f"(CASE WHEN {d} IS NULL OR {d} IN ('nan', 'None', '') THEN 0 ELSE CAST(len(string_split({d}, ',')) AS INTEGER) END)"
    if s == "burndown_rate":
        names = ["CompletionPct", "EstimatedHours", "ActualHours"]
        pct, est, act = inp.num("CompletionPct", 0)[0], inp.num("EstimatedHours", 1)[0], inp.num("ActualHours", 0)[0]
        val = (f"(CASE WHEN {act} = 0 THEN 0.0::DOUBLE ELSE "
               f"{R(f'({pct} / 100.0::DOUBLE) / greatest({act} / greatest({est}, 1.0::DOUBLE), 0.01::DOUBLE)', 2)} END)")
        nv = "0.5::DOUBLE" if inp.null_policy == "bad" else "NULL"
        return f"(CASE WHEN {is_bad(inp, names)} THEN 0.5::DOUBLE WHEN {null_bad(inp, names)} THEN {nv} ELSE {val} END)"
    if s == "delay_probability":
        return R(f"{sql_source(inp, 'schedule_risk_score')} * (1.0::DOUBLE / greatest("
                 f"{sql_source(inp, 'burndown_rate')}, 0.1::DOUBLE))", 2)
    if s == "sla_compliance_flag":
        names = ["SLATarget", "EscalationLevel"]
        esc = inp.num("EscalationLevel", 0)[0]
        nv = "'Unknown'" if inp.null_policy == "bad" else "'Compliant'"
        return (f"(CASE WHEN {is_bad(inp, names)} THEN 'Unknown' WHEN {null_bad(inp, names)} THEN {nv} "
                f"WHEN {esc} > 2 THEN 'Breached' ELSE 'Compliant' END)")
    if s == "mttr_band":
        v, raw = inp.num("EscalationLevel", 0)
        body = (f"WHEN {v} = 0 THEN 'Fast' WHEN {v} <= 1 THEN 'Normal' WHEN {v} <= 3 THEN 'Slow' "
                f"WHEN {v} IS NOT NULL THEN 'Critical'")
        if raw is None:
            return f"(CASE {body} END)"
        nv = "'Normal'" if inp.null_policy == "bad" else "'Critical'"
        return f"(CASE {body} WHEN {raw} IS NULL THEN {nv} ELSE 'Normal' END)"
    if s == "escalation_path":
        return lookup(inp, K.ESCALATION_PATH)
    if s == "incident_severity_score":
        return ("coalesce((CASE " + inp.text("Priority", "P3-Medium") + " " + " ".join(
            f"WHEN {S.q(k)} THEN {D(v)}" for k, v in K.PRIORITY_SEVERITY.items()) + " END), 0.4::DOUBLE)")
    if s == "recurring_pattern_flag":
        return f"({inp.text('Category', '')} IN ({', '.join(S.q(c) for c in K.RECURRING_CATEGORIES)}))"
    raise ValueError(s)


def _one_sql(source: str) -> str:
    d = DOMAIN_OF[source]
    inp = SqlInputs(K.DOMAIN_COLUMNS[d], TYPED)
    return S.with_fixtures([f"dom_{d}"], f"SELECT {DOMAIN_KEYS[d]}, {sql_source(inp, source)} AS {source} FROM dom_{d}")


for _s, _d in DOMAIN_OF.items():
    register(f"enr_{_s}", lambda s=_s: _one_sql(s))(
        lambda spark, sf, s=_s, d=_d: X.domain_table(spark, sf, d).select(
            DOMAIN_KEYS[d], E.enrichment_column(X.domain_table(spark, sf, d), s).alias(s)))


_USER_KINDS = ("column", "sql", "arrow")


def _recurring(categories):
    """The recurring-pattern rule on pandas series, built where the categories are known."""
    def flag(category):
        return category.isin(categories)
    return flag


def _user_functions(spark):
    """One user function of each kind, all with the rule of a built-in source."""
    functions = FunctionRegistry(spark, list(E.SOURCES))
    names = K.RECURRING_CATEGORIES
    functions.column("flag_column", "Category string", "boolean", lambda c: F.coalesce(c["Category"].isin(names), F.lit(False)))
    functions.sql("flag_sql", "Category string", "boolean", f"coalesce(Category IN ({', '.join(S.q(n) for n in names)}), false)")
    functions.arrow("flag_arrow", "Category string", "boolean", _recurring(names))
    return functions


@register("enr_user_functions", lambda: "SELECT *, " + ", ".join(f"recurring_pattern_flag AS flag_{k}" for k in _USER_KINDS)
          + f" FROM ({_one_sql('recurring_pattern_flag')})")
def enr_user_functions(spark, sf):
    """A user function of each kind beside the built-in source that it equals."""
    df = X.domain_table(spark, sf, "it_ops")
    names = ["recurring_pattern_flag", *(f"flag_{k}" for k in _USER_KINDS)]
    return E.enrich(df, names, functions=_user_functions(spark)).select(DOMAIN_KEYS["it_ops"], *names)


def _all_sql(d: str, null_policy: str) -> str:
    ctes, last = corrupted_domain_ctes(d)
    inp = SqlInputs(K.DOMAIN_COLUMNS[d], set(), null_policy)
    srcs = ", ".join(f"{sql_source(inp, s)} AS {s}" for s in K.ENRICHMENT_SOURCES[d])
    return S.with_fixtures([f"dom_{d}"], f"SELECT {DOMAIN_KEYS[d]}, _copy, {srcs} FROM {last}", ctes)


def _all(spark, sf, d, null_policy):
    df = corrupted_domain(spark, sf, d)
    return E.enrich_domain(df, d, null_policy).select(DOMAIN_KEYS[d], "_copy", *K.ENRICHMENT_SOURCES[d])


for _d in K.ENRICHMENT_SOURCES:
    register(f"enr_all_for_domain_{_d}", lambda d=_d: _all_sql(d, "bad"))(
        lambda spark, sf, d=_d: _all(spark, sf, d, "bad"))
    register(f"enr_all_fallthrough_{_d}", lambda d=_d: _all_sql(d, "fallthrough"))(
        lambda spark, sf, d=_d: _all(spark, sf, d, "fallthrough"))


def _gain_sql() -> str:
    parts = []
    for d in K.ENRICHMENT_SOURCES:
        inp = SqlInputs(K.DOMAIN_COLUMNS[d], TYPED)
        srcs = K.ENRICHMENT_SOURCES[d]
        nn = " + ".join(f"count({sql_source(inp, s)})" for s in srcs)
        n0 = len(K.DOMAIN_COLUMNS[d]) + (2 if d == "hr" else 0)
        parts.append(f"SELECT '{d}' AS domain, count(*) AS n_rows, {n0} AS initial_columns, {len(srcs)} AS added_columns, "
                     f"{R(f'{len(srcs)} / {n0}', 4)} AS information_gain, "
                     f"{R(f'({nn}) / (count(*) * {len(srcs)})', 4)} AS value_coverage FROM dom_{d}")
    return S.with_fixtures([f"dom_{d}" for d in K.ENRICHMENT_SOURCES], " UNION ALL ".join(parts))


@register("enr_information_gain", _gain_sql)
def enr_information_gain(spark, sf):
    """Per domain: added / initial columns, and the share of enriched cells
    that carry a value (one aggregation per domain view)."""
    out = None
    for d, srcs in K.ENRICHMENT_SOURCES.items():
        df = X.domain_table(spark, sf, d)
        n0 = len(df.columns)
        enriched = E.enrich_domain(df, d)
        nn = sum((F.count(F.col(s)) for s in srcs[1:]), F.count(F.col(srcs[0])))
        row = enriched.agg(
            F.lit(d).alias("domain"), F.count(F.lit(1)).alias("n_rows"), F.lit(n0).alias("initial_columns"),
            F.lit(len(srcs)).alias("added_columns"), F.round(F.lit(len(srcs) / n0), 4).alias("information_gain"),
            F.round(nn / (F.count(F.lit(1)) * len(srcs)), 4).alias("value_coverage"))
        out = row if out is None else out.unionByName(row)
    return out
