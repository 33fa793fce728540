"""Enrichment sources: derived columns and small lookups per domain.

Every source is one ``Column`` built from ``when`` chains, literal maps and
arithmetic, so ``enrich_domain`` is a single projection (no per-row Python,
no join: the lookup tables have 4-7 keys and travel inside the plan).

Input handling per source: a column that is **absent** yields the source's
default; an **unparseable** value yields the "bad" value. NULL follows
``null_policy``: ``"bad"`` (default) treats it as unparseable, while
``"fallthrough"`` reproduces NaN semantics (every comparison false, so the
last branch wins, and arithmetic stays NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import constants as K
from tessera.functions.exprs import dtype_of, literal_map, parse_double


class Inputs:
    def __init__(self, df: DataFrame, null_policy: str = "bad"):
        self.df = df
        self.cols = df.columns
        self.null_policy = null_policy
        self.parsed: dict[str, Column] = {}  # numbers that are columns already

    def num(self, name: str, absent: float) -> tuple[Column, Column | None]:
        if name not in self.cols:
            return F.lit(float(absent)), None
        if name in self.parsed:
            return self.parsed[name], F.col(name)
        return parse_double(F.col(name), dtype_of(self.df, name)), F.col(name)

    def text(self, name: str, absent: str) -> Column:
        """``str(value)``: NULL reads as the text 'None', absent as ``absent``."""
        if name not in self.cols:
            return F.lit(absent)
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    def string_columns(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.StringType)
                and not f.name.startswith("_")]


def _banded(inp: Inputs, name: str, absent: float, bands: list, last, bad) -> Column:
    v, raw = inp.num(name, absent)
    expr = None
    for thr, label in bands:
        expr = F.when(v < thr, F.lit(label)) if expr is None else expr.when(v < thr, F.lit(label))
    expr = expr.when(v.isNotNull(), F.lit(last))
    if raw is None:
        return expr
    null_val = bad if inp.null_policy == "bad" else last
    return expr.when(raw.isNull(), F.lit(null_val)).otherwise(F.lit(bad))


def _value_or(inp: Inputs, name: str, absent: float, bad: float) -> Column:
    """Parsed value; unparseable -> ``bad``; NULL -> ``bad`` or NULL."""
    v, raw = inp.num(name, absent)
    if raw is None:
        return v
    if inp.null_policy == "bad":
        return F.coalesce(v, F.lit(float(bad)))
    return F.when(raw.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(v, F.lit(float(bad))))


def _lookup(inp: Inputs, table: dict, default=None) -> Column:
    """First column, in table order, whose text is a key of ``table``."""
    m = literal_map(table)
    hits = [F.try_element_at(m, F.col(c)) for c in inp.string_columns()]
    if default is not None:
        hits.append(F.lit(default))
    if not hits:
        return F.lit(None)
    return F.coalesce(*hits) if len(hits) > 1 else hits[0]


# ------------------------------------------------------------------- hr
def salary_band(inp: Inputs) -> Column:
    return _banded(inp, "MonthlyIncome", 0, [(3000, "Entry"), (6000, "Mid"), (10000, "Senior")], "Executive",
                   "Unknown")


def tenure_risk(inp: Inputs) -> Column:
    return _banded(inp, "YearsAtCompany", 0, [(2, 0.8), (5, 0.4), (10, 0.2)], 0.3, 0.5)


def satisfaction_index(inp: Inputs) -> Column:
    return F.round(_value_or(inp, "JobSatisfaction", 3, 3) / 4.0, 2)


def industry_benchmark(inp: Inputs) -> Column:
    return _lookup(inp, K.INDUSTRY_BENCHMARK).cast("long")


def flight_risk_score(inp: Inputs) -> Column:
    overtime = F.when(F.lower(inp.text("OverTime", "No")) == "yes", 0.3).otherwise(0.0)
    return F.round(0.4 * tenure_risk(inp) + 0.4 * (1 - satisfaction_index(inp)) + 0.2 * overtime, 2)


# ---------------------------------------------------------------- sales
def deal_size_category(inp: Inputs) -> Column:
    return _banded(inp, "Amount", 0, [(5000, "Small"), (25000, "Medium"), (100000, "Large")], "Enterprise",
                   "Unknown")


def velocity_score(inp: Inputs) -> Column:
    return _banded(inp, "DaysInStage", 0, [(15, 1.0), (30, 0.7), (60, 0.4)], 0.1, 0.5)


def win_probability_model(inp: Inputs) -> Column:
    stage = F.coalesce(F.try_element_at(literal_map(K.STAGE_PROBABILITY), inp.text("Stage", "")), F.lit(0.3))
    return F.round(0.7 * stage + 0.3 * velocity_score(inp), 2)


def industry_code(inp: Inputs) -> Column:
    return _lookup(inp, K.INDUSTRY_CODE, K.INDUSTRY_CODE_DEFAULT)


def competitive_risk(inp: Inputs) -> Column:
    return F.round(1.0 - velocity_score(inp), 2)


# ------------------------------------------------------------------- pm
def schedule_risk_score(inp: Inputs) -> Column:
    return F.round(1.0 - _value_or(inp, "CompletionPct", 0, 0) / 100.0, 2)


def resource_utilization(inp: Inputs) -> Column:
    names = ["EstimatedHours", "ActualHours"]
    est = inp.num("EstimatedHours", 1)[0]
    act = inp.num("ActualHours", 0)[0]
    val = F.when(est == 0, F.lit(0.0)).otherwise(F.round(act / est, 2))
    null_val = F.lit(0.0 if inp.null_policy == "bad" else None).cast("double")
    return F.when(_is_bad(inp, names), F.lit(0.0)).when(_null_bad(inp, names), null_val).otherwise(val)


def _is_bad(inp: Inputs, names: list[str]) -> Column:
    cond = F.lit(False)
    for n in names:
        v, raw = inp.num(n, 0)
        if raw is not None:
            cond = cond | (raw.isNotNull() & v.isNull())
    return cond


def _null_bad(inp: Inputs, names: list[str]) -> Column:
    """Any NULL input (only meaningful when no input is unparseable)."""
    cond = F.lit(False)
    for n in names:
        _, raw = inp.num(n, 0)
        if raw is not None:
            cond = cond | raw.isNull()
    return cond & ~_is_bad(inp, names)


def dependency_chain_depth(inp: Inputs) -> Column:
    if "Dependencies" not in inp.cols:
        return F.lit(0)
    d = F.col("Dependencies").cast("string")
    return F.when(d.isNull() | d.isin("nan", "None", ""), F.lit(0)).otherwise(F.size(F.split(d, ",")))


def burndown_rate(inp: Inputs) -> Column:
    names = ["CompletionPct", "EstimatedHours", "ActualHours"]
    pct = inp.num("CompletionPct", 0)[0]
    est = inp.num("EstimatedHours", 1)[0]
    act = inp.num("ActualHours", 0)[0]
    val = F.when(act == 0, F.lit(0.0)).otherwise(
        F.round((pct / 100.0) / F.greatest(act / F.greatest(est, F.lit(1.0)), F.lit(0.01)), 2))
    nb = _null_bad(inp, names)
    null_val = F.lit(0.5 if inp.null_policy == "bad" else None).cast("double")
    return F.when(_is_bad(inp, names), F.lit(0.5)).when(nb, null_val).otherwise(val)


def delay_probability(inp: Inputs) -> Column:
    return F.round(schedule_risk_score(inp) * (1.0 / F.greatest(burndown_rate(inp), F.lit(0.1))), 2)


# --------------------------------------------------------------- it_ops
def sla_compliance_flag(inp: Inputs) -> Column:
    names = ["SLATarget", "EscalationLevel"]
    esc = inp.num("EscalationLevel", 0)[0]
    val = F.when(esc > 2, F.lit("Breached")).otherwise(F.lit("Compliant"))
    null_val = F.lit("Unknown" if inp.null_policy == "bad" else "Compliant")
    return F.when(_is_bad(inp, names), F.lit("Unknown")).when(_null_bad(inp, names), null_val).otherwise(val)


def mttr_band(inp: Inputs) -> Column:
    v, raw = inp.num("EscalationLevel", 0)
    expr = (F.when(v == 0, F.lit("Fast")).when(v <= 1, F.lit("Normal")).when(v <= 3, F.lit("Slow"))
            .when(v.isNotNull(), F.lit("Critical")))
    if raw is None:
        return expr
    null_val = "Normal" if inp.null_policy == "bad" else "Critical"
    return expr.when(raw.isNull(), F.lit(null_val)).otherwise(F.lit("Normal"))


def escalation_path(inp: Inputs) -> Column:
    return _lookup(inp, K.ESCALATION_PATH)


def incident_severity_score(inp: Inputs) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.PRIORITY_SEVERITY), inp.text("Priority", "P3-Medium")),
                      F.lit(0.4))


def recurring_pattern_flag(inp: Inputs) -> Column:
    return inp.text("Category", "").isin(K.RECURRING_CATEGORIES)


SOURCES = {
    "salary_band": salary_band, "tenure_risk": tenure_risk, "satisfaction_index": satisfaction_index,
    "industry_benchmark": industry_benchmark, "flight_risk_score": flight_risk_score,
    "deal_size_category": deal_size_category, "velocity_score": velocity_score,
    "win_probability_model": win_probability_model, "industry_code": industry_code,
    "competitive_risk": competitive_risk, "schedule_risk_score": schedule_risk_score,
    "resource_utilization": resource_utilization, "dependency_chain_depth": dependency_chain_depth,
    "burndown_rate": burndown_rate, "delay_probability": delay_probability,
    "sla_compliance_flag": sla_compliance_flag, "mttr_band": mttr_band, "escalation_path": escalation_path,
    "incident_severity_score": incident_severity_score, "recurring_pattern_flag": recurring_pattern_flag,
}


#: Columns that sources read as numbers.
NUMERIC_INPUTS = ["MonthlyIncome", "YearsAtCompany", "JobSatisfaction", "Amount", "DaysInStage", "CompletionPct",
                  "EstimatedHours", "ActualHours", "SLATarget", "EscalationLevel"]


def enrichment_column(df: DataFrame, source: str, null_policy: str = "bad") -> Column:
    if source not in SOURCES:
        raise ValueError(f"Unknown enrichment source '{source}'")
    return SOURCES[source](Inputs(df, null_policy))


def enrich(df: DataFrame, sources: list[str], null_policy: str = "bad", functions=None) -> DataFrame:
    """Add the given sources as columns in one projection. ``functions`` (a
    ``FunctionRegistry``) names user functions that are sources as well."""
    inp = Inputs(df, null_policy)
    unknown = [s for s in sources if s not in SOURCES and (functions is None or s not in functions)]
    if unknown:
        raise ValueError(f"Unknown enrichment source '{unknown[0]}'")
    # text that several sources read as numbers is parsed once, in a projection before theirs
    texts = [c for c in NUMERIC_INPUTS if c in inp.string_columns()]
    inp.parsed = {c: F.col(f"_n_{c}") for c in texts}
    parsed = df.withColumns({f"_n_{c}": parse_double(F.col(c)) for c in texts}) if texts else df
    out = parsed.withColumns({s: SOURCES[s](inp) if s in SOURCES else functions[s].column(df) for s in sources})
    return out.drop(*(f"_n_{c}" for c in texts))


def enrich_domain(df: DataFrame, domain: str, null_policy: str = "bad") -> DataFrame:
    return enrich(df, K.ENRICHMENT_SOURCES[domain], null_policy)


def registry(spark) -> DataFrame:
    """(domain, source) dimension of the available enrichments."""
    rows = [(d, s) for d, srcs in K.ENRICHMENT_SOURCES.items() for s in srcs]
    return spark.createDataFrame(rows, "domain string, source string")
