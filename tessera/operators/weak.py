"""Weak supervision: labeling functions as vote columns, majority vote,
label statistics and a vote-based quality score.

Each labeling function (LF) is a ``when`` chain returning ABSTAIN (-1), BAD
(0) or GOOD (1) for a row; applying a set of LFs is one projection, and the
majority vote is integer arithmetic over the vote columns.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.exprs import dtype_of, is_numeric_type, parse_double, ws_trim

ABSTAIN, BAD, GOOD = K.ABSTAIN, K.BAD, K.GOOD
INT_PATTERN = r"^\s*[+-]?\d+\s*$"


class Row:
    """Typed access to a row's fields, mirroring ``row.get(name)``."""

    def __init__(self, df: DataFrame):
        self.df = df

    def has(self, name: str) -> bool:
        return name in self.df.columns

    def raw(self, name: str) -> Column:
        return F.col(name) if self.has(name) else F.lit(None)

    def num(self, name: str, absent: float | None = None) -> Column:
        """``float(value)``; unparseable and NULL give NULL."""
        if not self.has(name):
            return F.lit(absent).cast("double")
        return parse_double(F.col(name), dtype_of(self.df, name))

    def bad(self, name: str) -> Column:
        """Present, not NULL, but not a number."""
        if not self.has(name):
            return F.lit(False)
        return F.col(name).isNotNull() & self.num(name).isNull()

    def int_strict(self, name: str) -> Column:
        """``int(value)``: numbers truncate, text must be an integer literal."""
        c = F.col(name)
        if is_numeric_type(dtype_of(self.df, name)):
            return c.try_cast("long")
        s = c.cast("string")
        return F.when(s.rlike(INT_PATTERN), F.trim(s).try_cast("long"))

    def text(self, name: str, absent: str = "") -> Column:
        """``str(value)``: NULL reads 'None'."""
        if not self.has(name):
            return F.lit(absent)
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def trunc(v: Column) -> Column:
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))


def _vote(c: Column) -> Column:
    return c.cast("int")


# ---------------------------------------------------------------- hr LFs
def lf_hr_constant_columns(r: Row) -> Column:
    bad = F.lit(False)
    for name, expected in (("EmployeeCount", 1), ("StandardHours", 80)):
        if r.has(name):
            iv = r.int_strict(name)
            bad = bad | (F.col(name).isNotNull() & (iv.isNull() | (iv != expected)))
    return _vote(F.when(bad, BAD).otherwise(ABSTAIN))


def lf_hr_salary_range(r: Row) -> Column:
    return _vote(F.when(r.num("MonthlyIncome").between(1000, 20000), GOOD).otherwise(BAD))


def lf_hr_age_range(r: Row) -> Column:
    return _vote(F.when(r.num("Age").between(18, 65), GOOD).otherwise(BAD))


def lf_hr_satisfaction_range(r: Row) -> Column:
    return _vote(F.when(r.raw("JobSatisfaction").isNull(), ABSTAIN)
                 .when(trunc(r.num("JobSatisfaction")).between(1, 4), GOOD).otherwise(BAD))


def lf_hr_years_nonnegative(r: Row) -> Column:
    return _vote(F.when(r.num("YearsAtCompany") >= 0, GOOD).otherwise(BAD))


# ------------------------------------------------------------- sales LFs
def _present(r: Row, name: str) -> Column:
    return r.raw(name).isNotNull() & (ws_trim(r.raw(name).cast("string")) != "")


def lf_sales_null_account(r: Row) -> Column:
    present = _present(r, "AccountName")
    return _vote(F.when(r.text("Stage").isin("Won", "Negotiation") & ~present, BAD)
                 .when(present, GOOD).otherwise(ABSTAIN))


def lf_sales_spelling(r: Row) -> Column:
    return _vote(F.when(r.text("Product").isin(K.SALES_BAD_SPELLINGS), BAD).otherwise(ABSTAIN))


def lf_sales_close_value_stage(r: Row) -> Column:
    return _vote(F.when(r.text("Stage") == "Won", F.when(r.num("Amount") > 0, GOOD).otherwise(BAD))
                 .otherwise(ABSTAIN))


def lf_sales_probability_range(r: Row) -> Column:
    return _vote(F.when(r.raw("Probability").isNull(), ABSTAIN)
                 .when(r.num("Probability").between(0, 100), GOOD).otherwise(BAD))


def lf_sales_amount_positive(r: Row) -> Column:
    return _vote(F.when(r.raw("Amount").isNull(), ABSTAIN).when(r.num("Amount") >= 0, GOOD).otherwise(BAD))


# ------------------------------------------------------------ it_ops LFs
def lf_itops_sla_breach(r: Row) -> Column:
    sla_bad = r.raw("SLATarget").isNotNull() & (r.num("SLATarget").isNull() | (r.num("SLATarget") < 0))
    return _vote(F.when(r.raw("ResolvedDate").isNull(), ABSTAIN).when(sla_bad, BAD).otherwise(GOOD))


def lf_itops_missing_resolution(r: Row) -> Column:
    return _vote(F.when(r.text("Status").isin("Closed", "Resolved"),
                        F.when(_present(r, "ResolvedDate"), GOOD).otherwise(BAD)).otherwise(ABSTAIN))


def lf_itops_reassignment_count(r: Row) -> Column:
    v = r.num("EscalationLevel")
    return _vote(F.when(r.raw("EscalationLevel").isNull(), ABSTAIN).when(trunc(v) > 5, BAD)
                 .when(v.isNotNull(), GOOD).otherwise(BAD))


def lf_itops_priority_valid(r: Row) -> Column:
    p = r.text("Priority")
    return _vote(F.when(p.isin(K.VALID_IT_PRIORITIES), GOOD).when(ws_trim(p) == "", ABSTAIN).otherwise(BAD))


# ---------------------------------------------------------------- pm LFs
def lf_pm_budget_overrun(r: Row) -> Column:
    act, est = r.num("ActualHours", 0.0), r.num("EstimatedHours", 0.0)
    return _vote(F.when(r.bad("ActualHours") | r.bad("EstimatedHours"), BAD)
                 .when((est > 0) & (act > est * 2), BAD).when((est > 0) & (act <= est), GOOD).otherwise(ABSTAIN))


def lf_pm_progress_status_mismatch(r: Row) -> Column:
    pct, status = r.num("CompletionPct", 0.0), r.text("Status")
    return _vote(F.when(r.bad("CompletionPct"), BAD).when((status == "Not Started") & (pct > 0), BAD)
                 .when((status == "Completed") & (pct < 100), BAD).otherwise(GOOD))


def lf_pm_completion_range(r: Row) -> Column:
    return _vote(F.when(r.num("CompletionPct").between(0, 100), GOOD).otherwise(BAD))


def lf_pm_hours_positive(r: Row) -> Column:
    bad = F.lit(False)
    for name in ("EstimatedHours", "ActualHours"):
        if r.has(name):
            bad = bad | (F.col(name).isNotNull() & (r.num(name).isNull() | (r.num(name) < 0)))
    return _vote(F.when(bad, BAD).otherwise(GOOD))


# ------------------------------------------------------------ generic LFs
def lf_critical_nulls(r: Row, critical: list[str]) -> Column:
    cond = F.lit(False)
    for c in critical:
        if r.has(c):
            cond = cond | F.col(c).isNull()
    return _vote(F.when(cond, BAD).otherwise(ABSTAIN))


def lf_type_mismatch(r: Row, numeric: list[str]) -> Column:
    cond = F.lit(False)
    for c in numeric:
        cond = cond | r.bad(c)
    return _vote(F.when(cond, BAD).otherwise(ABSTAIN))


def lf_all_fields_valid(r: Row, required: list[str]) -> Column:
    cond = F.lit(False)
    for c in required:
        if r.has(c):
            cond = cond | F.col(c).isNull()
    return _vote(F.when(cond, ABSTAIN).otherwise(GOOD))


DOMAIN_LFS: dict[str, list[Callable[[Row], Column]]] = {
    "hr": [lf_hr_constant_columns, lf_hr_salary_range, lf_hr_age_range, lf_hr_satisfaction_range,
           lf_hr_years_nonnegative],
    "sales": [lf_sales_null_account, lf_sales_spelling, lf_sales_close_value_stage, lf_sales_probability_range,
              lf_sales_amount_positive],
    "it_ops": [lf_itops_sla_breach, lf_itops_missing_resolution, lf_itops_reassignment_count,
               lf_itops_priority_valid],
    "pm": [lf_pm_budget_overrun, lf_pm_progress_status_mismatch, lf_pm_completion_range, lf_pm_hours_positive],
}


def apply_lfs(df: DataFrame, domain: str, functions=None, names: list[str] | None = None) -> DataFrame:
    """Add one vote column per domain LF (named after the LF), and one for each of the
    user functions ``names`` of ``functions`` (a ``FunctionRegistry``), which must give
    int votes."""
    r = Row(df)
    own = {name: functions[name] for name in names or []}
    for name, f in own.items():
        if f.returns.simpleString() != "int":
            raise TypeError(f"{name}: a vote is int")
    return df.withColumns({lf.__name__: lf(r) for lf in DOMAIN_LFS[domain]} | {name: f.column(df) for name, f in own.items()})


def majority_vote(votes: list[Column]) -> Column:
    """GOOD if more GOOD than BAD votes, BAD if more BAD, else ABSTAIN."""
    good = sum((F.when(v == GOOD, 1).otherwise(0) for v in votes[1:]), F.when(votes[0] == GOOD, 1).otherwise(0))
    bad = sum((F.when(v == BAD, 1).otherwise(0) for v in votes[1:]), F.when(votes[0] == BAD, 1).otherwise(0))
    return F.when(good > bad, GOOD).when(bad > good, BAD).otherwise(ABSTAIN).cast("int")


def label_domain(df: DataFrame, domain: str) -> DataFrame:
    """``_dq_label`` per row (0 when the domain has no LFs)."""
    lfs = DOMAIN_LFS.get(domain, [])
    if not lfs:
        return df.withColumn("_dq_label", F.lit(0))
    r = Row(df)
    return df.withColumn("_dq_label", majority_vote([lf(r) for lf in lfs]))


def row_good_share(votes: list[Column]) -> Column:
    """GOOD / non-abstain votes for a row, 0.5 when every LF abstains."""
    good = sum((F.when(v == GOOD, 1).otherwise(0) for v in votes[1:]), F.when(votes[0] == GOOD, 1).otherwise(0))
    cast = sum((F.when(v != ABSTAIN, 1).otherwise(0) for v in votes[1:]), F.when(votes[0] != ABSTAIN, 1).otherwise(0))
    return F.when(cast > 0, good / cast).otherwise(F.lit(0.5))


def lf_dq_score(df: DataFrame, domain: str) -> DataFrame:
    """Mean per-row GOOD share over the table (one aggregation)."""
    r = Row(df)
    votes = [lf(r) for lf in DOMAIN_LFS[domain]]
    return df.agg(F.round(F.avg(row_good_share(votes)), 4).alias("lf_dq_score"))


def lf_matrix_stats(df: DataFrame, domain: str) -> DataFrame:
    """Per LF: coverage (votes / rows), overlap (votes where another LF also
    votes), conflict (votes where another LF votes differently). One
    aggregation over the vote matrix, then a ``stack`` to long form."""
    r = Row(df)
    lfs = DOMAIN_LFS[domain]
    votes = {lf.__name__: lf(r) for lf in lfs}
    vm = df.select(*[v.alias(n) for n, v in votes.items()])
    aggs = []
    names = list(votes)
    for n in names:
        me = F.col(n)
        others = [F.col(o) for o in names if o != n]
        any_other = F.lit(False)
        diff = F.lit(False)
        for o in others:
            any_other = any_other | (o != ABSTAIN)
            diff = diff | ((o != ABSTAIN) & (o != me))
        voted = me != ABSTAIN
        aggs += [F.avg(F.when(voted, 1.0).otherwise(0.0)).alias(f"{n}__cov"),
                 F.avg(F.when(voted & any_other, 1.0).otherwise(0.0)).alias(f"{n}__ovl"),
                 F.avg(F.when(voted & diff, 1.0).otherwise(0.0)).alias(f"{n}__con")]
    wide = vm.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}__cov`, `{n}__ovl`, `{n}__con`" for n in names)
    return wide.select(F.expr(f"stack({len(names)}, {stack}) AS (lf, coverage, overlap, conflict)")).select(
        F.lit(domain).alias("domain"), "lf", F.round("coverage", 4).alias("coverage"),
        F.round("overlap", 4).alias("overlap"), F.round("conflict", 4).alias("conflict"))
