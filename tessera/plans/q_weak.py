"""Weak-supervision queries over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import weak as W
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.q_corrupt import DOMAIN_KEYS, corrupted_domain, corrupted_domain_ctes
from tessera.plans.q_enrich import TYPED
from tessera.sources import fixtures as X

HR_EXTRA = ["EmployeeCount", "StandardHours"]
BAD, GOOD, ABSTAIN = K.BAD, K.GOOD, K.ABSTAIN


class SqlRow:
    def __init__(self, cols: list[str], typed: set[str]):
        self.cols, self.typed = cols, typed

    def has(self, n):
        return n in self.cols

    def raw(self, n):
        return n if self.has(n) else "NULL"

    def num(self, n, absent=None):
        if not self.has(n):
            return "NULL::DOUBLE" if absent is None else f"{float(absent)!r}::DOUBLE"
        return S.parse_double(n, n in self.typed)

    def bad(self, n):
        if not self.has(n):
            return "FALSE"
        return f"({n} IS NOT NULL AND {self.num(n)} IS NULL)"

    def int_strict(self, n):
        if n in self.typed:
            return f"TRY_CAST(trunc(CAST({n} AS DOUBLE)) AS BIGINT)"
        s = f"CAST({n} AS VARCHAR)"
        return f"(CASE WHEN regexp_matches({s}, {S.q(W.INT_PATTERN)}) THEN TRY_CAST(trim({s}) AS BIGINT) END)"

    def text(self, n, absent=""):
        return f"coalesce(CAST({n} AS VARCHAR), 'None')" if self.has(n) else S.q(absent)


def trunc(v):
    return f"(CASE WHEN {v} >= 0 THEN floor({v}) ELSE ceil({v}) END)"


def present(r, n):
    return f"({r.raw(n)} IS NOT NULL AND {S.ws_trim(f'CAST({r.raw(n)} AS VARCHAR)')} <> '')"


def inl(vals):
    return "(" + ", ".join(S.q(v) for v in vals) + ")"


def lf_sql(r: SqlRow, name: str) -> str:
    if name == "lf_hr_constant_columns":
        parts = [f"({n} IS NOT NULL AND ({r.int_strict(n)} IS NULL OR {r.int_strict(n)} <> {e}))"
                 for n, e in (("EmployeeCount", 1), ("StandardHours", 80)) if r.has(n)]
        cond = " OR ".join(parts) or "FALSE"
        return f"(CASE WHEN {cond} THEN {BAD} ELSE {ABSTAIN} END)"
    if name == "lf_hr_salary_range":
        return f"(CASE WHEN {r.num('MonthlyIncome')} BETWEEN 1000 AND 20000 THEN {GOOD} ELSE {BAD} END)"
    if name == "lf_hr_age_range":
        return f"(CASE WHEN {r.num('Age')} BETWEEN 18 AND 65 THEN {GOOD} ELSE {BAD} END)"
    if name == "lf_hr_satisfaction_range":
        return (f"(CASE WHEN {r.raw('JobSatisfaction')} IS NULL THEN {ABSTAIN} "
                f"WHEN {trunc(r.num('JobSatisfaction'))} BETWEEN 1 AND 4 THEN {GOOD} ELSE {BAD} END)")
    if name == "lf_hr_years_nonnegative":
        return f"(CASE WHEN {r.num('YearsAtCompany')} >= 0 THEN {GOOD} ELSE {BAD} END)"
    if name == "lf_sales_null_account":
        p = present(r, "AccountName")
        return (f"(CASE WHEN {r.text('Stage')} IN ('Won', 'Negotiation') AND NOT {p} THEN {BAD} "
                f"WHEN {p} THEN {GOOD} ELSE {ABSTAIN} END)")
    if name == "lf_sales_spelling":
        return f"(CASE WHEN {r.text('Product')} IN {inl(K.SALES_BAD_SPELLINGS)} THEN {BAD} ELSE {ABSTAIN} END)"
    if name == "lf_sales_close_value_stage":
        return (f"(CASE WHEN {r.text('Stage')} = 'Won' THEN (CASE WHEN {r.num('Amount')} > 0 THEN {GOOD} "
                f"ELSE {BAD} END) ELSE {ABSTAIN} END)")
    if name == "lf_sales_probability_range":
        return (f"(CASE WHEN {r.raw('Probability')} IS NULL THEN {ABSTAIN} "
                f"WHEN {r.num('Probability')} BETWEEN 0 AND 100 THEN {GOOD} ELSE {BAD} END)")
    if name == "lf_sales_amount_positive":
        return (f"(CASE WHEN {r.raw('Amount')} IS NULL THEN {ABSTAIN} WHEN {r.num('Amount')} >= 0 THEN {GOOD} "
                f"ELSE {BAD} END)")
    if name == "lf_itops_sla_breach":
        sla = r.num("SLATarget")
        return (f"(CASE WHEN {r.raw('ResolvedDate')} IS NULL THEN {ABSTAIN} "
                f"WHEN {r.raw('SLATarget')} IS NOT NULL AND ({sla} IS NULL OR {sla} < 0) THEN {BAD} ELSE {GOOD} END)")
    if name == "lf_itops_missing_resolution":
        return (f"(CASE WHEN {r.text('Status')} IN ('Closed', 'Resolved') THEN (CASE WHEN {present(r, 'ResolvedDate')} "
                f"THEN {GOOD} ELSE {BAD} END) ELSE {ABSTAIN} END)")
    if name == "lf_itops_reassignment_count":
        v = r.num("EscalationLevel")
        return (f"(CASE WHEN {r.raw('EscalationLevel')} IS NULL THEN {ABSTAIN} WHEN {trunc(v)} > 5 THEN {BAD} "
                f"WHEN {v} IS NOT NULL THEN {GOOD} ELSE {BAD} END)")
    if name == "lf_itops_priority_valid":
        p = r.text("Priority")
        return (f"(CASE WHEN {p} IN {inl(K.VALID_IT_PRIORITIES)} THEN {GOOD} WHEN {S.ws_trim(p)} = '' "
                f"THEN {ABSTAIN} ELSE {BAD} END)")
    if name == "lf_pm_budget_overrun":
        act, est = r.num("ActualHours", 0.0), r.num("EstimatedHours", 0.0)
        return (f"(CASE WHEN {r.bad('ActualHours')} OR {r.bad('EstimatedHours')} THEN {BAD} "
                f"WHEN {est} > 0 AND {act} > {est} * 2 THEN {BAD} WHEN {est} > 0 AND {act} <= {est} THEN {GOOD} "
                f"ELSE {ABSTAIN} END)")
    if name == "lf_pm_progress_status_mismatch":
        pct, st = r.num("CompletionPct", 0.0), r.text("Status")
        return (f"(CASE WHEN {r.bad('CompletionPct')} THEN {BAD} WHEN {st} = 'Not Started' AND {pct} > 0 THEN {BAD} "
                f"WHEN {st} = 'Completed' AND {pct} < 100 THEN {BAD} ELSE {GOOD} END)")
    if name == "lf_pm_completion_range":
        return f"(CASE WHEN {r.num('CompletionPct')} BETWEEN 0 AND 100 THEN {GOOD} ELSE {BAD} END)"
    if name == "lf_pm_hours_positive":
        parts = [f"({n} IS NOT NULL AND ({r.num(n)} IS NULL OR {r.num(n)} < 0))"
                 for n in ("EstimatedHours", "ActualHours") if r.has(n)]
        return f"(CASE WHEN {' OR '.join(parts) or 'FALSE'} THEN {BAD} ELSE {GOOD} END)"
    raise ValueError(name)


def _cols(d):
    return K.DOMAIN_COLUMNS[d] + (HR_EXTRA if d == "hr" else [])


def _row(d):
    return SqlRow(_cols(d), TYPED)


def majority_sql(votes: list[str]) -> str:
    good = " + ".join(f"(CASE WHEN {v} = {GOOD} THEN 1 ELSE 0 END)" for v in votes)
    bad = " + ".join(f"(CASE WHEN {v} = {BAD} THEN 1 ELSE 0 END)" for v in votes)
    return f"(CASE WHEN ({good}) > ({bad}) THEN {GOOD} WHEN ({bad}) > ({good}) THEN {BAD} ELSE {ABSTAIN} END)"


def good_share_sql(votes: list[str]) -> str:
    good = " + ".join(f"(CASE WHEN {v} = {GOOD} THEN 1 ELSE 0 END)" for v in votes)
    cast = " + ".join(f"(CASE WHEN {v} <> {ABSTAIN} THEN 1 ELSE 0 END)" for v in votes)
    return f"(CASE WHEN ({cast}) > 0 THEN ({good}) / ({cast}) ELSE 0.5 END)"


for _d, _lfs in W.DOMAIN_LFS.items():
    for _lf in _lfs:
        register(_lf.__name__, lambda d=_d, n=_lf.__name__: S.with_fixtures(
            [f"dom_{d}"], f"SELECT {DOMAIN_KEYS[d]}, {lf_sql(_row(d), n)} AS vote FROM dom_{d}"))(
            lambda spark, sf, d=_d, lf=_lf: X.domain_table(spark, sf, d).select(
                DOMAIN_KEYS[d], lf(W.Row(X.domain_table(spark, sf, d))).alias("vote")))

    register(f"lf_apply_domain_{_d}", lambda d=_d: S.with_fixtures(
        [f"dom_{d}"], f"SELECT *, {majority_sql([lf_sql(_row(d), lf.__name__) for lf in W.DOMAIN_LFS[d]])} "
                      f"AS _dq_label FROM dom_{d}"))(
        lambda spark, sf, d=_d: W.label_domain(X.domain_table(spark, sf, d), d))


def _dist_sql() -> str:
    parts = [f"SELECT '{d}' AS domain, {majority_sql([lf_sql(_row(d), lf.__name__) for lf in lfs])} AS label "
             f"FROM dom_{d}" for d, lfs in W.DOMAIN_LFS.items()]
    return S.with_fixtures([f"dom_{d}" for d in W.DOMAIN_LFS],
                           "SELECT domain, label, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL")


@register("lf_label_distribution", _dist_sql)
def lf_label_distribution(spark, sf):
    out = None
    for d in W.DOMAIN_LFS:
        lab = W.label_domain(X.domain_table(spark, sf, d), d).select(F.lit(d).alias("domain"),
                                                                     F.col("_dq_label").alias("label"))
        out = lab if out is None else out.unionByName(lab)
    return out.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"))


def _score_sql() -> str:
    parts = [f"SELECT '{d}' AS domain, {S.sround(f'avg({good_share_sql([lf_sql(_row(d), lf.__name__) for lf in lfs])})', 4)} "
             f"AS lf_dq_score FROM dom_{d}" for d, lfs in W.DOMAIN_LFS.items()]
    return S.with_fixtures([f"dom_{d}" for d in W.DOMAIN_LFS], " UNION ALL ".join(parts))


@register("lf_dq_score", _score_sql)
def lf_dq_score(spark, sf):
    out = None
    for d in W.DOMAIN_LFS:
        s = W.lf_dq_score(X.domain_table(spark, sf, d), d).select(F.lit(d).alias("domain"), "lf_dq_score")
        out = s if out is None else out.unionByName(s)
    return out


def _matrix_sql() -> str:
    parts = []
    for d, lfs in W.DOMAIN_LFS.items():
        names = [lf.__name__ for lf in lfs]
        votes = {n: lf_sql(_row(d), n) for n in names}
        inner = f"SELECT {', '.join(f'{v} AS {n}' for n, v in votes.items())} FROM dom_{d}"
        for n in names:
            others = [o for o in names if o != n]
            any_o = " OR ".join(f"{o} <> {ABSTAIN}" for o in others) or "FALSE"
            diff = " OR ".join(f"({o} <> {ABSTAIN} AND {o} <> {n})" for o in others) or "FALSE"
            parts.append(
                f"SELECT '{d}' AS domain, '{n}' AS lf, "
                f"{S.sround(f'avg(CASE WHEN {n} <> {ABSTAIN} THEN 1.0 ELSE 0.0 END)', 4)} AS coverage, "
                f"{S.sround(f'avg(CASE WHEN {n} <> {ABSTAIN} AND ({any_o}) THEN 1.0 ELSE 0.0 END)', 4)} AS overlap, "
                f"{S.sround(f'avg(CASE WHEN {n} <> {ABSTAIN} AND ({diff}) THEN 1.0 ELSE 0.0 END)', 4)} AS conflict "
                f"FROM ({inner})")
    return S.with_fixtures([f"dom_{d}" for d in W.DOMAIN_LFS], " UNION ALL ".join(parts))


@register("lf_matrix_stats", _matrix_sql)
def lf_matrix_stats(spark, sf):
    out = None
    for d in W.DOMAIN_LFS:
        s = W.lf_matrix_stats(X.domain_table(spark, sf, d), d)
        out = s if out is None else out.unionByName(s)
    return out


# generic LFs over the corrupted sales table (nulls and junk in numerics)
_GEN = {
    "lf_critical_nulls": lambda r, d: W.lf_critical_nulls(r, K.DOMAIN_COLUMNS[d][:3]),
    "lf_type_mismatch": lambda r, d: W.lf_type_mismatch(r, K.DOMAIN_NUMERIC[d]),
    "lf_all_fields_valid": lambda r, d: W.lf_all_fields_valid(r, K.DOMAIN_COLUMNS[d]),
}


def _gen_sql(name: str, d: str = "sales") -> str:
    r = SqlRow(K.DOMAIN_COLUMNS[d], set())
    if name == "lf_critical_nulls":
        cond = " OR ".join(f"{c} IS NULL" for c in K.DOMAIN_COLUMNS[d][:3])
        e = f"(CASE WHEN {cond} THEN {BAD} ELSE {ABSTAIN} END)"
    elif name == "lf_type_mismatch":
        cond = " OR ".join(r.bad(c) for c in K.DOMAIN_NUMERIC[d])
        e = f"(CASE WHEN {cond} THEN {BAD} ELSE {ABSTAIN} END)"
    else:
        cond = " OR ".join(f"{c} IS NULL" for c in K.DOMAIN_COLUMNS[d])
        e = f"(CASE WHEN {cond} THEN {ABSTAIN} ELSE {GOOD} END)"
    ctes, last = corrupted_domain_ctes(d)
    return S.with_fixtures([f"dom_{d}"], f"SELECT {DOMAIN_KEYS[d]}, _copy, {e} AS vote FROM {last}", ctes)


for _n, _f in _GEN.items():
    register(_n, lambda n=_n: _gen_sql(n))(
        lambda spark, sf, f=_f: (lambda df: df.select(DOMAIN_KEYS["sales"], "_copy", f(W.Row(df), "sales").alias("vote")))(
            corrupted_domain(spark, sf, "sales")))
