"""Profiles, DQ scores, quality score, gates, and the domain-family cleaning
operators (fill_null, fix_type, key dedup, standardize, trim, typo fixes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import clean as C
from tessera.operators import quality as Q
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.policy import ORDERS_POLICY, compile_policy
from tessera.plans.q_clean import _policy_ctes
from tessera.plans.q_corrupt import corrupted_domain, corrupted_domain_ctes
from tessera.session import stored
from tessera.sources import fixtures as X

DO = X.DIRTY_ORDERS_SPEC
DO_COLS = DO["columns"]
R = S.sround


def _orders(spark, sf):
    return X.dirty_orders(spark, sf)


def _w(body, ctes=None, names=("dirty_orders",)):
    return S.with_fixtures(list(names), body, ctes)


# ------------------------------------------------------------------ profiles
@register("profile_missing", lambda: _w(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing FROM dirty_orders" for c in DO_COLS)))
def profile_missing(spark, sf):
    return Q.profile_missing(_orders(spark, sf))


@register("profile_invalid_tokens", lambda: _w(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, "
    + (f"CAST(count_if({S.in_list(c, K.INVALID_TOKENS)}) AS BIGINT)" if c != "order_id" else "CAST(count_if(FALSE) AS BIGINT)")
    + " AS n_invalid FROM dirty_orders" for c in DO_COLS)))
def profile_invalid_tokens(spark, sf):
    return Q.profile_invalid_tokens(_orders(spark, sf))


@register("profile_duplicates", lambda: _w(
    f"SELECT count(*) - count(DISTINCT ({', '.join(DO_COLS)})) AS n_duplicates FROM dirty_orders"))
def profile_duplicates(spark, sf):
    return Q.profile_duplicates(_orders(spark, sf))


@register("profile_types")
def profile_types(spark, sf):
    """Schema rows (name, Spark type, expected flag); a plan-time operator."""
    return Q.profile_types(_orders(spark, sf), DO_COLS)


# Spark types of the dom_hr view (plan-time schema; mirrored here for the oracle)
HR_TYPES = {"EmployeeID": "string", "Age": "bigint", "Department": "string", "JobRole": "string",
            "MonthlyIncome": "double", "YearsAtCompany": "bigint", "Attrition": "string",
            "JobSatisfaction": "bigint", "OverTime": "string", "DistanceFromHome": "bigint", "Education": "bigint",
            "PerformanceRating": "bigint", "EmployeeCount": "int", "StandardHours": "int"}


@register("profile_schema_info", lambda: S.with_fixtures(["dom_hr"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(count_if({c} IS NULL) AS BIGINT) AS n_nulls, "
    f"'{'expected' if c in K.DOMAIN_COLUMNS['hr'] else 'extra'}' AS role FROM dom_hr" for c, t in HR_TYPES.items())))
def profile_schema_info(spark, sf):
    return Q.profile_schema_info(X.dom_hr(spark, sf), K.DOMAIN_COLUMNS["hr"])


PM_NUM = K.DOMAIN_NUMERIC["pm"]


@register("profile_numeric_summary", lambda: S.with_fixtures(["dom_pm"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, {R(f'avg({c})', 6)} AS mean, "
    f"{R(f'stddev_samp({c})', 6)} AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, "
    f"quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM dom_pm"
    for c in PM_NUM)))
def profile_numeric_summary(spark, sf):
    df = Q.profile_numeric_summary(X.dom_pm(spark, sf), PM_NUM)
    return df.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


SALES_CAT = [c for c in K.DOMAIN_COLUMNS["sales"] if c not in ("Amount", "DaysInStage", "Probability")]


@register("profile_top_values", lambda: S.with_fixtures(["dom_sales"], (
    "SELECT * FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name "
    "ORDER BY n DESC, value ASC) AS rank FROM (SELECT column_name, value, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM dom_sales" for c in SALES_CAT)
    + ") WHERE value IS NOT NULL GROUP BY ALL)) WHERE rank <= 5")))
def profile_top_values(spark, sf):
    return Q.profile_top_values(X.dom_sales(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def _snapshot_sql() -> str:
    miss = " + ".join(f"count_if({c} IS NULL)" for c in DO_COLS)
    bad = f"count_if(price IS NOT NULL AND {S.parse_double('price')} IS NULL)"
    # dirty_orders: order_id bigint and customer_id/priority/status string match; price/order_date are text
    return _w(f"SELECT count(*) AS n_rows, {len(DO_COLS)} AS n_columns, CAST({miss} AS BIGINT) AS n_missing_cells, "
              f"count(*) - count(DISTINCT ({', '.join(DO_COLS)})) AS n_duplicate_rows, "
              f"CAST({bad} AS BIGINT) AS n_invalid_type_cells, {round(4 / 6, 4)}::DOUBLE AS schema_consistency FROM dirty_orders")


@register("profile_snapshot", _snapshot_sql)
def profile_snapshot(spark, sf):
    return Q.snapshot(_orders(spark, sf), DO)


# ---------------------------------------------------------------- DQ scores
def _dq_one(component: str):
    return _w(f"SELECT {component} FROM ({S.dq_select('dirty_orders', DO_COLS, DO['numeric'], {'order_id'})})")


for _comp in ["completeness", "consistency", "uniqueness"]:
    register(f"dq_{_comp}", lambda c=_comp: _dq_one(c))(
        lambda spark, sf, c=_comp: Q.dq_scores(_orders(spark, sf), DO_COLS, DO["numeric"]).select(c))


def _dq_overall_sql() -> str:
    # each domain's chain gets its own CTE names
    all_ctes = []
    selects = []
    for d in K.DOMAIN_COLUMNS:
        cc, last = corrupted_domain_ctes(d)
        ren = {n: f"{d}__{n}" for n, _ in cc}
        for n, sql in cc:
            for old, new in sorted(ren.items(), key=lambda kv: -len(kv[0])):
                sql = _rename_rel(sql, old, new)
            all_ctes.append((ren[n], sql))
        dq = S.dq_select(ren[last], K.DOMAIN_COLUMNS[d], K.DOMAIN_NUMERIC[d], set())
        selects.append(f"SELECT '{d}' AS domain, completeness, consistency, uniqueness, overall, "
                       f"overall > {K.DQ_DONE_THRESHOLD} AS done FROM ({dq})")
    return S.with_fixtures([f"dom_{d}" for d in K.DOMAIN_COLUMNS], " UNION ALL ".join(selects), all_ctes)


def _rename_rel(sql: str, old: str, new: str) -> str:
    import re
    return re.sub(rf"(?<![\w.]){re.escape(old)}(?![\w])", new, sql)


def _dq_domains(spark, sf, build):
    out = None
    for d in K.DOMAIN_COLUMNS:
        row = Q.dq_scores(build(spark, sf, d), K.DOMAIN_COLUMNS[d], K.DOMAIN_NUMERIC[d]).select(
            F.lit(d).alias("domain"), "completeness", "consistency", "uniqueness", "overall",
            (F.col("overall") > K.DQ_DONE_THRESHOLD).alias("done"))
        out = row if out is None else out.unionByName(row)
    return out


@register("dq_overall", _dq_overall_sql)
def dq_overall(spark, sf):
    """DQ components, blend and done flag of each corrupted domain table."""
    return _dq_domains(spark, sf, corrupted_domain)


def _done_sql() -> str:
    before = S.dq_select("dirty_orders", DO_COLS, DO["numeric"], {"order_id"})
    after = S.dq_select("cleaned", DO_COLS, DO["numeric"], {"order_id", "price"})
    return _w(f"SELECT 'raw' AS stage, overall, overall > {K.DQ_DONE_THRESHOLD} AS done FROM ({before}) "
              f"UNION ALL SELECT 'cleaned' AS stage, overall, overall > {K.DQ_DONE_THRESHOLD} AS done FROM ({after})",
              _policy_ctes())


@register("dq_done_flag", _done_sql)
def dq_done_flag(spark, sf):
    raw = _orders(spark, sf)
    cleaned = compile_policy(raw, ORDERS_POLICY)
    parts = [Q.dq_scores(t, DO_COLS, DO["numeric"]).select(F.lit(s).alias("stage"), "overall",
                                                           (F.col("overall") > K.DQ_DONE_THRESHOLD).alias("done"))
             for s, t in (("raw", raw), ("cleaned", cleaned))]
    return parts[0].unionByName(parts[1])


def gold_sql(d: str, rel: str, prefix: str) -> list[tuple[str, str]]:
    cols = K.DOMAIN_COLUMNS[d]
    num, cat = K.DOMAIN_NUMERIC[d], K.DOMAIN_CATEGORICAL[d]
    sel = []
    for c in cols:
        if c in num:
            v = S.parse_double(c)
            sel.append(f"coalesce({v}, (SELECT quantile_cont({v}, 0.5) FROM {prefix}0)) AS {c}")
        elif c in cat:
            sel.append(f"{S.ws_trim(f'CAST({c} AS VARCHAR)')} AS {c}")
        else:
            sel.append(c)
    return [(f"{prefix}0", f"SELECT DISTINCT {', '.join(cols)} FROM {rel}"),
            (f"{prefix}1", f"SELECT {', '.join(sel)} FROM {prefix}0")]


def _gold(spark, sf, d):
    return C.gold_table(corrupted_domain(spark, sf, d), K.DOMAIN_NUMERIC[d], K.DOMAIN_CATEGORICAL[d])


@register("gold_table", lambda: _wrap_one("it_ops", lambda last: gold_sql("it_ops", last, "g"), "g1"))
def gold_table(spark, sf):
    return _gold(spark, sf, "it_ops")


def _wrap_one(d, extra, final, body=None):
    ctes, last = corrupted_domain_ctes(d)
    more = extra(last)
    return S.with_fixtures([f"dom_{d}"], body or f"SELECT * FROM {final}", ctes + more)


def _before_after_sql() -> str:
    selects, all_ctes = [], []
    for d in K.DOMAIN_COLUMNS:
        cc, last = corrupted_domain_ctes(d)
        cc = cc + gold_sql(d, last, "g")
        names = [n for n, _ in cc]
        ren = {n: f"{d}__{n}" for n in names}
        for n, sql in cc:
            for old, new in sorted(ren.items(), key=lambda kv: -len(kv[0])):
                sql = _rename_rel(sql, old, new)
            all_ctes.append((ren[n], sql))
        b = S.dq_select(ren[last], K.DOMAIN_COLUMNS[d], K.DOMAIN_NUMERIC[d], set())
        a = S.dq_select(ren["g1"], K.DOMAIN_COLUMNS[d], K.DOMAIN_NUMERIC[d], set(K.DOMAIN_NUMERIC[d]))
        selects.append(f"SELECT '{d}' AS domain, b.overall AS dq_before, a.overall AS dq_after, "
                       f"{R('a.overall - b.overall', 4)} AS improvement FROM ({b}) b, ({a}) a")
    return S.with_fixtures([f"dom_{d}" for d in K.DOMAIN_COLUMNS], " UNION ALL ".join(selects), all_ctes)


@register("dq_before_after", _before_after_sql)
def dq_before_after(spark, sf):
    """Per domain: DQ of the corrupted table, of its gold version, and the
    gain (two one-row aggregates per domain)."""
    out = None
    for d in K.DOMAIN_COLUMNS:
        raw = corrupted_domain(spark, sf, d)
        b = Q.dq_scores(raw, K.DOMAIN_COLUMNS[d], K.DOMAIN_NUMERIC[d]).first()["overall"]
        g = C.gold_table(raw, K.DOMAIN_NUMERIC[d], K.DOMAIN_CATEGORICAL[d])
        row = Q.dq_scores(g, K.DOMAIN_COLUMNS[d], K.DOMAIN_NUMERIC[d]).select(
            F.lit(d).alias("domain"), F.lit(b).cast("double").alias("dq_before"), F.col("overall").alias("dq_after"),
            F.round(F.col("overall") - F.lit(b), 4).alias("improvement"))
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------ quality score and gates
def _stats_sql(rel: str, target: str) -> str:
    miss = " + ".join(f"count_if({c} IS NULL)" for c in DO_COLS if c != target)
    return (f"SELECT count(*) AS n_rows, CAST({miss} AS BIGINT) AS n_missing, "
            f"count(*) - count(DISTINCT ({', '.join(DO_COLS)})) AS n_duplicates FROM {rel}")


def _qscore_sql(tm: float) -> str:
    return (f"greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1.2::DOUBLE * (n_rows / greatest(raw_n, 1)) + "
            f"0.7::DOUBLE * {tm!r}::DOUBLE - 0.08::DOUBLE * n_missing - 0.2::DOUBLE * n_duplicates))")


# type match of the raw (price/order_date text) and cleaned (all typed) tables
TM_RAW, TM_CLEAN = 4 / 6, 1.0


@register("quality_score", lambda: _w(
    f"SELECT 'raw' AS stage, n_rows, n_missing, n_duplicates, {R(_qscore_sql(TM_RAW), 4)} AS quality_score "
    f"FROM ({_stats_sql('dirty_orders', 'status')}), (SELECT count(*) AS raw_n FROM dirty_orders) "
    f"UNION ALL SELECT 'cleaned', n_rows, n_missing, n_duplicates, {R(_qscore_sql(TM_CLEAN), 4)} "
    f"FROM ({_stats_sql('cleaned', 'status')}), (SELECT count(*) AS raw_n FROM dirty_orders)", _policy_ctes()))
def quality_score(spark, sf):
    raw = _orders(spark, sf)
    raw_n = raw.count()
    cleaned = compile_policy(raw, ORDERS_POLICY)
    a = Q.quality_score(raw, raw_n, DO).select(F.lit("raw").alias("stage"), "*")
    b = Q.quality_score(cleaned, raw_n, DO).select(F.lit("cleaned").alias("stage"), "*")
    return a.unionByName(b)


def _gate_sql() -> str:
    st = _stats_sql("cleaned", "status")
    return _w(f"""SELECT gate, passed, detail_value FROM (
        SELECT 'test_missing_values' AS gate, n_missing = 0 AS passed, CAST(n_missing AS DOUBLE) AS detail_value FROM s
        UNION ALL SELECT 'test_duplicated_rows', n_duplicates = 0, CAST(n_duplicates AS DOUBLE) FROM s
        UNION ALL SELECT 'test_data_consistency', TRUE, 1.0::DOUBLE
        UNION ALL SELECT 'test_data_retention', n_rows / greatest(raw_n, 1) >= {K.MIN_RETENTION},
                         {R('n_rows / greatest(raw_n, 1)', 4)} FROM s
        UNION ALL SELECT 'test_dtype_alignment', TRUE, 1.0::DOUBLE)""",
              _policy_ctes() + [("s", f"SELECT * FROM ({st}), (SELECT count(*) AS raw_n FROM dirty_orders)")])


def _gates(spark, sf):
    raw = _orders(spark, sf)
    return Q.gate_report(compile_policy(raw, ORDERS_POLICY), raw, DO)


register("gate_report", _gate_sql)(_gates)

for _g, _t in [("gate_missing", "test_missing_values"), ("gate_duplicates", "test_duplicated_rows"),
               ("gate_consistency", "test_data_consistency"), ("gate_retention", "test_data_retention"),
               ("gate_dtype", "test_dtype_alignment")]:
    register(_g, lambda t=_t: f"SELECT * FROM ({_gate_sql()}) WHERE gate = '{t}'")(
        lambda spark, sf, t=_t: _gates(spark, sf).where(F.col("gate") == t))


# ------------------------------------------ domain-family cleaning queries
def _corr(d):
    return lambda spark, sf: corrupted_domain(spark, sf, d)


def _dsql(d: str, body: str, extra=None) -> str:
    ctes, last = corrupted_domain_ctes(d)
    return S.with_fixtures([f"dom_{d}"], body.replace("{T}", last), ctes + (extra or []))


@register("clean_fill_null_median", lambda: _dsql("hr", (
    "SELECT EmployeeID, _copy, coalesce(MonthlyIncome, (SELECT CAST(quantile_cont("
    + S.parse_double("MonthlyIncome") + ", 0.5) AS VARCHAR) FROM {T})) AS MonthlyIncome FROM {T}")))
def clean_fill_null_median(spark, sf):
    return C.fill_null(corrupted_domain(spark, sf, "hr"), "MonthlyIncome", "median").select(
        "EmployeeID", "_copy", "MonthlyIncome")


@register("clean_fill_null_mode", lambda: _dsql("sales", (
    "SELECT DealID, _copy, coalesce(AccountName, " + S.mode_of("AccountName", "{T}") + ") AS AccountName FROM {T}")))
def clean_fill_null_mode(spark, sf):
    return C.fill_null(corrupted_domain(spark, sf, "sales"), "AccountName", "mode").select(
        "DealID", "_copy", "AccountName")


@register("clean_fill_null_value", lambda: _dsql("hr", (
    "SELECT EmployeeID, _copy, coalesce(CAST(Age AS VARCHAR), 'missing') AS Age FROM {T}")))
def clean_fill_null_value(spark, sf):
    return C.fill_null(corrupted_domain(spark, sf, "hr"), "Age", "missing").select("EmployeeID", "_copy", "Age")


@register("clean_fix_type", lambda: _dsql("hr", (
    "SELECT EmployeeID, _copy, " + S.parse_double("MonthlyIncome") + " AS MonthlyIncome FROM {T}")))
def clean_fix_type(spark, sf):
    return C.fix_type(corrupted_domain(spark, sf, "hr"), "MonthlyIncome").select(
        "EmployeeID", "_copy", "MonthlyIncome")


_SK = K.DOMAIN_COLUMNS["sales"][:5]


@register("clean_remove_duplicate_subset", lambda: _dsql("sales", (
    "SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY " + ", ".join(_SK)
    + " ORDER BY _copy) AS _rn FROM {T}) WHERE _rn = 1")))
def clean_remove_duplicate_subset(spark, sf):
    df = corrupted_domain(spark, sf, "sales").withColumnRenamed("_copy", "_seq")
    return C.remove_duplicate_subset(df, _SK).withColumnRenamed("_seq", "_copy")


@register("clean_standardize", lambda: _dsql("sales", (
    "SELECT DealID, _copy, lower(" + S.ws_trim("CAST(Stage AS VARCHAR)") + ") AS Stage, "
    + S.py_title(S.ws_trim("CAST(Region AS VARCHAR)")) + " AS Region FROM {T}")))
def clean_standardize(spark, sf):
    df = C.standardize(C.standardize(corrupted_domain(spark, sf, "sales"), "Stage", "lower"), "Region", "title")
    return df.select("DealID", "_copy", "Stage", "Region")


@register("clean_trim", lambda: _dsql("sales", (
    "SELECT DealID, _copy, " + S.ws_trim("CAST(Stage AS VARCHAR)") + " AS Stage FROM {T}")))
def clean_trim(spark, sf):
    return C.trim(corrupted_domain(spark, sf, "sales"), "Stage").select("DealID", "_copy", "Stage")


@register("clean_correct_typo", lambda: _dsql("hr", (
    "SELECT EmployeeID, _copy, CASE WHEN CAST(Department AS VARCHAR) = 'Sales' THEN 'Sales Dept' ELSE Department END "
    "AS Department FROM {T}")))
def clean_correct_typo(spark, sf):
    return C.correct_typo(corrupted_domain(spark, sf, "hr"), "Department", "Sales Dept", "Sales").select(
        "EmployeeID", "_copy", "Department")


def _rarest_sql():
    ctes, last = corrupted_domain_ctes("hr")
    r = ("r", f"SELECT CAST(JobRole AS VARCHAR) AS v, count(*) AS n FROM {last} WHERE JobRole IS NOT NULL GROUP BY 1")
    body = ("SELECT EmployeeID, _copy, CASE WHEN (SELECT count(*) FROM r) > 1 AND CAST(JobRole AS VARCHAR) = "
            f"(SELECT v FROM r ORDER BY n ASC, v ASC LIMIT 1) THEN 'Manager' ELSE JobRole END AS JobRole FROM {last}")
    return S.with_fixtures(["dom_hr"], body, ctes + [r])


@register("clean_correct_rarest", _rarest_sql)
def clean_correct_rarest(spark, sf):
    """No ``wrong`` value given: the least frequent value is replaced."""
    return C.correct_typo(corrupted_domain(spark, sf, "hr"), "JobRole", "Manager").select(
        "EmployeeID", "_copy", "JobRole")


# --------------------------------------------------- stability / encoding
from tessera.operators import clean as _C  # noqa: E402
from tessera.plans import sql_tasks as ST  # noqa: E402
from tessera.plans.policy import TASK_POLICIES  # noqa: E402
from tessera.sources import tasks as TK  # noqa: E402


def _ecommerce(spark, sf):
    """The dirty table, stored since statistics and rows are read from it, and its cleaned version."""
    raw = stored(TK.dirty_task(spark, sf, "ecommerce_mobile"))
    return raw, compile_policy(raw, TASK_POLICIES["ecommerce_mobile"], is_stored=True)


def _clean_ecommerce(spark, sf):
    return _ecommerce(spark, sf)[1]


def _encode_sql() -> str:
    ctes, last = ST.noise_ctes("ecommerce_mobile", "n")
    pctes, plast = ST.policy_ctes(last, ST.task_columns("ecommerce_mobile"), ST.dirty_types("ecommerce_mobile"),
                                  TASK_POLICIES["ecommerce_mobile"])
    text_cols = ["device_os", "customer_id", "country"]
    ranks = [(f"r_{c}", f"SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS i FROM "
                        f"(SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'missing') AS v FROM {plast})") for c in text_cols]
    sel = ["t._seq", "coalesce(CAST(t.session_id AS DOUBLE), 0.0) AS session_id"]
    sel += [f"r_{c}.i AS {c}" for c in text_cols]
    sel += [f"coalesce(CAST(t.{c} AS DOUBLE), 0.0) AS {c}" for c in ["items_in_cart", "order_value"]]
    sel += ["coalesce(CAST(date_diff('day', DATE '1970-01-01', CAST(t.event_date AS DATE)) + 719163 AS DOUBLE), 0.0) "
            "AS event_date", "t.converted"]
    joins = " ".join(f"LEFT JOIN r_{c} ON coalesce(CAST(t.{c} AS VARCHAR), 'missing') = r_{c}.v" for c in text_cols)
    body = f"SELECT {', '.join(sel)} FROM {plast} t {joins}"
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes + pctes + ranks) + "\n" + body


@register("encode_features", _encode_sql)
def encode_features(spark, sf):
    """Cleaned ecommerce table encoded for model fitting."""
    return Q.encode_features(_clean_ecommerce(spark, sf), "converted")


@register("gate_stability")
def gate_stability(spark, sf):
    """Random-forest stability probe of the cleaned ecommerce table
    (Spark ML; scores are not comparable across ML libraries, so rows-only)."""
    res = Q.stability_probe(stored(_clean_ecommerce(spark, sf)), "converted", "classification", "session_id")
    return spark.createDataFrame([(res["score_mean"], res["score_std"], res["n_folds"], res["score_std"] <= 0.15)],
                                 "score_mean double, score_std double, n_folds int, passed boolean")


# ------------------------------------------------- per-operation deltas
def _step_types(steps, types0):
    """Logical type names after each step (mirrors the policy's tracking)."""
    types = dict(types0)
    out = []
    for op, col, *_ in steps:
        if op in ("cast_numeric", "impute_numeric", "clip_outliers_iqr"):
            types[col] = "double"
        elif op == "cast_datetime":
            types[col] = "timestamp_ntz"
        elif op in ("normalize_categories", "impute_categorical"):
            types[col] = "string"
        out.append(dict(types))
    return out


DO_TYPES0 = {"order_id": "bigint", "customer_id": "string", "priority": "string", "price": "string",
             "order_date": "string", "status": "string"}


def _tm(types):
    exp = DO["expected_types"]
    return sum(1 for c, t in exp.items() if types.get(c) == t) / len(exp)


def _delta_sql() -> str:
    kinds = {c: ("num" if t == "bigint" else "str") for c, t in DO_TYPES0.items()}
    pctes, _ = ST.policy_ctes("dirty_orders", DO_COLS, kinds, ORDERS_POLICY)
    rels = ["dirty_orders"] + [n for n, _ in pctes]
    tms = [_tm(DO_TYPES0)] + [_tm(t) for t in _step_types(ORDERS_POLICY, DO_TYPES0)]
    q = [f"SELECT {i} AS k, {R(_qscore_sql(tms[i]), 4)} AS q FROM ({_stats_sql(r, 'status')}), "
         f"(SELECT count(*) AS raw_n FROM dirty_orders)" for i, r in enumerate(rels)]
    ops = " UNION ALL ".join(f"SELECT {i + 1} AS step, {S.q(op)} AS operation, {S.q(col) if col else 'NULL'} AS column"
                             for i, (op, col, *_) in enumerate(ORDERS_POLICY))
    body = (f"SELECT o.step, o.operation, o.column, b.q AS quality_before, a.q AS quality_after, "
            f"{R('greatest(-0.15, a.q - b.q - 0.02)', 4)} AS reward FROM ({ops}) o "
            "JOIN qs b ON b.k = o.step - 1 JOIN qs a ON a.k = o.step")
    return S.with_fixtures(["dirty_orders"], body, pctes + [("qs", " UNION ALL ".join(q))])


@register("quality_delta_per_op", _delta_sql)
def quality_delta_per_op(spark, sf):
    """Quality score before/after each operation of the orders policy and
    the shaped step reward. One stats row per intermediate table, all in one
    union job; deltas on the driver over ~10 numbers."""
    raw = _orders(spark, sf)
    raw_n = raw.count()
    tables = [raw]
    for op, col, *_ in ORDERS_POLICY:
        tables.append(_C.apply_tool_operation(tables[-1], op, col))
    scores = None
    for i, t in enumerate(tables):
        s = Q.quality_score(t, raw_n, DO).select(F.lit(i).alias("k"), "quality_score")
        scores = s if scores is None else scores.unionByName(s)
    qs = {r["k"]: r["quality_score"] for r in scores.collect()}
    rows = [(i + 1, op, col, qs[i], qs[i + 1], round(max(-0.15, qs[i + 1] - qs[i] - 0.02), 4))
            for i, (op, col, *_) in enumerate(ORDERS_POLICY)]
    return spark.createDataFrame(rows, "step int, operation string, column string, quality_before double, "
                                       "quality_after double, reward double")


# ------------------------------------------- rewards from the quality score
#: Submissions of the orders table: how many operations of the policy ran.
SUBMISSIONS = {"raw": 0, "without_dedup": len(ORDERS_POLICY) - 1, "whole_policy": len(ORDERS_POLICY)}


def _submission_sql() -> str:
    kinds = {c: ("num" if t == "bigint" else "str") for c, t in DO_TYPES0.items()}
    pctes, _ = ST.policy_ctes("dirty_orders", DO_COLS, kinds, ORDERS_POLICY)
    rels = ["dirty_orders"] + [n for n, _ in pctes]
    tms = [_tm(DO_TYPES0)] + [_tm(t) for t in _step_types(ORDERS_POLICY, DO_TYPES0)]
    ctes, selects = [], []
    for name, k in SUBMISSIONS.items():
        passed = (f"n_missing = 0 AND n_duplicates = 0 AND n_rows / greatest(raw_n, 1) >= {K.MIN_RETENTION} "
                  f"AND {'TRUE' if tms[k] == 1.0 else 'FALSE'}")
        ctes.append((f"sub_{name}", f"SELECT {R(_qscore_sql(tms[k]), 4)} AS quality_score, {passed} AS gates_passed, "
                     f"{k / len(ORDERS_POLICY)!r}::DOUBLE AS coverage FROM ({_stats_sql(rels[k], 'status')}), "
                     f"(SELECT count(*) AS raw_n FROM dirty_orders)"))
        selects.append(f"SELECT '{name}' AS submission, *, " + R(
            "0.45::DOUBLE * quality_score + 0.30::DOUBLE * (CASE WHEN gates_passed THEN 1.0 ELSE 0.0 END)::DOUBLE "
            "+ 0.25::DOUBLE * coverage", 6) + f" AS final_reward FROM sub_{name}")
    return S.with_fixtures(["dirty_orders"], " UNION ALL ".join(selects), pctes + ctes)


@register("rew_final_quality", _submission_sql)
def rew_final_quality(spark, sf):
    """Terminal reward of the orders table handed in raw, with all but the
    last operation, and after the whole policy: from its own quality score,
    gates and share of the policy's operations."""
    raw = table = stored(_orders(spark, sf))
    out, done = None, 0
    for name, k in SUBMISSIONS.items():  # each goes on from the one before
        if k > done:
            table, done = stored(compile_policy(table, ORDERS_POLICY[done:k], is_stored=True)), k
        row = Q.submission_reward(table, raw, DO, k / len(ORDERS_POLICY)).select(F.lit(name).alias("submission"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("gate_report_full")
def gate_report_full(spark, sf):
    """All six gates of the cleaned ecommerce table with the overall result,
    the shape and the retention (the probe is a Spark ML forest: no SQL)."""
    raw, cleaned = _ecommerce(spark, sf)
    cleaned = stored(cleaned)  # for the probe and the counts
    spec = TK.TASK_SPECS["ecommerce_mobile"]
    probe = Q.stability_probe(cleaned, "converted", "classification", "session_id")
    return Q.full_gate_report(cleaned, raw, spec, probe)


def _profile_columns_sql() -> str:
    nums = K.DOMAIN_NUMERIC["sales"]
    stats_ = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
              "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)",
              "max": "max({c})"}
    parts = [f"SELECT '{c}' AS column_name, '{i}' AS item, NULL::VARCHAR AS value, "
             f"{R('(' + e.format(c=c) + ')::DOUBLE', 6)} AS number FROM dom_sales" for c in nums for i, e in stats_.items()]
    text = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM dom_sales" for c in SALES_CAT)
    parts.append("SELECT column_name, 'top ' || rank AS item, value, n::DOUBLE AS number FROM (SELECT column_name, value, n, "
                 "row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS rank FROM (SELECT column_name, "
                 f"value, count(*) AS n FROM ({text}) WHERE value IS NOT NULL GROUP BY ALL)) WHERE rank <= 5")
    return S.with_fixtures(["dom_sales"], " UNION ALL ".join(parts))


@register("profile_columns", _profile_columns_sql)
def profile_columns(spark, sf):
    """Describe of the numeric and top values of the other sales columns."""
    return Q.profile_columns(X.dom_sales(spark, sf))
