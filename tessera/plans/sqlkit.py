"""DuckDB twins of the expression helpers and fixture views.

The oracle side of every query is plain SQL over the driver's Parquet views;
this module builds the shared pieces so each oracle query reads like the
Spark plan it checks.
"""

from __future__ import annotations

from tessera.functions import constants as K
from tessera.functions.exprs import NUMERIC_PATTERN

SEQ_STRIDE = 1 << 40


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def arr(values: list) -> str:
    if all(isinstance(v, str) for v in values):
        return "[" + ", ".join(q(v) for v in values) + "]"
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def pick(values: list, idx0: str) -> str:
    """``values[idx0]`` for a 0-based integer expression."""
    return f"({arr(values)})[({idx0})::BIGINT + 1]"


def uni(*parts) -> str:
    """DuckDB twin of ``hash_uniform``: same md5 bits, same [0,1) value."""
    pieces = [p if isinstance(p, Sql) else q(str(p)) for p in parts]
    key = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in pieces) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


class Sql(str):
    """Marks a string as an SQL expression (not a tag) for ``uni``."""


def hpick(u: str, values: list) -> str:
    n = len(values)
    return f"({arr(values)})[least(floor({u} * {n})::BIGINT, {n - 1}) + 1]"


def parse_double(x: str, numeric: bool = False) -> str:
    if numeric:
        return f"(CASE WHEN isnan(CAST({x} AS DOUBLE)) THEN NULL ELSE CAST({x} AS DOUBLE) END)"
    s = f"CAST({x} AS VARCHAR)"
    v = f"(CASE WHEN regexp_matches({s}, {q(NUMERIC_PATTERN)}) THEN TRY_CAST({s} AS DOUBLE) END)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def is_numeric_like(x: str, numeric: bool = False) -> str:
    if numeric:
        return "TRUE"
    return f"({x} IS NULL OR regexp_matches(CAST({x} AS VARCHAR), {q(NUMERIC_PATTERN)}))"


def ws_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def py_title(x: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(" + x + ", '(\\p{L}+|[^\\p{L}]+)', 1), "
            "lambda p: upper(left(p, 1)) || lower(substr(p, 2))), '')")


def sround(x: str, n: int) -> str:
    """Spark's ``round`` on doubles: half-up on the shortest decimal text of
    the value (0.385 -> 0.39), which DuckDB's binary ``round`` does not do."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,20)), {n}) AS DOUBLE)"


def text2(x: str) -> str:
    """Spark's cast of a double to decimal(18,2) text (same half-up rule)."""
    return f"CAST(CAST(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,20)) AS DECIMAL(18,2)) AS VARCHAR)"


def number_text(x: str) -> str:
    """Spark's cast of a double to text, for the fixtures' range (1e-3 to 1e7),
    where both engines print the shortest digits without an exponent."""
    return f"CAST({x} AS VARCHAR)"


def in_list(x: str, values: list[str]) -> str:
    return f"{x} IN (" + ", ".join(q(v) for v in values) + ")"


def case_map(x: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else repr(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {default} END)"


# ------------------------------------------------------------------ fixtures
def dirty_orders_sql() -> str:
    k, cp = Sql("o_orderkey"), Sql("_copy")
    pri = "lower(substr(o_orderpriority, 3, 100))"
    kind = uni(k, cp, "priority_kind")
    drifted = (f"(CASE WHEN {kind} < 0.25 THEN '  ' || {pri} || '  ' WHEN {kind} < 0.5 THEN upper({pri}) "
               f"WHEN {kind} < 0.75 THEN lower({pri}) ELSE {pri} || ' ' END)")
    priority = (f"(CASE WHEN {uni(k, 'priority_missing')} < 0.05 THEN NULL "
                f"WHEN {uni(k, 'priority_invalid')} < 0.04 THEN {hpick(uni(k, 'priority_token'), K.INVALID_TOKENS)} "
                f"WHEN {uni(k, cp, 'priority_drift')} < 0.06 THEN {drifted} ELSE {pri} END)")
    price = (f"(CASE WHEN {uni(k, 'price_missing')} < 0.05 THEN NULL "
             f"WHEN {uni(k, cp, 'price_outlier')} < 0.02 THEN {text2('o_totalprice * 20')} "
             f"WHEN {uni(k, cp, 'price_junk')} < 0.03 THEN {hpick(uni(k, cp, 'price_pick'), K.NUMERIC_JUNK)} "
             f"ELSE {text2('o_totalprice')} END)")
    odate = (f"(CASE WHEN {uni(k, 'date_bad')} < 0.03 THEN 'not a date' "
             f"WHEN {uni(k, 'date_missing')} < 0.02 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END)")
    return f"""
    SELECT CAST(_copy AS BIGINT) * {SEQ_STRIDE} + o_orderkey AS _seq, o_orderkey AS order_id,
           CAST(o_custkey AS VARCHAR) AS customer_id, {priority} AS priority, {price} AS price,
           {odate} AS order_date, o_orderstatus AS status
    FROM (SELECT o.*, unnest(range(0, CASE WHEN {uni(k, 'dup')} < 0.03 THEN 2 ELSE 1 END)) AS _copy
          FROM orders o)"""


def dom_hr_sql() -> str:
    c = K.DOMAIN_CATEGORIES["hr"]
    return f"""
    SELECT concat('EMP-', c_custkey) AS EmployeeID, 18 + (c_custkey * 7) % 52 AS Age,
           {pick(c['Department'], 'c_nationkey % 3')} AS Department, {pick(c['JobRole'], 'c_custkey % 6')} AS JobRole,
           CASE WHEN {uni(Sql('c_custkey'), 'income_missing')} < 0.05 THEN NULL ELSE {sround('c_acctbal * 2', 2)} END
             AS MonthlyIncome,
           (c_custkey * 13) % 40 - 1 AS YearsAtCompany,
           CASE WHEN c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS Attrition,
           (c_custkey * 3) % 5 AS JobSatisfaction,
           CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS OverTime,
           (c_custkey * 11) % 29 + 1 AS DistanceFromHome, c_custkey % 5 + 1 AS Education,
           3 + c_custkey % 2 AS PerformanceRating,
           CASE WHEN c_custkey % 97 = 0 THEN 2 ELSE 1 END AS EmployeeCount, 80 AS StandardHours
    FROM customer"""


def dom_sales_sql() -> str:
    c = K.DOMAIN_CATEGORIES["sales"]
    product = pick(c["Product"], "(o_orderkey * 7) % 5")
    return f"""
    SELECT concat('D-', o_orderkey) AS DealID,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_name END AS AccountName,
           {pick(c['Stage'], 'o_orderkey % 6')} AS Stage, o_totalprice AS Amount,
           strftime(o_orderdate, '%Y-%m-%d') AS CloseDate, concat('Rep ', o_custkey % 20) AS Rep,
           CASE WHEN o_orderkey % 50 = 1 THEN replace({product}, ' ', '') ELSE {product} END AS Product,
           r_name AS Region, c_mktsegment AS LeadSource, o_custkey % 120 + 1 AS DaysInStage,
           {pick([10.0, 25.0, 50.0, 75.0, 100.0, 0.0], 'o_orderkey % 6')} AS Probability,
           {pick(c['ForecastCategory'], 'o_orderkey % 4')} AS ForecastCategory
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey"""


def dom_pm_sql() -> str:
    c = K.DOMAIN_CATEGORIES["pm"]
    status = pick(c["Status"], "(l_orderkey + l_linenumber) % 5")
    deps = ("array_to_string(list_transform(range(greatest(1, l_linenumber - 3), l_linenumber), "
            "lambda i: concat('T-', l_orderkey, '-', i)), ',')")
    return f"""
    SELECT concat('T-', l_orderkey, '-', l_linenumber) AS TaskID, concat('Project ', l_orderkey % 50) AS ProjectName,
           concat('Eng ', l_suppkey % 30) AS Assignee, {status} AS Status,
           {pick(c['Priority'], 'l_partkey % 4')} AS Priority, strftime(l_shipdate, '%Y-%m-%d') AS DueDate,
           l_quantity AS EstimatedHours, l_quantity * (5 + (l_partkey % 7) * 4) / 10.0 AS ActualHours,
           CASE WHEN l_linenumber = 1 THEN NULL ELSE {deps} END AS Dependencies,
           concat('M', l_orderkey % 8) AS Milestone, {pick(c['RiskFlag'], '(l_partkey + l_suppkey) % 4')} AS RiskFlag,
           CASE WHEN {status} = 'Completed' THEN (CASE WHEN l_orderkey % 11 = 0 THEN 90.0 ELSE 100.0 END)::DOUBLE
                WHEN {status} = 'Not Started' THEN (CASE WHEN l_orderkey % 13 = 0 THEN 5.0 ELSE 0.0 END)::DOUBLE
                ELSE CAST((l_orderkey * 7 + l_linenumber * 13) % 101 AS DOUBLE) END AS CompletionPct
    FROM lineitem"""


def dom_it_ops_sql() -> str:
    c = K.DOMAIN_CATEGORIES["it_ops"]
    status = pick(c["Status"], "(event_id * 3 + user_id) % 5")
    return f"""
    SELECT concat('INC-', event_id) AS TicketID, {pick(c['Category'], 'user_id % 5')} AS Category,
           {pick(c['Priority'], 'event_id % 4')} AS Priority, {status} AS Status,
           concat('Agent ', user_id % 12) AS Assignee, strftime(ts, '%Y-%m-%d') AS CreatedDate,
           CASE WHEN {status} IN ('Resolved', 'Closed', 'Pending') AND event_id % 9 <> 0
                THEN strftime(CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER), '%Y-%m-%d') END AS ResolvedDate,
           CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN -1.0::DOUBLE
                ELSE {pick([4.0, 8.0, 24.0, 48.0], 'event_id % 4')} END AS SLATarget,
           CAST(floor(value / 7) AS BIGINT) AS EscalationLevel, event_type AS AffectedSystem,
           {pick(c['ResolutionType'], 'event_id % 5')} AS ResolutionType,
           {pick(['Low', 'Medium', 'High'], '(user_id + event_id) % 3')} AS CustomerImpact
    FROM events"""


FIXTURE_SQL = {
    "dirty_orders": dirty_orders_sql,
    "dom_hr": dom_hr_sql,
    "dom_sales": dom_sales_sql,
    "dom_pm": dom_pm_sql,
    "dom_it_ops": dom_it_ops_sql,
}


def with_fixtures(names: list[str], body: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """``WITH name AS (...), ... body`` for the fixture views a query reads,
    followed by the query's own CTEs."""
    parts = [f"{n} AS ({FIXTURE_SQL[n]()})" for n in names]
    parts += [f"{n} AS ({sql})" for n, sql in (ctes or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ------------------------------------------------------- cleaning twins
DUCK_DATETIME_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%m/%d/%Y"]


def invalid_null(x: str) -> str:
    return f"(CASE WHEN {in_list(x, K.INVALID_TOKENS)} THEN NULL ELSE {x} END)"


def normalize(x: str) -> str:
    v = f"lower({ws_trim(f'CAST({x} AS VARCHAR)')})"
    out = v
    for alias, canon in K.CATEGORY_ALIASES.items():
        out = f"(CASE WHEN {v} = {q(alias)} THEN {q(canon)} ELSE {out} END)"
    return out


def to_datetime(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime(CAST({x} AS VARCHAR), {q(f)})" for f in DUCK_DATETIME_FORMATS) + ")"


def iqr_bounds(q1: str, q3: str) -> tuple[str, str]:
    return sround(f"{q1} - 1.5 * ({q3} - {q1})", 9), sround(f"{q3} + 1.5 * ({q3} - {q1})", 9)


def clip(x: str, q1: str, q3: str) -> str:
    lo, hi = iqr_bounds(q1, q3)
    return f"(CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END)"


def mode_of(x: str, rel: str) -> str:
    """Scalar subquery: most frequent non-null value, ties -> smallest."""
    return (f"(SELECT {x} FROM {rel} WHERE {x} IS NOT NULL GROUP BY {x} "
            f"ORDER BY count(*) DESC, {x} ASC LIMIT 1)")


def dq_select(rel: str, columns: list[str], numeric: list[str], numeric_typed: set[str] | None = None) -> str:
    """completeness / consistency / uniqueness / overall, as in ``dq_scores``."""
    numeric_typed = numeric_typed or set()
    key = ", ".join(columns[:5])
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in columns)
    cons = " + ".join(f"avg(CASE WHEN {is_numeric_like(c, c in numeric_typed)} THEN 1.0 ELSE 0.0 END)"
                      for c in numeric) if numeric else None
    comp = f"(1.0 - ({nulls}) / (count(*) * {len(columns)}))"
    consistency = f"(({cons}) / {len(numeric)})" if cons else "1.0"
    uniq = f"(CASE WHEN count(*) > 0 THEN 1.0 - (count(*) - count(DISTINCT ({key},))) / count(*) ELSE 1.0 END)"
    return (f"SELECT {sround(comp, 4)} AS completeness, {sround(consistency, 4)} AS consistency, "
            f"{sround(uniq, 4)} AS uniqueness, "
            f"{sround(f'0.4 * {comp} + 0.35 * {consistency} + 0.25 * {uniq}', 4)} AS overall FROM {rel}")


def h52(*parts) -> str:
    pieces = [p if isinstance(p, Sql) else q(str(p)) for p in parts]
    key = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in pieces) + ")"
    return f"CAST(('0x' || substr(md5({key}), 1, 13))::BIGINT AS DOUBLE)"


# ------------------------------------------------------- answer tables
def answers_sql() -> str:
    from tessera.sources.fixtures import DOMAINS, PERSONA_NAMES, PERSONA_ROLES
    dom = pick(DOMAINS, "doc_id % 4")
    cols = "(CASE " + dom + " " + " ".join(f"WHEN '{d}' THEN {arr(K.DOMAIN_COLUMNS[d])}" for d in DOMAINS) + " END)"
    a, b = f"{cols}[doc_id % 12 + 1]", f"{cols}[(doc_id * 5 + 1) % 12 + 1]"
    return f"""SELECT doc_id, {dom} AS domain, {pick(PERSONA_ROLES, 'doc_id % 3')} AS persona_role,
        {pick(PERSONA_NAMES, '(doc_id * 7 + 3) % 4')} AS requested_persona, text AS answer,
        CASE WHEN doc_id % 11 = 0 THEN []::VARCHAR[] WHEN doc_id % 3 = 0 THEN [{a}, {b}, 'Revenue'] ELSE [{a}, {b}] END
          AS cited_columns,
        CASE WHEN doc_id % 2 = 0 THEN floor({uni(Sql('doc_id'), 'judge')} * 10000) / 10000.0 END AS judge_score
        FROM documents"""


def action_text_sql() -> str:
    from tessera.operators.actions import ALL_SOURCES
    from tessera.sources.fixtures import DOMAINS
    op = pick(K.DOMAIN_OPERATIONS, "(conv_id + turn) % 6")
    col = pick(K.DOMAIN_COLUMNS["hr"], "turn % 12")
    src = pick(ALL_SOURCES, "(conv_id * 3 + turn) % 20")
    tool = pick(K.VALID_TOOLS + ["delete_table"], "(conv_id + 2 * turn) % 8")
    top = pick(K.TOOL_OPERATIONS + ["explode"], "conv_id % 9")
    kind = "(conv_id * 31 + turn) % 7"
    ans = ('{"answer": "Attrition is highest in Sales", "cited_columns": ["Department", "Attrition"], '
           '"reasoning": "grouped by department"}')
    return f"""SELECT conv_id, turn, {pick(DOMAINS, 'conv_id % 4')} AS domain, CASE
        WHEN {kind} = 0 THEN concat('{{"operation": "', {op}, '", "column": "', {col}, '", "value": "median"}}')
        WHEN {kind} = 1 THEN concat('<think>', text, '</think> I will fix the type of "', {col}, '" now.')
        WHEN {kind} = 2 THEN concat('{{"operation": "trim", "column": ', text)
        WHEN {kind} = 3 THEN text
        WHEN {kind} = 4 THEN concat('{{"tool": "', {tool}, '", "arguments": {{"operation": "', {top}, '", "column": "', {col}, '"}}}}')
        WHEN {kind} = 5 THEN concat('Step 1: ', text, ' {{"tool": "', {tool}, '"}}')
        ELSE concat(text, ' {{"operation": "add_field", "field_name": "', {src}, '", "source": "', {src}, {q('"} ' + ans)})
        END AS output FROM conversations"""


FIXTURE_SQL["answers"] = answers_sql
FIXTURE_SQL["action_text"] = action_text_sql


# ------------------------------------------------------------ step logs
def steps_sql() -> str:
    from tessera.sources.fixtures import AGENTS, EVENT_TOOL, STEP_COLUMNS, TASK_IDS
    day = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
    tool = "(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in EVENT_TOOL.items()) + " END)"
    isop = f"({tool} = 'apply_cleaning_operation')"
    e = Sql("event_id")
    reward = (f"(CASE WHEN event_type = 'error' THEN {K.TOOL_ERROR_REWARD}::DOUBLE "
              f"WHEN event_type = 'click' THEN floor({uni(e, 'reward')} * 3000) / 10000.0 - 0.1 "
              f"WHEN event_type = 'purchase' THEN (CASE WHEN value > 25 THEN {K.GATE_BONUS_PASS}::DOUBLE "
              f"ELSE {K.GATE_BONUS_FAIL}::DOUBLE END) END)")
    return f"""SELECT user_id * 100000 + {day} AS episode_id, user_id AS run_id, {day} AS day, ts, event_id,
        {pick(TASK_IDS, 'user_id % 3')} AS task_id, {pick(AGENTS, '(user_id // 3) % 3')} AS agent, {tool} AS tool_name,
        CASE WHEN {isop} THEN {pick(K.TOOL_OPERATIONS, 'event_id % 8')} END AS operation,
        CASE WHEN {isop} AND event_id % 8 <> 0 THEN {pick(STEP_COLUMNS, '(event_id // 8) % 5')} END AS "column",
        CASE WHEN event_type = 'error' THEN 'Unknown column' END AS error, {reward} AS reward,
        CASE WHEN event_type = 'signup' THEN floor({uni(e, 'final')} * 10000) / 10000.0 END AS final_reward,
        CASE WHEN event_type = 'purchase' THEN value > 25 END AS passed,
        CASE WHEN event_type = 'purchase' THEN 1 - value / 1000 END AS retention_ratio,
        CASE WHEN event_type = 'signup' THEN value > 100 END AS report_passed,
        CASE WHEN event_type = 'signup' THEN 1 - value / 2000 END AS report_retention
        FROM events"""


def metric_series_sql() -> str:
    from tessera.sources.fixtures import CURVE_TASKS
    day = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
    secs = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))"
    epoch = f"((({day}) % 15) * 86400 + {secs}) / 432000.0"
    e = Sql("event_id")
    vals = {"train/epoch": epoch, "train/reward": "value / 100.0", "train/loss": "1.0 / (value + 1.0)",
            "train/kl": "value / 1000.0", "train/reward_std": f"floor({uni(e, 'std')} * 1000) / 1000.0",
            "train/rewards/format_reward/mean": f"floor({uni(e, 'fmt')} * 1000) / 1000.0"}
    case = "(CASE m.metric " + " ".join(f"WHEN {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in vals.items()) + " END)"
    mlist = ", ".join(f"({q(k)})" for k in vals)
    return f"""SELECT task, metric, value, row_number() OVER (PARTITION BY task, metric ORDER BY ts, event_id) - 1 AS idx
        FROM (SELECT {pick(CURVE_TASKS, 'user_id % 3')} AS task, m.metric, ts, event_id, {case} AS value
              FROM events, (VALUES {mlist}) m(metric))"""


FIXTURE_SQL["steps"] = steps_sql
FIXTURE_SQL["metric_series"] = metric_series_sql


def with_duplicates(rel: str, key: str, columns: list[str], p: float, seed: int) -> str:
    """``rel`` with exactly max(1, int(n p)) copies drawn with replacement
    (``_copy`` > 0); ``columns`` are its columns, in any order."""
    order = ", ".join(f"{c} NULLS FIRST" for c in [key, *sorted(set(columns) - {key})])
    rank = f"least(CAST(floor({h52(Sql('j'), seed, 'dup')} / 4503599627370496.0::DOUBLE * c.n::DOUBLE) AS BIGINT), c.n - 1)"
    return (f"SELECT t.* EXCLUDE (_at), unnest(range(0, 1 + coalesce(d.drawn, 0))) AS _copy FROM "
            f"(SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS _at FROM {rel}) t LEFT JOIN "
            f"(SELECT {rank} AS at_rank, count(*) AS drawn FROM (SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 0 "
            f"ELSE greatest(1, CAST(floor(count(*) * {p}::DOUBLE) AS BIGINT)) END AS k FROM {rel}) c, "
            f"LATERAL (SELECT unnest(range(0, c.k)) AS j) s GROUP BY ALL) d ON d.at_rank = t._at")
