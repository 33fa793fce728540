"""Extensions sketched in the reference's design notes: reward shaping and
normalisation, curricula by variance, weighted / dependent / subtle quality
operators and enrichment budgets. All are window, aggregate or join plans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.exprs import hash_uniform
from tessera.operators import actions as A
from tessera.operators import enrich as E
from tessera.operators import stats
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.q_enrich import SqlInputs, TYPED, sql_source
from tessera.plans.q_text import enr_parse_sql
from tessera.plans.q_trajectory import _episodes, episodes_sql
from tessera.sources import fixtures as X

R = S.sround
GAMMA = 0.99
ORDER = ("ts", "event_id")


def _st(spark, sf):
    return X.steps(spark, sf)


def _ws(body, ctes=None):
    return S.with_fixtures(["steps"], body, ctes)


@register("x_step_cost", lambda: _ws(f"SELECT event_id, {R('coalesce(reward, 0.0) - 0.02', 6)} AS reward FROM steps"))
def x_step_cost(spark, sf):
    """Every step pays 0.02."""
    return _st(spark, sf).select("event_id", F.round(F.coalesce("reward", F.lit(0.0)) - 0.02, 6).alias("reward"))


@register("x_invalid_penalty", lambda: _ws(
    f"SELECT event_id, {R('coalesce(reward, 0.0) - CASE WHEN error IS NOT NULL THEN 0.1 ELSE 0.0 END', 6)} AS reward "
    "FROM steps"))
def x_invalid_penalty(spark, sf):
    """Invalid actions pay an extra 0.1."""
    df = _st(spark, sf)
    pen = F.when(F.col("error").isNotNull(), 0.1).otherwise(0.0)
    return df.select("event_id", F.round(F.coalesce("reward", F.lit(0.0)) - pen, 6).alias("reward"))


@register("x_hindsight_relabel", lambda: _ws(
    "SELECT s.event_id, " + R("0.5 * coalesce(s.reward, 0.0) + 0.5 * CASE WHEN e.success THEN 1.0 ELSE 0.0 END", 6)
    + " AS reward FROM steps s JOIN episodes e USING (episode_id)", [("episodes", episodes_sql())]))
def x_hindsight_relabel(spark, sf):
    """Step reward blended with the episode's final outcome (join on episode)."""
    eps = _episodes(spark, sf).select("episode_id", "success")
    j = _st(spark, sf).join(eps, "episode_id")
    return j.select("event_id", F.round(0.5 * F.coalesce("reward", F.lit(0.0))
                                        + 0.5 * F.when(F.col("success"), 1.0).otherwise(0.0), 6).alias("reward"))


@register("x_potential_shaping", lambda: _ws(
    "SELECT event_id, " + R(f"coalesce(reward, 0.0) + {GAMMA} * coalesce(lead(phi) OVER w, 0.0) - phi", 6)
    + " AS reward FROM (SELECT *, sum(coalesce(reward, 0.0)) OVER (PARTITION BY episode_id ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phi FROM steps) WINDOW w AS (PARTITION BY episode_id "
    "ORDER BY ts, event_id)"))
def x_potential_shaping(spark, sf):
    """r + gamma * Phi(next) - Phi(current), Phi = running return (``lead``)."""
    df = _st(spark, sf)
    w = W.partitionBy("episode_id").orderBy(*ORDER)
    phi = F.sum(F.coalesce("reward", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = df.select("episode_id", "event_id", *ORDER, "reward", phi.alias("phi"))
    nxt = F.coalesce(F.lead("phi").over(w), F.lit(0.0))
    return d.select("event_id", F.round(F.coalesce("reward", F.lit(0.0)) + GAMMA * nxt - F.col("phi"), 6)
                    .alias("reward"))


@register("x_reward_normalize", lambda: _ws(
    "SELECT s.event_id, " + R("CASE WHEN g.sd > 0 THEN (coalesce(s.reward, 0.0) - g.mu) / g.sd ELSE 0.0 END", 6)
    + " AS z FROM steps s JOIN (SELECT task_id, avg(coalesce(reward, 0.0)) AS mu, stddev_pop(coalesce(reward, 0.0)) "
    "AS sd FROM steps GROUP BY task_id) g USING (task_id)"))
def x_reward_normalize(spark, sf):
    """Per-task z-score of step rewards: group statistics by aggregation,
    joined back (broadcast: one row per task) -- no window over a task."""
    df = _st(spark, sf)
    r = F.coalesce("reward", F.lit(0.0))
    g = df.groupBy("task_id").agg(F.avg(r).alias("mu"), F.stddev_pop(r).alias("sd"))
    j = df.join(g, "task_id")
    return j.select("event_id", F.round(F.when(F.col("sd") > 0, (r - F.col("mu")) / F.col("sd")).otherwise(0.0), 6)
                    .alias("z"))


@register("x_inverse_variance_weights", lambda: _ws(
    "SELECT agent, " + R("(1.0 / v) / sum(1.0 / v) OVER ()", 6) + " AS weight FROM (SELECT agent, "
    "var_pop(total_return) AS v FROM episodes GROUP BY agent) WHERE v > 0", [("episodes", episodes_sql())]))
def x_inverse_variance_weights(spark, sf):
    """1 / variance of episode returns per agent, normalised to sum 1."""
    per = _episodes(spark, sf).groupBy("agent").agg(F.var_pop("total_return").alias("v")).where(F.col("v") > 0)
    total = per.agg(F.sum(1.0 / F.col("v"))).first()[0]
    return per.select("agent", F.round((1.0 / F.col("v")) / F.lit(total), 6).alias("weight"))


@register("x_discounted_return", lambda: _ws(
    "SELECT event_id, " + R("g - avg(g) OVER (PARTITION BY task_id)", 6) + " AS advantage FROM (SELECT event_id, task_id, "
    f"sum(coalesce(reward, 0.0) * pow({GAMMA}, k)) OVER (PARTITION BY episode_id ORDER BY ts, event_id ROWS BETWEEN "
    f"CURRENT ROW AND UNBOUNDED FOLLOWING) / pow({GAMMA}, k) AS g FROM (SELECT *, row_number() OVER (PARTITION BY "
    "episode_id ORDER BY ts, event_id) - 1 AS k FROM steps))"))
def x_discounted_return(spark, sf):
    """gamma-discounted return-to-go per step minus the task's mean return-to-go."""
    from tessera.operators.trajectory import discounted_returns
    df = _st(spark, sf).select("episode_id", "task_id", *ORDER, "reward")
    gd = discounted_returns(df, ["episode_id"], list(ORDER), "reward", GAMMA).select("event_id", "task_id", "g")
    base = gd.groupBy("task_id").agg(F.avg("g").alias("b"))
    return gd.join(base, "task_id").select("event_id", F.round(F.col("g") - F.col("b"), 6).alias("advantage"))


@register("x_variance_curriculum", lambda: _ws(
    "SELECT run_id, " + R("v", 6) + " AS variance FROM (SELECT run_id, var_pop(total_return) AS v FROM episodes "
    "GROUP BY run_id) WHERE v >= (SELECT quantile_cont(v, 0.5) FROM (SELECT var_pop(total_return) AS v FROM episodes "
    "GROUP BY run_id))", [("episodes", episodes_sql())]))
def x_variance_curriculum(spark, sf):
    """Keep the runs whose return variance is at or above the median (the
    top half), with the median from the distributed exact quantile."""
    per = _episodes(spark, sf).groupBy("run_id").agg(F.var_pop("total_return").alias("v"))
    med = stats.exact_quantiles(per, {"v": F.col("v")}, [0.5])["v"][0]
    return per.where(F.col("v") >= F.lit(med)).select("run_id", F.round("v", 6).alias("variance"))


@register("x_verifiable_reward", lambda: _ws(
    "SELECT episode_id, " + R("0.5 * total_return + 0.5 * CASE WHEN retention_ratio >= 0.85 THEN 1.0 ELSE 0.0 END", 6)
    + " AS reward FROM episodes", [("episodes", episodes_sql())]))
def x_verifiable_reward(spark, sf):
    """Return mixed with a verifiable threshold check (retention >= 0.85)."""
    eps = _episodes(spark, sf)
    ok = F.when(F.col("retention_ratio") >= K.MIN_RETENTION, 1.0).otherwise(0.0)
    return eps.select("episode_id", F.round(0.5 * F.col("total_return") + 0.5 * ok, 6).alias("reward"))


@register("x_prefix_weight", lambda: _ws(
    "SELECT event_id, " + R("1.0 / count(*) OVER (PARTITION BY p)", 6) + " AS weight FROM (SELECT event_id, "
    "coalesce(array_to_string(list(tool_name) OVER (PARTITION BY episode_id ORDER BY ts, event_id ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND CURRENT ROW), '|'), '') AS p FROM steps)"))
def x_prefix_weight(spark, sf):
    """1 / number of steps (over all episodes) that share the same action
    prefix: prefix text per step, counted by aggregation, joined back."""
    df = _st(spark, sf)
    w = W.partitionBy("episode_id").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    p = df.select("event_id", F.array_join(F.collect_list("tool_name").over(w), "|").alias("p"))
    cnt = p.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    return p.join(cnt, "p").select("event_id", F.round(1.0 / F.col("c"), 6).alias("weight"))


# Column importance weights for the weighted DQ score.
DQ_WEIGHTS = {"order_id": 1.0, "customer_id": 1.0, "priority": 2.0, "price": 3.0, "order_date": 1.0, "status": 1.0}


@register("x_weighted_dq", lambda: S.with_fixtures(["dirty_orders"], (
    "SELECT " + R("(" + " + ".join(f"{w} * (1.0 - count_if({c} IS NULL) / count(*))" for c, w in DQ_WEIGHTS.items())
                  + f") / {sum(DQ_WEIGHTS.values())}", 4) + " AS weighted_completeness FROM dirty_orders")))
def x_weighted_dq(spark, sf):
    df = X.dirty_orders(spark, sf)
    n = F.count(F.lit(1))
    terms = [w * (1.0 - F.count_if(F.col(c).isNull()) / n) for c, w in DQ_WEIGHTS.items()]
    return df.agg(F.round(sum(terms[1:], terms[0]) / sum(DQ_WEIGHTS.values()), 4).alias("weighted_completeness"))


@register("x_dependent_corruption", lambda: S.with_fixtures(["dom_hr"], (
    "SELECT EmployeeID, Department, CASE WHEN " + S.uni(S.Sql("EmployeeID"), 42, "dep_null")
    + " < (CASE WHEN Department = 'Sales' THEN 0.3 ELSE 0.05 END) THEN NULL ELSE MonthlyIncome END AS MonthlyIncome "
    "FROM dom_hr")))
def x_dependent_corruption(spark, sf):
    """Conditional noise: income goes missing far more often in Sales."""
    df = X.dom_hr(spark, sf)
    p = F.when(F.col("Department") == "Sales", 0.3).otherwise(0.05)
    return df.select("EmployeeID", "Department", F.when(hash_uniform(F.col("EmployeeID"), 42, "dep_null") < p, F.lit(None))
                     .otherwise(F.col("MonthlyIncome")).alias("MonthlyIncome"))


@register("x_subtle_corruption", lambda: S.with_fixtures(["dom_sales"], (
    "SELECT DealID, AccountName, Amount, 0 AS _near FROM dom_sales UNION ALL SELECT DealID, upper(AccountName), "
    "Amount * 1.01, 1 FROM dom_sales WHERE " + S.uni(S.Sql("DealID"), 42, "near") + " < 0.03")))
def x_subtle_corruption(spark, sf):
    """Near-duplicates: 3% of deals re-appear with an upper-cased account and
    the amount off by 1% (exact dedup does not catch them)."""
    df = X.dom_sales(spark, sf).select("DealID", "AccountName", "Amount")
    near = df.where(hash_uniform(F.col("DealID"), 42, "near") < 0.03).select(
        "DealID", F.upper("AccountName").alias("AccountName"), (F.col("Amount") * 1.01).alias("Amount"),
        F.lit(1).alias("_near"))
    return df.withColumn("_near", F.lit(0)).unionByName(near)


@register("x_citation_rate", lambda: S.with_fixtures(["answers"], (
    "SELECT c AS column_name, count(*) AS n, " + R("count(*) / (SELECT count(*) FROM answers)", 4)
    + " AS rate FROM (SELECT unnest(cited_columns) AS c FROM answers) GROUP BY c")))
def x_citation_rate(spark, sf):
    """How often each column is cited per answer."""
    a = X.answers(spark, sf)
    n = a.count()
    return (a.select(F.explode("cited_columns").alias("column_name")).groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.lit(n), 4).alias("rate")))


# Cost of each enrichment source (lookups cost more) and budget.
SOURCE_COST = {s: (2.0 if s in ("industry_benchmark", "industry_code", "escalation_path") else 1.0)
               for srcs in K.ENRICHMENT_SOURCES.values() for s in srcs}
BUDGET = 3.0


@register("x_budgeted_enrichment", lambda: S.with_fixtures(["action_text"], (
    "SELECT conv_id, turn, field_name, spent FROM (SELECT conv_id, turn, field_name, sum(cost) OVER (PARTITION BY "
    "conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM (SELECT conv_id, turn, "
    "field_name, (CASE field_name " + " ".join(f"WHEN {S.q(s)} THEN {c}::DOUBLE" for s, c in SOURCE_COST.items())
    + " END) AS cost FROM (SELECT conv_id, turn, " + enr_parse_sql("output") + " FROM action_text)) WHERE cost IS NOT NULL) "
    f"WHERE spent <= {BUDGET}")))
def x_budgeted_enrichment(spark, sf):
    """Enrichment actions kept while the conversation's running cost stays
    within the budget (running sum window per conversation)."""
    df = X.action_text(spark, sf)
    p = A.parse_enrichment_action(F.col("output"))
    cost = F.try_element_at(F.create_map(*[x for s, c in SOURCE_COST.items() for x in (F.lit(s), F.lit(c))]),
                            p["field_name"])
    d = df.select("conv_id", "turn", p["field_name"].alias("field_name"), cost.alias("cost")).where(
        F.col("cost").isNotNull())
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return d.select("conv_id", "turn", "field_name", F.sum("cost").over(w).alias("spent")).where(
        F.col("spent") <= BUDGET)


@register("x_composite_enrichment", lambda: S.with_fixtures(["dom_hr"], (
    "SELECT EmployeeID, " + R(f"0.5 * {sql_source(SqlInputs(K.DOMAIN_COLUMNS['hr'] + ['EmployeeCount', 'StandardHours'], TYPED), 'flight_risk_score')}"
                              f" + 0.5 * (1 - {sql_source(SqlInputs(K.DOMAIN_COLUMNS['hr'] + ['EmployeeCount', 'StandardHours'], TYPED), 'satisfaction_index')})", 2)
    + " AS retention_risk FROM dom_hr")))
def x_composite_enrichment(spark, sf):
    """A derived-of-derived field: blends two enrichment outputs."""
    df = X.dom_hr(spark, sf)
    inp = E.Inputs(df)
    return df.select("EmployeeID", F.round(0.5 * E.flight_risk_score(inp) + 0.5 * (1 - E.satisfaction_index(inp)), 2)
                     .alias("retention_risk"))


@register("x_source_conflict", lambda: S.with_fixtures(["dom_sales"], (
    "SELECT DealID, arg_max(v, rel) AS deal_size FROM (SELECT DealID, "
    + sql_source(SqlInputs(K.DOMAIN_COLUMNS["sales"], TYPED), "deal_size_category") + " AS v, 0.9 AS rel FROM dom_sales "
    "UNION ALL SELECT DealID, CASE WHEN Amount * 1.1 < 5000 THEN 'Small' WHEN Amount * 1.1 < 25000 THEN 'Medium' "
    "WHEN Amount * 1.1 < 100000 THEN 'Large' ELSE 'Enterprise' END, CASE WHEN Stage = 'Won' THEN 0.95 ELSE 0.5 END "
    "FROM dom_sales) GROUP BY DealID")))
def x_source_conflict(spark, sf):
    """Two sources disagree on a field: keep the value of the more reliable
    source per key (``max_by`` aggregation)."""
    df = X.dom_sales(spark, sf)
    a = df.select("DealID", E.deal_size_category(E.Inputs(df)).alias("v"), F.lit(0.9).alias("rel"))
    amt = F.col("Amount") * 1.1
    b = df.select("DealID", F.when(amt < 5000, "Small").when(amt < 25000, "Medium").when(amt < 100000, "Large")
                  .otherwise("Enterprise").alias("v"),
                  F.when(F.col("Stage") == "Won", 0.95).otherwise(0.5).alias("rel"))
    return a.unionByName(b).groupBy("DealID").agg(F.max_by("v", "rel").alias("deal_size"))
