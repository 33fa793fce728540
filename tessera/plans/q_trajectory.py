"""Trajectory, evaluation, curriculum, curve and reward queries over the
step log and answer tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.exprs import hash_uniform
from tessera.operators import answers as AN
from tessera.operators import actions as A
from tessera.operators import trajectory as T
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.policy import TASK_POLICIES
from tessera.plans.q_text import align_sql, by_persona_sql, enr_parse_sql
from tessera.sources import fixtures as X

R = S.sround
ORDER = ("ts", "event_id")


def _steps(spark, sf):
    return X.steps(spark, sf)


def _ws(body, ctes=None, extra=()):
    return S.with_fixtures(["steps", *extra], body, ctes)


# ------------------------------------------------------------ step level
@register("view_steps", lambda: _ws("SELECT * FROM steps"))
def view_steps(spark, sf):
    return _steps(spark, sf)


@register("traj_reward_extract", lambda: _ws(
    "SELECT event_id, coalesce(reward, final_reward, 0.0) AS reward FROM steps"))
def traj_reward_extract(spark, sf):
    df = _steps(spark, sf)
    return df.select("event_id", T.reward_extract(df).alias("reward"))


@register("traj_running_return", lambda: _ws(
    "SELECT episode_id, event_id, row_number() OVER w - 1 AS idx, "
    f"{R('sum(coalesce(reward, 0.0)) OVER w', 6)} AS running_return FROM steps "
    "WINDOW w AS (PARTITION BY episode_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def traj_running_return(spark, sf):
    """Step index and cumulative reward per episode via the range-partitioned
    prefix sum (skew-safe: no task holds a whole episode)."""
    df = _steps(spark, sf)
    out = T.ordered_prefix(df, ["episode_id"], list(ORDER), {"running_return": F.coalesce("reward", F.lit(0.0))})
    return out.select("episode_id", "event_id", "idx", F.round("running_return", 6).alias("running_return"))


def episodes_sql() -> str:
    return ("SELECT episode_id, any_value(run_id) AS run_id, any_value(day) AS day, any_value(task_id) AS task_id, "
            "any_value(agent) AS agent, "
            f"{R('sum(coalesce(reward, 0.0))', 6)} AS total_return, count(*) AS steps, "
            "CAST(count_if(error IS NOT NULL) AS BIGINT) AS invalid_actions, "
            "coalesce(arg_max_null(report_passed, (ts, event_id)), arg_max_null(passed, (ts, event_id))) AS quality_gate_passed, "
            "coalesce(arg_max_null(report_retention, (ts, event_id)), arg_max_null(retention_ratio, (ts, event_id))) "
            "AS retention_ratio, "
            "coalesce(coalesce(arg_max_null(report_passed, (ts, event_id)), arg_max_null(passed, (ts, event_id))), FALSE) "
            "AS success, max(final_reward) AS final_reward FROM steps GROUP BY episode_id")


def _episodes(spark, sf):
    df = _steps(spark, sf)
    return T.episode_metrics(df, extra=[
        F.any_value("run_id").alias("run_id"), F.any_value("day").alias("day"),
        F.any_value("task_id").alias("task_id"), F.any_value("agent").alias("agent"),
        F.max("final_reward").alias("final_reward")])


@register("traj_episode_metrics", lambda: _ws(episodes_sql()))
def traj_episode_metrics(spark, sf):
    return _episodes(spark, sf)


def _we(body, ctes=None, extra=()):
    return S.with_fixtures(["steps", *extra], body, [("episodes", episodes_sql())] + (ctes or []))


def _agg_sql(group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (f"SELECT {g}count(*) AS episodes, {R('coalesce(avg(CAST(success AS DOUBLE)), 0.0)', 6)} AS success_rate, "
            f"{R('coalesce(avg(total_return), 0.0)', 6)} AS avg_return, {R('coalesce(avg(steps), 0.0)', 6)} AS avg_steps, "
            f"{R('coalesce(avg(invalid_actions), 0.0)', 6)} AS avg_invalid_actions FROM episodes"
            + (f" GROUP BY {group}" if group else ""))


@register("traj_aggregate", lambda: _we(_agg_sql()))
def traj_aggregate(spark, sf):
    return T.aggregate_metrics(_episodes(spark, sf))


@register("traj_by_task", lambda: _we(
    "SELECT task_id, " + ", ".join(
        f"{R(f'avg(CASE WHEN agent = {S.q(a)} THEN CAST(success AS DOUBLE) END)', 4)} AS {a}" for a in X.AGENTS)
    + " FROM episodes GROUP BY task_id"))
def traj_by_task(spark, sf):
    """Success rate per task x agent (NULL where an agent has no episodes)."""
    eps = _episodes(spark, sf)
    p = eps.groupBy("task_id").pivot("agent", X.AGENTS).agg(F.avg(F.col("success").cast("double")))
    return p.select("task_id", *[F.round(a, 4).alias(a) for a in X.AGENTS])


@register("traj_agent_compare", lambda: _we(
    "SELECT a.*, " + R("a.avg_return - b.avg_return", 6) + " AS delta_return, "
    + R("a.success_rate - b.success_rate", 6) + " AS delta_success FROM (" + _agg_sql("agent") + ") a, ("
    + _agg_sql("agent") + ") b WHERE b.agent = 'random'"))
def traj_agent_compare(spark, sf):
    """Metrics per agent and deltas against the random baseline (the
    baseline is a one-row aggregate, inlined as literals)."""
    per = T.aggregate_metrics(_episodes(spark, sf), ["agent"])
    base = per.where(F.col("agent") == "random").first()
    if base is None:
        return per.withColumn("delta_return", F.lit(None).cast("double")).withColumn(
            "delta_success", F.lit(None).cast("double"))
    return per.select("*", F.round(F.col("avg_return") - F.lit(base["avg_return"]), 6).alias("delta_return"),
                      F.round(F.col("success_rate") - F.lit(base["success_rate"]), 6).alias("delta_success"))


@register("traj_error_rows", lambda: _we(
    "SELECT e.episode_id, e.task_id, e.agent, CASE WHEN f.error IS NULL THEN e.total_return ELSE 0.0 END AS total_return, "
    "CASE WHEN f.error IS NULL THEN e.steps ELSE 0 END AS steps, "
    "CASE WHEN f.error IS NULL THEN e.invalid_actions ELSE 0 END AS invalid_actions, f.error IS NULL AND e.success AS success, "
    "CASE WHEN f.error IS NULL THEN e.quality_gate_passed ELSE FALSE END AS quality_gate_passed, "
    "CASE WHEN f.error IS NULL THEN e.retention_ratio END AS retention_ratio, f.error "
    "FROM episodes e LEFT JOIN (SELECT episode_id, arg_min_null(error, (ts, event_id)) AS error FROM steps "
    "GROUP BY episode_id) f USING (episode_id)"))
def traj_error_rows(spark, sf):
    """The log of all episodes: those whose first step failed are zero rows
    carrying the error, the others keep their metrics (error null)."""
    eps = T.episode_metrics(_steps(spark, sf), extra=[
        F.any_value("task_id").alias("task_id"), F.any_value("agent").alias("agent"),
        F.min_by("error", F.struct(*ORDER)).alias("error")])
    return T.zero_failed(eps).select("episode_id", "task_id", "agent", "total_return", "steps", "invalid_actions",
                                     "success", "quality_gate_passed", "retention_ratio", "error")


@register("traj_progress_log", lambda: _we(
    "SELECT run_id, episode_no, " + R("success_so_far", 6) + " AS success_rate, " + R("return_so_far", 6)
    + " AS avg_return FROM (SELECT run_id, row_number() OVER w AS episode_no, "
    "avg(CAST(success AS DOUBLE)) OVER w AS success_so_far, avg(total_return) OVER w AS return_so_far "
    "FROM episodes WINDOW w AS (PARTITION BY run_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "WHERE episode_no % 5 = 0"))
def traj_progress_log(spark, sf):
    """Aggregates so far, logged every 5th episode of each run (a run is one
    user's daily episodes, so the window partition is bounded by days)."""
    eps = _episodes(spark, sf)
    w = W.partitionBy("run_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    out = eps.select("run_id", F.row_number().over(W.partitionBy("run_id").orderBy("day")).cast("long").alias("episode_no"),
                     F.avg(F.col("success").cast("double")).over(w).alias("s"), F.avg("total_return").over(w).alias("r"))
    return out.where(F.col("episode_no") % 5 == 0).select(
        "run_id", "episode_no", F.round("s", 6).alias("success_rate"), F.round("r", 6).alias("avg_return"))


@register("eval_summarize", lambda: _we(
    "SELECT agent, count(*) AS total, CAST(count_if(steps > 0) AS BIGINT) AS valid, " + R("avg(total_return)", 4) + " AS mean_return, "
    + R("coalesce(stddev_samp(total_return), 0.0)", 4) + " AS std_return FROM episodes GROUP BY agent"))
def eval_summarize(spark, sf):
    eps = _episodes(spark, sf)
    return eps.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("steps") > 0).alias("valid"),
        F.round(F.avg("total_return"), 4).alias("mean_return"),
        F.round(F.coalesce(F.stddev_samp("total_return"), F.lit(0.0)), 4).alias("std_return"))


@register("eval_summarize_pop", lambda: _we(
    "SELECT task_id, agent, count(*) AS n, " + R("avg(total_return)", 4) + " AS mean_return, "
    + R("stddev_pop(total_return)", 4) + " AS std_return FROM episodes GROUP BY GROUPING SETS ((), (task_id), (agent))"))
def eval_summarize_pop(spark, sf):
    """Overall, per-task and per-agent mean and population std in one
    aggregation (GROUPING SETS expands rows, not scans)."""
    return _episodes(spark, sf).groupingSets([[], ["task_id"], ["agent"]], "task_id", "agent").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("total_return"), 4).alias("mean_return"),
        F.round(F.stddev_pop("total_return"), 4).alias("std_return"))


@register("demo_success_filter", lambda: _we(
    "SELECT episode_id, task_id, final_reward FROM episodes WHERE final_reward > 0.5"))
def demo_success_filter(spark, sf):
    return _episodes(spark, sf).where(F.col("final_reward") > 0.5).select("episode_id", "task_id", "final_reward")


@register("demo_stats", lambda: _we(
    "SELECT task_id, count(*) AS n, " + R("avg(CAST(final_reward > 0.5 AS DOUBLE))", 4) + " AS success_rate, "
    + R("avg(steps)", 4) + " AS avg_steps, " + R("avg(total_return)", 4)
    + " AS avg_reward FROM episodes GROUP BY GROUPING SETS ((), (task_id))"))
def demo_stats(spark, sf):
    """Totals and per task (GROUPING SETS ((), (task_id)))."""
    eps = _episodes(spark, sf)
    win = F.when(F.col("final_reward") > 0.5, 1.0).when(F.col("final_reward").isNotNull(), 0.0)
    return eps.cube("task_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(win), 4).alias("success_rate"),
        F.round(F.avg("steps"), 4).alias("avg_steps"), F.round(F.avg("total_return"), 4).alias("avg_reward"))


@register("sft_step_examples", lambda: _ws(
    "SELECT episode_id, event_id, tool_name AS target_tool, coalesce(len(h), 0) AS n_history, "
    "coalesce(array_to_string(h, '|'), '') AS history FROM (SELECT *, list(tool_name) OVER (PARTITION BY episode_id "
    "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM steps)"))
def sft_step_examples(spark, sf):
    """One training row per step whose prompt is the episode's earlier
    actions. The history is O(step) per row by definition; episodes are one
    user-day here, so each window partition is small."""
    df = _steps(spark, sf)
    w = W.partitionBy("episode_id").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    h = F.collect_list("tool_name").over(w)
    return df.select("episode_id", "event_id", F.col("tool_name").alias("target_tool"),
                     F.size(h).cast("long").alias("n_history"), F.array_join(h, "|").alias("history"))


# ------------------------------------------------- required ops / rewards
REQUIRED = TASK_POLICIES["ecommerce_mobile"]


def _required_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {S.q(op)} AS operation, {S.q(c) if c else 'NULL'} AS col" for op, c in REQUIRED)


@register("required_op_coverage", lambda: _we(
    f"SELECT e.episode_id, {R('count(DISTINCT CASE WHEN r.operation IS NOT NULL THEN (r.operation, r.col) END) / ' + str(len(REQUIRED)), 4)} AS coverage "
    "FROM episodes e LEFT JOIN (SELECT DISTINCT episode_id, operation, \"column\" FROM steps WHERE operation IS NOT NULL) x "
    "ON e.episode_id = x.episode_id LEFT JOIN req r ON x.operation = r.operation AND x.\"column\" IS NOT DISTINCT FROM r.col "
    "GROUP BY e.episode_id", [("req", _required_sql())]))
def required_op_coverage(spark, sf):
    """Matched required (operation, column) pairs / required pairs per
    episode: a null-safe join to the 15-row required-ops dimension (fixed
    size, broadcast)."""
    df = _steps(spark, sf)
    req = spark.createDataFrame([(op, c) for op, c in REQUIRED], "operation string, col string")
    ex = df.where(F.col("operation").isNotNull()).select("episode_id", "operation", "column").distinct()
    hit = ex.join(F.broadcast(req), (ex.operation == req.operation) & ex["column"].eqNullSafe(req.col))
    per = hit.groupBy("episode_id").agg(F.count_distinct(F.struct(req.operation, req.col)).alias("m"))
    eps = df.select("episode_id").distinct()
    return eps.join(per, "episode_id", "left").select(
        "episode_id", F.round(F.coalesce(F.col("m"), F.lit(0)) / len(REQUIRED), 4).alias("coverage"))


def _required_pairs(spark, sf):
    """(episode, required operation) pairs, and the operations the steps ran."""
    df = _steps(spark, sf)
    pairs = F.array(*[F.struct(F.lit(op).alias("operation"), F.lit(c).cast("string").alias("col"))
                      for op, c in dict.fromkeys(REQUIRED)])
    wanted = df.select("episode_id").distinct().select("episode_id", F.inline(pairs))
    ran = df.where(F.col("operation").isNotNull()).select("episode_id", "operation", F.col("column").alias("col")).distinct()
    return wanted, ran


_PAIRS_SQL = "SELECT e.episode_id, r.operation, r.col FROM (SELECT DISTINCT episode_id FROM steps) e, req r"
_RAN_SQL = "SELECT episode_id, operation, \"column\" FROM steps WHERE operation IS NOT NULL"


@register("required_op_missing", lambda: _we(f"{_PAIRS_SQL} EXCEPT {_RAN_SQL}", [("req", _required_sql())]))
def required_op_missing(spark, sf):
    """Required operations that an episode never ran (anti join on the distinct
    operations, null columns matching each other)."""
    wanted, ran = _required_pairs(spark, sf)
    same = (wanted.episode_id == ran.episode_id) & (wanted.operation == ran.operation) & wanted["col"].eqNullSafe(ran["col"])
    return wanted.join(ran, same, "left_anti")


@register("required_op_done", lambda: _we(f"{_PAIRS_SQL} INTERSECT {_RAN_SQL}", [("req", _required_sql())]))
def required_op_done(spark, sf):
    """Required operations that an episode ran (intersection of key sets)."""
    wanted, ran = _required_pairs(spark, sf)
    return wanted.intersect(ran)


@register("rew_tool_error", lambda: _ws(
    f"SELECT event_id, CASE WHEN error IS NOT NULL THEN {K.TOOL_ERROR_REWARD}::DOUBLE ELSE reward END AS reward FROM steps"))
def rew_tool_error(spark, sf):
    df = _steps(spark, sf)
    return df.select("event_id", F.when(F.col("error").isNotNull(), F.lit(K.TOOL_ERROR_REWARD))
                     .otherwise(F.col("reward")).alias("reward"))


@register("rew_gate_bonus", lambda: _ws(
    f"SELECT event_id, CASE WHEN passed THEN {K.GATE_BONUS_PASS}::DOUBLE ELSE {K.GATE_BONUS_FAIL}::DOUBLE END AS bonus "
    "FROM steps WHERE tool_name = 'run_quality_gates'"))
def rew_gate_bonus(spark, sf):
    df = _steps(spark, sf).where(F.col("tool_name") == "run_quality_gates")
    return df.select("event_id", F.when(F.col("passed"), F.lit(K.GATE_BONUS_PASS))
                     .otherwise(F.lit(K.GATE_BONUS_FAIL)).alias("bonus"))


@register("rew_step", lambda: _ws(
    "SELECT event_id, " + R(f"greatest({K.STEP_MAX_NEGATIVE}::DOUBLE, (q - coalesce(lag(q) OVER w, 0.0)) - "
                            f"{K.STEP_IMPROVEMENT_MARGIN}::DOUBLE)", 6)
    + " AS reward FROM (SELECT *, sum(coalesce(reward, 0.0)) OVER (PARTITION BY episode_id ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM steps) WINDOW w AS (PARTITION BY episode_id "
    "ORDER BY ts, event_id)"))
def rew_step(spark, sf):
    """max(-0.15, delta quality - 0.02) with quality = the running return. The
    return rises by the step's own reward, so no window over the episode is
    needed, however long it is."""
    delta = F.coalesce("reward", F.lit(0.0))
    return _steps(spark, sf).select("event_id", F.round(
        T.step_reward(F.lit(0.0), delta), 6).alias("reward"))


@register("rew_final", lambda: _we(
    "SELECT e.episode_id, " + R("0.45 * coalesce(e.retention_ratio, 0.0) + 0.30 * (CASE WHEN e.success THEN 1.0 ELSE 0.0 END)"
                                " + 0.25 * c.coverage", 6) + " AS final_reward FROM episodes e JOIN cov c USING (episode_id)",
    [("req", _required_sql()), ("cov", (
        f"SELECT e.episode_id, {R('count(DISTINCT CASE WHEN r.operation IS NOT NULL THEN (r.operation, r.col) END) / ' + str(len(REQUIRED)), 4)} AS coverage "
        "FROM episodes e LEFT JOIN (SELECT DISTINCT episode_id, operation, \"column\" FROM steps WHERE operation IS NOT NULL) x "
        "ON e.episode_id = x.episode_id LEFT JOIN req r ON x.operation = r.operation AND x.\"column\" IS NOT DISTINCT FROM r.col "
        "GROUP BY e.episode_id"))]))
def rew_final(spark, sf):
    """.45 quality (retention) + .30 gate + .25 required-op coverage."""
    eps = _episodes(spark, sf)
    cov = required_op_coverage(spark, sf)
    j = eps.join(cov, "episode_id")
    return j.select("episode_id", F.round(T.final_reward(
        F.coalesce("retention_ratio", F.lit(0.0)), F.col("success"), F.col("coverage")), 6).alias("final_reward"))


def _dq_pair_sql() -> str:
    b = f"(0.6 + 0.3 * {S.uni(S.Sql('episode_id'), 'dq_before')})"
    return f"SELECT episode_id, run_id, {b} AS dq_before, {b} + 0.2 * ({S.uni(S.Sql('episode_id'), 'dq_after')} - 0.3) AS dq_after FROM episodes"


def _dq_pair(spark, sf):
    eps = _episodes(spark, sf).select("episode_id", "run_id")
    b = 0.6 + 0.3 * hash_uniform(F.col("episode_id"), "dq_before")
    return eps.select("episode_id", "run_id", b.alias("dq_before"),
                      (b + 0.2 * (hash_uniform(F.col("episode_id"), "dq_after") - 0.3)).alias("dq_after"))


@register("rew_cleaning", lambda: _we(
    "SELECT episode_id, " + R("0.5 * dq_after + 0.5 * least(greatest(0.0, dq_after - dq_before) * 5.0, 1.0)", 4)
    + " AS reward FROM dq", [("dq", _dq_pair_sql())]))
def rew_cleaning(spark, sf):
    d = _dq_pair(spark, sf)
    imp = F.greatest(F.lit(0.0), F.col("dq_after") - F.col("dq_before"))
    return d.select("episode_id", F.round(0.5 * F.col("dq_after") + 0.5 * F.least(imp * 5.0, F.lit(1.0)), 4)
                    .alias("reward"))


# --------------------------------------------- enrichment coverage (conversations)
def _cov_sql() -> str:
    avail = "(CASE domain " + " ".join(f"WHEN '{d}' THEN {S.arr(K.ENRICHMENT_SOURCES[d])}" for d in X.DOMAINS) + " END)"
    return ("SELECT conv_id, any_value(domain) AS domain, count(*) AS steps, "
            f"{R('count(DISTINCT CASE WHEN list_contains(' + avail + ', field_name) THEN field_name END) / 5', 4)} "
            "AS coverage FROM (SELECT conv_id, turn, domain, " + enr_parse_sql("output") + " FROM action_text) GROUP BY conv_id")


def _coverage(spark, sf):
    df = X.action_text(spark, sf)
    p = A.parse_enrichment_action(F.col("output"))
    avail = F.element_at(F.create_map(*[x for d in X.DOMAINS for x in (
        F.lit(d), F.array(*[F.lit(s) for s in K.ENRICHMENT_SOURCES[d]]))]), F.col("domain"))
    x = df.select("conv_id", "domain", p["field_name"].alias("f"), avail.alias("avail"))
    return x.groupBy("conv_id").agg(
        F.any_value("domain").alias("domain"), F.count(F.lit(1)).alias("steps"),
        F.round(F.count_distinct(F.when(F.array_contains("avail", F.col("f")), F.col("f"))) / 5, 4).alias("coverage"))


@register("enr_coverage", lambda: S.with_fixtures(["action_text"], _cov_sql()))
def enr_coverage(spark, sf):
    """Distinct valid fields added / possible fields, per conversation."""
    return _coverage(spark, sf)


@register("enr_coverage_done", lambda: S.with_fixtures(["action_text"], (
    "SELECT conv_id, coverage > 0.8 OR steps >= 12 AS done FROM (" + _cov_sql() + ")")))
def enr_coverage_done(spark, sf):
    c = _coverage(spark, sf)
    return c.select("conv_id", ((F.col("coverage") > 0.8) | (F.col("steps") >= 12)).alias("done"))


@register("rew_enrichment", lambda: S.with_fixtures(["action_text"], (
    "SELECT conv_id, " + R("coverage", 4) + " AS reward FROM (" + _cov_sql() + ")")))
def rew_enrichment(spark, sf):
    return _coverage(spark, sf).select("conv_id", F.round("coverage", 4).alias("reward"))


# ------------------------------------------------------ answering rewards
def _answer_reward_sql() -> str:
    cols = "(CASE domain " + " ".join(f"WHEN '{d}' THEN {S.arr(X.VIEW_COLUMNS[d])}" for d in X.DOMAINS) + " END)"
    faith = (f"(CASE WHEN len(cited_columns) > 0 THEN len(list_filter(cited_columns, lambda c: list_contains({cols}, c)))"
             " / len(cited_columns) ELSE 0.1 END)")
    persona = by_persona_sql("persona_role", lambda p: align_sql("answer", p), AN.PERSONA_BY_ROLE)
    return (f"SELECT doc_id, domain, persona_role, {faith} AS faith, {persona} AS persona, judge_score, "
            f"{R(f'CASE WHEN judge_score IS NULL THEN 0.3 * {faith} + 0.7 * {persona} ELSE 0.4 * judge_score + 0.6 * {persona} END', 4)}"
            " AS reward FROM answers")


def _answer_rewards(spark, sf):
    df = X.answers(spark, sf)
    faith = AN.faithfulness_eval(F.col("cited_columns"), F.element_at(X.domain_columns_map(X.VIEW_COLUMNS),
                                                                      F.col("domain")))
    persona = AN.persona_alignment(df)
    reward = F.when(F.col("judge_score").isNull(), 0.3 * faith + 0.7 * persona).otherwise(
        0.4 * F.col("judge_score") + 0.6 * persona)
    return df.select("doc_id", "domain", "persona_role", faith.alias("faith"), persona.alias("persona"),
                     "judge_score", F.round(reward, 4).alias("reward"))


@register("rew_answering", lambda: S.with_fixtures(["answers"], f"SELECT doc_id, reward FROM ({_answer_reward_sql()})"))
def rew_answering(spark, sf):
    return _answer_rewards(spark, sf).select("doc_id", "reward")


@register("eval_by_persona", lambda: S.with_fixtures(["answers"], (
    f"SELECT persona_role, count(*) AS n, {R('avg(reward)', 4)} AS mean_reward FROM ({_answer_reward_sql()}) "
    "GROUP BY persona_role")))
def eval_by_persona(spark, sf):
    return _answer_rewards(spark, sf).groupBy("persona_role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 4).alias("mean_reward"))


@register("eval_by_domain", lambda: S.with_fixtures(["answers"], (
    f"SELECT domain, count(*) AS n, {R('avg(reward)', 4)} AS mean_reward FROM ({_answer_reward_sql()}) GROUP BY domain")))
def eval_by_domain(spark, sf):
    return _answer_rewards(spark, sf).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 4).alias("mean_reward"))


@register("eval_baseline_matrix", lambda: S.with_fixtures(["answers"], (
    f"SELECT domain, persona_role, count(*) AS n, {R('avg(reward)', 4)} AS mean_reward, {R('avg(faith)', 4)} AS mean_faith, "
    f"{R('avg(persona)', 4)} AS mean_persona FROM ({_answer_reward_sql()}) GROUP BY domain, persona_role")))
def eval_baseline_matrix(spark, sf):
    """Every domain x persona cell from one grouped aggregation (cells come
    from the data; no dimension cross product)."""
    return _answer_rewards(spark, sf).groupBy("domain", "persona_role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 4).alias("mean_reward"),
        F.round(F.avg("faith"), 4).alias("mean_faith"), F.round(F.avg("persona"), 4).alias("mean_persona"))


@register("eval_heatmap", lambda: S.with_fixtures(["answers"], (
    "SELECT metric, " + ", ".join(f"{R(f'avg(CASE WHEN domain = {S.q(d)} THEN v END)', 4)} AS {d}" for d in X.DOMAINS)
    + f" FROM (SELECT domain, unnest(['faith', 'persona', 'reward']) AS metric, unnest([faith, persona, reward]) AS v "
    f"FROM ({_answer_reward_sql()})) GROUP BY metric")))
def eval_heatmap(spark, sf):
    r = _answer_rewards(spark, sf)
    long = r.select("domain", F.expr("stack(3, 'faith', faith, 'persona', persona, 'reward', reward) AS (metric, v)"))
    p = long.groupBy("metric").pivot("domain", X.DOMAINS).agg(F.avg("v"))
    return p.select("metric", *[F.round(d, 4).alias(d) for d in X.DOMAINS])


@register("eval_topk_showcase", lambda: S.with_fixtures(["answers"], (
    "SELECT b.persona_role, b.doc_id, b.reward, b.rank, a.answer FROM (SELECT persona_role, doc_id, reward, row_number() OVER "
    f"(PARTITION BY persona_role ORDER BY reward DESC, doc_id ASC) AS rank FROM ({_answer_reward_sql()})) b JOIN answers a USING (doc_id) WHERE b.rank <= 2")))
def eval_topk_showcase(spark, sf):
    """Best two answers per persona (a top-k report: the limit is the feature),
    with their whole texts, which are joined after the ranking."""
    r = _answer_rewards(spark, sf)
    w = W.partitionBy("persona_role").orderBy(F.col("reward").desc(), F.col("doc_id").asc())
    best = r.select("persona_role", "doc_id", "reward", F.row_number().over(w).cast("long").alias("rank")).where(
        F.col("rank") <= 2)
    return best.join(X.answers(spark, sf).select("doc_id", "answer"), "doc_id")


@register("eval_improvement_pct", lambda: _we(
    "SELECT task_id, " + R("(n.r - b.r) / greatest(b.r, 0.001) * 100", 1) + " AS improvement_pct FROM "
    "(SELECT task_id, avg(total_return) AS r FROM episodes WHERE agent = 'llm' GROUP BY task_id) n JOIN "
    "(SELECT task_id, avg(total_return) AS r FROM episodes WHERE agent = 'random' GROUP BY task_id) b USING (task_id)"))
def eval_improvement_pct(spark, sf):
    """(new - base) / max(base, .001) * 100 per task, llm agent vs random."""
    eps = _episodes(spark, sf)
    p = eps.groupBy("task_id").pivot("agent", ["llm", "random"]).agg(F.avg("total_return"))
    return p.where(F.col("llm").isNotNull() & F.col("random").isNotNull()).select(
        "task_id", F.round((F.col("llm") - F.col("random")) / F.greatest(F.col("random"), F.lit(0.001)) * 100, 1)
        .alias("improvement_pct"))


@register("eval_comparison_long", lambda: _we(
    "SELECT agent, metric, value FROM (SELECT agent, unnest(['success_rate', 'avg_return', 'avg_steps']) AS metric, "
    "unnest([success_rate, avg_return, avg_steps]) AS value FROM (" + _agg_sql("agent") + "))"))
def eval_comparison_long(spark, sf):
    per = T.aggregate_metrics(_episodes(spark, sf), ["agent"])
    return per.select("agent", F.expr("stack(3, 'success_rate', success_rate, 'avg_return', avg_return, "
                                      "'avg_steps', avg_steps) AS (metric, value)"))


@register("rew_e2e", lambda: S.with_fixtures(["steps", "answers", "action_text"], (
    "SELECT d.domain, " + R("0.3 * c.clean + 0.3 * e.enrich + 0.4 * a.answer", 4) + " AS e2e FROM "
    f"(SELECT domain, avg(reward) AS answer FROM ({_answer_reward_sql()}) GROUP BY domain) a JOIN "
    f"(SELECT domain, avg(coverage) AS enrich FROM ({_cov_sql()}) GROUP BY domain) e USING (domain) JOIN "
    "(SELECT " + S.pick(X.DOMAINS, "run_id % 4") + " AS domain, avg(" + R(
        "0.5 * dq_after + 0.5 * least(greatest(0.0, dq_after - dq_before) * 5.0, 1.0)", 4) + ") AS clean FROM dq "
    "GROUP BY 1) c USING (domain) JOIN (SELECT unnest(" + S.arr(X.DOMAINS) + ") AS domain) d USING (domain)"),
    [("episodes", episodes_sql()), ("dq", _dq_pair_sql().replace("FROM episodes", "FROM episodes"))]))
def rew_e2e(spark, sf):
    """.3 cleaning + .3 enrichment + .4 answering reward, per domain: three
    grouped aggregates joined on the 4-row domain key."""
    d = _dq_pair(spark, sf)
    imp = F.greatest(F.lit(0.0), F.col("dq_after") - F.col("dq_before"))
    clean = d.select(X._pick(X.DOMAINS, F.pmod(F.col("run_id"), F.lit(4))).alias("domain"),
                     F.round(0.5 * F.col("dq_after") + 0.5 * F.least(imp * 5.0, F.lit(1.0)), 4).alias("r")) \
        .groupBy("domain").agg(F.avg("r").alias("clean"))
    enrich = _coverage(spark, sf).groupBy("domain").agg(F.avg("coverage").alias("enrich"))
    answer = _answer_rewards(spark, sf).groupBy("domain").agg(F.avg("reward").alias("answer"))
    j = answer.join(enrich, "domain").join(clean, "domain")
    return j.select("domain", F.round(0.3 * F.col("clean") + 0.3 * F.col("enrich") + 0.4 * F.col("answer"), 4)
                    .alias("e2e"))


# ------------------------------------------------------------ curriculum
def promotion_sql(columns: str) -> str:
    """DuckDB: the promotion rule, one episode of every run at a time."""
    levels = "(VALUES " + ", ".join(f"({i}, {S.q(name)}, {rows}, {steps}, {rate}, {size})" for i, (name, rows, steps, rate, size) in enumerate(T.LEVELS)) + ") AS l(level, name, n_rows, max_steps, rate, size)"
    sql = _we(
        f"SELECT {columns} FROM (SELECT s.run_id, s.no AS episode_no, l.name AS difficulty, n.name AS next_difficulty, "
        "round((list_sum(s.win) / len(s.win)::DOUBLE)::DECIMAL(38, 12), 4)::DOUBLE AS window_success_rate, s.up AS promoted, l.n_rows AS n_rows, l.max_steps AS max_steps "
        "FROM state s JOIN levels l ON l.level = s.level JOIN levels n ON n.level = s.level + s.up::INT WHERE s.no >= 0)",
        [("levels", f"SELECT * FROM {levels}"),
         ("eps", "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY day) - 1 AS no, success::INT AS ok FROM episodes"),
         ("state(run_id, no, level, win, up)", (
             "SELECT DISTINCT run_id, -1::BIGINT, 0, []::INT[], false FROM eps UNION ALL "
             "SELECT run_id, no, level, w, CASE WHEN level < 2 AND len(w) >= size AND list_sum(w) / len(w)::DOUBLE >= rate THEN true ELSE false END FROM ("
             "SELECT e.run_id, e.no, l.level, l.size, l.rate, list_append(CASE WHEN s.up THEN []::INT[] ELSE s.win END, e.ok)[-l.size:] AS w "
             "FROM state s JOIN eps e ON e.run_id = s.run_id AND e.no = s.no + 1 JOIN levels l ON l.level = s.level + s.up::INT)"))])
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("eps AS (", "eps AS MATERIALIZED (")


@register("cur_promotion", lambda: promotion_sql("*"))
def cur_promotion(spark, sf):
    """Per run (one user's daily episodes): difficulty level, window success
    rate and promotions; stateful, so one pandas group per run."""
    eps = _episodes(spark, sf)
    w = W.partitionBy("run_id").orderBy("day")
    e = eps.select("run_id", (F.row_number().over(w) - 1).cast("long").alias("episode_no"), "success")
    out = T.curriculum_promotion(e)
    sched = {name: (rows, steps) for name, rows, steps, _, _ in T.LEVELS}
    rows_m = F.create_map(*[x for k, (r, _) in sched.items() for x in (F.lit(k), F.lit(r))])
    steps_m = F.create_map(*[x for k, (_, s) in sched.items() for x in (F.lit(k), F.lit(s))])
    return out.select("*", F.element_at(rows_m, F.col("difficulty")).alias("n_rows"),
                      F.element_at(steps_m, F.col("difficulty")).alias("max_steps"))


@register("cur_task_assignment", lambda: _we(
    "SELECT run_id, episode_no, " + S.pick(X.TASK_IDS, "episode_no % 3") + " AS task_id FROM (SELECT run_id, "
    "row_number() OVER (PARTITION BY run_id ORDER BY day) - 1 AS episode_no FROM episodes)"))
def cur_task_assignment(spark, sf):
    """Round-robin task per episode of each run (index mod number of tasks)."""
    eps = _episodes(spark, sf)
    w = W.partitionBy("run_id").orderBy("day")
    e = eps.select("run_id", (F.row_number().over(w) - 1).cast("long").alias("episode_no"))
    return e.select("run_id", "episode_no", T.round_robin_task(F.col("episode_no"), X.TASK_IDS).alias("task_id"))


# ---------------------------------------------------------------- curves
def _series(spark, sf):
    raw = X.metric_series_raw(spark, sf)
    s = T.ordered_prefix(raw, ["task", "metric"], list(ORDER), {})
    return s.select("task", "metric", "idx", "value")


def _wm(body, ctes=None):
    return S.with_fixtures(["metric_series"], body, ctes)


def _trim_ctes():
    core = ", ".join(S.q(m) for m in T.CORE_METRICS)
    return [
        ("ep", "SELECT * FROM metric_series WHERE metric = 'train/epoch'"),
        ("resets", "SELECT a.task, max(a.idx) AS reset_idx FROM ep a JOIN ep b ON a.task = b.task AND b.idx = a.idx - 1 "
                   "WHERE a.value < b.value - 0.5 GROUP BY a.task"),
        ("bounds", f"SELECT l.task, coalesce(r.reset_idx, 0) AS reset_idx, min(l.len - coalesce(r.reset_idx, 0)) AS n "
                   f"FROM (SELECT task, metric, count(*) AS len FROM metric_series WHERE metric IN ({core}) GROUP BY ALL) l "
                   "LEFT JOIN resets r USING (task) GROUP BY l.task, coalesce(r.reset_idx, 0)"),
        ("trimmed", f"SELECT s.task, s.metric, s.idx - b.reset_idx AS step, CASE WHEN s.metric = 'train/epoch' THEN "
                    f"{R('s.value', 3)} ELSE s.value END AS value FROM metric_series s JOIN bounds b USING (task) "
                    "WHERE s.idx >= b.reset_idx AND s.idx < b.reset_idx + b.n"),
    ]


@register("view_metric_series", lambda: _wm("SELECT task, metric, idx, value FROM metric_series"))
def view_metric_series(spark, sf):
    """Series index per (task, metric) from the range-partitioned prefix."""
    return _series(spark, sf)


@register("curve_reset_trim", lambda: _wm("SELECT * FROM trimmed", _trim_ctes()))
def curve_reset_trim(spark, sf):
    return T.curve_reset_trim(_series(spark, sf))


@register("curve_relabel", lambda: _wm(
    "SELECT " + S.case_map("task", T.RELABEL) + " AS task, metric, step, value FROM trimmed", _trim_ctes()))
def curve_relabel(spark, sf):
    t = T.curve_reset_trim(_series(spark, sf))
    m = F.create_map(*[x for k, v in T.RELABEL.items() for x in (F.lit(k), F.lit(v))])
    return t.select(F.element_at(m, F.col("task")).alias("task"), "metric", "step", "value")


@register("curve_components", lambda: _wm(
    "SELECT task, regexp_replace(regexp_replace(metric, '^train/rewards/', ''), '/mean$', '') AS component, step, value "
    "FROM trimmed WHERE regexp_matches(metric, '^train/rewards/.*/mean$')",
    [(n, sql.replace("WHERE s.idx >= b.reset_idx AND s.idx < b.reset_idx + b.n",
                     "WHERE s.idx >= b.reset_idx AND s.idx < b.reset_idx + b.n")) for n, sql in _trim_ctes()]))
def curve_components(spark, sf):
    """Reward components (train/rewards/<name>/mean) on the trimmed range."""
    t = T.curve_reset_trim(_series(spark, sf))
    c = t.where(F.col("metric").rlike("^train/rewards/.*/mean$"))
    return c.select("task", F.regexp_replace(F.regexp_replace("metric", "^train/rewards/", ""), "/mean$", "")
                    .alias("component"), "step", "value")


@register("curve_stats", lambda: _wm(
    "SELECT task, metric, min(value) AS min, max(value) AS max, " + R("avg(value)", 6)
    + " AS mean, arg_max_null(value, idx) AS final, count(*) AS n_points FROM metric_series GROUP BY task, metric"))
def curve_stats(spark, sf):
    return T.curve_stats(_series(spark, sf))


@register("curve_downsample", lambda: _wm(
    "SELECT s.task, s.metric, s.idx, s.value FROM metric_series s JOIN (SELECT task, metric, count(*) AS n FROM "
    "metric_series GROUP BY ALL) l USING (task, metric) WHERE l.n <= 100 OR (ceil(s.idx * 100 / l.n) < 100 AND "
    "floor(ceil(s.idx * 100 / l.n) * l.n / 100) = s.idx)"))
def curve_downsample(spark, sf):
    return T.curve_downsample(_series(spark, sf))


@register("pipeline_metrics_episode", lambda: _we(
    "SELECT e.episode_id, " + R("d.dq_before", 4) + " AS initial_dq, " + R("d.dq_after", 4) + " AS final_dq, "
    + R("d.dq_after - d.dq_before", 4) + " AS dq_improvement, " + R("e.total_return", 4) + " AS total_reward, "
    + R("e.total_return / greatest(e.steps, 1)", 4) + " AS avg_reward, e.steps FROM episodes e JOIN dq d USING (episode_id)",
    [("dq", _dq_pair_sql())]))
def pipeline_metrics_episode(spark, sf):
    """Per episode: initial/final DQ, improvement, total and mean reward."""
    eps = _episodes(spark, sf)
    d = _dq_pair(spark, sf)
    j = eps.join(d.drop("run_id"), "episode_id")
    return j.select("episode_id", F.round("dq_before", 4).alias("initial_dq"), F.round("dq_after", 4).alias("final_dq"),
                    F.round(F.col("dq_after") - F.col("dq_before"), 4).alias("dq_improvement"),
                    F.round("total_return", 4).alias("total_reward"),
                    F.round(F.col("total_return") / F.greatest("steps", F.lit(1)), 4).alias("avg_reward"), "steps")
