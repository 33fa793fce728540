"""Answer scoring and action-parsing queries (documents -> answers,
conversations -> model outputs), whole texts throughout."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as TX
from tessera.operators import actions as A
from tessera.operators import answers as AN
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.sources import fixtures as X

R = S.sround
q = S.q


def _ans(spark, sf):
    return X.answers(spark, sf)


def _act(spark, sf):
    return X.action_text(spark, sf)


def _wa(body, ctes=None):
    return S.with_fixtures(["answers"], body, ctes)


def _wt(body, ctes=None):
    return S.with_fixtures(["action_text"], body, ctes)


# ------------------------------------------------------------ SQL twins
def count_sql(low: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN instr({low}, {q(n.lower())}) > 0 THEN 1 ELSE 0 END)" for n in needles) + ")"


def any_sql(low: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"instr({low}, {q(n.lower())}) > 0" for n in needles) + ")"


def kw_sql(low: str, p: dict) -> str:
    denom = max(len(p["keywords"]) * 0.3, 1)
    return f"least({count_sql(low, p['keywords'])} / {denom!r}::DOUBLE, 1.0::DOUBLE)"


def anti_sql(low: str, p: dict) -> str:
    return f"least({count_sql(low, p['anti_keywords'])} * 0.15::DOUBLE, 0.5::DOUBLE)"


def formality_sql(txt: str, low: str, style: str) -> str:
    if style in K.FORMALITY_INDICATORS:
        return f"least({count_sql(low, K.FORMALITY_INDICATORS[style])} / 2.0::DOUBLE, 1.0::DOUBLE)"
    if style == "plain-personal":
        words = f"len(regexp_extract_all({txt}, {q('[^' + TX.BLANKS + '.]+')}))"
        sents = f"(length({txt}) - length(replace({txt}, '.', '')) + 1)"
        avg = f"({words} / {sents})"
        return f"(CASE WHEN {avg} < 20 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - ({avg} - 20) / 30) END)"
    return "0.5::DOUBLE"


def align_sql(txt: str, p: dict) -> str:
    low = f"lower({txt})"
    raw = (f"0.5::DOUBLE * {kw_sql(low, p)} + 0.2::DOUBLE * {formality_sql(txt, low, p['style'])} + 0.3::DOUBLE "
           f"- {anti_sql(low, p)}")
    return R(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {raw}))", 4)


def by_persona_sql(key: str, fn, personas: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {key} = {q(n)} THEN {fn(p)}" for n, p in personas.items())
    return f"(CASE {whens}" + (f" ELSE {default}" if default else "") + " END)"


# ------------------------------------------------------ persona scoring
@register("persona_alignment", lambda: _wa(
    f"SELECT doc_id, persona_role, {by_persona_sql('persona_role', lambda p: align_sql('answer', p), AN.PERSONA_BY_ROLE)}"
    " AS alignment FROM answers"))
def persona_alignment(spark, sf):
    df = _ans(spark, sf)
    return df.select("doc_id", "persona_role", AN.persona_alignment(df).alias("alignment"))


@register("persona_keyword_score", lambda: _wa(
    f"SELECT doc_id, {by_persona_sql('persona_role', lambda p: R(kw_sql('lower(answer)', p), 4), AN.PERSONA_BY_ROLE)}"
    " AS keyword_score FROM answers"))
def persona_keyword_score(spark, sf):
    df = _ans(spark, sf)
    low = F.lower(F.col("answer"))
    return df.select("doc_id", AN.by_persona(F.col("persona_role"), lambda p: F.round(AN.keyword_score(low, p), 4),
                                             AN.PERSONA_BY_ROLE).alias("keyword_score"))


@register("persona_anti_penalty", lambda: _wa(
    f"SELECT doc_id, {by_persona_sql('persona_role', lambda p: R(anti_sql('lower(answer)', p), 4), AN.PERSONA_BY_ROLE)}"
    " AS anti_penalty FROM answers"))
def persona_anti_penalty(spark, sf):
    df = _ans(spark, sf)
    low = F.lower(F.col("answer"))
    return df.select("doc_id", AN.by_persona(F.col("persona_role"), lambda p: F.round(AN.anti_penalty(low, p), 4),
                                             AN.PERSONA_BY_ROLE).alias("anti_penalty"))


for _name, _style in [("formality_strategic", "strategic-financial"), ("formality_operational", "operational-actionable"),
                      ("formality_plain", "plain-personal")]:
    register(_name, lambda st=_style: _wa(
        f"SELECT doc_id, {R(formality_sql('answer', 'lower(answer)', st), 4)} AS formality FROM answers"))(
        lambda spark, sf, st=_style: _ans(spark, sf).select(
            "doc_id", F.round(AN.formality(F.col("answer"), F.lower(F.col("answer")), st), 4).alias("formality")))


def _hits_sql(low: str, needles: list[str]) -> str:
    return f"array_to_string(list_filter({S.arr(needles)}, lambda k: instr({low}, lower(k)) > 0), ',')"


@register("persona_breakdown", lambda: _wa(
    "SELECT doc_id, persona_role, "
    + by_persona_sql("persona_role", lambda p: _hits_sql("lower(answer)", p["keywords"]), AN.PERSONA_BY_ROLE)
    + " AS keyword_hits, "
    + by_persona_sql("persona_role", lambda p: _hits_sql("lower(answer)", p["anti_keywords"]), AN.PERSONA_BY_ROLE)
    + " AS anti_hits, "
    + by_persona_sql("persona_role", lambda p: R(f"{count_sql('lower(answer)', p['keywords'])} / {len(p['keywords'])}", 4),
                     AN.PERSONA_BY_ROLE)
    + " AS keyword_coverage FROM answers"))
def persona_breakdown(spark, sf):
    df = _ans(spark, sf)
    low = F.lower(F.col("answer"))
    role = F.col("persona_role")
    return df.select(
        "doc_id", "persona_role",
        AN.by_persona(role, lambda p: F.array_join(AN.hits_list(low, p["keywords"]), ","), AN.PERSONA_BY_ROLE)
        .alias("keyword_hits"),
        AN.by_persona(role, lambda p: F.array_join(AN.hits_list(low, p["anti_keywords"]), ","), AN.PERSONA_BY_ROLE)
        .alias("anti_hits"),
        AN.by_persona(role, lambda p: F.round(F.size(AN.hits_list(low, p["keywords"])) / len(p["keywords"]), 4),
                      AN.PERSONA_BY_ROLE).alias("keyword_coverage"))


@register("persona_batch_avg", lambda: _wa(
    f"SELECT persona_role, count(*) AS n, {R('avg(a)', 4)} AS avg_alignment FROM (SELECT persona_role, "
    f"{by_persona_sql('persona_role', lambda p: align_sql('answer', p), AN.PERSONA_BY_ROLE)} AS a FROM answers) "
    "GROUP BY persona_role"))
def persona_batch_avg(spark, sf):
    df = _ans(spark, sf)
    return (df.select("persona_role", AN.persona_alignment(df).alias("a")).groupBy("persona_role")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 4).alias("avg_alignment")))


@register("persona_match_reward", lambda: _wa(
    f"SELECT doc_id, requested_persona, "
    f"{by_persona_sql('requested_persona', lambda p: align_sql('answer', p), AN.PERSONA_BY_NAME, '0.0::DOUBLE')} "
    "AS reward FROM answers"))
def persona_match_reward(spark, sf):
    df = _ans(spark, sf)
    return df.select("doc_id", "requested_persona",
                     AN.persona_match_reward(F.col("answer"), F.col("requested_persona")).alias("reward"))


# --------------------------------------------------------- faithfulness
_KEYS = {"hr": "EmployeeID", "sales": "DealID", "pm": "TaskID", "it_ops": "TicketID"}


def _samples_sql() -> str:
    parts = []
    for d, cols in X.VIEW_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT '{d}' AS domain, '{c}' AS column_name, CAST({_KEYS[d]} AS VARCHAR) AS k, "
                         f"CAST({c} AS VARCHAR) AS value FROM dom_{d} WHERE {c} IS NOT NULL")
    return ("SELECT domain, column_name, list(value ORDER BY rn) AS vals FROM (SELECT *, row_number() OVER "
            "(PARTITION BY domain, column_name ORDER BY k, value) AS rn FROM (" + " UNION ALL ".join(parts)
            + ")) WHERE rn <= 10 GROUP BY domain, column_name")


def _faith_sql() -> str:
    cols = "(CASE domain " + " ".join(f"WHEN '{d}' THEN {S.arr(X.VIEW_COLUMNS[d])}" for d in X.DOMAINS) + " END)"
    body = f"""
    SELECT doc_id, {R('least(base + 0.15 * hits, 1.0)', 4)} AS faithfulness FROM (
      SELECT a.doc_id, CASE WHEN len(a.cited_columns) > 0 THEN 0.5 * (len(v.valid) / len(a.cited_columns))
                            ELSE 0.1 END AS base,
             (SELECT count(*) FROM (SELECT unnest(v.valid[1:3]) AS c) x
              WHERE EXISTS (SELECT 1 FROM samples s WHERE s.domain = a.domain AND s.column_name = x.c
                            AND len(list_filter(s.vals, lambda t: instr(lower(a.answer), lower(t)) > 0)) > 0)) AS hits
      FROM answers a, LATERAL (SELECT list_filter(a.cited_columns, lambda c: list_contains({cols.replace('domain', 'a.domain')}, c)) AS valid) v)"""
    return S.with_fixtures(["answers"] + [f"dom_{d}" for d in X.DOMAINS], body, [("samples", _samples_sql())])


def _samples(spark, sf):
    return AN.sample_values({d: (X.domain_table(spark, sf, d), _KEYS[d]) for d in X.DOMAINS})


@register("faithfulness_cited", _faith_sql)
def faithfulness_cited(spark, sf):
    return AN.faithfulness_cited(_ans(spark, sf), _samples(spark, sf), X.VIEW_COLUMNS)


@register("faithfulness_eval", lambda: _wa(
    "SELECT doc_id, " + R(
        "CASE WHEN len(cited_columns) > 0 THEN len(list_filter(cited_columns, lambda c: list_contains((CASE domain "
        + " ".join(f"WHEN '{d}' THEN {S.arr(X.VIEW_COLUMNS[d])}" for d in X.DOMAINS)
        + " END), c))) / len(cited_columns) ELSE 0.1 END", 4) + " AS faithfulness FROM answers"))
def faithfulness_eval(spark, sf):
    df = _ans(spark, sf)
    return df.select("doc_id", F.round(AN.faithfulness_eval(
        F.col("cited_columns"), F.element_at(X.domain_columns_map(X.VIEW_COLUMNS), F.col("domain"))), 4)
        .alias("faithfulness"))


def _double_sep(txt: str) -> str:
    return f"regexp_replace({txt}, '([^{TX.WORDC}])', '\\1\\1', 'g')"


def _caps_sql(txt: str) -> str:
    return f"regexp_extract_all({_double_sep(txt)}, {q(TX.bounded(TX.CAPITALISED))}, 1)"


def _local_sql(txt: str) -> str:
    n = f"len({_caps_sql(txt)})"
    low = f"lower({txt})"
    s = (f"(CASE WHEN {n} >= 1 THEN 0.3 ELSE 0.0 END) + (CASE WHEN {n} >= 3 THEN 0.2 ELSE 0.0 END) + "
         f"(CASE WHEN regexp_matches({txt}, {q(AN.PERCENT)}) OR regexp_matches({txt}, {q(AN.TWO_DIGITS)}) "
         f"THEN 0.2 ELSE 0.0 END) - (CASE WHEN {any_sql(low, AN.HEDGES)} THEN 0.2 ELSE 0.0 END) - "
         f"(CASE WHEN length({S.ws_trim(txt)}) < 50 THEN 0.3 ELSE 0.0 END)")
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST({s} AS DOUBLE)))"


@register("faithfulness_local", lambda: _wa(f"SELECT doc_id, {R(_local_sql('answer'), 4)} AS faithfulness FROM answers"))
def faithfulness_local(spark, sf):
    return _ans(spark, sf).select("doc_id", F.round(AN.faithfulness_local(F.col("answer")), 4).alias("faithfulness"))


@register("cite_extract_regex", lambda: _wa(
    f"SELECT doc_id, array_to_string({_caps_sql('answer')}[1:5], ',') AS cited FROM answers"))
def cite_extract_regex(spark, sf):
    return _ans(spark, sf).select("doc_id", F.array_join(AN.cite_extract_regex(F.col("answer")), ",").alias("cited"))


@register("cite_extract_known", lambda: _wa(
    "SELECT doc_id, array_to_string(list_filter((CASE domain "
    + " ".join(f"WHEN '{d}' THEN {S.arr(X.VIEW_COLUMNS[d])}" for d in X.DOMAINS)
    + " END), lambda c: instr(lower(answer), lower(c)) > 0), ',') AS cited FROM answers"))
def cite_extract_known(spark, sf):
    df = _ans(spark, sf)
    cols = F.element_at(X.domain_columns_map(X.VIEW_COLUMNS), F.col("domain"))
    return df.select("doc_id", F.array_join(AN.cite_extract_known(F.col("answer"), cols), ",").alias("cited"))


# ------------------------------------------------------- action parsing
def brace_sql(txt: str, key: str) -> str:
    return f"regexp_extract({txt}, {q('(?s)[{][^{}]*\"' + key + '\"[^{}]*[}]')}, 0)"


def valid_sql(m: str) -> str:
    return f"({m} <> '' AND json_valid({m}))"


def has_sql(m: str, k: str) -> str:
    return f"(CASE WHEN {valid_sql(m)} THEN coalesce(list_contains(json_keys({m}), {q(k)}), FALSE) ELSE FALSE END)"


def jstr_sql(m: str, path: str) -> str:
    return f"(CASE WHEN {valid_sql(m)} THEN json_extract_string({m}, {q('$.' + path)}) END)"


def extract_column_sql(txt: str) -> str:
    quoted = f"regexp_extract({txt}, {q(TX.QUOTED_WORD)}, 1)"
    camel = f"regexp_extract({txt}, {q(TX.bounded(TX.CAMEL))}, 1)"
    return f"(CASE WHEN {quoted} <> '' THEN {quoted} WHEN {camel} <> '' THEN {camel} ELSE '' END)"


def clean_parse_sql(txt: str) -> str:
    m = brace_sql(txt, "operation")
    use = f"({valid_sql(m)} AND {has_sql(m, 'operation')} AND {has_sql(m, 'column')})"
    low = f"lower({txt})"
    fb = (f"(CASE WHEN {any_sql(low, ['fill', 'null'])} THEN 'fill_null' "
          f"WHEN {any_sql(low, ['type', 'cast', 'convert'])} THEN 'fix_type' "
          f"WHEN {any_sql(low, ['duplicate', 'dedup'])} THEN 'remove_duplicate' "
          f"WHEN {any_sql(low, ['standard', 'normalize'])} THEN 'standardize' "
          f"WHEN {any_sql(low, ['trim', 'whitespace'])} THEN 'trim' "
          f"WHEN {any_sql(low, ['typo', 'correct'])} THEN 'correct_typo' ELSE 'fill_null_default' END)")
    op = f"(CASE WHEN {fb} = 'fill_null_default' THEN 'fill_null' ELSE {fb} END)"
    col = f"(CASE WHEN {fb} IN ('remove_duplicate', 'fill_null_default') THEN '' ELSE {extract_column_sql(txt)} END)"
    val = f"(CASE WHEN {fb} IN ('fill_null', 'fill_null_default') THEN 'median' WHEN {fb} = 'fix_type' THEN 'numeric' END)"
    return (f"CASE WHEN {use} THEN {jstr_sql(m, 'operation')} ELSE {op} END AS operation, "
            f"CASE WHEN {use} THEN {jstr_sql(m, 'column')} ELSE {col} END AS column, "
            f"CASE WHEN {use} THEN {jstr_sql(m, 'value')} ELSE {val} END AS value, "
            f"CASE WHEN {use} THEN 'json' ELSE 'keyword' END AS parsed_from")


def _struct_out(df, struct_col, fields):
    return df.select("conv_id", "turn", *[struct_col[f].alias(f) for f in fields])


@register("parse_cleaning_action", lambda: _wt(f"SELECT conv_id, turn, {clean_parse_sql('output')} FROM action_text"))
def parse_cleaning_action(spark, sf):
    df = _act(spark, sf)
    return _struct_out(df, A.parse_cleaning_action(F.col("output")), ["operation", "column", "value", "parsed_from"])


@register("extract_column", lambda: _wt(f"SELECT conv_id, turn, {extract_column_sql('output')} AS column FROM action_text"))
def extract_column(spark, sf):
    return _act(spark, sf).select("conv_id", "turn", A.extract_column(F.col("output")).alias("column"))


def enr_parse_sql(txt: str) -> str:
    m = brace_sql(txt, "operation")
    use = f"({valid_sql(m)} AND {has_sql(m, 'field_name')})"
    low = f"lower({txt})"
    found = "(CASE " + " ".join(
        f"WHEN instr({low}, {q(s.replace('_', ' '))}) > 0 OR instr({low}, {q(s)}) > 0 THEN {q(s)}"
        for s in A.ALL_SOURCES) + " END)"
    return (f"CASE WHEN {use} THEN {jstr_sql(m, 'operation')} ELSE 'add_field' END AS operation, "
            f"CASE WHEN {use} THEN {jstr_sql(m, 'field_name')} ELSE coalesce({found}, 'unknown') END AS field_name, "
            f"CASE WHEN {use} THEN {jstr_sql(m, 'source')} ELSE coalesce({found}, '') END AS source, "
            f"CASE WHEN {use} THEN 'json' ELSE 'keyword' END AS parsed_from")


@register("parse_enrichment_action", lambda: _wt(f"SELECT conv_id, turn, {enr_parse_sql('output')} FROM action_text"))
def parse_enrichment_action(spark, sf):
    df = _act(spark, sf)
    return _struct_out(df, A.parse_enrichment_action(F.col("output")), ["operation", "field_name", "source", "parsed_from"])


def _cited_json_sql(m: str) -> str:
    return f"(CASE WHEN {valid_sql(m)} THEN TRY_CAST(json_extract({m}, '$.cited_columns') AS VARCHAR[]) END)"


@register("parse_answering_action", lambda: _wt(
    "SELECT conv_id, turn, "
    f"CASE WHEN u THEN {jstr_sql('m', 'answer')} ELSE output END AS answer, "
    f"array_to_string(CASE WHEN u THEN {_cited_json_sql('m')} ELSE {_caps_sql('output')}[1:5] END, ',') AS cited_columns, "
    f"CASE WHEN u THEN {jstr_sql('m', 'reasoning')} ELSE '' END AS reasoning, "
    "CASE WHEN u THEN 'json' ELSE 'keyword' END AS parsed_from "
    f"FROM (SELECT *, ({valid_sql('m')} AND {has_sql('m', 'answer')}) AS u FROM "
    f"(SELECT *, {brace_sql('output', 'answer')} AS m FROM action_text))"))
def parse_answering_action(spark, sf):
    df = _act(spark, sf)
    p = A.parse_answering_action(F.col("output"))
    return df.select("conv_id", "turn", p["answer"].alias("answer"),
                     F.array_join(p["cited_columns"], ",").alias("cited_columns"), p["reasoning"].alias("reasoning"),
                     p["parsed_from"].alias("parsed_from"))


def tool_parse_sql(txt: str) -> str:
    m = brace_sql(txt, "tool")
    tool_json = f"coalesce({jstr_sql(m, 'tool')}, 'profile_data')"
    use = f"({valid_sql(m)} AND {tool_json} IN ({', '.join(q(t) for t in K.VALID_TOOLS)}))"
    low = f"lower({txt})"
    colm = f"regexp_extract({low}, {q(A.COLUMN_ARG)}, 1)"

    def col_or(d):
        return f"(CASE WHEN {colm} <> '' THEN {colm} ELSE {q(d)} END)"

    branches = [
        (any_sql(low, ["profile", "inspect"]), "profile_data", None, None, None),
        (any_sql(low, ["duplicate", "dedup"]), "apply_cleaning_operation", "drop_duplicates", None, None),
        (any_sql(low, ["invalid", "null", "replace"]), "apply_cleaning_operation", "replace_invalid_with_null",
         col_or("amount"), None),
        (any_sql(low, ["dtype", "cast", "numeric"]), "apply_cleaning_operation", "cast_numeric", col_or("amount"), None),
        (any_sql(low, ["impute", "fill", "missing"]), "apply_cleaning_operation", "impute_numeric", col_or("amount"),
         "median"),
        (any_sql(low, ["clip", "outlier"]), "apply_cleaning_operation", "clip_outliers_iqr", col_or("order_value"), None),
        (any_sql(low, ["normaliz", "categor", "whitespace", "strip"]), "apply_cleaning_operation",
         "normalize_categories", col_or("device_os"), None),
        (any_sql(low, ["unit_test", "validate", "quality", "gate"]), "run_quality_gates", None, None, None),
        (any_sql(low, ["submit"]), "submit_solution", None, None, None),
    ]

    def chain(i):
        def lit(v):
            return "NULL" if v is None else (v if v.startswith("(CASE") else q(v))
        body = " ".join(f"WHEN {b[0]} THEN {lit(b[i + 1])}" for b in branches)
        return f"(CASE {body} ELSE {q('profile_data') if i == 0 else 'NULL'} END)"

    args = [("operation", 1), ("column", 2), ("strategy", 3)]
    out = [f"CASE WHEN {use} THEN {tool_json} ELSE {chain(0)} END AS tool"]
    out += [f"CASE WHEN {use} THEN {jstr_sql(m, 'arguments.' + a)} ELSE {chain(i)} END AS {a}" for a, i in args]
    out.append(f"CASE WHEN {use} THEN 'json' ELSE 'keyword' END AS parsed_from")
    return ", ".join(out)


@register("parse_tool_action", lambda: _wt(f"SELECT conv_id, turn, {tool_parse_sql('output')} FROM action_text"))
def parse_tool_action(spark, sf):
    df = _act(spark, sf)
    return _struct_out(df, A.parse_tool_action(F.col("output")), ["tool", "operation", "column", "strategy", "parsed_from"])


@register("strip_think", lambda: _wt(
    f"SELECT conv_id, turn, {S.ws_trim(chr(114) + 'egexp_replace(output, ' + q('(?s)<think>.*?</think>') + ", '', 'g')")} "
    "AS stripped FROM action_text"))
def strip_think(spark, sf):
    return _act(spark, sf).select("conv_id", "turn", TX.strip_think(F.col("output")).alias("stripped"))


# ------------------------------------------------------ format rewards
def fmt_clean_sql(txt):
    m = brace_sql(txt, "operation")
    op = jstr_sql(m, "operation")
    ok = f"coalesce({op} IN ({', '.join(q(o) for o in A.CLEANING_VALID_OPS)}), FALSE)"
    return (f"(CASE WHEN {m} = '' THEN 0.0 WHEN NOT {valid_sql(m)} THEN 0.2 WHEN {ok} AND {has_sql(m, 'column')} "
            f"THEN 1.0 WHEN {ok} THEN 0.6 ELSE 0.3 END)")


def fmt_enr_sql(txt):
    m = brace_sql(txt, "operation")
    op_ok = f"coalesce({jstr_sql(m, 'operation')} IN ({', '.join(q(o) for o in A.ENRICHMENT_VALID_OPS)}), FALSE)"
    field_ok = f"({has_sql(m, 'field_name')} AND coalesce({jstr_sql(m, 'field_name')}, '') <> 'unknown')"
    return (f"(CASE WHEN {m} = '' THEN 0.0 WHEN NOT {valid_sql(m)} THEN 0.2 WHEN {op_ok} AND {field_ok} THEN 1.0 "
            f"WHEN {op_ok} THEN 0.5 ELSE 0.2 END)")


def fmt_ans_sql(txt):
    m = brace_sql(txt, "answer")
    ha = f"coalesce({S.ws_trim(jstr_sql(m, 'answer'))} <> '', FALSE)"
    hc = f"coalesce(len({_cited_json_sql(m)}) > 0, FALSE)"
    hr = f"coalesce({S.ws_trim(jstr_sql(m, 'reasoning'))} <> '', FALSE)"
    return (f"(CASE WHEN {m} = '' THEN 0.0 WHEN NOT {valid_sql(m)} THEN 0.2 WHEN {ha} AND {hc} AND {hr} THEN 1.0 "
            f"WHEN {ha} AND {hc} THEN 0.7 WHEN {ha} THEN 0.4 ELSE 0.2 END)")


def fmt_tool_sql(txt):
    m = f"regexp_extract({txt}, {q('[{][^{}]*\"tool\"[^{}]*[}]')}, 0)"
    tool = f"coalesce({jstr_sql(m, 'tool')}, '')"
    op = f"coalesce({jstr_sql(m, 'arguments.operation')}, '')"
    return (f"(CASE WHEN {m} = '' THEN 0.0 WHEN NOT {valid_sql(m)} THEN 0.2 "
            f"WHEN {tool} = 'apply_cleaning_operation' THEN (CASE WHEN {op} IN "
            f"({', '.join(q(o) for o in K.TOOL_OPERATIONS)}) THEN 1.0 ELSE 0.3 END) "
            f"WHEN {tool} IN ({', '.join(q(t) for t in K.VALID_TOOLS)}) THEN 1.0 ELSE 0.3 END)")


_FMT = [("fmt_cleaning", A.fmt_cleaning, fmt_clean_sql), ("fmt_enrichment", A.fmt_enrichment, fmt_enr_sql),
        ("fmt_answering", A.fmt_answering, fmt_ans_sql), ("fmt_tool", A.fmt_tool, fmt_tool_sql)]
for _n, _f, _s in _FMT:
    register(_n, lambda s=_s: _wt(f"SELECT conv_id, turn, CAST({s('output')} AS DOUBLE) AS reward FROM action_text"))(
        lambda spark, sf, f=_f: _act(spark, sf).select("conv_id", "turn", f(F.col("output")).alias("reward")))


def _avail_sql() -> str:
    return "(CASE domain " + " ".join(f"WHEN '{d}' THEN {S.arr(K.ENRICHMENT_SOURCES[d])}" for d in X.DOMAINS) + " END)"


@register("source_relevance", lambda: _wt(
    f"SELECT conv_id, turn, CAST(CASE WHEN list_contains({_avail_sql()}, source) THEN 1.0 WHEN field_name <> 'unknown' "
    f"THEN 0.3 ELSE 0.0 END AS DOUBLE) AS reward FROM (SELECT conv_id, turn, domain, {enr_parse_sql('output')} FROM action_text)"))
def source_relevance(spark, sf):
    df = _act(spark, sf)
    avail = F.element_at(F.create_map(*[x for d in X.DOMAINS for x in (
        F.lit(d), F.array(*[F.lit(s) for s in K.ENRICHMENT_SOURCES[d]]))]), F.col("domain"))
    return df.select("conv_id", "turn", A.source_relevance(F.col("output"), avail).alias("reward"))


@register("reasoning_score", lambda: _wt(
    "SELECT conv_id, turn, CAST(least((CASE WHEN " + any_sql("lower(output)", A.REASONING_WORDS) + " THEN 0.3 ELSE 0.0 END)"
    " + (CASE WHEN " + any_sql("lower(output)", A.ISSUE_WORDS) + " THEN 0.2 ELSE 0.0 END)"
    f" + (CASE WHEN regexp_matches(output, {q(TX.CAMEL)}) THEN 0.1 ELSE 0.0 END), 0.5) AS DOUBLE) AS reward "
    "FROM action_text"))
def reasoning_score(spark, sf):
    return _act(spark, sf).select("conv_id", "turn", A.reasoning_score(F.col("output")).alias("reward"))


@register("methodology_score", lambda: _wt(
    "SELECT conv_id, turn, CAST(least((CASE WHEN " + any_sql("lower(output)", A.INSPECT_WORDS) + " THEN 0.3 ELSE 0.0 END)"
    " + (CASE WHEN " + any_sql("lower(output)", A.GATE_WORDS) + " THEN 0.2 ELSE 0.0 END)"
    " + (CASE WHEN " + any_sql("lower(output)", A.STABILITY_WORDS) + " THEN 0.3 ELSE 0.0 END), 1.0) AS DOUBLE) AS reward "
    "FROM action_text"))
def methodology_score(spark, sf):
    return _act(spark, sf).select("conv_id", "turn", A.methodology_score(F.col("output")).alias("reward"))


@register("view_answers", lambda: _wa("SELECT doc_id, domain, persona_role, requested_persona, answer, "
                                      "array_to_string(cited_columns, ',') AS cited_columns, judge_score FROM answers"))
def view_answers(spark, sf):
    df = _ans(spark, sf)
    return df.withColumn("cited_columns", F.array_join("cited_columns", ","))


@register("view_action_text", lambda: _wt("SELECT * FROM action_text"))
def view_action_text(spark, sf):
    return _act(spark, sf)


# ---------------------------------------------------- strict parsers
@register("parse_tool_strict", lambda: _wt(
    "SELECT conv_id, turn, CASE WHEN " + valid_sql(brace_sql("output", "tool")) + " THEN coalesce("
    + jstr_sql(brace_sql("output", "tool"), "tool") + ", 'profile_data') ELSE 'profile_data' END AS tool, "
    "CASE WHEN " + valid_sql(brace_sql("output", "tool")) + " THEN " + jstr_sql(brace_sql("output", "tool"), "arguments.operation")
    + " END AS operation, CASE WHEN " + valid_sql(brace_sql("output", "tool")) + " THEN "
    + jstr_sql(brace_sql("output", "tool"), "arguments.column") + " END AS column FROM action_text"))
def parse_tool_strict(spark, sf):
    df = _act(spark, sf)
    return _struct_out(df, A.parse_tool_strict(F.col("output")), ["tool", "operation", "column"])


def _any_sql() -> str:
    m = "regexp_extract(output, '(?s)[{][^{}]*[}]', 0)"
    ok = valid_sql(m)
    return (f"SELECT conv_id, turn, {ok} AS has_json, CASE WHEN {ok} THEN array_to_string(json_keys({m}), ',') END AS keys, "
            f"CASE WHEN {ok} THEN {jstr_sql(m, 'operation')} END AS operation, "
            f"CASE WHEN {ok} THEN {jstr_sql(m, 'tool')} END AS tool FROM action_text")


@register("parse_any_json", lambda: _wt(_any_sql()))
def parse_any_json(spark, sf):
    df = _act(spark, sf)
    return _struct_out(df, A.parse_any_json(F.col("output")), ["has_json", "keys", "operation", "tool"])


_EC_COLS = ["session_id", "device_os", "customer_id", "country", "items_in_cart", "order_value", "event_date",
            "converted"]


def _validation_sql() -> str:
    ops = ", ".join(q(o) for o in K.TOOL_OPERATIONS)
    cols = ", ".join(q(c) for c in _EC_COLS)
    err = ("CASE WHEN tool <> 'apply_cleaning_operation' THEN NULL "
           f"WHEN operation IS NULL OR operation NOT IN ({ops}) THEN concat('Unsupported operation ''', coalesce(operation, 'None'), '''.') "
           "WHEN operation = 'drop_duplicates' THEN NULL "
           "WHEN \"column\" IS NULL THEN concat('Operation ''', operation, ''' requires a column.') "
           f"WHEN \"column\" NOT IN ({cols}) THEN concat('Unknown column ''', \"column\", '''.') END")
    return _wt(f"SELECT conv_id, turn, tool, {err} AS error, CASE WHEN ({err}) IS NOT NULL THEN -0.2::DOUBLE END AS reward "
               f"FROM (SELECT conv_id, turn, {tool_parse_sql('output')} FROM action_text)")


@register("op_validation", _validation_sql)
def op_validation(spark, sf):
    """Parsed tool calls checked against the ecommerce task: unknown
    operation / missing column / unknown column become an error row with
    the tool-error reward."""
    df = _act(spark, sf)
    p = A.parse_tool_action(F.col("output"))
    err = A.validate_tool_call(p["tool"], p["operation"], p["column"], _EC_COLS)
    return df.select("conv_id", "turn", p["tool"].alias("tool"), err.alias("error"),
                     F.when(err.isNotNull(), F.lit(K.TOOL_ERROR_REWARD)).alias("reward"))
