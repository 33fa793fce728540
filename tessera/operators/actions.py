"""Action parsing and format rewards over a table of model outputs.

Each parser is: the first brace group that mentions the key field
(``regexp_extract``), its top-level keys (``json_object_keys``, NULL when the
text is not valid JSON), JSON fields, and an ordered keyword fallback as a
``when`` chain over the lower-cased text. One projection per table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.text import CAMEL, QUOTED_WORD, first_bounded, json_has, json_keys, json_str
from tessera.functions.exprs import ws_trim

# Operation sets the format rewards accept.
CLEANING_VALID_OPS = ["fill_null", "fix_type", "remove_duplicate", "standardize", "trim", "correct_typo"]
ENRICHMENT_VALID_OPS = ["add_field", "lookup", "compute_derived", "add_category"]
ALL_SOURCES = [s for srcs in K.ENRICHMENT_SOURCES.values() for s in srcs]
# Reasoning / methodology indicator words.
REASONING_WORDS = ["first", "let me", "i should", "step 1", "think", "analyze", "examining"]
ISSUE_WORDS = ["null", "missing", "type", "duplicate", "whitespace", "typo", "inconsistent"]
INSPECT_WORDS = ["inspect", "profile", "first", "understand", "look at"]
GATE_WORDS = ["run_quality_gates", "validate", "quality gate", "before submit"]
STABILITY_WORDS = ["group_by", "group-wise", "per-region", "per-category", "pcs", "stability"]
COLUMN_ARG = r"column['\"]?\s*[=:]\s*['\"]?([A-Za-z0-9_]+)"


def brace_group(text: Column, key: str) -> Column:
    """First ``{...}`` without nested braces that contains ``"key"``."""
    return F.regexp_extract(text, '(?s)\\{[^{}]*"' + key + '"[^{}]*\\}', 0)


def has_any(lowered: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | (F.instr(lowered, w) > 0)
    return cond


def extract_column(text: Column) -> Column:
    """First quoted word, else first CamelCase word, else ''."""
    quoted = F.regexp_extract(text, QUOTED_WORD, 1)
    camel = first_bounded(text, CAMEL)
    return F.when(quoted != "", quoted).when(camel != "", camel).otherwise(F.lit(""))


def _valid(m: Column) -> Column:
    return (m != "") & json_keys(m).isNotNull()


def parse_cleaning_action(text: Column) -> Column:
    m = brace_group(text, "operation")
    use_json = _valid(m) & json_has(m, "operation") & json_has(m, "column")
    low = F.lower(text)
    col = extract_column(text)
    fb_op = (F.when(has_any(low, ["fill", "null"]), "fill_null")
             .when(has_any(low, ["type", "cast", "convert"]), "fix_type")
             .when(has_any(low, ["duplicate", "dedup"]), "remove_duplicate")
             .when(has_any(low, ["standard", "normalize"]), "standardize")
             .when(has_any(low, ["trim", "whitespace"]), "trim")
             .when(has_any(low, ["typo", "correct"]), "correct_typo")
             .otherwise("fill_null_default"))
    op = F.when(fb_op == "fill_null_default", "fill_null").otherwise(fb_op)
    fb_col = F.when(fb_op.isin("remove_duplicate", "fill_null_default"), F.lit("")).otherwise(col)
    fb_val = F.when(fb_op.isin("fill_null", "fill_null_default"), F.lit("median")) \
        .when(fb_op == "fix_type", F.lit("numeric"))
    return F.struct(
        F.when(use_json, json_str(m, "operation")).otherwise(op).alias("operation"),
        F.when(use_json, json_str(m, "column")).otherwise(fb_col).alias("column"),
        F.when(use_json, json_str(m, "value")).otherwise(fb_val).alias("value"),
        F.when(use_json, "json").otherwise("keyword").alias("parsed_from"))


def parse_enrichment_action(text: Column) -> Column:
    m = brace_group(text, "operation")
    use_json = _valid(m) & json_has(m, "field_name")
    low = F.lower(text)
    found = None
    for s in ALL_SOURCES:
        cond = (F.instr(low, s.replace("_", " ")) > 0) | (F.instr(low, s) > 0)
        found = F.when(cond, F.lit(s)) if found is None else found.when(cond, F.lit(s))
    found = found.otherwise(F.lit(None))
    return F.struct(
        F.when(use_json, json_str(m, "operation")).otherwise(F.lit("add_field")).alias("operation"),
        F.when(use_json, json_str(m, "field_name")).otherwise(F.coalesce(found, F.lit("unknown"))).alias("field_name"),
        F.when(use_json, json_str(m, "source")).otherwise(F.coalesce(found, F.lit(""))).alias("source"),
        F.when(use_json, "json").otherwise("keyword").alias("parsed_from"))


def parse_answering_action(text: Column) -> Column:
    from tessera.operators.answers import cite_extract_regex
    m = brace_group(text, "answer")
    use_json = _valid(m) & json_has(m, "answer")
    cited_json = F.from_json(F.get_json_object(m, "$.cited_columns"), "array<string>")
    return F.struct(
        F.when(use_json, json_str(m, "answer")).otherwise(text).alias("answer"),
        F.when(use_json, cited_json).otherwise(cite_extract_regex(text)).alias("cited_columns"),
        F.when(use_json, json_str(m, "reasoning")).otherwise(F.lit("")).alias("reasoning"),
        F.when(use_json, "json").otherwise("keyword").alias("parsed_from"))


def parse_tool_action(text: Column) -> Column:
    """JSON ``{"tool": ...}`` naming a valid tool; else an ordered keyword
    fallback with a ``column=...`` regex and a per-branch default column."""
    m = brace_group(text, "tool")
    tool_json = F.coalesce(json_str(m, "tool"), F.lit("profile_data"))
    use_json = _valid(m) & tool_json.isin(K.VALID_TOOLS)
    low = F.lower(text)
    colm = F.regexp_extract(low, COLUMN_ARG, 1)

    def col_or(default: str) -> Column:
        return F.when(colm != "", colm).otherwise(F.lit(default))

    branches = [
        (has_any(low, ["profile", "inspect"]), "profile_data", None, None, None),
        (has_any(low, ["duplicate", "dedup"]), "apply_cleaning_operation", "drop_duplicates", None, None),
        (has_any(low, ["invalid", "null", "replace"]), "apply_cleaning_operation", "replace_invalid_with_null",
         col_or("amount"), None),
        (has_any(low, ["dtype", "cast", "numeric"]), "apply_cleaning_operation", "cast_numeric", col_or("amount"),
         None),
        (has_any(low, ["impute", "fill", "missing"]), "apply_cleaning_operation", "impute_numeric", col_or("amount"),
         "median"),
        (has_any(low, ["clip", "outlier"]), "apply_cleaning_operation", "clip_outliers_iqr", col_or("order_value"),
         None),
        (has_any(low, ["normaliz", "categor", "whitespace", "strip"]), "apply_cleaning_operation",
         "normalize_categories", col_or("device_os"), None),
        (has_any(low, ["unit_test", "validate", "quality", "gate"]), "run_quality_gates", None, None, None),
        (has_any(low, ["submit"]), "submit_solution", None, None, None),
    ]

    def chain(idx: int) -> Column:
        expr = None
        for cond, tool, op, col, strat in branches:
            val = [F.lit(tool), F.lit(op), col if col is not None else F.lit(None), F.lit(strat)][idx]
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        default = [F.lit("profile_data"), F.lit(None), F.lit(None), F.lit(None)][idx]
        return expr.otherwise(default).cast("string")

    return F.struct(
        F.when(use_json, tool_json).otherwise(chain(0)).alias("tool"),
        F.when(use_json, F.get_json_object(m, "$.arguments.operation")).otherwise(chain(1)).alias("operation"),
        F.when(use_json, F.get_json_object(m, "$.arguments.column")).otherwise(chain(2)).alias("column"),
        F.when(use_json, F.get_json_object(m, "$.arguments.strategy")).otherwise(chain(3)).alias("strategy"),
        F.when(use_json, "json").otherwise("keyword").alias("parsed_from"))


# ------------------------------------------------------------ format rewards
def fmt_cleaning(text: Column) -> Column:
    m = brace_group(text, "operation")
    op = json_str(m, "operation")
    return (F.when(m == "", 0.0).when(~_valid(m), 0.2)
            .when(op.isin(CLEANING_VALID_OPS) & json_has(m, "column"), 1.0)
            .when(op.isin(CLEANING_VALID_OPS), 0.6).otherwise(0.3))


def fmt_enrichment(text: Column) -> Column:
    m = brace_group(text, "operation")
    op_ok = F.coalesce(json_str(m, "operation").isin(ENRICHMENT_VALID_OPS), F.lit(False))
    field_ok = json_has(m, "field_name") & (F.coalesce(json_str(m, "field_name"), F.lit("")) != "unknown")
    return (F.when(m == "", 0.0).when(~_valid(m), 0.2).when(op_ok & field_ok, 1.0).when(op_ok, 0.5)
            .otherwise(0.2))


def _nonblank_text(m: Column, key: str) -> Column:
    v = json_str(m, key)
    return F.coalesce(ws_trim(v) != "", F.lit(False))


def fmt_answering(text: Column) -> Column:
    m = brace_group(text, "answer")
    has_answer = _nonblank_text(m, "answer")
    cited = F.from_json(F.get_json_object(m, "$.cited_columns"), "array<string>")
    has_cited = F.coalesce(F.size(cited) > 0, F.lit(False))
    has_reason = _nonblank_text(m, "reasoning")
    return (F.when(m == "", 0.0).when(~_valid(m), 0.2).when(has_answer & has_cited & has_reason, 1.0)
            .when(has_answer & has_cited, 0.7).when(has_answer, 0.4).otherwise(0.2))


def fmt_tool(text: Column) -> Column:
    m = F.regexp_extract(text, '\\{[^{}]*"tool"[^{}]*\\}', 0)
    tool = F.coalesce(json_str(m, "tool"), F.lit(""))
    op = F.coalesce(F.get_json_object(m, "$.arguments.operation"), F.lit(""))
    return (F.when(m == "", 0.0).when(~_valid(m), 0.2)
            .when(tool == "apply_cleaning_operation", F.when(op.isin(K.TOOL_OPERATIONS), 1.0).otherwise(0.3))
            .when(tool.isin(K.VALID_TOOLS), 1.0).otherwise(0.3))


def source_relevance(text: Column, available: Column) -> Column:
    p = parse_enrichment_action(text)
    return (F.when(F.array_contains(available, p["source"]), 1.0)
            .when(p["field_name"] != "unknown", 0.3).otherwise(0.0))


def reasoning_score(text: Column) -> Column:
    low = F.lower(text)
    s = (F.when(has_any(low, REASONING_WORDS), 0.3).otherwise(0.0)
         + F.when(has_any(low, ISSUE_WORDS), 0.2).otherwise(0.0)
         + F.when(text.rlike(CAMEL), 0.1).otherwise(0.0))
    return F.least(s, F.lit(0.5))


def methodology_score(text: Column) -> Column:
    low = F.lower(text)
    s = (F.when(has_any(low, INSPECT_WORDS), 0.3).otherwise(0.0)
         + F.when(has_any(low, GATE_WORDS), 0.2).otherwise(0.0)
         + F.when(has_any(low, STABILITY_WORDS), 0.3).otherwise(0.0))
    return F.least(s, F.lit(1.0))


def parse_tool_strict(text: Column) -> Column:
    """JSON-only tool call: the brace group's tool (any value, as text) and
    arguments, else profile_data with no arguments."""
    m = brace_group(text, "tool")
    ok = _valid(m)
    return F.struct(
        F.when(ok, F.coalesce(json_str(m, "tool"), F.lit("profile_data"))).otherwise(F.lit("profile_data")).alias("tool"),
        F.when(ok, F.get_json_object(m, "$.arguments.operation")).alias("operation"),
        F.when(ok, F.get_json_object(m, "$.arguments.column")).alias("column"))


def parse_any_json(text: Column) -> Column:
    """First flat ``{...}`` that parses: its keys (in order) and common
    fields; otherwise an empty result."""
    m = F.regexp_extract(text, "(?s)\\{[^{}]*\\}", 0)
    ok = _valid(m)
    return F.struct(ok.alias("has_json"), F.when(ok, F.array_join(json_keys(m), ",")).alias("keys"),
                    F.when(ok, json_str(m, "operation")).alias("operation"),
                    F.when(ok, json_str(m, "tool")).alias("tool"))


# Validation messages of the tool environment.
def validate_tool_call(tool: Column, operation: Column, column: Column, columns: list[str]) -> Column:
    """Error text for an invalid cleaning call (NULL when valid)."""
    is_apply = tool == "apply_cleaning_operation"
    return (F.when(~is_apply, F.lit(None))
            .when(operation.isNull() | ~operation.isin(K.TOOL_OPERATIONS),
                  F.concat(F.lit("Unsupported operation '"), F.coalesce(operation, F.lit("None")), F.lit("'.")))
            .when(operation == "drop_duplicates", F.lit(None))
            .when(column.isNull(), F.concat(F.lit("Operation '"), operation, F.lit("' requires a column.")))
            .when(~column.isin(columns), F.concat(F.lit("Unknown column '"), column, F.lit("'."))))
