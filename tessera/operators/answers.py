"""Answer scoring: persona alignment, faithfulness and citation extraction
over a table of model answers (one row per answer, whole texts).

Everything is built-in string/array expressions; the per-domain sample-value
dimension is a small aggregate (columns x 10 values) broadcast to the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.exprs import bound, ws_trim
from tessera.functions.text import (CAPITALISED_RUN, WORDC, any_substring, bounded, count_substrings, find_all_bounded,
                                    sentence_count, word_count_in_sentences)
from tessera.session import ensure_checkpoint_dir

PERSONA_BY_ROLE = {p["role"]: p for p in K.PERSONAS}
PERSONA_BY_NAME = {p["name"]: p for p in K.PERSONAS}
# Hedging phrases and number-evidence patterns of the local
# faithfulness heuristic.
HEDGES = ["i believe", "probably", "might be", "i'm not sure", "i think maybe"]
PERCENT = r"\d+\.?\d*%"
TWO_DIGITS = bounded("[0-9]{2,}")
#: The same texts, found from their first digit on without backtracking (Java only).
TWO_DIGITS_RUN = f"[0-9](?<![{WORDC}][0-9])[0-9]++(?![{WORDC}])"
#: All that ``ws_trim`` can take away.
MOST_BLANKS = " \t\n\x0b\f\r\u0085\u2028\u2029"


def keyword_score(lowered: Column, persona: dict) -> Column:
    denom = max(len(persona["keywords"]) * 0.3, 1)
    return F.least(count_substrings(lowered, persona["keywords"]) / F.lit(denom), F.lit(1.0))


def anti_penalty(lowered: Column, persona: dict) -> Column:
    return F.least(count_substrings(lowered, persona["anti_keywords"]) * 0.15, F.lit(0.5))


def formality(text: Column, lowered: Column, style: str) -> Column:
    if style in K.FORMALITY_INDICATORS:
        return F.least(count_substrings(lowered, K.FORMALITY_INDICATORS[style]) / 2.0, F.lit(1.0))
    if style == "plain-personal":
        avg = word_count_in_sentences(text) / sentence_count(text)
        return F.when(avg < 20, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - (avg - 20) / 30))
    return F.lit(0.5)


def alignment(text: Column, persona: dict) -> Column:
    lowered = F.lower(text)
    raw = (0.50 * keyword_score(lowered, persona) + 0.20 * formality(text, lowered, persona["style"]) + 0.30
           - anti_penalty(lowered, persona))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def by_persona(key: Column, fn, personas: dict, default=None) -> Column:
    """``fn(persona)`` for the persona named by ``key`` (CASE: only the
    matching branch is evaluated per row)."""
    expr = None
    for name, p in personas.items():
        expr = F.when(key == name, fn(p)) if expr is None else expr.when(key == name, fn(p))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def persona_alignment(df: DataFrame, text: str = "answer", role: str = "persona_role") -> Column:
    return by_persona(F.col(role), lambda p: alignment(F.col(text), p), PERSONA_BY_ROLE)


def persona_match_reward(text: Column, persona_name: Column) -> Column:
    """Alignment with the requested persona (by display name); unknown -> 0."""
    return by_persona(persona_name, lambda p: alignment(text, p), PERSONA_BY_NAME, 0.0)


def hits_list(lowered: Column, needles: list[str]) -> Column:
    """Needles found in the text, in list order."""
    return F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.instr(lowered, F.lower(n)) > 0)


# ------------------------------------------------------------- faithfulness
#: Rows of smallest key that are looked at first for every column's sample values.
SAMPLE_HEAD = 1000


def _sampled_rows(df: DataFrame, key: str, cols: list[str], k: int, head: int) -> DataFrame:
    """``_k, column_name, value`` of non-null values, at least the first ``k`` of every column in the
    order of (key, value). The ``head`` rows of smallest key are taken without sorting the table. All
    rows of a smaller key than the last of them are among them, so a column with ``k`` values there
    is done; only columns with fewer, which are mostly null, are read whole."""
    def stacked(rows: DataFrame, columns: list[str]) -> DataFrame:
        items = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns]
        return rows.select("_k", F.explode(F.array(*items)).alias("x")).select("_k", "x.*").where("value IS NOT NULL")

    rows = df.select(F.col(key).cast("string").alias("_k"), *[F.col(c).cast("string").alias(c) for c in cols])
    ensure_checkpoint_dir(df.sparkSession)
    first = rows.orderBy("_k").limit(head).checkpoint(eager=True)
    n, last = first.agg(F.count(F.lit(1)), F.max("_k")).first()
    if n < head:
        return stacked(first, cols)
    whole = first.where(F.col("_k").isNull() | (F.col("_k") < F.lit(last)))  # null keys come first
    counts = whole.agg(*[F.count(F.col(c)) for c in cols]).first()
    few = [c for c, m in zip(cols, counts) if m < k]
    done = stacked(whole, [c for c in cols if c not in few]) if len(few) < len(cols) else None
    if not few:
        return done
    rest = stacked(rows, few)
    return rest if done is None else done.unionByName(rest)


def sample_values(domain_tables: dict[str, tuple[DataFrame, str]], k: int = 10, head: int = SAMPLE_HEAD) -> DataFrame:
    """(domain, column_name, values) with the first ``k`` non-null values of
    every column as text, in key order. ``row_number() <= k`` is planned as
    a per-partition group limit before the shuffle, over few rows for all
    columns but mostly null ones; the dimension stays at columns x k rows."""
    out = None
    for d, (df, key) in domain_tables.items():
        cols = [c for c in df.columns if not c.startswith("_")]
        long = _sampled_rows(df, key, cols, k, head)
        w = W.partitionBy("column_name").orderBy("_k", "value")
        top = long.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
        agg = top.groupBy("column_name").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("values"))
        part = agg.select(F.lit(d).alias("domain"), "column_name", "values")
        out = part if out is None else out.unionByName(part)
    return out


def faithfulness_cited(answers: DataFrame, samples: DataFrame, domain_columns: dict[str, list[str]]) -> DataFrame:
    """.5 * valid/cited (no citation: .1) + .15 for each of the first three
    valid cited columns whose sample values occur in the answer; cap 1.

    The sample dimension is collapsed to one map per domain (bounded by
    columns x 10 values) and broadcast-joined on domain."""
    per_domain = samples.groupBy("domain").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "values"))).alias("_samples"))
    cols_map = F.create_map(*[x for d, cs in domain_columns.items()
                              for x in (F.lit(d), F.array(*[F.lit(c) for c in cs]))])
    j = answers.join(F.broadcast(per_domain), "domain", "left")
    cited = F.col("cited_columns")
    valid = F.filter(cited, lambda c: F.array_contains(F.try_element_at(cols_map, F.col("domain")), c))
    lowered = F.lower(F.col("answer"))
    first3 = F.slice(valid, 1, 3)
    hit = F.transform(first3, lambda c: F.when(F.exists(
        F.coalesce(F.try_element_at(F.col("_samples"), c), F.array().cast("array<string>")),
        lambda v: F.instr(lowered, F.lower(v)) > 0), 1).otherwise(0))
    n_hits = F.aggregate(hit, F.lit(0), lambda a, b: a + b)
    base = F.when(F.size(cited) > 0, 0.5 * (F.size(valid) / F.size(cited))).otherwise(F.lit(0.1))
    return j.select("doc_id", F.round(F.least(base + 0.15 * n_hits, F.lit(1.0)), 4).alias("faithfulness"))


def faithfulness_eval(cited: Column, valid_columns: Column) -> Column:
    valid = F.filter(cited, lambda c: F.array_contains(valid_columns, c))
    return F.when(F.size(cited) > 0, F.size(valid) / F.size(cited)).otherwise(F.lit(0.1))


def capitalised_words(text: Column) -> Column:
    return find_all_bounded(text, CAPITALISED_RUN)


def faithfulness_local(text: Column) -> Column:
    n_cap = F.size(capitalised_words(text))
    hedged = bound(F.lower(text), lambda lowered: any_substring(lowered, HEDGES))
    score = (F.when(n_cap >= 1, 0.3).otherwise(0.0) + F.when(n_cap >= 3, 0.2).otherwise(0.0)
             + F.when((F.contains(text, F.lit("%")) & text.rlike(PERCENT)) | text.rlike(TWO_DIGITS_RUN), 0.2).otherwise(0.0)
             - F.when(hedged, 0.2).otherwise(0.0)
             - F.when((F.length(F.btrim(text, F.lit(MOST_BLANKS))) < 50) & (F.length(ws_trim(text)) < 50), 0.3).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def cite_extract_regex(text: Column, k: int = 5) -> Column:
    return F.slice(capitalised_words(text), 1, k)


def cite_extract_known(text: Column, columns: Column) -> Column:
    lowered = F.lower(text)
    return F.filter(columns, lambda c: F.instr(lowered, F.lower(c)) > 0)
