"""Text helpers: regex patterns written so that Spark (Java regex) and DuckDB
(RE2) agree, keyword counting, and JSON field access.

Word boundaries: Java's ``\\b`` is Unicode-aware and RE2's is ASCII, so they
disagree next to accented letters. Patterns here spell the boundary as an
explicit ASCII class; "find all" extraction looks at the characters beside a
match without consuming them (RE2 has no such thing: the twin doubles the
separators instead).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.exprs import ws_trim

WORDC = "A-Za-z0-9_"
# Capitalised-word and CamelCase shapes used by the parsers.
CAPITALISED = "[A-Z][a-zA-Z]+(?:[A-Z][a-z]+)*"
#: The same words between boundaries, without backtracking (Java only).
CAPITALISED_RUN = "[A-Z][a-zA-Z]++"
CAMEL = "[A-Z][a-z]+(?:[A-Z][a-z]+)+"
QUOTED_WORD = f"[\"']([{WORDC}]+)[\"']"
BLANKS = " \\t\\n\\r\\f\\x0B"


def bounded(core: str) -> str:
    """``\\b(core)\\b`` with an explicit ASCII word class; group 1 is core."""
    return f"(?:^|[^{WORDC}])({core})(?:[^{WORDC}]|$)"


def find_all_bounded(text: Column, core: str) -> Column:
    """All ``\\b(core)\\b`` matches of a core of word characters, left to right."""
    return F.regexp_extract_all(text, F.lit(f"(?<![{WORDC}])({core})(?![{WORDC}])"), 1)


def first_bounded(text: Column, core: str) -> Column:
    """First ``\\b(core)\\b`` match or ''."""
    return F.regexp_extract(text, bounded(core), 1)


def any_substring(lowered: Column, needles: list[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(lowered, F.lit(n.lower()))
    return cond


def count_substrings(lowered: Column, needles: list[str]) -> Column:
    total = F.lit(0)
    for n in needles:
        total = total + F.when(F.instr(lowered, n.lower()) > 0, 1).otherwise(0)
    return total


def word_count_in_sentences(text: Column) -> Column:
    """sum(len(s.split()) for s in text.split('.')): maximal runs of
    characters that are neither blank nor '.'."""
    return F.regexp_count(text, F.lit(f"[^{BLANKS}.]+"))


def sentence_count(text: Column) -> Column:
    """len(text.split('.'))."""
    return F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) + 1


def strip_think(text: Column) -> Column:
    return ws_trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def json_keys(js: Column) -> Column:
    """Top-level keys of a JSON object text; NULL when it does not parse."""
    return F.json_object_keys(js)


def json_has(js: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(json_keys(js), F.lit(key)), F.lit(False))


def json_str(js: Column, key: str) -> Column:
    return F.get_json_object(js, f"$.{key}")
