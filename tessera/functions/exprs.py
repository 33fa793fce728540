"""Column-expression helpers shared by every operator.

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen. Each has a DuckDB twin in
``tessera.plans.sqlkit`` that gives the same value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number as Python's float() reads it (sign, digits, optional
# fraction and exponent, or inf/infinity/nan), surrounded by optional blanks.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"

TWO_POW_32 = 4294967296.0


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                           T.DecimalType))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def bound(value: Column, use) -> Column:
    """``use(value)``, where the value is computed once a row however often it
    is used. Long expressions stay short that way: code of more than 8,000
    bytes in one method is never compiled by the JVM, only interpreted."""
    return F.transform(F.array(value), use)[0]


def as_text(c: Column, dt: T.DataType | None = None) -> Column:
    """Text of a value. Doubles go through decimal so that both engines print
    the same digits (1e7 -> 10000000.00)."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.cast(T.DecimalType(18, 2)).cast("string")
    return c.cast("string")


def parse_double(c, dt: T.DataType | None = None) -> Column:
    """Coerce to double the way ``float(x)`` would; anything else is NULL.

    ANSI casts would throw, Spark alone accepts '1d', so the text is checked
    against the pattern first and then ``try_cast``. NaN becomes NULL.
    """
    c = col_of(c)
    if dt is not None and is_numeric_type(dt):
        return nan_to_null(c.cast("double"))
    s = c.cast("string")
    parsed = F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))
    return nan_to_null(parsed)


def is_numeric_like(c, dt: T.DataType | None = None) -> Column:
    """True when the value is NULL or parses as a number."""
    c = col_of(c)
    if dt is not None and is_numeric_type(dt):
        return F.lit(True)
    return c.isNull() | c.cast("string").rlike(NUMERIC_PATTERN)


def ws_trim(c) -> Column:
    """Python ``str.strip()``: remove all leading/trailing whitespace."""
    return F.regexp_replace(col_of(c), r"^\s+|\s+$", "")


def py_title(c) -> Column:
    """Python ``str.title()``: every run of letters gets an upper-case first
    letter and lower-case rest (``initcap`` alone splits on blanks only)."""
    pieces = F.regexp_extract_all(col_of(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def hash_hex(*parts) -> Column:
    """md5 of the parts (columns, or plain values used as tags), 32 hex digits.

    Columns that are null are left out, as ``concat_ws`` does. Tags that stand
    together are one literal, so a draw is a short expression."""
    out, tags = [], []
    for p in [*parts, None]:
        if p is not None and not isinstance(p, Column):
            tags.append(str(p))
            continue
        if tags:
            out.append(F.lit("|".join(tags)))
            tags = []
        if p is not None:
            out.append(p.cast("string"))
    return F.md5(F.concat_ws("|", *out))


def hash_below(p: float, *parts) -> Column:
    """``hash_uniform(*parts) < p``, compared as hex text: as many digits in
    the same order, without a number made of each."""
    least = math.ceil(p * TWO_POW_32)
    if least > 0xFFFFFFFF:
        return F.lit(True)
    return hash_hex(*parts) < F.lit(format(max(least, 0), "08x"))


def hash_uniform(*parts) -> Column:
    """Deterministic uniform draw in [0, 1) from the md5 of the parts
    (columns, or plain values used as tags).

    Partition independent and stable on task retries, so noise injection is
    reproducible at any scale; DuckDB computes the same bits.
    """
    return F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def hash_pick(u: Column, options: list) -> Column:
    """Pick ``options[floor(u * n)]`` for a uniform ``u``."""
    idx = F.least(F.floor(u * len(options)).cast("int"), F.lit(len(options) - 1)) + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx)


def safe_round(c: Column, scale: int) -> Column:
    return F.round(c, scale)


def literal_map(mapping: dict) -> Column:
    items = []
    for k, v in mapping.items():
        items.extend([F.lit(k), F.lit(v)])
    return F.create_map(*items)


def lookup(mapping: dict, key: Column) -> Column:
    """Small fixed lookup as a literal map (no join, no shuffle)."""
    return F.try_element_at(literal_map(mapping), key)


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive substring test of a fixed needle against lowered text."""
    return F.instr(text, needle.lower()) > 0


def count_hits(lowered_text: Column, needles: list[str]) -> Column:
    """How many of the fixed needles occur in the (already lower-cased) text."""
    terms = [F.when(contains_ci(lowered_text, n), 1).otherwise(0) for n in needles]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def hash52(*parts) -> Column:
    """52-bit integer hash (exact in a double) for ranking rows by a seeded
    random order; collisions are ~n^2/2^53."""
    return hex52(hash_hex(*parts))


def hex52(digits: Column) -> Column:
    """The number that the first 13 hex digits are."""
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("double")


def hex_at_most(digits: Column, most: float | None) -> Column:
    """``hex52(digits) <= most``, compared as text."""
    if most is None:
        return F.lit(None).cast("boolean")
    above = math.floor(most) + 1
    return F.lit(True) if above >= 1 << 52 else digits < F.lit(format(max(above, 0), "013x"))


def swapcase_char(ch: Column) -> Column:
    return F.when(F.upper(ch) == ch, F.lower(ch)).otherwise(F.upper(ch))
