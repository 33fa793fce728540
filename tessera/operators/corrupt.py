"""Corruption injectors: reproducible dirty versions of clean tables.

Random choices are md5 draws of (row key, seed, column, purpose), so a dirty
table is identical across runs, partitionings and task retries. "Exactly k
cells" choices pick the k rows with the smallest seeded hash; the k-th hash
value is found with ``stats.kth_smallest`` (bounded distributed passes), and
the final selection is a plain filter -- no global sort, no row_number over
the whole table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tessera.functions import constants as K
from tessera.functions.exprs import (bound, dtype_of, hash52, hash_below, hash_hex, hash_pick, hash_uniform, hex_at_most,
                                     parse_double, swapcase_char)
from tessera.operators import stats

# Typo kinds and inserted letters.
TYPO_KINDS = ["swap", "delete", "insert", "case"]
LETTERS = list(string.ascii_lowercase)


def _k(n: int, rate: float, share: float) -> int:
    return max(1, int(n * rate * share))


def _thresholds(df: DataFrame, hashes: dict[str, Column], k: int, n: int) -> dict[str, float | None]:
    return stats.kth_of_uniform(df, hashes, {c: min(k, n) - 1 for c in hashes}, n)


#: Decimals of the two outlier values.
OUTLIER_DECIMALS = 9


# ---------------------------------------------------- tool-family noise
def noise_missing(df: DataFrame, key: str, columns: list[str], p: float, seed: int = 42) -> DataFrame:
    k = F.col(key)
    return df.withColumns({c: F.when(hash_below(p, k, seed, c, "missing"), F.lit(None)).otherwise(F.col(c))
                           for c in columns})


def noise_invalid_tokens(df: DataFrame, key: str, columns: list[str], p: float, seed: int = 42) -> DataFrame:
    k = F.col(key)
    return df.withColumns({
        c: F.when(hash_below(p, k, seed, c, "invalid"),
                  hash_pick(hash_uniform(k, seed, c, "token"), K.INVALID_TOKENS)).otherwise(F.col(c).cast("string"))
        for c in columns})


def duplicate_draws(spark, n: int, p: float, seed: int = 42) -> DataFrame:
    """``_rank, _drawn``: which of ``n`` rows are drawn how often when exactly
    ``max(1, int(n * p))`` rows are drawn with replacement. Draw j is a 52-bit
    hash of j scaled to a rank, so tables of any size are reached evenly."""
    draws = max(1, int(n * p)) if n else 0
    share = hash52(F.col("id"), seed, "dup") / F.lit(2.0 ** 52)
    rank = F.least(F.floor(share * F.lit(float(n))).cast("long"), F.lit(n - 1).cast("long"))
    return spark.range(draws).groupBy(rank.alias("_rank")).agg(F.count(F.lit(1)).alias("_drawn"))


def noise_duplicates(df: DataFrame, key: str, p: float, seed: int = 42) -> DataFrame:
    """Append exactly ``max(1, int(n * p))`` copies, drawn with replacement from
    the ``n`` rows; ``_copy`` is 0 for a row itself and 1, 2, ... for its copies.

    A draw addresses a row by its rank in the order of ``key`` (rows of equal key
    by their other columns, those in the order of their names), so the result doesn't depend on the partitioning.
    Rows are range partitioned and written once, the sizes of the partitions are
    the directory that turns a place in a partition into a rank, and the draws
    (``p`` of the rows at most, already counted per rank) meet their rows by an
    equijoin on the rank. An empty table stays empty."""
    from tessera.operators.trajectory import ordered_prefix
    tie = sorted(f.name for f in df.schema.fields if f.name != key and not isinstance(f.dataType, (MapType, VariantType)))
    ranked = ordered_prefix(df, [], [key, *tie], {})
    drawn = duplicate_draws(df.sparkSession, ranked.count(), p, seed)
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_drawn", F.lit(0)).cast("long"))
    return ranked.join(drawn, ranked.idx == drawn["_rank"], "left").select(*df.columns, F.explode(copies).alias("_copy"))


def noise_outliers(df: DataFrame, key: str, columns: list[str], p: float, seed: int = 42) -> DataFrame:
    """Cells -> Q3 + 10 IQR or Q1 - 10 IQR with probability p when IQR > 0."""
    vals = {c: parse_double(F.col(c), dtype_of(df, c)) for c in columns}
    qs = stats.exact_quantiles(df, vals, [0.25, 0.75])
    k = F.col(key)
    out = {}
    for c in columns:
        q1, q3 = qs[c]
        if q1 is None or not (q3 - q1) > 0:
            out[c] = vals[c]
            continue
        iqr = q3 - q1
        # rounded, so that the last place does not depend on the engine's order of operations
        hi, lo = round(q3 + 10 * iqr, OUTLIER_DECIMALS), round(q1 - 10 * iqr, OUTLIER_DECIMALS)
        side = F.when(hash_below(0.5, k, seed, c, "side"), F.lit(hi)).otherwise(F.lit(lo))
        out[c] = F.when(hash_below(p, k, seed, c, "outlier"), side).otherwise(vals[c])
    return df.withColumns(out)


def noise_category_drift(df: DataFrame, key: str, columns: list[str], p: float, seed: int = 42) -> DataFrame:
    """Pad both sides / upper / lower / trailing space. NULL stays NULL."""
    k = F.col(key)
    out = {}
    for c in columns:
        s = F.col(c).cast("string")
        drifted = bound(F.struct(s.alias("s"), hash_uniform(k, seed, c, "drift_kind").alias("kind")), lambda d: (
            F.when(d["kind"] < 0.25, F.concat(F.lit("  "), d["s"], F.lit("  ")))
            .when(d["kind"] < 0.5, F.upper(d["s"])).when(d["kind"] < 0.75, F.lower(d["s"]))
            .otherwise(F.concat(d["s"], F.lit(" ")))))
        out[c] = F.when(hash_below(p, k, seed, c, "drift"), drifted).otherwise(s)
    return df.withColumns(out)


def noise_string_in_numeric(df: DataFrame, key: str, columns: list[str], p: float, seed: int = 42) -> DataFrame:
    """Numeric cells -> one of unknown, ?, n/a, ''; the column becomes text,
    and the cells that are left alone read back to the same number."""
    k = F.col(key)
    out = {}
    for c in columns:
        text = F.col(c).cast("string")  # reads back to the same number
        out[c] = F.when(hash_below(p, k, seed, c, "junk"),
                        hash_pick(hash_uniform(k, seed, c, "junk_pick"), K.NUMERIC_JUNK)).otherwise(text)
    return df.withColumns(out)


# Noise presets (missing, invalid, duplicate, outlier, drift, junk).
NOISE_PROFILES = {
    "light": (0.02, 0.02, 0.02, 0.01, 0.03, 0.02),
    "medium": (0.05, 0.04, 0.03, 0.02, 0.06, 0.03),
    "heavy": (0.08, 0.06, 0.05, 0.04, 0.10, 0.05),
}


def apply_noise_profile(df: DataFrame, key: str, numeric: list[str], categorical: list[str], target: str,
                        profile: str = "medium", seed: int = 42, skip_missing: list[str] | None = None) -> DataFrame:
    """The six steps in order: missing, invalid tokens, duplicates, outliers,
    drift, junk in numerics. Draws after duplication are keyed by copy, so
    copies can drift apart; ``_seq`` orders copies after originals."""
    pm, pi, pd_, po, pdr, pj = NOISE_PROFILES[profile]
    skip = set(skip_missing or []) | {target, key}
    df = noise_missing(df, key, [c for c in df.columns if c not in skip and not c.startswith("_")], pm, seed)
    df = noise_invalid_tokens(df, key, [c for c in categorical if c != target], pi, seed)
    df = noise_duplicates(df, key, pd_, seed)
    row_key = F.concat_ws("#", F.col(key).cast("string"), F.col("_copy").cast("string"))
    df = df.withColumn("_rk", row_key)
    df = noise_outliers(df, "_rk", [c for c in numeric if c != target], po, seed)
    df = noise_category_drift(df, "_rk", [c for c in categorical if c != target], pdr, seed)
    df = noise_string_in_numeric(df, "_rk", [c for c in numeric if c != target], pj, seed)
    if "_seq" in df.columns:
        df = df.withColumn("_seq", F.col("_copy").cast("long") * (1 << 40) + F.col("_seq"))
    return df.drop("_rk", "_copy")


# --------------------------------------------------- domain-family corruption
def corrupt_nulls(df: DataFrame, key: str, numeric: list[str], rate: float = 0.15, seed: int = 42) -> DataFrame:
    k = F.col(key)
    return df.withColumns({c: F.when(hash_below(rate, k, seed, c, "null"), F.lit(None)).otherwise(F.col(c))
                           for c in numeric if c in df.columns})


def _type_hashes(key: str, cols: list[str], seed: int) -> dict[str, Column]:
    return {f"type:{c}": hash_hex(F.col(key), seed, c, "type") for c in cols}


def _typo_hashes(key: str, cols: list[str], seed: int) -> dict[str, Column]:
    return {f"typo:{c}": hash_hex(F.col(key), seed, c, "typo") for c in cols}


def _apply_type(df: DataFrame, key: str, cols: list[str], th: dict, seed: int) -> DataFrame:
    k = F.col(key)
    out = {}
    for c in cols:
        text = F.col(c).cast("string")  # reads back to the same number
        out[c] = F.when(hex_at_most(hash_hex(k, seed, c, "type"), th[f"type:{c}"]),
                        hash_pick(hash_uniform(k, seed, c, "type_tok"), K.TYPE_MISMATCH_TOKENS)).otherwise(text)
    return df.withColumns(out)


def _apply_typos(df: DataFrame, key: str, cols: list[str], th: dict, seed: int) -> DataFrame:
    k = F.col(key)
    out = {}
    for c in cols:
        t = typo_expr(F.col(c).cast("string"), hash_uniform(k, seed, c, "typo_kind"),
                      hash_uniform(k, seed, c, "typo_idx"), hash_uniform(k, seed, c, "typo_char"))
        out[c] = F.when(hex_at_most(hash_hex(k, seed, c, "typo"), th[f"typo:{c}"]), t).otherwise(F.col(c).cast("string"))
    return df.withColumns(out)


def corrupt_type_mismatch(df: DataFrame, key: str, numeric: list[str], rate: float = 0.15, seed: int = 42,
                          n: int | None = None) -> DataFrame:
    """Exactly max(1, int(n*rate*0.3)) cells per numeric column become one of
    N/A, unknown, #REF!, TBD, -; the columns become text."""
    cols = [c for c in numeric if c in df.columns]
    n = df.count() if n is None else n
    hashes = _type_hashes(key, cols, seed)
    th = stats.kth_of_uniform(df, hashes, {h: min(_k(n, rate, 0.3), n) - 1 for h in hashes}, n)
    return _apply_type(df, key, cols, th, seed)


def typo_expr(text: Column, u_kind: Column, u_idx: Column, u_char: Column) -> Column:
    """One typo at a hash-chosen index: swap with next, delete, insert a
    letter, or flip case. Strings shorter than 2 are unchanged; a swap at the
    last index falls through to a case flip."""
    n = F.length(text)
    drawn = F.struct(text.alias("text"), n.alias("n"), F.least(F.floor(u_idx * n).cast("int"), n - 1).alias("idx"),
                     hash_pick(u_kind, TYPO_KINDS).alias("kind"), hash_pick(u_char, LETTERS).alias("ch"))

    def typo(d: Column) -> Column:
        text, idx, kind = d["text"], d["idx"], d["kind"]
        pre = F.substring(text, F.lit(1), idx)
        at = F.substring(text, idx + 1, F.lit(1))
        nxt = F.substring(text, idx + 2, F.lit(1))
        rest1 = F.substr(text, idx + 2)
        rest2 = F.substr(text, idx + 3)
        return (F.when(text.isNull() | (d["n"] < 2), text)
                .when((kind == "swap") & (idx < d["n"] - 1), F.concat(pre, nxt, at, rest2))
                .when(kind == "delete", F.concat(pre, rest1))
                .when(kind == "insert", F.concat(pre, d["ch"], F.substr(text, idx + 1)))
                .otherwise(F.concat(pre, swapcase_char(at), rest1)))

    return bound(drawn, typo)


def corrupt_typos(df: DataFrame, key: str, categorical: list[str], rate: float = 0.15, seed: int = 42,
                  n: int | None = None) -> DataFrame:
    """Exactly max(1, int(n*rate*0.2)) cells per categorical column get a typo."""
    cols = [c for c in categorical if c in df.columns]
    n = df.count() if n is None else n
    hashes = _typo_hashes(key, cols, seed)
    th = stats.kth_of_uniform(df, hashes, {h: min(_k(n, rate, 0.2), n) - 1 for h in hashes}, n)
    return _apply_typos(df, key, cols, th, seed)


def _dup_rows(df: DataFrame, key: str, th_dup: float, seed: int) -> DataFrame:
    chosen = hex_at_most(hash_hex(F.col(key), seed, "dup"), th_dup)
    return df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.when(chosen, 1).otherwise(0).cast("long")))
                     .alias("_copy"))


def _apply_whitespace(rows: DataFrame, key: str, categorical: list[str], rate: float, seed: int,
                      n: int) -> DataFrame:
    rk = F.concat_ws("#", F.col(key).cast("string"), F.col("_copy").cast("string"))
    cols = [c for c in categorical[:2] if c in rows.columns]
    total = n + _k(n, rate, 0.1)
    hashes = {c: hash_hex(rk, seed, c, "ws") for c in cols}
    ths = stats.kth_of_uniform(rows, hashes, {c: min(_k(n, rate, 0.2), total) - 1 for c in cols}, total)
    out = {c: F.when(hex_at_most(hashes[c], ths[c]), F.concat(F.lit("  "), F.col(c).cast("string"), F.lit("  ")))
           .otherwise(F.col(c)) for c in cols}
    return rows.withColumns(out)


def corrupt_duplicates_whitespace(df: DataFrame, key: str, categorical: list[str], rate: float = 0.15,
                                  seed: int = 42, n: int | None = None) -> DataFrame:
    """Append exactly max(1, int(n*rate*0.1)) duplicate rows, then pad
    exactly max(1, int(n*rate*0.2)) cells of each of the first two
    categorical columns with two spaces on each side."""
    n = df.count() if n is None else n
    th = stats.kth_of_uniform(df, {"dup": hash_hex(F.col(key), seed, "dup")}, {"dup": _k(n, rate, 0.1) - 1}, n)["dup"]
    return _apply_whitespace(_dup_rows(df, key, th, seed), key, categorical, rate, seed, n)


def corrupt_domain(df: DataFrame, key: str, numeric: list[str], categorical: list[str], rate: float = 0.15,
                   seed: int = 42) -> DataFrame:
    """nulls -> type mismatches -> typos -> duplicates -> whitespace.

    Every "exactly k" choice of the first three steps ranks rows by a hash of
    the original key, so all their thresholds come from one batched
    ``kth_of_uniform`` over the clean table; only the whitespace step (which
    ranks the duplicated rows) needs a second batch. Jobs: count + 1 + 1."""
    n = df.count()
    num = [c for c in numeric if c in df.columns]
    cat = [c for c in categorical if c in df.columns]
    hashes = {**_type_hashes(key, num, seed), **_typo_hashes(key, cat, seed), "dup": hash_hex(F.col(key), seed, "dup")}
    ranks = {**{h: min(_k(n, rate, 0.3), n) - 1 for h in _type_hashes(key, num, seed)},
             **{h: min(_k(n, rate, 0.2), n) - 1 for h in _typo_hashes(key, cat, seed)},
             "dup": min(_k(n, rate, 0.1), n) - 1}
    th = stats.kth_of_uniform(df, hashes, ranks, n)
    out = corrupt_nulls(df, key, numeric, rate, seed)
    out = _apply_type(out, key, num, th, seed)
    out = _apply_typos(out, key, cat, th, seed)
    return _apply_whitespace(_dup_rows(out, key, th["dup"], seed), key, categorical, rate, seed, n)
