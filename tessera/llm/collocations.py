"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word starts one window of up to five
words of its piece (lead columns ``w1`` to ``w5``, null past the end). A phrase of
k words occurs where a window's first k columns are that phrase, so the counts of
all shorter phrases are sums over windows that share a prefix, and one Spark
``ROLLUP (w1 .. w5)`` gives the count of every phrase of every length, with the
words of a language at its top. No n-grams of shorter order are exploded.

Windows are padded early where no frequent phrase can go on. A first pass adds up
hashed counts of the starts of the same windows in a table of buckets for each
length; a bucket's sum is never below the count of anything in it, so a phrase whose
bucket stays under the least count is no candidate and in no part of one. A window
ends where it would hold such a phrase, and a word of such a bucket starts an empty
one (counted for its language only).
Buckets grow with the text up to a fixed number, so what is broadcast is bounded.
Counts of all phrases of at least the least count stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, blobs_of, checkpointed, mix64, slices, tidied

#: Longest phrase.
MOST_WORDS = 5
#: Buckets of each table: a power of 2, about one for every so many bytes of text, within these.
BYTES_A_BUCKET = 64
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 25
#: Languages up to which their totals are broadcast.
FEW_LANGUAGES = 10_000
#: Buckets of a slice, the unit in which tables are summed.
SLICE = 1 << 16
#: Bytes of text of a task, beyond three tasks a core.
TASK_BYTES = 256 << 20
#: Distinct windows held by a task before they are given out.
HELD_WINDOWS = 1 << 18

_STOPS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLASS = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_CLASS[list(_GAPS)] = 1
_CLASS[list(_STOPS)] = 2
_BYTE_CODE = np.random.default_rng(20_250_117).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_BASE, 1), _powers(_INVERSE, 1)


def words_of(blobs: list[bytes], salts: list[int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts as one, and of each word in order: start, end, a
    64-bit code of the word and its text's salt, and whether the next word follows
    in the same piece."""
    global _up, _down
    joined = b"\n".join(blobs) + b"\n"
    joined = joined.translate(LOWER)
    data = np.frombuffer(joined, np.uint8)
    kind = _CLASS[data]
    inside = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the text ends with a stop, so edges pair up
    if len(_up) < len(data):
        _up, _down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _up[: len(data)], out=prefix[1:])
    at = np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs])))
    owner = np.searchsorted(at, starts, "right") - 1
    salt = np.array(salts, np.uint64)[owner]
    codes = mix64((prefix[ends] - prefix[starts]) * _down[starts] + (ends - starts).astype(np.uint64) ^ salt)
    stops = np.concatenate(([0], np.cumsum(kind == 2)))
    joins = np.zeros(len(starts), bool)
    joins[:-1] = stops[ends[:-1]] == stops[starts[1:]]
    return joined, starts, ends, codes, joins


def _salt(lang: str) -> int:
    """A language's part of its words' codes."""
    value = len(lang) + 1
    for b in lang.encode():
        value = (value * 1_099_511_628_211 + b + 1) % 2**64
    return int(mix64(np.array([value], np.uint64))[0])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    """Languages, texts and salts, about a megabyte at a time."""
    salts: dict[str, int] = {}
    for batch in batches:
        langs, blobs = batch.column(0).to_pylist(), blobs_of(batch.column(1))
        for a, b in slices(blobs):
            for lang in langs[a:b]:
                if lang not in salts:
                    salts[lang] = _salt(lang)
            yield langs[a:b], blobs[a:b], [salts[lang] for lang in langs[a:b]]


def _longer(codes: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Codes of phrases of ``size`` words from those of one word less, at each place that has room."""
    n = max(len(words) - size + 1, 0)
    return mix64(codes[:n] * np.uint64(3) + words[size - 1: size - 1 + n] * np.uint64(_BASE))


def _frequent_buckets(rows: DataFrame, buckets: int, least: int, words: int) -> np.ndarray:
    """Bits (packed) of a table of ``buckets`` for each length, from one word on:
    whether a bucket's phrases occur ``least`` times together."""
    mask = np.uint64(buckets - 1)
    most = min(least, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a count that reaches ``most`` in one task says all there is to know
        table = np.zeros(words * buckets, np.uint8)
        for _, blobs, salts in _texts(batches):
            _, _, _, codes, joins = words_of(blobs, salts)
            whole, grams = np.ones(len(codes), bool), codes
            for k in range(1, words + 1):
                if k > 1:
                    grams = _longer(grams, codes, k)
                    whole = whole[: len(grams)] & joins[k - 2: k - 2 + len(grams)]
                some, n = np.unique(grams[whole] & mask, return_counts=True)
                some = some.astype(np.int64) + (k - 1) * buckets
                table[some] = np.minimum(table[some] + n, most)
        for k in range(0, words * buckets, SLICE):
            part = table[k: k + SLICE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": [k // SLICE], "counts": [part.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(counts, np.uint8).astype(np.uint32)
                # sums beyond ``most`` are of no use, and stay there
                sums[k] = np.minimum(sums[k] + counts, most) if k in sums else counts
        for k, total in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": [k], "bits": [np.packbits(total >= most).tobytes()]})

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    tables = rows.mapInArrow(tidied(count), "slice long, counts binary").repartition(parts, "slice").mapInArrow(tidied(add), "slice long, bits binary")
    bits = np.zeros(words * buckets // 8, np.uint8)
    for row in tables.toLocalIterator():  # at most words * MOST_BUCKETS bits
        at = row.slice * SLICE // 8
        bits[at: at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return bits


def count_windows(rows: DataFrame, buckets: int, bits: np.ndarray, words: int = MOST_WORDS) -> DataFrame:
    """``lang, w1 .. wn, n``: counts of padded longest windows, added up within each task."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    mask = np.uint64(buckets - 1)
    names = [f"w{k}" for k in range(1, words + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def marked(grams: np.ndarray, size: int) -> np.ndarray:
            places = (grams & mask).astype(np.int64) + (size - 1) * buckets
            return (table[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)

        held: dict[tuple, int] = {}
        text_of: dict[int, str] = {}

        def close() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for a in range(0, len(rows), 20_000):
                some = rows[a: a + 20_000]
                cols = [[key[0] for key, _ in some]]
                cols += [[text_of[key[k]] if k < len(key) else None for key, _ in some] for k in range(1, words + 1)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array([n for _, n in some], pa.int64())], names=["lang", *names, "n"])
            held.clear()
            text_of.clear()

        for langs, blobs, salts in _texts(batches):
            joined, starts, ends, codes, joins = words_of(blobs, salts)
            if not len(codes):
                continue
            # length of the window at each word: it grows while its phrase, and that from its second word, may be frequent
            grams, often = codes, marked(codes, 1)
            length = often.astype(np.int64)
            for k in range(2, words + 1):
                grams = _longer(grams, codes, k)
                n = len(grams)
                at = np.flatnonzero(often[:n] & often[1: n + 1] & joins[k - 2: k - 2 + n])
                often = np.zeros(n, bool)
                often[at] = marked(grams[at], k)
                length[:n] += often
            # equal words get equal numbers in this slice
            _, first, number = np.unique(codes, return_index=True, return_inverse=True)
            base = len(first) + 1
            grid = np.zeros((len(codes), words), np.int64)
            for k in range(words):
                ok = length > k
                at = np.flatnonzero(ok)
                grid[at, k] = number[at + k] + 1
            at_lang = np.searchsorted(np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs]))), starts, "right") - 1
            lang_names = sorted(set(langs))
            lang_no = np.array([lang_names.index(x) for x in langs])[at_lang]
            # two columns of at most 2**62 each, as a slice has under 2**20 distinct words
            high = (lang_no * base + grid[:, 0]) * base + grid[:, 1]
            low = (grid[:, 2] * base + grid[:, 3]) * base + grid[:, 4] if words == 5 else np.zeros(len(codes), np.int64)
            order = np.lexsort((low, high))
            new = np.concatenate(([True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
            places = order[np.flatnonzero(new)]
            counts = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
            used = np.unique(grid[places])
            word_codes = codes[first]
            for no in used[used > 0].tolist():
                code = int(word_codes[no - 1])
                if code not in text_of:
                    text_of[code] = joined[starts[first[no - 1]]: ends[first[no - 1]]].decode("utf-8", "replace")
            code_list = [0, *word_codes.tolist()]
            for lang, size, row, n in zip(lang_no[places].tolist(), length[places].tolist(), grid[places].tolist(), counts.tolist()):
                key = (lang_names[lang], *[code_list[no] for no in row[:size]])
                held[key] = held.get(key, 0) + n
            if len(held) > HELD_WINDOWS:
                yield from close()
        yield from close()

    return rows.mapInArrow(tidied(run), ", ".join(["lang string", *(f"{w} string" for w in names), "n long"]))


def phrase_counts(windows: DataFrame, least: int, words: int = MOST_WORDS) -> DataFrame:
    """``lang, size, p (the words), f`` of every phrase of at least ``least``
    occurrences, and of each language as a whole (size 0), by one ROLLUP."""
    names = [f"w{k}" for k in range(1, words + 1)]
    spark = windows.sparkSession
    view = spark.sql(f"SELECT lang, {', '.join(names)}, sum(n) AS f, grouping_id() AS g FROM {{windows}} GROUP BY lang, ROLLUP ({', '.join(names)})", windows=windows)
    # the grouping id has a one for every column that is summed over
    size = sum((F.when(F.col("g") < 2 ** (words - k), 1).otherwise(0) for k in range(1, words + 1)), F.lit(0))
    last = F.coalesce(*[F.when(size == k, F.col(f"w{k}").isNotNull()) for k in range(1, words + 1)], F.lit(True))
    found = view.withColumns({"size": size, "whole": last}).where(F.col("whole") & ((F.col("f") >= least) | (F.col("size") == 0)))
    return found.select("lang", "size", F.filter(F.array(*names), lambda w: w.isNotNull()).alias("p"), "f")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(counts: DataFrame, percent: int = 100) -> DataFrame:
    """Candidates with their lowest-scoring cut, without those inside a longer
    candidate that has at least ``percent`` of their count."""
    phrases = checkpointed(counts)
    candidates = phrases.where("size >= 2").select("lang", "p", "size", F.col("f").alias("a"))
    totals = phrases.where("size = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))  # a row a language
    parts = phrases.where("size >= 1").select(F.col("lang").alias("_lang"), F.col("p").alias("_p"), F.col("f").alias("_f"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("k")), "right": F.slice("p", F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(parts.withColumnRenamed("_f", "l"), (F.col("lang") == F.col("_lang")) & (F.col("left") == F.col("_p"))).drop("_lang", "_p")
    cuts = cuts.join(parts.withColumnRenamed("_f", "r"), (F.col("lang") == F.col("_lang")) & (F.col("right") == F.col("_p"))).drop("_lang", "_p")
    if totals.count() <= FEW_LANGUAGES:
        totals = F.broadcast(totals)
    cuts = cuts.join(totals, F.col("lang") == F.col("_lang")).drop("_lang")
    top, below = _exact("a") * _exact("n") * F.lit(1000).cast("decimal(4,0)"), _exact("l") * _exact("r")
    cuts = cuts.withColumn("score", F.call_function("div", top, below))
    best = F.min_by(F.struct("score", "l", "r", "n", "a", "size"), F.struct("score", "k"))
    rated = cuts.groupBy("lang", "p").agg(best.alias("b")).select("lang", "p", "b.*")

    inner = candidates.where("size >= 3").select("lang", F.col("a").alias("f"), "p", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "f", "p", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.slice("p", F.col("at"), F.col("m")).alias("p")).agg(F.max("f").alias("inside"))
    return rated.join(inner, ["lang", "p"], "left").where(F.expr(f"inside IS NULL OR 100 * inside < {percent} * a")).drop("inside")


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of 2 to 5 words of each language: ``lang, rank, phrase,
    a, l, r, n, score``.

    Texts are lower-cased (A-Z) and cut in pieces at ``.,;:!?`` and line ends, and
    those in words at spaces and tabs; null text is empty, a null language is
    ``und`` (and counts with texts whose language is ``und``). Repeated rows count
    as often as they occur, whatever their ids, which are not read, nor are other
    columns. Ties are ordered by score, then count, then phrase, so a rank is
    unique. A language without candidates, or an empty table, has no rows."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = LEAST_BUCKETS
    while buckets < MOST_BUCKETS and buckets * BYTES_A_BUCKET < size:
        buckets *= 2
    # fewer, larger tasks add up more windows before the shuffle
    rows = rows.coalesce(max(3 * docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES + 1))
    windows = count_windows(rows, buckets, _frequent_buckets(rows, buckets, least, MOST_WORDS))
    rated = scored(phrase_counts(windows, least), percent).withColumn("phrase", F.array_join("p", " "))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rated.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


#: DuckDB, by counting all phrases of each length.
COLLOCATIONS_SQL = r"""
WITH piece AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
gram AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p FROM piece, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k >= 2),
cut AS (
  SELECT c.lang, c.p, c.a, l.f AS l, r.f AS r, n, cut_at, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut_at FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:cut_at], ' ')
  JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.w[cut_at + 1:], ' ')
  JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut_at) = 1),
inside AS (
  SELECT lang, p, max(a) AS f FROM (
    SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS p
    FROM cand, (SELECT unnest(range(2, 5)) AS m) WHERE m < k) GROUP BY lang, p),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.p = b.p WHERE i.f IS NULL OR 100 * i.f < 100 * b.a)
SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) WHERE rank <= 2000
"""
