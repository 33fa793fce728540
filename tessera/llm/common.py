"""Helpers shared by the operators: hashed word shingles over Arrow batches
and connected components by alternating stars."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[list(WORD_BREAKS)] = True
_BYTE_CODE = np.random.default_rng(20_240_601).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply), element-wise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _BASE_INV):
            table = np.ones(size, np.uint64)
            table[1:] = np.uint64(base)
            out.append(np.multiply.accumulate(table))
        _powers = (out[0], out[1])
    return _powers


def slices(blobs: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``limit`` bytes (one longer text alone)."""
    start, total = 0, 0
    for i, b in enumerate(blobs):
        if i > start and total + len(b) > limit:
            yield start, i
            start, total = i, 0
        total += len(b) + 1
    if start < len(blobs):
        yield start, len(blobs)


def word_codes(blobs: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, in order, and ``bounds`` so that
    text i has words ``bounds[i]:bounds[i + 1]``."""
    joined = b"\n".join(blobs) + b"\n"
    if lower:
        joined = joined.translate(LOWER)
    data = np.frombuffer(joined, np.uint8)
    word = ~_IS_BREAK[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the text ends with a break, so edges pair up
    up, down = _power_table(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=prefix[1:])
    codes = mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs])))
    return codes, np.searchsorted(starts, offsets)


def shingles(blobs: list[bytes], width: int, lower: bool = True) -> list[np.ndarray]:
    """For each text the 64-bit codes of its word shingles, by position. A text
    of fewer words than ``width`` has its whole sequence as the only shingle; a
    text without words has none."""
    codes, bounds = word_codes(blobs, lower)
    n = len(codes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            rolled += codes[j: n - width + 1 + j] * np.uint64(pow(_BASE, 2 * j + 3, 2**64))
        rolled = mix64(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                out.append(rolled[a: b - width + 1])
            elif b > a:
                short = sum((int(c) * pow(_BASE, 2 * j + 5, 2**64) for j, c in enumerate(codes[a:b])), b - a)
                out.append(mix64(np.array([short % 2**64], np.uint64)))
            else:
                out.append(rolled[:0])
    return out


def blobs_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def text_slices(batches: Iterable[pa.RecordBatch], id_col: str = "doc_id", text_col: str = "text",
                limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about ``limit`` bytes of text, with the texts as bytes."""
    for batch in batches:
        blobs = blobs_of(batch.column(text_col))
        for a, b in slices(blobs, limit):
            yield batch.slice(a, b - a), blobs[a:b]


def give_back() -> None:
    """Gives freed memory of this process back to the machine: Python workers are
    used again by later stages, beside which it would lie idle."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What operators keep in this process from task to task, by name.
stores: dict[str, dict] = {}


def tidied(run: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow: what other operators keep in the process is dropped
    at the start of each task, and free memory given back at its end."""
    def tidy(batches: Iterator) -> Iterator:
        for name, store in stores.items():
            if name != keeps:
                store.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` on the cluster's shared folder, with the lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table on the cluster's shared folder. Unlike a
    checkpoint it has its true size in the plans of further joins, where estimates
    multiply with each join."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of ``(a, b)`` long edges:
    one row ``(node, root)`` for each node that has an edge to another node,
    ``root`` being the smallest node of its component.

    Alternating large and small stars: each round is two aggregations and two
    joins over the edges, no group is gathered, and the number of rounds grows
    with the logarithm of the longest path. Every round is checkpointed.
    """
    cur = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.x).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low2, large.u == low2.x).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        cur = checkpointed(small.where("u <> v").distinct())
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
