"""Nearest neighbours by a block matrix join over int8 tiles.

Queries and rows are dealt into blocks; a tile is one block of queries against
one block of rows. In a tile, vectors are rounded to int8 with a scale each, and
one matrix product gives all rounded distances. The rounding error of each
vector is known, so a distance lies within the two errors of the rounded one;
only pairs whose lower bound is within the k-th upper bound seen so far are
computed again, in double precision, and pushed on the query's heap. The k best
of all tiles are merged. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries held by one tile, and rows dealt to one block.
QUERY_BLOCK = 16_384
ROW_BLOCK = 16_384
#: Rows and queries of one matrix product.
STRIP, QUERY_STRIP = 1024, 1024


def usable(vector: str = "embedding") -> Column:
    """Neither null, empty or all zero, nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, for exact products up to 1,040 dimensions at a
    time), scales, squared norms of the rounded vectors, and rounding errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None])
    rounded = codes * scale[:, None]
    return codes.astype(np.int8), scale, (rounded ** 2).sum(axis=1), np.sqrt(((x - rounded) ** 2).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], 1024):  # sums below 2 ** 24 are exact in float32
        out += a[:, d: d + 1024].astype(np.float32) @ b[:, d: d + 1024].astype(np.float32).T
    return out


class Tile:
    """A block of queries with a heap of the k nearest each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes, self.scale, self.square, self.error = quantise(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-distance, -id): the worst on top
        self.bound = np.full(len(ids), np.inf)  # the k-th distance so far

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        codes, scale, square, error = quantise(vectors)
        for a in range(0, len(self.ids), QUERY_STRIP):
            q = slice(a, a + QUERY_STRIP)
            dots = int8_products(self.codes[q], codes) * self.scale[q, None] * scale[None, :]
            rounded = np.sqrt(np.maximum(self.square[q, None] + square[None, :] - 2 * dots, 0))
            slack = self.error[q, None] + error[None, :] + 1e-9 * (1 + rounded)
            same = self.ids[q, None] == ids[None, :]
            upper = np.where(same, np.inf, rounded + slack)
            bound = self.bound[q]
            if upper.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
            survive = (rounded - slack <= bound[:, None]) & ~same
            at, row = np.nonzero(survive)
            for c in range(0, len(at), 65_536):
                i, j = at[c: c + 65_536] + a, row[c: c + 65_536]
                exact = np.sqrt(((self.vectors[i] - vectors[j]) ** 2).sum(axis=1))
                for qi, d, r in zip(i.tolist(), exact.tolist(), ids[j].tolist()):
                    heap = self.heaps[qi]
                    if len(heap) < self.k:
                        heapq.heappush(heap, (-d, -r))
                    elif (-d, -r) > heap[0]:
                        heapq.heapreplace(heap, (-d, -r))
            for qi in np.unique(at).tolist():
                if len(self.heaps[qi + a]) == self.k:
                    self.bound[qi + a] = -self.heaps[qi + a][0][0]

    def rows(self) -> tuple[list[int], list[int], list[float]]:
        flat = [(int(q), -r, -d) for q, heap in zip(self.ids, self.heaps) for d, r in heap]
        return tuple(list(x) for x in zip(*flat)) if flat else ([], [], [])


def _tiles(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (dim, qb, rb, role): the queries of a tile, then its rows in strips."""
        key, tile, ids, vectors = None, None, [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if tile is not None:
                q, r, d = tile.rows()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(d, pa.float64())], schema=schema)

        for batch in batches:
            cols = np.stack([batch.column(c).to_numpy() for c in ("dim", "qb", "rb", "role")], axis=1)
            cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cols)]):
                if a == b:
                    continue
                dim, role = int(cols[a, 0]), int(cols[a, 3])
                if tuple(cols[a, :3]) != key:
                    yield from finish()
                    key, tile, ids, vectors = tuple(cols[a, :3]), None, [], []
                part = batch.slice(a, b - a)
                x, i = matrix(part.column("embedding"), dim), part.column("vec_id").to_numpy()
                if role == 0:
                    ids.append(i)
                    vectors.append(x)
                    continue
                if tile is None and ids:
                    tile = Tile(np.concatenate(ids), np.concatenate(vectors), k)
                    ids, vectors = [], []
                for s in range(0, len(x) if tile is not None else 0, STRIP):
                    tile.add(i[s: s + STRIP], x[s: s + STRIP])
        yield from finish()

    return run, "query_id long, vec_id long, score double"


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` rows nearest to each query by Euclidean distance:
    ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id.
    A query's own id is no candidate; with fewer than ``k`` candidates all are
    returned, with none the query has no row.

    Queries are copied to each block of rows and rows to each block of queries,
    so a tile's size is bounded whatever the tables hold. Vectors that are null,
    zero or hold null or non-finite components take no part; vectors of
    different lengths are never compared. Rows that repeat an id are one
    candidate each; a repeated query id is one query. Null ids take no part.
    """
    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
            .where(usable()).where("vec_id IS NOT NULL").withColumn("dim", F.size("embedding"))

    q, r = ready(queries).dropDuplicates(["vec_id"]), ready(rows)
    count = r.count(), q.count()
    row_blocks, query_blocks = (max(1, -(-n // b)) for n, b in zip(count, (ROW_BLOCK, QUERY_BLOCK)))

    def block(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = q.withColumn("qb", block("q", query_blocks)).withColumn("rb", every(row_blocks)).withColumn("role", F.lit(0))
    right = r.withColumn("rb", block("r", row_blocks)).withColumn("qb", every(query_blocks)).withColumn("role", F.lit(1))
    order = ["dim", "qb", "rb", "role"]
    run, schema = _tiles(k)
    best = left.select(*order, "vec_id", "embedding").unionByName(right.select(*order, "vec_id", "embedding")) \
        .repartition("dim", "qb", "rb").sortWithinPartitions(*order).mapInArrow(run, schema)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ANN_SQL = """
WITH ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_distance(q.e, r.e) AS score
  FROM ok q JOIN ok r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
