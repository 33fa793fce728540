"""Embedding near-dedup by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves. Each half has a codebook
(k-means on a bounded sample), and the pair of nearest centroids is a vector's
home cell in the product grid. A vector visits cells in the order of the sum of
its two centroid distances, by the multi-sequence algorithm, as many as reach
the target recall: on sampled vectors, the home of a copy turned by exactly the
threshold angle must be among the visited cells often enough. Pairs that meet in
a cell are verified by cosine in double precision.

A pair is looked at in one place only: the smaller of its two home cells. So a
vector visits only cells up to its own home, and links are counted exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ann import matrix, usable
from tessera.llm.common import checkpointed, components

#: Vectors of the sample that codebooks and the number of visits are fitted on.
SAMPLE = 8192
#: Vectors that a cell of one label holds on average; sets the codebook size.
PER_CELL = 128
#: Vector lengths, the most frequent ones, that get a grid of their own; vectors
#: of any other length are all in one cell of their label and compared completely.
GRIDS = 64
#: Home vectors of one task; larger cells are cut into parts.
PART = 2048


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by the largest component so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = half_distances(x, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (mine := x[at == c]).size:
                centres[c] = mine.mean(axis=0)
    return centres


def half_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1)[None, :] - 2 * x @ centres.T, 0)


class Grid:
    """Two codebooks and the number of cells that a vector visits."""

    def __init__(self, sample: np.ndarray, cells_wanted: float, cosine: float, recall: float, seed: int = 9):
        self.half = sample.shape[1] // 2
        k = max(1, min(round(cells_wanted ** 0.5), len(sample) // 8))
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half:], k)]
        rng = np.random.default_rng(seed)
        x = sample[rng.permutation(len(sample))[:1000]]
        turn = rng.normal(size=x.shape)
        turn -= (turn * x).sum(axis=1, keepdims=True) * x
        norm = np.sqrt((turn ** 2).sum(axis=1, keepdims=True))
        turned = cosine * x + (1 - cosine ** 2) ** 0.5 * turn / np.where(norm == 0, 1, norm)
        home, target = self.homes(x), self.homes(turned)
        # a pair meets when the vector with the larger home visits the smaller home
        ranks = []
        for vector, other, a, b in zip(x, turned, home, target):
            visitor, cell = (vector, b) if b <= a else (other, a)
            ranks.append(self.sequence(visitor, len(self.books[0]) * len(self.books[1])).index(cell) + 1)
        self.visits = int(np.quantile(ranks, recall, method="higher")) if ranks else 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return half_distances(x[:, : self.half], self.books[0]), half_distances(x[:, self.half:], self.books[1])

    def homes(self, x: np.ndarray) -> list[int]:
        a, b = self.distances(x)
        return (a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)).tolist()

    def sequence(self, vector: np.ndarray, n: int) -> list[int]:
        """The ``n`` nearest cells, by the multi-sequence algorithm."""
        a, b = self.distances(vector[None, :])
        return multi_sequence(a[0], b[0], n)

    def visited(self, x: np.ndarray) -> tuple[list[int], list[list[int]]]:
        """Home cells, and the visited cells that do not lie behind them."""
        a, b = self.distances(x)
        homes = (a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)).tolist()
        return homes, [[c for c in dict.fromkeys([h, *multi_sequence(p, q, self.visits)]) if c <= h] for h, p, q in zip(homes, a, b)]


def multi_sequence(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Cells (i, j), as i * len(b) + j, by increasing a[i] + b[j]: a heap holds
    the border of the cells taken, in the two sorted orders."""
    first, second = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    heap, out, seen = [(a[first[0]] + b[second[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append(first[i] * len(b) + second[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(first) and q < len(second) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[first[p]] + b[second[q]], p, q))
    return out


def _visits(grids: dict[int, Grid]):
    schema = pa.schema([("dim", pa.int32()), ("label", pa.string()), ("cell", pa.int64()), ("home", pa.int64()), ("vec_id", pa.int64()),
                        ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for a in range(0, len(part), 512):
                    some = part.slice(a, 512)
                    x = unit(matrix(some.column("embedding"), dim))
                    homes, cells = grids[dim].visited(x) if dim in grids else ([0] * len(x), [[0]] * len(x))
                    at = np.repeat(np.arange(len(homes)), [len(c) for c in cells])
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("dim").take(take), some.column("label").take(take), pa.array([c for cs in cells for c in cs], pa.int64()),
                         pa.array(np.array(homes, np.int64)[at]), some.column("vec_id").take(take), some.column("embedding").take(take)], schema=schema)

    return run, "dim int, label string, cell long, home long, vec_id long, embedding array<double>"


def _meet(cosine: float):
    """Rows sorted by (dim, label, cell, part, visitor): the part's home vectors
    first, then all vectors that meet them, in strips."""
    schema = pa.schema([("vec_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, state = None, [], [], None

        def finish() -> Iterator[pa.RecordBatch]:
            if state is not None:
                home, links, parent = state["ids"], state["links"], state["parent"]
                hit = np.flatnonzero(links).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(home[hit]), pa.array(home[[_root(parent, i) for i in hit]]), pa.array(links[hit])], schema=schema)

        for batch in batches:
            names = ("dim", "label", "cell", "part", "visitor")
            rows = list(zip(*[batch.column(c).to_pylist() for c in names]))
            cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                if a == b:
                    continue
                if rows[a][:4] != key:
                    yield from finish()
                    key, ids, vectors, state = rows[a][:4], [], [], None
                some = batch.slice(a, b - a)
                x, i = unit(matrix(some.column("embedding"), key[0])), some.column("vec_id").to_numpy()
                homes = some.column("home").to_numpy()
                if rows[a][4] == 0:
                    ids.append(i)
                    vectors.append(x)
                    continue
                if state is None and ids:
                    home = np.concatenate(ids)
                    state = {"ids": home, "x": np.concatenate(vectors), "links": np.zeros(len(home), np.int64), "parent": list(range(len(home)))}
                    ids, vectors = [], []
                for s in range(0, len(x) if state is not None else 0, 512):
                    out = _link(state, x[s: s + 512], i[s: s + 512], homes[s: s + 512] == key[2], cosine)
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=schema)
        yield from finish()

    return run, "vec_id long, root long, links long"


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _link(state: dict, x: np.ndarray, ids: np.ndarray, here: np.ndarray, cosine: float):
    """Links of visitors to the part's home vectors. Two vectors at home here
    count once: the larger id is the visitor."""
    close = x @ state["x"].T >= cosine
    close &= np.where(here[:, None], ids[:, None] > state["ids"][None, :], ids[:, None] != state["ids"][None, :])
    state["links"] += close.sum(axis=0)
    links = close.sum(axis=1)
    hit = np.flatnonzero(links)
    if not len(hit):
        return None
    roots = []
    for v in hit.tolist():
        linked = np.flatnonzero(close[v])
        first = _root(state["parent"], int(linked[0]))
        for h in linked[1:].tolist():
            other = _root(state["parent"], h)
            if other != first:
                state["parent"][max(first, other)] = min(first, other)
                first = min(first, other)
        roots.append(first)
    return ids[hit], state["ids"][roots], links[hit].astype(np.int64)


def near_duplicates(rows: DataFrame, cosine: float = 0.98, recall: float = 0.995) -> DataFrame:
    """Links vectors of one non-null label whose cosine reaches ``cosine``, and
    returns one row per input row: ``vec_id, n_links, component_id, kept``.

    ``recall`` is the share of pairs at exactly the threshold that the visited
    cells must hold; closer pairs are found more often. No pair below the
    threshold is linked. Vectors that are null, zero or hold null or non-finite
    components, and rows without a label or id, link with nothing (a null id has
    a null component and ``kept`` false). Vectors of different lengths are never
    compared; there may be any number of lengths. Rows that repeat an id count as one vector (the first by value).
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    ready = base.where(usable()).where("vec_id IS NOT NULL AND label IS NOT NULL") \
        .select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    ready = checkpointed(ready.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
                         .select("vec_id", "v.label", "v.embedding", F.size("v.embedding").alias("dim")))
    shapes = ready.groupBy("dim").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")) \
        .orderBy(F.desc("n"), "dim").limit(GRIDS).collect()
    grids = {}
    for shape in shapes:
        # hashes below a bound that about two samples stay under, so that partitions do not each send a whole one
        bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * SAMPLE // shape["n"])
        sample = ready.where((F.col("dim") == shape["dim"]) & (F.xxhash64("vec_id") <= F.lit(bound))) \
            .orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
        x = unit(np.array([r[0] for r in sample], np.float64))
        grids[shape["dim"]] = Grid(x, shape["n"] / shape["labels"] / PER_CELL, cosine, recall)
    run, schema = _visits(grids)
    visits = ready.mapInArrow(run, schema)
    key = ["dim", "label", "cell"]
    sizes = visits.where("home = cell").groupBy(*key).agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    visits = visits.join(sizes, key)
    at_home = visits.where("home = cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("visitor", F.lit(0))
    visiting = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("visitor", F.lit(1))
    order = [*key, "part", "visitor"]
    both = at_home.select(*order, "home", "vec_id", "embedding").unionByName(visiting.select(*order, "home", "vec_id", "embedding"))
    run, schema = _meet(cosine)
    found = checkpointed(both.repartition(*key, "part").sortWithinPartitions(*order).mapInArrow(run, schema))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    return base.select("vec_id").join(links, "vec_id", "left").join(roots, F.col("vec_id") == F.col("node"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"))
