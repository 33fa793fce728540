"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a fixed-length window,
each filter keeps its maximum over the window, and a softmax layer gives the
languages. The network is trained here, in numpy, on a bounded sample of
labelled documents: one window of each, cut at a place that a hash chooses. A
whole text is cut into consecutive windows; all of them are scored in batches
and their log-probabilities are averaged by the number of bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blobs_of, slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class ByteCnn:
    """Trained weights. ``filters`` holds all widths, zero-padded to the widest."""
    languages: list[str]
    window: int
    embedding: np.ndarray  # 256 x dim
    filters: np.ndarray    # (widest * dim) x filters
    bias: np.ndarray
    out: np.ndarray        # filters x languages
    out_bias: np.ndarray

    @property
    def widest(self) -> int:
        return self.filters.shape[0] // self.embedding.shape[1]

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows x positions) x (widest * dim) matrix of embedded bytes."""
        dim = self.embedding.shape[1]
        padded = np.zeros((len(windows), self.window + self.widest - 1), np.uint8)
        padded[:, : self.window] = windows
        flat = self.embedding[padded].reshape(len(windows), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, self.widest * dim, axis=1)[:, ::dim]
        return view.reshape(-1, self.widest * dim)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = (self.patches(windows) @ self.filters).reshape(len(windows), self.window, -1)
        z = np.maximum(scores.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut_windows(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive zero-padded windows of all texts, their text and their number of bytes."""
    counts = np.array([-(-len(b) // window) for b in blobs], np.int64)
    data = np.frombuffer(b"".join(b.ljust(c * window, b"\0") for b, c in zip(blobs, counts.tolist())), np.uint8)
    owner = np.repeat(np.arange(len(blobs)), counts)
    size = np.full(len(owner), window, np.int64)
    some = counts > 0
    last = np.cumsum(counts)[some] - 1
    size[last] = np.array([len(b) for b in blobs], np.int64)[some] - (counts[some] - 1) * window
    return data.reshape(-1, window), owner, size


def train(texts: list[bytes], labels: list[str], window: int = 160, widths: tuple[int, ...] = (2, 3, 4, 5), per_width: int = 8,
          dim: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteCnn:
    """Adam on cross-entropy; classes are weighted to count alike. A third of the
    windows of each pass is cut short, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = np.zeros((len(texts), window), np.uint8)
    for i, t in enumerate(texts):
        x[i, : min(len(t), window)] = np.frombuffer(t[:window], np.uint8)
    widest, total = max(widths), per_width * len(widths)
    mask = np.zeros((widest, dim, total), np.float32)
    for k, w in enumerate(widths):
        mask[:w, :, k * per_width: (k + 1) * per_width] = 1
    mask = mask.reshape(widest * dim, total)
    p = {
        "embedding": rng.normal(0, 0.5, (256, dim)).astype(np.float32),
        "filters": (rng.normal(0, 0.3, (widest * dim, total)) * mask).astype(np.float32),
        "bias": np.zeros(total, np.float32),
        "out": rng.normal(0, 0.3, (total, len(languages))).astype(np.float32),
        "out_bias": np.zeros(len(languages), np.float32)}
    p["embedding"][0] = 0
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    weight = len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            rows = order[a: a + batch]
            xb = x[rows].copy()
            short = rng.random(len(rows)) < 0.33
            cut = rng.integers(12, window, len(rows))
            xb[short[:, None] & (np.arange(window)[None, :] >= cut[:, None])] = 0
            net = ByteCnn(languages, window, **p)
            patches = net.patches(xb)
            conv = (patches @ p["filters"]).reshape(len(rows), window, -1)
            place = conv.argmax(axis=1)
            pooled = np.take_along_axis(conv, place[:, None, :], axis=1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            z = hidden @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            dz[np.arange(len(rows)), y[rows]] -= 1
            dz = (dz * (weight[y[rows]] / len(rows))[:, None]).astype(np.float32)
            dh = (dz @ p["out"].T) * (pooled > 0)
            # only the winning place of each filter passes a gradient
            at = (np.arange(len(rows))[:, None] * window + place).ravel()
            column = np.tile(np.arange(total), len(rows))
            won = patches[at]
            g_filters = np.zeros_like(p["filters"])
            np.add.at(g_filters.T, column, won * dh.ravel()[:, None])
            d_patch = (p["filters"].T[column] * dh.ravel()[:, None]).reshape(-1, widest, dim)
            padded = np.zeros((len(rows), window + widest - 1), np.uint8)
            padded[:, :window] = xb
            row, col = at // window, at % window
            g_embedding = np.zeros_like(p["embedding"])
            for j in range(widest):
                np.add.at(g_embedding, padded[row, col + j], d_patch[:, j])
            g_embedding[0] = 0
            grads = {"embedding": g_embedding, "filters": g_filters * mask, "bias": dh.sum(axis=0),
                     "out": hidden.T @ dz, "out_bias": dz.sum(axis=0)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return ByteCnn(languages, window, **p)


def training_sample(labelled: DataFrame, per_language: int, window: int) -> list[tuple[bytes, str]]:
    """About ``per_language`` windows of each language (a bound on the sample):
    one window per chosen document, at a place that a hash chooses. ``labelled``
    has doc_id, text and lang. Small languages are taken whole."""
    rows = labelled.where("lang IS NOT NULL AND length(text) > 0")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(256).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.length("text") - window // 2, F.lit(1))).cast("int") + 1
    taken = rows.where(draw < share[F.col("lang")]).select("doc_id", "lang", F.substring("text", place, F.lit(window)).alias("cut"))
    taken = taken.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "cut").limit(2 * per_language * len(counts))
    return [(r["cut"].encode(), r["lang"]) for r in taken.collect()]


def _predictor(net: ByteCnn | None, keep: list[str]):
    def predict(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        windows, owner, size = cut_windows(blobs, net.window)
        sums = np.zeros((len(blobs), len(net.languages)))
        for a in range(0, len(windows), 128):
            logs = net.log_probabilities(windows[a: a + 128])
            np.add.at(sums, owner[a: a + 128], logs * size[a: a + 128, None])
        sums /= np.maximum(np.array([len(b) for b in blobs]), 1)[:, None]
        z = np.exp(sums - sums.max(axis=1, keepdims=True))
        return sums.argmax(axis=1), (z / z.sum(axis=1, keepdims=True)).max(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, lettered = blobs_of(batch.column("text")), batch.column("_lettered").to_numpy(zero_copy_only=False)
            for a, b in slices(blobs):
                best, score = [UNDETERMINED] * (b - a), np.zeros(b - a)
                rows = [i for i in range(a, b) if lettered[i]] if net else []
                if rows:
                    at, top = predict([blobs[i] for i in rows])
                    for i, k, s in zip(rows, at, top):
                        best[i - a], score[i - a] = net.languages[k], s
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(best), pa.array(score)],
                                                 names=[*keep, "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, labelled: DataFrame, per_language: int = 1200, window: int = 160,
                      columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (default doc_id) with ``lang_pred`` and ``score``
    (0 to 1). ``labelled`` (doc_id, text, lang) is all that is learned from;
    only ``text`` of docs is an input of a prediction. The sample is bounded by
    ``2 * per_language`` windows a language, and 256 languages.

    - null text, or text without a letter: ``und``, score 0;
    - no labelled row: ``und`` for all; one language: that language;
    - repeated rows get equal results; an empty table gives an empty result;
    - input columns named lang_pred or score are replaced.
    """
    sample = training_sample(labelled.select("doc_id", "text", "lang"), per_language, window)
    net = train([t for t, _ in sample], [x for _, x in sample], window=window) if sample else None
    keep = [c for c in (columns or ["doc_id"]) if c not in ("lang_pred", "score")]
    lettered: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_lettered", lettered)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(_predictor(net, keep), f"{fields}, lang_pred string, score double")
