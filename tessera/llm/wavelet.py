"""Token ids in wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents. Its wavelet matrix has a bit plane
for each bit of the ids, the highest first: plane k holds bit k of the ids in the
order in which the planes above have left them, and each plane sorts them stably
by its bit (zeros first). Planes are cut in blocks, each compressed on its own,
with the number of ones before it, so that one id, the count of an id in a range,
and the place of its j-th occurrence are read from one block a plane:

- ``access(i)``: follow i down the planes by rank;
- ``rank(id, i)``: how often the id occurs before i;
- ``select(id, j)``: where its j-th occurrence is, back up the planes.

File: the magic, the header's length, the zstd-compressed header (numbers as JSON;
document ids, their null flags and token counts, zeros of each plane, and sizes and
ones of the blocks as little-endian arrays), then the blocks. All offsets follow
from the sizes.

``write_token_shards`` deals documents to tasks by ranges of their id, encodes them
with a public tokenizer and writes one file for every so many tokens, under a name
of its own for each attempt of a task; the manifest, which Spark writes, names the
files that count. ``read_token_shards`` gives the documents back from the files.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stores, tidied
from tessera.session import ensure_checkpoint_dir

MAGIC = b"WVM1"
#: Bits of a block of a plane.
BLOCK_BITS = 1 << 17
#: Tokens of a shard: a file ends with the document that reaches them.
SHARD_TOKENS = 2 << 20
#: Bytes of encoded parts kept in a task's Python process, about.
KEPT_BYTES = 160 << 20
#: Characters encoded at a time.
CHARS = 1 << 20
END_ID = 0
TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Place of a public tokenizer's file, on driver and executors alike."""
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


# ------------------------------------------------------------------ wavelet matrix

def _pack(bits: np.ndarray, blocks: list[bytes], ones: list[int]) -> None:
    """Adds a plane's compressed blocks, and the ones in each."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for a in range(0, len(bits), BLOCK_BITS):
        part = bits[a: a + BLOCK_BITS]
        blocks.append(squeeze.compress(np.packbits(part).tobytes()))
        ones.append(int(np.count_nonzero(part)))


def pack_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: ``ids`` of its documents end to end."""
    width = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    seq = ids.astype(np.uint16 if width <= 16 else np.uint32)
    zeros = []
    blocks, ones = [], []
    for k in range(width - 1, -1, -1):
        bits = (seq & seq.dtype.type(1 << k)) != 0
        _pack(bits, blocks, ones)
        zeros.append(len(seq) - int(np.count_nonzero(bits)))
        if k:
            sorted_seq = np.empty_like(seq)
            np.compress(~bits, seq, out=sorted_seq[: zeros[-1]])
            np.compress(bits, seq, out=sorted_seq[zeros[-1]:])
            seq = sorted_seq
    names = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    arrays = [names, nulls, np.array(lengths, np.int64), np.array(zeros, np.int64), np.array([len(b) for b in blocks], np.int64), np.array(ones, np.int64)]
    numbers = json.dumps({"tokens": len(ids), "width": width, "docs": len(names), "block": BLOCK_BITS}).encode()
    head = zstandard.ZstdCompressor(level=3).compress(
        len(numbers).to_bytes(4, "little") + numbers + b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays))
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *blocks])


class WaveletShard:
    """A shard's file, read through ``source``, a seekable binary file: the header
    at once, blocks as they are asked for."""

    def __init__(self, source):
        self.source = source
        if source.read(4) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(source.read(8), "little")
        raw = zstandard.ZstdDecompressor().decompress(source.read(size))
        cut = 4 + int.from_bytes(raw[:4], "little")
        numbers = json.loads(raw[4:cut])
        self.tokens, self.width, self.docs, self.block = (numbers[k] for k in ("tokens", "width", "docs", "block"))
        self.per_plane = -(-self.tokens // self.block)

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal cut
            out = np.frombuffer(raw, dtype, n, cut)
            cut += out.nbytes
            return out
        names, nulls = take("<i8", self.docs), take("<u1", self.docs)
        self.doc_ids = [None if null else int(i) for i, null in zip(names, nulls)]
        self.lengths = take("<i8", self.docs)
        self.zeros = take("<i8", self.width)
        sizes, ones = (take("<i8", self.width * self.per_plane) for _ in "ab")
        self.offsets = 12 + size + np.concatenate(([0], np.cumsum(sizes)))
        # ones before each block of its plane
        before = ones.reshape(self.width, self.per_plane)
        self.before = np.concatenate((np.zeros((self.width, 1), np.int64), np.cumsum(before, axis=1)), axis=1)
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, plane: int, block: int) -> np.ndarray:
        """Bits of one block; the last blocks read stay in memory, one a plane."""
        found = self._kept.get((plane, block))
        if found is None:
            at = plane * self.per_plane + block
            self.source.seek(int(self.offsets[at]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.offsets[at + 1] - self.offsets[at])))
            found = np.unpackbits(np.frombuffer(raw, np.uint8), count=min(self.block, self.tokens - block * self.block))
            for key in [k for k in self._kept if k[0] == plane]:
                del self._kept[key]
            self._kept[plane, block] = found
        return found

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        block, rest = divmod(i, self.block)
        return int(self.before[plane, block]) + (int(np.count_nonzero(self._bits(plane, block)[:rest])) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k in range(self.width):
            block, rest = divmod(i, self.block)
            bit, ones = int(self._bits(k, block)[rest]), self._ones(k, i)
            value = value << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the ids of places lo to hi that equal ``token`` stand below the last plane."""
        if token < 0 or token >> self.width:
            return 0, 0
        for k in range(self.width):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if token >> (self.width - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before place i."""
        lo, hi = self._range(token, 0, min(max(i, 0), self.tokens))
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` occurs in places lo to hi (end exclusive)."""
        hi = self.tokens if hi is None else min(hi, self.tokens)
        first, last = self._range(token, min(max(lo, 0), hi), hi)
        return last - first

    def select(self, token: int, j: int) -> int:
        """Place of the j-th occurrence of ``token``, from 0; IndexError if there are fewer."""
        lo, hi = self._range(token, 0, self.tokens)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        at = lo + j
        for k in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - k) & 1
            at = self._select(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th one (or zero) of a plane."""
        ones = self.before[plane]
        held = ones if bit else np.minimum(np.arange(len(ones)) * self.block, self.tokens) - ones
        block = int(np.searchsorted(held, j, "right")) - 1
        return block * self.block + int(np.flatnonzero(self._bits(plane, block) == bit)[j - int(held[block])])

    def all_tokens(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        seq = np.zeros(self.tokens, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            bits = np.concatenate([self._bits(k, b) for b in range(self.per_plane)]).view(bool) if self.per_plane else np.zeros(0, bool)
            above = np.empty_like(seq)
            zeros = int(self.zeros[k])
            above[np.flatnonzero(~bits)] = seq[:zeros]
            above[np.flatnonzero(bits)] = seq[zeros:] | seq.dtype.type(1 << (self.width - 1 - k))
            seq = above
        return seq


# ------------------------------------------------------------------ encoding

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


class WordEncoder:
    """Encodes whole texts through a store of encoded parts.

    A text is cut before white space (space, tab, line ends) that follows another
    character, and between a word of Latin letters and the stops ``.,;:!?`` beside
    it. A byte-level pre-tokenizer, whose words are white space and then letters,
    digits or other characters, splits at all these places whatever surrounds
    them, and white space stays with what follows it, so the ids of the parts, end
    to end, are those of the text. A text with other kinds of white space, on
    which libraries differ, is encoded whole.
    """

    _part = re.compile(rf"[ \n\t\r]*[{_LETTERS}]+(?=[.,;:!? \n\t\r]|\Z)|[.,;:!?]+(?=[{_LETTERS} \n\t\r]|\Z)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
    _odd_space = re.compile(r"[^\S \n\t\r]")
    _odd_ascii = re.compile(r"[\x0b\x0c\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.room = KEPT_BYTES

    def _ids(self, texts: list[str]) -> list[bytes]:
        # 4-byte machine integers, swapped on big-endian machines
        if sys.byteorder != "little" or array("I").itemsize != 4:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str]:
        if (self._odd_ascii if text.isascii() else self._odd_space).search(text):
            return [text]
        return self._part.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        kept, cut, fresh = self.kept, [], {}
        for text in texts:
            parts = self._parts(text)
            found = list(map(kept.get, parts))
            gaps = [i for i, ids in enumerate(found) if ids is None]
            fresh.update(dict.fromkeys([parts[i] for i in gaps]))
            cut.append((found, [(i, parts[i]) for i in gaps]))
        words = list(fresh)
        made = {w: ids for a in range(0, len(words), 4_096) for w, ids in zip(words[a: a + 4_096], self._ids(words[a: a + 4_096]))}
        for found, gaps in cut:
            for i, part in gaps:
                found[i] = made[part]
        if self.room > 0:
            kept.update(made)
            self.room -= sum(map(len, made)) + sum(map(len, made.values())) + 200 * len(made)
        return [b"".join(found) for found, _ in cut]


def encoder(path: str) -> WordEncoder:
    """The process's encoder; its store lasts from task to task of this operator."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    encoders = stores.setdefault("wavelet", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


# ------------------------------------------------------------------ shards

def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by URI or path."""
    return pafs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (pafs.LocalFileSystem(), folder)


def _write(folder: str, name: str, body: bytes) -> None:
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(body)


def write_token_shards(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                       shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Encodes every text, ends each document with ``end_id`` and writes the shards
    in ascending id order to ``folder`` (a URI or path that all executors reach).
    Returns the manifest, a row per file that counts: ``part``, ``seq``, ``file``,
    ``docs``, ``tokens``, ``start`` (ids of all files before it); it lies in the
    folder too.

    Null text is empty, an empty text has the end id only. Null ids come first;
    documents of equal id are ordered by their text's hash, equal rows are
    documents of their own. A document is never split over files. An empty table
    gives no files. Other columns are not read."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["id", "_hash", "_m"]
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_m": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    run_id = uuid.uuid4().hex
    files = f"{folder.rstrip('/')}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        words, attempt, part = encoder(path), uuid.uuid4().hex[:12], TaskContext.get().partitionId()
        ends = int(end_id).to_bytes(4, "little")
        held, ids, lengths, tokens, seq = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{run_id}-{part:06d}-{seq:06d}-{attempt}.wvm"
            _write(files, name, pack_shard(np.frombuffer(b"".join(held), "<u4"), ids, lengths))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "docs": [len(ids)], "tokens": [tokens]},
                                             schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            held.clear(), ids.clear(), lengths.clear()
            return row
        for batch in batches:
            names, texts, a = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while a < len(texts):
                b, chars = a + 1, len(texts[a])
                while b < len(texts) and chars + len(texts[b]) <= CHARS:
                    chars += len(texts[b])
                    b += 1
                for name, body in zip(names[a:b], words.encode(texts[a:b])):
                    held += (body, ends)
                    ids.append(name)
                    lengths.append(len(body) // 4 + 1)
                    tokens += lengths[-1]
                    if tokens >= shard_tokens:
                        yield close()
                        tokens, seq = 0, seq + 1
                a = b
        if ids:
            yield close()

    made = rows.select("id", "text").mapInArrow(tidied(write, "wavelet"), "part long, seq long, file string, docs long, tokens long")
    made.write.parquet(f"{folder.rstrip('/')}/files")
    made = spark.read.schema(made.schema).parquet(f"{folder.rstrip('/')}/files")
    # files before it in its part, and all parts before: one row a part in the second window
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = made.groupBy("part").agg(F.sum("tokens").alias("_sum"))
    before = sums.select(F.col("part").alias("_p"), F.coalesce(F.sum("_sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    manifest = made.withColumn("_in", inside).join(before, F.col("part") == F.col("_p")).select(*made.columns, (F.col("_in") + F.col("_before")).alias("start"))
    manifest.write.parquet(f"{folder.rstrip('/')}/manifest")
    return manifest_of(spark, folder)


MANIFEST = "part long, seq long, file string, docs long, tokens long, start long"


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def _over_files(spark: SparkSession, folder: str, fill, schema: str) -> DataFrame:
    """Rows that ``fill(shard, start)`` makes of each file that the manifest names."""
    files = f"{folder.rstrip('/')}/shards"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(files)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{path}/{name}") as source:
                    yield fill(WaveletShard(source), start)

    return manifest_of(spark, folder).select("file", "start").repartition(parts, "file").mapInArrow(tidied(run), schema)


def read_token_shards(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from the files: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) and, if
    asked for, ``ids``."""
    def fill(shard: WaveletShard, start: int) -> pa.RecordBatch:
        ids = shard.all_tokens()
        ends = np.cumsum(shard.lengths)
        starts = ends - shard.lengths
        crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist())]
        out = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + start, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return _over_files(spark, folder, fill, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``token``, ``n``: how often each of the asked ids occurs in all shards, by rank alone."""
    def fill(shard: WaveletShard, start: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _over_files(spark, folder, fill, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``doc_id``, ``place`` of every occurrence of an id (place: among all ids), by select."""
    def fill(shard: WaveletShard, start: int) -> pa.RecordBatch:
        at = np.array([shard.select(token, j) for j in range(shard.count(token))], np.int64)
        owner = np.searchsorted(np.cumsum(shard.lengths), at, "right")
        return pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[i] for i in owner], pa.int64()), pa.array(at + start, pa.int64())], names=["doc_id", "place"])

    return _over_files(spark, folder, fill, "doc_id long, place long")


def encode_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards of ``docs`` to a new place in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_shards(docs, folder, path)
    return read_token_shards(spark, folder)
