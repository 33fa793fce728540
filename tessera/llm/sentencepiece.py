"""SentencePiece encoding and decoding with a shared-prefix Viterbi.

A text is marked (spaces become the space mark, one is put in front) and cut in
marked words: a run of marks with what follows up to the next mark. The distinct
words of a batch are sorted, which puts them in the order of a depth-first walk
of their trie, and the walk keeps a stack of forward states, one per character:
words that share a prefix share its states, so only new characters cost work.

For a unigram model a state is the best score of the prefix and its last piece.
For a BPE model (as ``piece_bpe_32k``) the encoding of every prefix is unique,
and a piece can end it if and only if it and the last piece of the prefix before
it would be left apart by the merges; a state is that last piece. The pieces are
read back from the last state to the first. Characters that no piece holds
become byte pieces. The results equal those of the sentencepiece library, which
is used to read the model file only.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stores, tidied

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of encoded words (about) and tested pairs kept from batch to batch in a task's Python process.
KEPT_BYTES = 96 << 20
KEPT_PAIRS = 300_000
#: Characters of text handled at a time.
CHARS = 1 << 19


class PieceModel:
    """Pieces, scores and byte pieces of a model file; encodes words and decodes ids."""

    def __init__(self, path: str = MODEL_PATH, kind: str = "bpe"):
        import sentencepiece as library
        sp = library.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.kind, self.pieces = kind, [sp.id_to_piece(i) for i in ids]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in ids]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in ids if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.ids = {self.pieces[i]: i for i in ids if not special[i]}
        self.scores = [sp.get_score(i) for i in ids]
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.room = KEPT_BYTES
        #: bytes that an id stands for: marks as spaces, nothing for control pieces
        self.bytes_of = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(MARK, " ").encode() for i in ids]
        #: pieces that can end a prefix: for BPE those that their own merges give back
        self.usable = self.ids if kind == "unigram" else {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        #: the longest usable piece with these last two characters
        self.reach: dict[str, int] = {}
        for p in self.usable:
            self.reach[p[-2:]] = max(self.reach.get(p[-2:], 1), len(p))

    # merges of a short string, for the pair test of BPE models

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = (self.scores[piece], i)
            if best is None:
                break
            i = best[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges of the two pieces' text end in just these two."""
        a, b = self.pieces[left], self.pieces[right]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def step_unigram(self, word: str, end: int, scores: list[float], tail: list[int], back: list[int]) -> None:
        """Adds the state of ``word[:end]``: best score, its last piece (below 0:
        byte pieces) and the length before it."""
        best, piece, at = scores[end - 1] + self.lowest, -1, end - 1
        for start in range(max(0, end - self.reach.get(word[max(0, end - 2): end], 1)), end):
            i = self.usable.get(word[start:end])
            if i is not None and scores[start] + self.scores[i] > best:
                best, piece, at = scores[start] + self.scores[i], i, start
        scores.append(best)
        tail.append(piece)
        back.append(at)

    def step_bpe(self, word: str, end: int, scores: list[float], tail: list[int], back: list[int]) -> None:
        """The same for the one piece that can end the encoding of ``word[:end]``."""
        for start in range(max(0, end - self.reach.get(word[max(0, end - 2): end], 1)), end):
            piece = self.usable.get(word[start:end])
            if piece is None:
                continue
            before = tail[start]
            fits = start == 0 or before < 0
            if not fits:
                fits = self.pairs.get(before << 32 | piece)
                if fits is None:
                    fits = self.apart(before, piece)
            if fits:
                tail.append(piece)
                back.append(start)
                return
        tail.append(-1)
        back.append(end - 1)

    def encode_sorted(self, words: list[str]) -> dict[str, array]:
        """Ids of sorted distinct words, as 32-bit integers, by one walk that shares the states of common prefixes."""
        step = self.step_unigram if self.kind == "unigram" else self.step_bpe
        out, last, scores, tail, back = {}, "", [0.0], [-1], [0]
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            for states in (scores, tail, back):
                del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                step(word, end, scores, tail, back)
            ids, at = [], len(word)
            while at:
                piece, start = tail[at], back[at]
                if piece >= 0:
                    ids.append(piece)
                elif self.bytes:
                    ids += [self.bytes[b] for b in reversed(word[start:at].encode())]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
                at = start
            ids.reverse()
            out[word] = array("i", ids)
            last = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [marked_words(t) for t in texts]
        kept = self.words
        fresh = {w: ids.tobytes() for w, ids in self.encode_sorted(sorted({w for words in cut for w in words if w not in kept})).items()}
        kept.update(fresh)
        out = [np.frombuffer(b"".join(map(kept.__getitem__, words)), np.int32) for words in cut]
        for word, ids in fresh.items():
            if self.room > 0:
                self.room -= 200 + len(word) + len(ids)
            else:  # beyond the store's bytes
                del kept[word]
        return out

    def raw(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the ids, without the space of the first mark."""
        text = b"".join(map(self.bytes_of.__getitem__, ids))
        return text[1:] if text.startswith(b" ") else text

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: byte pieces joined as UTF-8, marks as spaces, the first mark dropped."""
        return self.raw(ids).decode("utf-8", "replace")

    def round_trips(self, ids: np.ndarray, text: str) -> bool:
        """Whether all ids decode to the text, its marks read as spaces."""
        return self.raw(ids.tolist()) == text.replace(MARK, " ").encode()


def marked_words(text: str) -> list[str]:
    """A mark in front, spaces as marks, cut before each run of marks that follows
    another character. Empty text has no words."""
    if not text:
        return []
    words, held = [], 0
    for part in text.replace(MARK, " ").split(" "):
        held += 1
        if part:
            words.append(MARK * held + part)
            held = 0
    if held:
        words.append(MARK * held)
    return words


def model(path: str, kind: str) -> PieceModel:
    """The process's model; its word store lasts from task to task of this operator."""
    models = stores.setdefault("sentencepiece", {})
    if (path, kind) not in models:
        models[path, kind] = PieceModel(path, kind)
    return models[path, kind]


def encode_documents(docs: DataFrame, path: str = MODEL_PATH, kind: str = "bpe", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (default doc_id) with ``n_tokens``, ``ids`` and
    ``round_trip`` (decoding the ids gives the text back, space marks in the
    text read as spaces).

    Null text has null ids, n_tokens 0 and round_trip true; empty text has empty
    ids. Equal texts get equal ids; an empty table gives an empty result; input
    columns with names of the new ones are replaced. ``path`` must be readable
    on every executor.
    """
    new = ("n_tokens", "ids", "round_trip")
    keep = [c for c in (columns or ["doc_id"]) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path, kind)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or "") <= CHARS):
                    size += len(texts[end] or "")
                    end += 1
                part = texts[start:end]
                ids = pieces.encode([t or "" for t in part])
                same = [t is None or pieces.round_trips(i, t) for t, i in zip(part, ids)]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)),
                                                 mask=pa.array([t is None for t in part]))
                piece = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array([len(i) for i in ids], pa.int64()), lists, pa.array(same, pa.bool_())],
                                                 names=[*keep, *new])
                start = end

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(tidied(run, "sentencepiece"), f"{fields}, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL_PATH, kind: str = "bpe", ids_col: str = "ids") -> DataFrame:
    """``encoded`` with its ids decoded to ``text`` (null ids: null text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path, kind)
        for batch in batches:
            text = [None if i is None else pieces.decode(i) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    rows = encoded.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidied(run, "sentencepiece"), f"{fields}, text string")
