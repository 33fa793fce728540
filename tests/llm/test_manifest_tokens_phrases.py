"""Merkle manifest, wavelet token shards and phrase collocations against brute force."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, merkle, queries, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, h string, w1 string, n long, part int, id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n_chars, r.text)))


def climb(row, arity):
    """Levels from leaves to root."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i: i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def proof(levels, i, arity):
    """(left siblings, right siblings) from the leaf up."""
    out = []
    for row in levels[:-1]:
        a = i - i % arity
        out.append((row[a:i], row[i + 1: a + arity]))
        i //= arity
    return out


def brute_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    key = lambda x: (x is not None, (x or "").encode())
    langs = sorted(groups, key=key)
    for lang in langs:
        groups[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars)))
    trees = {lang: climb([leaf(r, r.n_chars) for r in groups[lang]], arity) for lang in langs}
    upper = climb([trees[lang][-1][0] for lang in langs], arity)
    for k, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            steps = proof(trees[lang], i, arity) + proof(upper, k, arity)
            bad = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 if r.doc_id is not None else False
            h = leaf(r, r.n_chars + 1 if bad and r.n_chars is not None else r.n_chars)
            for left, right in steps:
                h = sha("".join([*left, h, *right]))
            yield (r.doc_id, leaf(r, r.n_chars), trees[lang][-1][0], upper[-1][0], sha("".join("".join(a + b) for a, b in steps)), h, h == upper[-1][0])


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in all columns, empty and long texts, repeats, one id with two texts, clashing names."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["Ein Wort, zwei.", "", "a  b\tc\n\nd ", "naïve café x", "x" * 5000, None]), rng.choice(["de", "en", "é", None]), rng.choice(["a", None]), rng.choice([3, None]),
             "t", 1, "h", "w", 2, 3, "i") for i in range(60)]
    rows += [rows[3], rows[3], (3, "other text", rows[3][2], "a", 3, "t", 1, "h", "w", 2, 3, "i"), (None, "no id", "en", "a", 1, "t", 1, "h", "w", 2, 3, "i"), (None, None, "only", None, None, "t", 1, "h", "w", 2, 3, "i")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.mark.parametrize("arity", [2, 3])
def test_merkle_manifest(docs, arity):
    told = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.merkle_manifest(docs, arity=arity, tampered=told)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_manifest(docs.collect(), arity)))
    assert 0 < got.where("not verified").count() < got.count()


def test_merkle_of_one_row_and_none(docs):
    one = docs.where("doc_id = 5")
    (r,) = merkle.merkle_manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == sha("")
    assert merkle.merkle_manifest(docs.limit(0)).count() == 0


def test_wavelet_shard():
    rng = np.random.default_rng(0)
    for n, most in ((0, 9), (1, 9), (5, 2), (3000, 7), (300_000, 50_257), (1000, 1 << 20)):
        ids = rng.integers(0, most, n).astype("<u4")
        ids[::3] %= 5
        shard = wavelet.WaveletShard(io.BytesIO(wavelet.pack_shard(ids, [4, None], [n // 2, n - n // 2])))
        assert (shard.all_tokens() == ids).all() and shard.doc_ids == [4, None]
        for i in rng.integers(0, n, 20) if n else []:
            assert shard.access(int(i)) == ids[i]
        for t in {0, 3, int(ids[-1]) if n else 1, 1 << 25}:
            where = np.flatnonzero(ids == t)
            assert shard.count(t) == len(where)
            assert [shard.select(t, j) for j in range(0, len(where), max(1, len(where) // 5))] == where[:: max(1, len(where) // 5)].tolist()
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert shard.rank(t, a) == int((ids[:a] == t).sum()) and shard.count(t, a, b) == int((ids[a:b] == t).sum())
        for i in (-1, n):
            with pytest.raises(IndexError):
                shard.access(i)


def test_parts_encode_as_whole_texts():
    words, rng = wavelet.WordEncoder(wavelet.tokenizer_path()), random.Random(3)
    pieces = [" ", "  ", "\n", "\r\n", "a", "bc", "'s", "'", " x", "9", "é", ".", ",", "!?", "\x1c", "\x85", "\xa0", "\t", "日本", "​", "<|endoftext|>", "½", ")"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for a in range(0, len(texts), 500):
        for text, got in zip(texts[a: a + 500], words.encode(texts[a: a + 500])):
            assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_shards(spark, docs, tmp_path):
    path = f"{tmp_path}/shards"
    manifest = wavelet.write_token_shards(docs, path, shard_tokens=700).collect()
    got = wavelet.read_token_shards(spark, path, with_ids=True).collect()
    plain = wavelet.WordEncoder(wavelet.tokenizer_path()).tokenizer
    want = Counter((r.doc_id, tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and len(manifest) > 5
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # ascending ids without gaps, null first
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    every = [i for r in sorted(got, key=lambda r: r.start) for i in r.ids]
    assert {r.token: r.n for r in wavelet.count_tokens(spark, path, [0, 11, 50_000]).collect()} == {t: every.count(t) for t in (0, 11, 50_000)}
    assert sorted(r.place for r in wavelet.find_token(spark, path, 0).collect()) == [i for i, t in enumerate(every) if t == 0]
    wavelet.write_token_shards(docs.limit(0), f"{path}-none")
    assert wavelet.read_token_shards(spark, f"{path}-none").count() == 0


def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r.lang if r.lang is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i: i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i:j]) for p, a in cand.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and a >= cand[(p[0], *p[i:j])]}
    out = {}
    for p, a in cand.items():
        if p not in gone:
            score, k = min((1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p)))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(p[0], *p[k:])]))
    for lang, found in out.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            yield (lang, rank, p.decode(), -a, left, right, n[lang], -s)


@pytest.mark.parametrize("least", [2, 4, 300])
def test_collocations(spark, least):
    rng = random.Random(1)
    vocabulary = ["The", "cat", "sat", "on", "é", "Ä", "mat x", "runs", "x-y", "z"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", ", ", ".\n", " ", "\r"]) for _ in range(rng.choice([0, 1, 5, 40, 900]))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "en", "de", None, "und"]), "s", 1, "t", 1, "h", "w", 2, 3, "i") for i, t in enumerate([*texts, None, "", " \t", ".,;", texts[5], texts[5]])]
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    for top in (2000, 7):
        got = collocations.collocations(table, least=least, top=top)
        assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(table.collect(), least, top))
    assert collocations.collocations(table.limit(0), least=least).count() == 0


def test_queries_are_registered():
    assert [n for n in queries.QUERIES if n.split("_")[0] in ("op11", "op12", "op13")] == ["op11_merkle_manifest", "op12_wavelet_tokens", "op13_phrase_collocations"]
