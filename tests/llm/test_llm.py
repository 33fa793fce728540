"""The ten operators against brute force, exact round trips or held-out
accuracy, on small tables with nulls, empty texts, ties, repeats and extra columns."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import (ann, embed_dedup, html_extract, langid, mixing, ngram_join, pii, queries, sentencepiece, sharding,
                         substring_dedup)
from tessera.llm.common import shingles

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, k1 string, n long, part int"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, a long text, repeats, nulls, and columns with clashing names."""
    rng = random.Random(1)
    texts = [words(rng, rng.choice([3, 8, 60, 120, 200])) for _ in range(40)]
    for i in (4, 7, 9, 9, 11):
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts += [texts[i], " ".join(w), "Intro " + texts[i].upper()]
    texts += [None, None, "", "   \n", "12 34", words(rng, 6000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[41], (None, texts[5], "en", "a", "x", 1, 2), (None, "only here now and then", None, None, "x", 1, 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_every_query_runs_on_empty_and_small_tables(spark, tmp_path):
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES)
    for table in ("documents", "embeddings", "pages"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_langid_held_out(spark):
    out = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 200 and sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_langid_without_letters(spark, docs):
    out = langid.identify_language(docs.withColumn("score", F.lit("s")), docs, columns=["doc_id", "text", "score"]).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.lang_pred == "und") == (r.text is None or not re.search(r"[^\W\d_]", r.text))
    none = langid.identify_language(docs, docs.where("false")).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def brute_passages(texts, least=50):
    """Documents that share a run of at least ``least`` equal words with another one."""
    grams = {}
    for i, t in texts:
        w = (t or "").lower().split()
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k: k + least]), set()).add(i)
    return {i for ids in grams.values() if len(ids) > 1 for i in ids}


def test_compact_windows_match_all_passages():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v = rng.integers(0, 30, 60).astype(np.uint64)
        for width in (2, 7):
            found = substring_dedup.compact_windows(v, width)
            for i in range(len(v)):
                for j in range(i + width - 1, len(v)):
                    c = i + int(v[i: j + 1].argmin())
                    assert sum(a <= i <= c2 <= j <= b for a, c2, b in found) == 1
                    assert any(a <= i and j <= b and c2 == c for a, c2, b in found)


def test_substring_dedup(spark, docs):
    rng = random.Random(5)
    shared = words(rng, 55, 5000)
    more = spark.createDataFrame([(1000 + i, f"{words(rng, 30 + i, 5000)} {shared} {words(rng, 20, 5000)}") for i in range(30)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    out = substring_dedup.near_duplicate_passages(both).collect()
    exact = brute_passages([tuple(r) for r in both.collect() if r[0] is not None])
    assert exact <= {r.doc_id for r in out} and all(r.doc_id != r.other_id and r.similarity >= 0.8 for r in out)
    assert all(r.end_word - r.start_word >= 50 and r.other_end - r.other_start >= 50 for r in out)
    hit = {r.doc_id: (r.start_word, r.end_word) for r in out if r.doc_id >= 1000}
    assert all(abs(hit[1000 + i][0] - (30 + i)) <= 2 and abs(hit[1000 + i][1] - (85 + i)) <= 2 for i in range(30))


def tokens_of(text):
    return (shingles([text.encode()], 5)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def test_exact_part_of_a_half_edited_text():
    rng = random.Random(6)
    same, other = words(rng, 100, 10**6), words(rng, 160, 10**6).split()
    edited = " ".join("new" + w if i % 8 == 7 else w for i, w in enumerate(other))
    other = " ".join(other)
    for a, b, lo in ((f"{same} {other}", f"{same} {edited}", 0), (f"{other} {same}", f"{edited} {same}", 160)):
        for x, y in ((a, b), (b, a)):
            found = substring_dedup.passages(tokens_of(x), tokens_of(y), 46, 80)
            assert any(p[0] <= lo and lo + 95 <= p[1] for p in found) and all(100 * p[4] >= 80 * p[5] for p in found)


def test_equal_runs_are_found_among_repeats():
    for n in range(300):
        rng = np.random.default_rng(n)
        pool = int(rng.integers(3, 60))
        run = rng.integers(0, pool, 12)
        a, b = (np.concatenate([rng.integers(0, pool, rng.integers(0, 25)), run, rng.integers(0, pool, rng.integers(0, 25))]).astype(np.int32) for _ in "ab")
        assert substring_dedup.passages(a, b, 10, 80)


def test_equal_runs_of_either_side_come_together():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9], np.int32)
    b = np.array([0, 1, 2, 3, 4, 0, 5, 6, 7, 8, 1, 2, 3, 4], np.int32)
    assert sorted(set(substring_dedup._equal_runs(a, b, 4))) == [(0, 1, 4), (0, 10, 4), (4, 6, 4)]
    assert substring_dedup._equal_runs(a[:8], b[:10], 4) == [(0, 1, 4), (4, 6, 4)]  # nothing comes twice: from one side only
    assert not substring_dedup._equal_runs(a[:3], b, 4) and not substring_dedup._equal_runs(a, a + 100, 4)


def test_windows_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(16)
    for most in (0, 3, 10**6):
        texts = [rng.integers(0, most, n, endpoint=True).astype(np.uint64) for n in (7, 300, 8, 60, 7, 900)]
        ends = np.cumsum([len(t) for t in texts])
        found = list(zip(*(x.tolist() for x in substring_dedup._windows_of(np.concatenate(texts), ends, 7))))
        start = ends - [len(t) for t in texts]
        assert found == [tuple(int(x + s) for x in w) for s, t in zip(start, texts) for w in substring_dedup.compact_windows(t, 7)]
        view = np.lib.stride_tricks.sliding_window_view(texts[-1], 7)
        assert {c for _, c, _ in substring_dedup.compact_windows(texts[-1], 7)} == set((view.argmin(1) + np.arange(len(view))).tolist())


def test_passage_with_an_insertion_from_both_sides():
    rng = random.Random(8)
    plain = words(rng, 90, 10**6).split()
    longer = " ".join(plain[:45] + words(rng, 9, 10**6).split() + plain[45:])
    for a, b in ((" ".join(plain), longer), (longer, " ".join(plain))):
        (found,) = substring_dedup.passages(tokens_of(a), tokens_of(b), 46, 80)
        assert found[4:] == (82, 99)


def test_hashes_agree_across_the_edge_of_a_bucket(spark):
    near = [(0, 1, 0, 63, 90, 2, 0, 0, 50), (1, 1, 5, 65, 95, 2, 0, 1, 60), (2, 1, 5, 400, 450, 2, 0, 1, 60)]
    rows = spark.createDataFrame(near, "j int, doc_a long, l_a int, c_a int, r_a int, doc_b long, l_b int, c_b int, r_b int")
    found = {(r.agree, r.lo_a, r.hi_a, r.lo_b, r.hi_b) for r in substring_dedup.agreeing(rows).collect()}
    assert found == {(2, 0, 95, 0, 60), (1, 5, 450, 0, 60)}


def near_copies(rng):
    """Texts whose passage has one near copy only, never a neighbour's, and shares with all others of its family too little."""
    rows, mates = [], set()
    for k in range(2):
        base = words(rng, 120, 10**6).split()
        for v in range(12):
            one = [w if i % 30 < 16 else f"v{k}x{v}x{i}" for i, w in enumerate(base)]
            for copy in range(2):
                near = [f"edit{copy}" if copy and i in (25, 55, 85) else w for i, w in enumerate(one)]
                rows.append((1000 * k + 12 * copy + v, " ".join([*words(rng, 40, 10**6).split(), *near, *words(rng, 40, 10**6).split()])))
            mates.add((1000 * k + v, 1000 * k + 12 + v))
    return rows, mates


def test_near_copies_in_keys_of_many_windows(spark, monkeypatch):
    rows, mates = near_copies(random.Random(10))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 8):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        out = substring_dedup.near_duplicate_passages(docs).collect()
        found = {(r.doc_id, r.other_id) for r in out if r.doc_id < r.other_id}
        assert found == mates and all(r.similarity >= 0.8 for r in out), block


def test_cores_are_compared_as_all_pairs_are():
    """Two cores with a passage in common are linked, if by others, and every link is such a pair; each has a link of its own."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 65536, 40)
    cores = []
    for _ in range(60):
        core = base.copy()
        core[rng.integers(0, 40, rng.integers(1, 7))] = rng.integers(0, 65536)
        cores.append(np.concatenate([rng.integers(0, 65536, rng.integers(0, 6)), core]).astype(np.uint16))
    at = np.array([len(c) - 20 for c in cores])
    every = np.array([[bool(substring_dedup.passages(x, y, 20, 80)) for y in cores] for x in cores])
    docs = np.arange(60)
    docs[30] = 29

    for sides in (np.zeros(60, int), np.arange(60) % 2):
        found = {tuple(p) for p in substring_dedup.compared(cores, sides, 20, 80, docs, at, docs < 0).tolist()}
        assert all(i < j and docs[i] != docs[j] and every[i, j] and (sides[i] != sides[j] or not sides.any()) for i, j in found)
        kind = np.arange(60)
        for block in range(2 if sides.any() else 0):  # blocks are compared with themselves too
            own = np.flatnonzero(sides == block)
            found |= {(own[i], own[j]) for i, j in substring_dedup.compared([cores[k] for k in own], np.zeros(len(own), int), 20, 80, docs[own], at[own], own < 0).tolist()}
        for i, j in found:
            kind[kind == kind[j]] = kind[i]
        for i, j in itertools.combinations(range(60), 2):
            assert kind[i] == kind[j] or not every[i, j] or docs[i] == docs[j]
        assert {k for p in found for k in p} == {i for i in range(60) if any(every[i, j] and docs[i] != docs[j] for j in range(60))}


def test_links_of_near_copies_grow_with_their_number():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 65536, 90)
    cores = []
    for _ in range(200):
        core = base.copy()
        core[rng.choice(90, 4, replace=False)] = rng.integers(0, 65536, 4)
        cores.append(core.astype(np.uint16))
    found = substring_dedup.compared(cores, np.zeros(200, int), 46, 80, np.arange(200), np.full(200, 45), np.ones(200, bool))
    assert len(found) < 1000 and set(found.ravel().tolist()) == set(range(200))


def test_every_pair_of_cores_with_a_passage_is_a_candidate():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 65536, 40)
    cores = []
    for k in range(60):
        core = base.copy()
        core[rng.integers(0, 40, rng.integers(1, 7))] = rng.integers(0, 65536)
        if k % 5 == 0:
            core = np.insert(core, 10, rng.integers(0, 65536, 2))
        cores.append(np.concatenate([rng.integers(0, 65536, rng.integers(0, 6)), core]).astype(np.uint16))
    at = np.array([len(c) - 20 for c in cores])
    docs = np.arange(60)
    docs[30] = 29
    every = {(i, j) for i, j in itertools.combinations(range(60), 2) if docs[i] != docs[j] and substring_dedup.passages(cores[i], cores[j], 20, 80)}
    for sides in (np.zeros(60, int), np.arange(60) % 2):
        found = {p for a, b in substring_dedup.alike_pairs(cores, sides, 20, 80, docs, at) for p in zip(a.tolist(), b.tolist())}
        assert all(i < j and docs[i] != docs[j] and (sides[i] != sides[j] or not sides.any()) for i, j in found)
        assert {(i, j) for i, j in every if sides[i] != sides[j] or not sides.any()} <= found


def test_every_pair_of_near_copies_is_found(spark, monkeypatch):
    rng = random.Random(14)
    base = words(rng, 100, 10**6).split()
    rows = []
    for v in range(14):
        near = [f"edit{v}" if i == 22 + 4 * v else w for i, w in enumerate(base)]
        rows.append((v, " ".join([*words(rng, 40, 10**6).split(), *near, *words(rng, 40, 10**6).split()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 8):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        found = {(r.doc_id, r.other_id) for r in substring_dedup.near_duplicate_passages(docs).select("doc_id", "other_id").collect()}
        assert found == set(itertools.permutations(range(14), 2)), block


def test_both_places_of_a_core_in_one_document_are_tied():
    tokens = np.arange(60, dtype=np.uint16).tobytes()
    rows = [{"key": 4, "p": 0, "q": 0, "core": 9, "side": 0, "doc": d, "l": c - 30, "c": c, "r": c + 29, "start": c - 30, "tokens": tokens} for d, c in ((1, 30), (1, 530), (2, 30), (3, 30))]
    run, _ = substring_dedup._compare(46, 80)
    found = {(r["doc_a"], r["c_a"], r["doc_b"], r["c_b"]) for batch in run(iter([pa.RecordBatch.from_pylist(rows)])) for r in batch.to_pylist()}
    assert {(1, 30, 2, 30), (1, 530, 2, 30), (1, 30, 3, 30)} <= found


def test_a_word_said_often_is_one_passage():
    a, b = np.full(900, 7, np.int32), np.concatenate([np.arange(100, 160), np.full(300, 7), np.arange(200, 260)]).astype(np.int32)
    for x, y, whole in ((a, b, (0, 899, 60, 359)), (b, a, (60, 359, 0, 899))):
        found = substring_dedup.passages(x, y, 46, 80)
        assert any(p[:4] == whole for p in found) and len(found) < 5
    period = np.tile(np.arange(5), 200).astype(np.int32)
    assert len(substring_dedup.passages(period, period[3:400], 46, 80)) < 5


def test_identical_passages_of_interleaved_variants(spark):
    rng = random.Random(9)
    rows, at = [], {}
    for k in range(12):  # passages that differ in two places, similarity under 0.8
        a = words(rng, 55, 10**6).split()
        b = [("new" if i in (18, 36) else "") + w for i, w in enumerate(a)]
        for i in range(16):
            rows.append((100 * k + i, " ".join([*words(rng, 70, 10**6).split(), *(b if i % 2 else a), *words(rng, 70, 10**6).split()])))
    out = substring_dedup.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in out:
        at.setdefault(r.doc_id, set()).add(r.other_id)
        assert r.doc_id // 100 == r.other_id // 100 and r.similarity >= 0.8
    assert all(100 * k + i % 2 in at[100 * k + i] for k in range(12) for i in range(2, 16))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_spans_match_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "B.", "@", "x@y.z", "1", "4111 1111 1111 1111", "10.2.3", ".4", ".", "-", "+1 (555) 12", "345-67", " ", "é", "%", "\n"])
                       for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_query_and_mask(spark, docs):
    some = docs.select("doc_id", "text").union(spark.createDataFrame(
        [(900, "mail me at a.b@c.org or +1 (555) 123-45678; password=hunter2hunter22"), (901, "x" * 200_000 + "@" * 1000)], "doc_id long, text string"))
    out = {r.doc_id: r for r in pii.find_pii(some).collect()}
    assert out[900].n_email == 1 and out[900].n_phone == 1 and out[901].n_email == 0
    assert out[None].spans == "" and len(out[None].base_sha256) == 64
    assert "a.b@c.org" not in {r.doc_id: r.text for r in pii.mask_documents(some).collect()}[900]


def test_votes_are_weighed_by_reliability():
    counts = [("card", (1, 2, 1, 1, 1), 900), ("card", (0, 2, 2, 0, 1), 500), ("card", (1, 2, 2, 1, 0), 60), ("card", (0, 2, 1, 0, 0), 40)]
    model = pii.estimate(counts)
    assert model.probability("card", (1, 2, 1, 1, 1)) > 0.95 > 0.05 > model.probability("card", (0, 2, 2, 0, 1))


def brute_join(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = frozenset(tuple(w[k: k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join_matches_brute_force(spark, docs, width, percent):
    for part in (ngram_join.PART_SHINGLES, 300):  # also with blocks cut into parts
        before, ngram_join.PART_SHINGLES = ngram_join.PART_SHINGLES, part
        out = ngram_join.ngram_jaccard_join(docs, width, percent).collect()
        ngram_join.PART_SHINGLES = before
        truth = brute_join([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], width, percent)
        assert len(out) == docs.count()
        for r in out:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id) == truth[r.doc_id]


def test_sets_and_their_codes_are_made_for_many_texts_at_once():
    blobs = [b"a b c d e", b"", b"d e a b c", b"a b a b a b", b"b a b a b", b"a b c d e"]
    sets = ngram_join._sets(blobs, 2)
    assert all((s == np.unique(t)).all() for s, t in zip(sets, shingles(blobs, 2))) and [len(s) for s in sets] == [4, 0, 4, 2, 2, 4]
    k1, k2 = ngram_join._set_codes(sets)
    assert len(set(zip(k1.tolist(), k2.tolist()))) == 4 and k1[0] == k1[5] and k1[3] == k1[4] and k2[0] != k2[2]
    for i in range(len(sets)):  # whatever stands beside it
        assert [x.tolist() for x in ngram_join._set_codes(sets[i: i + 1])] == [[k1[i]], [k2[i]]]


def test_trie_finds_what_all_pairs_find():
    rng = random.Random(8)
    base = [sorted(rng.sample(range(300), 60)) for _ in range(4)]
    sets = [np.array(sorted(set(rng.sample(rng.choice(base), rng.randrange(50, 61))) | set(rng.sample(range(300), 3))), np.int32) for _ in range(60)]
    links, _ = ngram_join.join_group(sets, [0] * 60, [1] * 60, 85)
    for i, x in enumerate(sets):
        near = [len(np.intersect1d(x, y)) for y in sets]
        assert links[i] == sum(100 * o >= 85 * (len(x) + len(y) - o) for j, (o, y) in enumerate(zip(near, sets)) if j != i)


def test_html_held_out_and_hard_pages(spark):
    rng = np.random.default_rng(4)
    field = html_extract.train([html_extract.labelled_page(rng) for _ in range(300)])
    rng, wrong, total = np.random.default_rng(99), 0, 0
    for _ in range(100):
        chain = html_extract.blocks(html_extract.labelled_page(rng))
        truth = [int(html_extract.LABEL in b.text) for b in chain]
        plain = [html_extract.Block(b.text.replace(html_extract.LABEL, "") or "x", b.path, b.linked) for b in chain]
        wrong += sum(a != b for a, b in zip(truth, field.decode(plain)))
        total += len(truth)
    assert wrong <= 0.02 * total
    page = ('<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One\n two.<script>if(a<b)"</p>"</script><p>Th&eacute; end.</article>'
            '<div class="comments"><p>Nice post, thank you very much.</p></div><footer>&copy; x')
    assert html_extract.main_text(page, field) == "T & U\nOne two.\nThé end."
    rows = spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5), (None, "v", "", 5), (4, "w", "<" * 50_000, 5)],
                                 "page_id long, url string, html string, text int")
    out = html_extract.extract_text(rows, training_pages=200).collect()
    assert len(out) == 5 and [r.n_chars for r in out] == [len(r.text) for r in out]


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(1)
    chain = [html_extract.Block("x" * k, (("p", ""),), 0.0) for k in (1, 5, 30, 200, 9)]
    names = {f: i for i, f in enumerate(sorted({f for facts in html_extract.block_facts(chain) for f in facts}))}
    for _ in range(20):
        field = html_extract.ChainField(names, rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)))
        s = field.scores(chain)

        def total(y):
            return sum(s[i, v] for i, v in enumerate(y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:]))

        every = [[(k >> i) & 1 for i in range(5)] for k in range(32)]
        assert total(field.decode(chain)) == pytest.approx(max(map(total, every)))


VECTORS = "vec_id long, embedding array<float>, label int, dim string"


def vectors(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2:] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * 0.05
    x[5] = x[6]
    rows = [(i, [float(v) for v in np.float32(r)], int(i % 3) if i % 50 else None, "d") for i, r in enumerate(x)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0, 2.0]]
    return rows + [(1000 + i, b, 1, "d") for i, b in enumerate(bad)]


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 70)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rows = spark.createDataFrame(vectors(), VECTORS)
    out = {}
    for r in ann.nearest(rows.where("vec_id % 10 = 0"), rows).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v, float) for i, v, *_ in vectors() if i < 1000}
    assert sorted(out) == [i for i in sorted(good) if i % 10 == 0]
    for q, found in out.items():
        truth = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        assert [(k + 1, i) for k, (_, i) in enumerate(truth)] == [(a, b) for a, b, _ in sorted(found)]
        assert np.allclose([d for d, _ in truth], [d for _, _, d in sorted(found)], atol=1e-12)


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_CELL", 4)
    monkeypatch.setattr(embed_dedup, "PART", 16)
    data = vectors()
    out = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()}
    x = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, label, _ in data if i < 1000 and label is not None}
    label = {i: k for i, _, k, _ in data}
    truth = {(a, b) for a in x for b in x if a < b and label[a] == label[b] and x[a] @ x[b] >= 0.98}
    assert len(out) == len(data) and sum(r.n_links for r in out.values()) >= 0.9 * 2 * len(truth) > 0
    assert sum(r.n_links for r in out.values()) <= 2 * len(truth)
    assert all(r.kept == (r.component_id == i) and r.component_id <= i for i, r in out.items())


def test_sentencepiece_equals_the_library(spark, docs):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r.text for r in docs.collect()]
    texts += ["", " ", "  a  b ", "x\ty\n z   ", "é€😀", "日本語 mixed", "    " * 7, "a" * 3000]
    pieces = sentencepiece.PieceModel()
    for t, ids in zip(texts, pieces.encode([t or "" for t in texts])):
        assert ids.tolist() == library.encode(t or "") and pieces.decode(ids.tolist()) == (t or "")
    out = sentencepiece.encode_documents(docs.withColumn("ids", F.lit(1)))
    assert out.where("not round_trip").count() == 0 and out.where("ids is null").count() == 2
    back = sentencepiece.decode_documents(out)
    assert back.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("not (text <=> t)").count() == 0


def test_unigram_viterbi_is_the_best_segmentation():
    m = sentencepiece.PieceModel.__new__(sentencepiece.PieceModel)
    rng = random.Random(2)
    m.kind, m.pieces = "unigram", sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(20)} | {"a", "b"})
    m.ids = {p: i for i, p in enumerate(m.pieces)}
    m.scores, m.lowest, m.bytes, m.unknown, m.usable = [-rng.random() * len(p) for p in m.pieces], -99.0, {}, -1, m.ids
    m.reach = {}
    for p in m.ids:
        m.reach[p[-2:]] = max(m.reach.get(p[-2:], 1), len(p))

    def best(w):
        return max((best(w[:k]) + m.scores[m.ids[w[k:]]] for k in range(len(w)) if w[k:] in m.ids), default=0.0) if w else 0.0

    ws = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(40)})
    for w, ids in m.encode_sorted(ws).items():
        assert "".join(m.pieces[i] for i in ids) == w and sum(m.scores[i] for i in ids) == pytest.approx(best(w))


@pytest.mark.parametrize("limit", [200, 5_000, 10**9])
def test_shards(spark, docs, limit):
    out = sharding.assign_shards(docs, limit).collect()
    assert len(out) == docs.count()
    held = {}
    for r in out:
        held.setdefault(r.shard, []).append(r.n_bytes)
        assert r.depth == len(r.shard)
    total = sum(r.n_bytes for r in out)
    for shard, sizes in held.items():
        assert sum(sizes) <= limit or len(shard) == sharding.HASH_BITS
        if shard:  # its bucket split because it was too large
            parent = sum(sum(v) for s, v in held.items() if s.startswith(shard[:-1]))
            assert parent > limit
    assert (len(held) == 1) == (total <= limit)


def test_shards_match_sql(spark, duck):
    for limit in (20_000, sharding.SHARD_LIMIT):
        rows = duck.execute(sharding.SHARDING_SQL.replace(str(sharding.SHARD_LIMIT), str(limit))).fetchall()
        out = sharding.assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit)
        assert sorted(map(tuple, out.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes").collect())) == sorted(rows)


def test_raking_meets_its_targets():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 1000, (5, 4, 3)).astype(float)
    goals = [rng.dirichlet(np.ones(n)) for n in tokens.shape]
    raked = mixing.rake(tokens, goals)
    for axis, goal in enumerate(goals):
        assert np.allclose(raked.sum(axis=tuple(a for a in range(3) if a != axis)), goal, atol=1e-6)
    p = mixing.calibrate(tokens, raked, 0.3)
    assert (p <= 1).all() and (p * tokens).sum() == pytest.approx(0.3 * tokens.sum())


def test_mixing(spark, docs):
    out = mixing.mix_documents(docs.withColumn("mix_kept", F.lit("old")), keep=0.5, topics=3, columns=["doc_id", "source", "mix_kept"]).collect()
    assert len(out) == docs.count() and all(0 <= r.mix_probability <= 1 for r in out)
    only = mixing.mix_documents(docs, keep=0.5, topics=2, targets={"source": {"a": 1.0}}).collect()
    assert all(r.mix_probability == 0 for r in only if r.source != "a")


def test_every_source_has_its_own_target(spark):
    rows = spark.createDataFrame([(i, "one two three four", "en", f"site{i % 600:03}") for i in range(1200)], "doc_id long, text string, lang string, source string")
    equal = {round(r.mix_probability, 9) for r in mixing.mix_documents(rows, keep=0.5, topics=1).collect()}
    assert equal == {0.5}
    out = mixing.mix_documents(rows, keep=0.002, topics=1, targets={"source": {"site599": 0.75, "site001": 0.25, "absent": 1.0}}).collect()
    p = {r.source: r.mix_probability for r in out}
    assert p["site599"] == pytest.approx(0.9) and p["site001"] == pytest.approx(0.3) and sum(p.values()) == pytest.approx(1.2)


def test_raking_by_spark_equals_the_driver(spark):
    rows = [("b", "de", 0, 0)] + [(s, g, 0, n * m) for s, n in (("a", 30), (None, 2), ("b", 1)) for g, m in (("en", 20), (None, 3))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long").coalesce(1)
    few, many = (sorted((str(r[:3]), round(r[3], 6)) for r in f(spark, c, 0.5, {"lang": {"en": 3.0, None: 1.0}}, 0.7).collect())
                 for f, c in ((mixing._few, cells.collect()), (mixing._many, cells)))
    assert few == many and any(p == 1 for _, p in few)


def test_pipeline(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_dedup", "mask_pii", "mix_sources", "encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = after.cache()
        assert 0 < docs.count() <= 200
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0
