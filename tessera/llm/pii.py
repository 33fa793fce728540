"""Personal data by weak supervision.

Fixed patterns give the base spans, which always count. Looser patterns give
further candidates. Regex, gazetteer, context, shape and boundary labelers vote
on every candidate (yes, no or no opinion); expectation-maximisation over the
counts of all vote patterns estimates how reliable each labeler is for each
kind, and a logistic span classifier is trained on the resulting probabilities
of a bounded sample of candidates. It sees the span and its surroundings, not
the votes, and decides which candidates are added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

BASE_KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans of one start are listed.
KINDS = (*BASE_KINDS, "secret", "ssn", "iban", "name")
LABELERS = ("regex", "gazetteer", "context", "shape", "boundary")
#: Candidates that the span classifier is trained on at most.
SAMPLE = 20_000
FEATURES = 512
ADD_FROM = 0.5

Span = tuple[int, int, str]  # start, end, kind

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63})+")
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9])(?:[Pp]assword|PASSWORD|passwd|pwd|[Tt]oken|TOKEN|[Ss]ecret|api[_-]?key|API[_-]?KEY) ?[=:] ?[\"']?([A-Za-z0-9+/_.-]{8,128})")
_NAME = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. ([A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){1,2})(?![a-z])")

#: Common endings of host names, given names, and words near each kind.
ENDINGS = frozenset("com org net edu gov info biz io de fr es it uk us ca mx br co eu".split())
GIVEN_NAMES = frozenset("""James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan
Joseph Jessica Thomas Sarah Charles Karen Anna Maria Peter Paul Hans Klaus Sabine Petra Pierre Marie Jean Sophie Claire Carlos
Jose Juan Luis Ana Carmen Miguel""".split())
NEAR = {
    "email": ("email", "e-mail", "mail", "contact", "write"), "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "secret": ("key", "password", "token", "secret", "login"), "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "bank", "account", "transfer"), "name": ("name", "signed", "dear", "by")}
NEAR_NOT = ("version", "license", "isbn", "issn", "page", "section", "chapter", "order", "figure", "doi")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind. An address is found from its
    ``@``: its local part is the run before it, so long runs cost no more."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end, "email"))
            at = text.find("@", end)
        else:
            end = max(end, at + 1) if start == at else end
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def loose_spans(text: str) -> list[Span]:
    """Further candidates of all kinds."""
    out: list[Span] = []
    if "(at)" in text or "[at]" in text:
        out += [(m.start(), m.end(), "email") for m in _OBFUSCATED.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(1), m.end(1), "secret") for m in _ASSIGNED.finditer(text)]
        out += [(m.start(), m.end(), "ip") for m in _IPV6.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "secret") for m in _KEY.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), k) for k, p in (("phone", _NATIONAL), ("ssn", _SSN), ("iban", _IBAN)) for m in p.finditer(text)]
    if any(t in text for t in ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ")):
        out += [(m.start(1), m.end(1), "name") for m in _NAME.finditer(text)]
    return out


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and loose spans that overlap none of them nor an earlier one."""
    base = base_spans(text)
    taken, rest, last = sorted((s, e) for s, e, _ in base), [], 0
    starts = [s for s, _ in taken]
    for span in sorted(set(loose_spans(text)), key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        i = int(np.searchsorted(starts, span[1]))  # bases that start before the span ends
        if span[0] >= last and not any(e > span[0] for _, e in taken[max(0, i - 4): i]):
            rest.append(span)
            last = span[1]
    return base, rest


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 yes, 0 no, 2 no opinion."""
    start, end, kind = span
    s = text[start:end]
    if is_base:
        strict = 1
    elif kind == "iban":
        strict = int(_iban(s))
    elif kind == "ssn":
        strict = int(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    elif kind == "secret":
        strict = 1 if s.startswith("AKIA") or len(set(s)) >= 8 and any(c.isdigit() for c in s) else 0
    else:
        strict = 2
    if kind == "email":
        listed = 1 if re.split(r"[^A-Za-z0-9]+", s)[-1].lower() in ENDINGS else 2
    elif kind == "name":
        listed = 1 if s.split(" ")[0] in GIVEN_NAMES else 2
    elif kind in ("phone", "card"):
        listed = 0 if len(set(s) & set("0123456789")) <= 1 else 2
    else:
        listed = 2
    before = re.findall(r"[a-z-]+", text[max(0, start - 40): start].lower())
    near = 1 if any(w in NEAR[kind] for w in before) else 0 if any(w in NEAR_NOT for w in before) else 2
    digits = sum(c.isdigit() for c in s) / len(s)
    shape = {"card": 1 if digits > 0.7 else 0, "phone": 1 if digits > 0.5 else 0, "ip": 1 if digits > 0.4 or ":" in s else 0,
             "email": 1 if len(s) <= 80 else 0, "name": 1 if len(s) <= 40 else 0, "ssn": 1, "iban": 1 if digits > 0.3 else 0,
             "secret": 1 if 0 < digits < 1 else 0}[kind]
    edge = int(not (text[start - 1: start].isalnum() or text[end: end + 1].isalnum()))
    return strict, listed, near, shape, edge


def features(text: str, span: Span) -> list[int]:
    """Hashed indices: kind with length, shape, neighbours and the word before."""
    start, end, kind = span
    s = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s[:64]))))
    before = re.findall(r"\w+", text[max(0, start - 24): start].lower())
    facts = (f"k{kind}", f"l{kind}{min(len(s) // 4, 12)}", f"s{kind}{shape[:16]}", f"p{kind}{text[start - 1: start].isalnum()}",
             f"n{kind}{text[end: end + 1].isalnum()}", f"w{kind}{before[-1] if before else ''}",
             f"d{kind}{sum(c.isdigit() for c in s) * 5 // len(s)}", f"u{kind}{min(len(set(s)) // 2, 8)}")
    return [int.from_bytes(hashlib.md5(f.encode()).digest()[:4], "big") % FEATURES for f in facts]


@dataclass(frozen=True)
class VoteModel:
    """Share of true candidates and, per truth, labeler and vote, a probability, for each kind."""
    prior: dict[str, float]
    table: dict[str, np.ndarray]  # kind -> 2 x labelers x 3

    def probability(self, kind: str, pattern: tuple[int, ...]) -> float:
        if kind not in self.prior:
            return 0.5
        logs = [np.log(p) + sum(np.log(self.table[kind][y, j, v]) for j, v in enumerate(pattern))
                for y, p in ((0, 1 - self.prior[kind]), (1, self.prior[kind]))]
        return float(1 / (1 + np.exp(min(50.0, logs[0] - logs[1]))))


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> VoteModel:
    """EM for each kind over its vote patterns; labelers are taken as
    independent given the truth and start as better than chance."""
    prior, tables = {}, {}
    for kind in sorted({k for k, _, _ in counts}):
        mine = sorted((p, n) for k, p, n in counts if k == kind)
        patterns, n = np.array([p for p, _ in mine]), np.array([c for _, c in mine], float)
        said = (patterns == 1).sum(axis=1) - (patterns == 0).sum(axis=1)
        q = 1 / (1 + np.exp(-1.5 * said))
        for _ in range(rounds):
            share = float(np.clip((q * n).sum() / n.sum(), 0.01, 0.99))
            table = np.full((2, len(LABELERS), 3), 0.0)
            for y, w in ((0, (1 - q) * n), (1, q * n)):
                for j in range(len(LABELERS)):
                    for v in range(3):
                        # a weak prior: a labeler that votes is more often right than wrong
                        table[y, j, v] = w[patterns[:, j] == v].sum() + (4.0 if v == y else 1.0)
                table[y] /= table[y].sum(axis=1, keepdims=True)
            logs = np.log(table)
            score = [logs[y, np.arange(len(LABELERS)), patterns].sum(axis=1) for y in (0, 1)]
            q = 1 / (1 + np.exp(np.clip(np.log(1 - share) + score[0] - np.log(share) - score[1], -50, 50)))
        prior[kind], tables[kind] = share, table
    return VoteModel(prior, tables)


def train_classifier(rows: list[list[int]], target: list[float], rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on hashed features with soft targets (the last weight is the constant)."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        return w
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    y, square = np.array(target), np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + decay * w
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base, rest = candidates(text)
    added = [s for s in rest if 1 / (1 + np.exp(-(weights[features(text, s)].sum() + weights[-1]))) >= ADD_FROM]
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "pattern", "features", "draw"]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            if text := text.as_py():
                base, rest = candidates(text)
                for spans, is_base in ((base, True), (rest, False)):
                    for s in spans:
                        near = f"{text[max(0, s[0] - 20): s[1] + 20]}|{s[0]}"
                        draw = int.from_bytes(hashlib.md5(near.encode()).digest()[:7], "big")
                        rows.append((s[2], "".join(map(str, votes(text, s, is_base))), features(text, s), draw))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64()))], names=names)


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from the candidates of all documents."""
    seen = checkpointed(docs.select("text").where("text IS NOT NULL")
                        .mapInArrow(_votes, "kind string, pattern string, features array<int>, draw long"))
    counts = seen.groupBy("kind", "pattern").count().collect()  # at most kinds x 3 ** labelers rows
    model = estimate([(r["kind"], tuple(map(int, r["pattern"])), r["count"]) for r in counts])
    sample = seen.orderBy("draw", "kind", "pattern").limit(SAMPLE).collect()
    return train_classifier([r["features"] for r in sample], [model.probability(r["kind"], tuple(map(int, r["pattern"]))) for r in sample])


def find_pii(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every
    row; the counts and the digest are of the base spans, ``spans`` has all.

    Offsets are code points of the whole text, ends exclusive. Null text counts
    as empty; repeated rows get equal results; null ids are kept; other columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
        for batch in batches:
            counts, digests, spans = {k: [] for k in BASE_KINDS}, [], []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py() or "", weights)
                for k in BASE_KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                                              pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, weights: np.ndarray) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, last = [], 0
    for start, end, kind in all_spans(text, weights)[1]:
        if start >= last:
            out += [text[last:start], f"<{kind.upper()}>"]
        last = max(last, end)
    return "".join(out) + text[last:]


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with all found spans of ``text`` masked; null text stays null."""
    weights = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [None if t is None else mask(t, weights) for t in (x.as_py() for x in batch.column("text"))]
            cols = [pa.array(masked, pa.string()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
