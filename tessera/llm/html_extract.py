"""Main text of web pages by a linear-chain conditional random field.

A page is read once, from left to right, into its leaf blocks: runs of text
between block-level tags, each with its open elements. Features tell the tags
and class and id words around a block and the form of its text. The field labels
the chain of blocks as text or not; it is trained here on labelled pages that
``labelled_page`` lays out in many templates, by gradient steps on the exact
log-likelihood (forward-backward), and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, and elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike
strong sub sup time tt u var wbr""".split())
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # open elements: tag, class and id words
    linked: float                      # share of the text inside links


def _tag_end(page: str, at: int) -> int:
    """End of the tag that starts at ``at``; quotes hold back a ``>``."""
    quote, i = "", at + 1
    while True:
        stop = page.find(">", i)
        if stop < 0:
            return -1
        part = page[i:stop]
        if quote:
            if quote not in part:
                i = stop + 1
                continue
            part = part[part.index(quote) + 1:]
            quote = ""
        while True:
            marks = [(part.find(q), q) for q in "\"'" if q in part]
            if not marks:
                break
            start, q = min(marks)
            close = part.find(q, start + 1)
            if close < 0:
                quote = q
                break
            part = part[close + 1:]
        if not quote:
            return stop
        if page.find(quote, stop + 1) < 0:  # a quote that never closes holds nothing back
            return stop
        i = stop + 1


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. One pass; what is left open at the end is closed there."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked = links = 0
    in_head = False
    gone: set[str] = set()  # closing marks that do not come any more

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, tuple(stack), min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not in_head:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def find(mark: str, start: int) -> int:
        if mark in gone:
            return -1
        at = page.find(mark, start)
        if at < 0:
            gone.add(mark)
        return at

    i, n = 0, len(page)
    while i < n:
        at = page.find("<", i)
        if at < 0:
            say(page[i:])
            break
        nxt = page[at + 1: at + 2]
        if not (nxt.isascii() and nxt.isalpha() or nxt in ("/", "!", "?")) or not nxt:
            say(page[i: at + 1])
            i = at + 1
            continue
        say(page[i:at])
        if page.startswith("<!--", at):
            stop = find("-->", at + 4)
            i = n if stop < 0 else stop + 3
            continue
        stop = _tag_end(page, at) if ">" not in gone else -1
        if stop < 0:  # a tag that never ends
            gone.add(">")
            break
        body = page[at + 1: stop]
        i = stop + 1
        m = _NAME.match(body)
        if not m:
            continue
        tag = m[1].lower()
        if body[0] == "/":
            if tag == "head":
                in_head = False
            where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if tag not in INLINE:
                flush()
            if where >= 0:
                if tag in INLINE and any(t not in INLINE for t, _ in stack[where + 1:]):
                    continue
                del stack[where:]
                links = sum(t == "a" for t, _ in stack)
            continue
        if tag == "head":
            in_head = True
            continue
        if tag == "body":
            in_head = False
        if tag in RAW:
            if tag not in ("title",):
                pieces.append(" ")
            close = re.compile(f"</{tag}", re.I).search(page, i) if tag not in gone else None
            if close is None:
                gone.add(tag)
                if tag in ("script", "style"):
                    break
                continue
            end = page.find(">", close.end())
            i = n if end < 0 else end + 1
            continue
        if tag in VOID or body.endswith("/"):
            if tag == "br":
                pieces.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            places = [k for k, (t, _) in enumerate(stack) if t == "p"]
            if places:  # a paragraph ends where another block starts
                del stack[places[-1]:]
        words = " ".join(v for a in _ATTRIBUTE.finditer(body[m.end():]) for v in a.groups()[1:] if v)
        if len(stack) < 200:
            stack.append((tag, words.lower()))
        links = sum(t == "a" for t, _ in stack)
    flush()
    return out


@functools.lru_cache(maxsize=4096)
def _place_facts(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    facts = set()
    outer = [(t, w) for t, w in path if t not in INLINE]
    for tag, words in outer:
        facts.add(f"a:{tag}")
        for word in re.split(r"[^a-z]+", words):
            if len(word) > 1:
                facts.add(f"c:{word}")
    if outer:
        facts.add(f"p:{outer[-1][0]}")
    if len(outer) > 1:
        facts.add(f"g:{outer[-2][0]}")
    facts.add("main" if any(t in ("article", "main") for t, _ in outer) else "not main")
    return tuple(sorted(facts))


def block_facts(chain: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(chain):
        n = len(b.text)
        facts = [*_place_facts(b.path), "bias", f"len:{min(n.bit_length(), 11)}", f"link:{int(b.linked * 3.99)}",
                 f"stops:{min(sum(b.text[:2000].count(c) for c in '.,;'), 6)}", f"end:{b.text[-1] in '.!?:'}"]
        if "©" in b.text[:40]:
            facts.append("copyright")
        if i == 0:
            facts.append("first")
        if i == len(chain) - 1:
            facts.append("last")
        out.append(facts)
    return out


# labelled pages

MAIN = ['<article>|</article>', '<main>|</main>', '<main><article>|</article></main>', '<div class="content">|</div>', '<div id="main-content">|</div>',
        '<div class="post"><div class="entry-content">|</div></div>', '<section class="article-body">|</section>', '<div class="story text">|</div>',
        '<div id="page"><article class="post">|</article></div>', '<div class="article"><div class="body">|</div></div>']
ASIDE = ['<nav>|</nav>', '<div class="menu">|</div>', '<div id="navbar" class="nav">|</div>', '<div class="breadcrumb">|</div>', '<header>|</header>',
         '<div class="header masthead">|</div>', '<div id="top-header">|</div>', '<div role="banner" class="topbar">|</div>', '<aside>|</aside>', '<div class="sidebar">|</div>', '<div id="sidebar" class="widget">|</div>',
         '<div class="related recommended">|</div>', '<section class="trending popular">|</section>', '<div class="ad">|</div>', '<div class="ads banner">|</div>',
         '<div class="advert advertisement">|</div>', '<div class="sponsored promo">|</div>', '<div class="cookie notice">|</div>', '<div id="cookie-banner" class="consent">|</div>',
         '<div class="alert gdpr">|</div>', '<div class="newsletter subscribe">|</div>', '<div class="popup modal">|</div>', '<form>|</form>', '<div class="search"><form action="/s">|</form></div>',
         '<div class="share social">|</div>', '<footer>|</footer>', '<div class="footer">|</div>', '<div id="copyright" class="legal">|</div>', '<div role="contentinfo" class="bottom">|</div>',
         '<section id="comments">|</section>', '<div class="comments"><div class="comment">|</div></div>', '<ol class="comment-list"><li class="comment reply">|</li></ol>',
         '<div id="disqus_thread" class="discussion">|</div>', '<div class="user-comments responses">|</div>']
_SYLLABLES = "ka lo mi ter an sol ve du ri pon esta gra he ou un in che be la tor".split()
LABEL = "\ue000"  # marks text of the article in a labelled page


def _sentence(rng: np.random.Generator, words: int) -> str:
    spot = rng.integers(0, len(_SYLLABLES), (words, 3))
    made = ["".join(_SYLLABLES[k] for k in row[: 1 + row[2] % 3]) for row in spot.tolist()]
    return " ".join(made).capitalize() + ".. .!?,"[rng.integers(7)].strip()


def _wrap(rng: np.random.Generator, options: list[str], inner: str) -> str:
    a, b = options[rng.integers(len(options))].split("|")
    return a + inner + b


def _boilerplate(rng: np.random.Generator) -> str:
    kind = rng.integers(5)
    if kind == 0:
        inner = "<ul>" + "".join(f'<li><a href="/{k}">{_sentence(rng, int(rng.integers(1, 4)))}</a></li>' for k in range(rng.integers(2, 8))) + "</ul>"
    elif kind == 1:
        inner = "".join(f"<p>{_sentence(rng, int(rng.integers(3, 60)))}</p>" for _ in range(rng.integers(1, 5)))
    elif kind == 2:
        inner = f"&copy; {_sentence(rng, 3)} &middot; " + _sentence(rng, int(rng.integers(2, 14)))
    elif kind == 3:
        inner = f"<label>{_sentence(rng, 2)}</label><input name=q><button>{_sentence(rng, 1)}</button>" + f"<span>{_sentence(rng, 6)}</span>" * int(rng.integers(2))
    else:
        inner = _sentence(rng, int(rng.integers(2, 40)))
    return _wrap(rng, ASIDE, inner)


def labelled_page(rng: np.random.Generator) -> str:
    """A page whose article texts are marked; templates, order and extent vary."""
    def paragraph() -> str:
        kind = rng.integers(12)
        if kind == 0:
            return f"<h2>{LABEL}{_sentence(rng, int(rng.integers(1, 8)))}</h2>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{LABEL}{_sentence(rng, int(rng.integers(1, 25)))}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{LABEL}{_sentence(rng, int(rng.integers(4, 40)))}</p></blockquote>"
        if kind == 3:
            return f"<p>{LABEL}{_sentence(rng, int(rng.integers(1, 5)))}</p>"
        if kind == 4:
            return f'<p>{LABEL}{_sentence(rng, 8)} <a href="/x">{_sentence(rng, int(rng.integers(1, 12)))}</a> {_sentence(rng, 5)}</p>'
        if kind == 5:
            return f"<p>{LABEL}{rng.choice(['All rights reserved.', '&copy; ', 'Licensed under CC BY.', 'Share: ', 'Subscribe: '])} {_sentence(rng, 3)}</p>"
        if kind == 6:
            return f"<pre>{LABEL}{_sentence(rng, 12)}</pre>"
        return f"<p><b>{LABEL}" * int(rng.integers(2)) + f"<p>{LABEL}{_sentence(rng, int(rng.integers(5, 120)))}" + ("</p>" if rng.random() < 0.9 else "<br>")

    inner = f"<h1>{LABEL}{_sentence(rng, int(rng.integers(2, 12)))}</h1>" if rng.random() < 0.8 else ""
    for _ in range(rng.integers(0 if inner else 1, 10)):
        inner += paragraph()
        if rng.random() < 0.08:
            inner += _boilerplate(rng)
    if rng.random() < 0.25:
        inner += _boilerplate(rng)
    before = "".join(_boilerplate(rng) for _ in range(rng.integers(0, 5)))
    after = "".join(_boilerplate(rng) for _ in range(rng.integers(0, 5)))
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{_wrap(rng, MAIN, inner)}{after}" + "</body></html>" * int(rng.integers(2))


@dataclass(frozen=True)
class ChainField:
    names: dict[str, int]
    unary: np.ndarray       # features x 2
    transition: np.ndarray  # 2 x 2

    def scores(self, chain: list[Block]) -> np.ndarray:
        known = self.names
        return np.array([self.unary[[known[f] for f in facts if f in known]].sum(axis=0) for facts in block_facts(chain)])

    def decode(self, chain: list[Block]) -> list[int]:
        """Viterbi: the best label sequence (1: text of the article)."""
        if not chain:
            return []
        score, t = self.scores(chain).tolist(), self.transition.tolist()
        best, back = score[0], []
        for s in score[1:]:
            from_one = [best[1] + t[1][y] > best[0] + t[0][y] for y in (0, 1)]
            back.append(from_one)
            best = [max(best[0] + t[0][y], best[1] + t[1][y]) + s[y] for y in (0, 1)]
        label = int(best[1] > best[0])
        out = [label]
        for from_one in reversed(back):
            label = int(from_one[label])
            out.append(label)
        return out[::-1]


def log_marginals(score: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: label probabilities (n x 2), and of neighbours, summed (2 x 2)."""
    n = len(score)
    fore, rear = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = score[0]
    for i in range(1, n):
        fore[i] = score[i] + np.logaddexp(fore[i - 1, 0] + t[0], fore[i - 1, 1] + t[1])
    for i in range(n - 2, -1, -1):
        step = rear[i + 1] + score[i + 1]
        rear[i] = np.logaddexp(t[:, 0] + step[0], t[:, 1] + step[1])
    z = np.logaddexp(fore[-1, 0], fore[-1, 1])
    pairs = np.exp(fore[:-1, :, None] + t[None] + (score[1:] + rear[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return np.exp(fore + rear - z), pairs


def train(pages: list[str], epochs: int = 4, rate: float = 0.25, decay: float = 1e-5, seed: int = 2) -> ChainField:
    """AdaGrad on the log-likelihood of labelled pages."""
    chains = [c for c in map(blocks, pages) if c]
    labels = [np.array([int(LABEL in b.text) for b in c]) for c in chains]
    chains = [[Block(b.text.replace(LABEL, "") or "x", b.path, b.linked) for b in c] for c in chains]
    facts = [block_facts(c) for c in chains]
    names = {f: i for i, f in enumerate(sorted({f for c in facts for b in c for f in b}))}
    rows = [[np.array([names[f] for f in b]) for b in c] for c in facts]
    unary, transition = np.zeros((len(names), 2)), np.zeros((2, 2))
    square_u, square_t = np.full(unary.shape, 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y = labels[k]
            score = np.array([unary[r].sum(axis=0) for r in rows[k]])
            p, pairs = log_marginals(score, transition)
            wrong = p.copy()
            wrong[np.arange(len(y)), y] -= 1
            for r, g in zip(rows[k], wrong):
                square_u[r] += g * g
                unary[r] -= rate * (g / np.sqrt(square_u[r]) + decay * unary[r])
            np.subtract.at(pairs, (y[:-1], y[1:]), 1)
            square_t += pairs * pairs
            transition -= rate * pairs / np.sqrt(square_t)
    return ChainField(names, unary, transition)


def main_text(page: str, field: ChainField) -> str:
    chain = blocks(page)
    return "\n".join(b.text for b, y in zip(chain, field.decode(chain)) if y)


def extract_text(pages: DataFrame, training_pages: int = 700, seed: int = 4) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the article's blocks, one a
    line, from the whole page.

    Null or empty html gives empty text; plain text without tags is one block;
    unclosed tags, comments and quotes end with the page. Repeated rows get equal
    results, null ids and urls are kept, other columns are ignored, an empty
    table gives an empty result. ``training_pages`` labelled pages are laid out
    by ``labelled_page``.
    """
    rng = np.random.default_rng(seed)
    field = train([labelled_page(rng) for _ in range(training_pages)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py() or "", field) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
