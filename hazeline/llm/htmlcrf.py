"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 5).

A page is cut into leaf blocks: runs of text between block-level tags. Features of a block are the tags and the words
in class and id names of its ancestors, and its text: length, share of linked text, final sign. A chain model with two
labels scores blocks and the steps between neighbours; Viterbi gives the best labels. It is trained on labelled pages
(``mainpages``) by stochastic gradients of the likelihood, with forward and backward sums.

Defined results: null and empty pages, and pages without an article, have the empty text. Unclosed tags, stray end tags
and missing ends of script or comment are read as browsers do, up to the end of the page. Bodies of scripts and other raw
text are skipped to their end tag without looking for tags in them; a head ends at its end tag or at the first tag or
text that does not belong there. Formulas and drawings (``math``, ``svg``) and what ``object`` and ``canvas`` hold are text
of the block around them. White space is that of Unicode, so that no-break spaces count. Time grows with the page's length,
however many tags it leaves open or nests. Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Container, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from hazeline.llm.mainpages import labelled_pages

# Names of HTML elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var br wbr img object param canvas".split())
SILENT = frozenset("script style noscript template textarea select button iframe title head".split())
RAW = frozenset("script style template textarea title noscript iframe noframes".split())  # up to their end tag
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FOREIGN = frozenset("svg math".split())  # what they hold is read as inline, up to one of these tags
BREAKOUT = frozenset("blockquote body center dd div dl dt embed h1 h2 h3 h4 h5 h6 head hr li listing menu meta ol p pre ruby "
                     "table ul".split())
SCOPES = frozenset("ul ol dl table tbody thead tr div section article main aside nav body".split())

OPEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
STOP = re.compile("[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|$)", re.I) for tag in RAW}
NAMED = re.compile(r"\b(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    tag: str  # of the innermost open element
    tags: frozenset[str]  # of all open elements
    names: frozenset[str]  # words of their class, id and role
    linked: int  # characters inside links
    label: int


class Element(NamedTuple):
    """An open element with what it and those around it hand down; sets are shared where an element adds nothing."""

    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    label: int
    scope: int  # place of the nearest element that bounds the search for open paragraphs and the like


class TagEnds:
    """Ends of the tags of a page. What led to no end once is not read again, so all tags together take linear time."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.begin, self.stop = 0, -1  # the first stop after ``begin`` is at ``stop``
        self.last = {sign: page.rfind(sign) for sign in "\"'>"}

    def after(self, at: int) -> int:
        """Place of the ">" of the tag whose attributes begin at ``at``, beyond its quoted values, or -1."""
        page, seen = self.page, []
        if not self.begin <= at <= self.stop:
            self.begin, self.stop = at, self._next(at)
        stop = self.stop
        while self.last[">"] >= stop and stop not in self.dead:
            sign = page[stop]
            if sign == ">":
                return stop
            seen.append(stop)
            if self.last[sign] <= stop:
                break
            stop = self._next(page.index(sign, stop + 1) + 1)
        self.dead.update(seen)
        return -1

    def _next(self, at: int) -> int:
        found = STOP.search(self.page, at)
        return found.start() if found else len(self.page)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order; tags and names whose features are not ``known`` are left out of their sets."""
    out: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    top = Element("", frozenset(), frozenset(), 0, -1)
    text: list[str] = []
    linked, links, at, look, silent, foreign = 0, 0, 0, 0, "", 0
    ends = TagEnds(page)

    def flush() -> None:
        nonlocal text, linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            own = stack[-1] if stack else top
            out.append(Block(joined, own.tag, own.tags, own.names, min(linked, len(joined)), own.label))
        text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked, silent
        if silent == "head" and piece.strip():
            silent = ""
        if piece and not silent:
            text.append(piece)
            if links:
                linked += len(piece)

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    def among(old: frozenset[str], new: Iterable[str], kind: str) -> frozenset[str]:
        more = {x for x in new if x not in old and (known is None or f"{kind}={x}" in known)}
        return old | more if more else old

    while m := OPEN.search(page, look):
        start, end, attributes = m.start(), m.end(), ""
        if m[0] in ("<!", "<?"):
            end = page.index(">", end) + 1 if ends.last[">"] >= end else -1
        elif m[2] is not None:
            stop = ends.after(end)
            attributes, end = page[end: stop], stop + 1 if stop >= 0 else -1
        if end < 0:
            look = start + 1
            continue
        add(page[at: start])
        at = look = end
        if m[2] is None:
            continue
        tag, closing, empty = m[2].lower(), bool(m[1]), attributes.endswith("/")
        if silent == "head" and (tag in ("head", "body", "html") if closing else tag not in HEAD and tag not in ("head", "html")):
            silent = ""
            if closing and tag == "head":
                continue
        if not closing and tag in RAW and not (empty and foreign):
            found = RAW_END[tag].search(page, at)
            at = look = found.end() if found else len(page)
            if not silent and tag not in ("script", "style") and not foreign:
                flush()
            continue
        if silent:
            if closing and tag == silent:
                silent = ""
            continue
        if tag in SILENT and not closing:
            if not empty:
                silent = tag
            if not foreign:
                flush()
            continue
        if tag in FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not empty)
            continue
        if foreign:
            if tag not in BREAKOUT or closing:
                text.append("" if tag in INLINE else " ")
                continue
            foreign = 0
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        links = 0
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in SELF_CLOSING:
            nearest = max((places[t][-1] for t in SELF_CLOSING[tag] if places.get(t)), default=-1)
            if nearest >= 0 and nearest >= stack[-1].scope:
                close(nearest)
        elif stack and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in VOID or empty:
            continue
        own = stack[-1] if stack else top
        words, label = set(), own.label
        for name, *values in NAMED.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "data-main":
                label = int(value == "1")
            else:
                words.update(NAME_WORD.findall(value))
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, among(own.tags, (tag,), "in"), among(own.names, words, "name"), label,
                             len(stack) if tag in SCOPES else own.scope))
    add(page[at:])
    flush()
    return out


def features(block: Block, place: float) -> list[str]:
    """Names of the features that a block has."""
    n = len(block.text)
    words = block.text.count(" ") + 1
    share = block.linked / n
    out = ["1", f"tag={block.tag}", f"len={min(6, int(math.log2(words + 1)))}",
           f"link={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
           f"end={'.' if block.text[-1] in '.!?:' else 'w'}", f"place={int(place * 3)}"]
    out += [f"in={tag}" for tag in block.tags]
    out += [f"name={word}" for word in block.names]
    if "©" in block.text:
        out.append("copyright")
    if words < 4:
        out.append(f"short,in={block.tag}")
    return out


class Chain(NamedTuple):
    """Weights of features for the label "main", and of steps between labels."""

    weights: dict[str, float]
    steps: list[list[float]]

    def scores(self, page: list[Block]) -> tuple[list[list[str]], list[float]]:
        n, get = len(page), self.weights.get
        found = [features(b, i / n) for i, b in enumerate(page)]
        return found, [sum(get(f, 0.0) for f in fs) for fs in found]

    def labels(self, page: list[Block]) -> list[int]:
        """The best labels by Viterbi."""
        if not page:
            return []
        _, scores = self.scores(page)
        best, back = [0.0, scores[0]], []
        for s in scores[1:]:
            into = [max((best[a] + self.steps[a][b], a) for a in (0, 1)) for b in (0, 1)]
            back.append((into[0][1], into[1][1]))
            best = [into[0][0], into[1][0] + s]
        label = int(best[1] > best[0])
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def trained(pages: list[str], epochs: int = 8, rate: float = 0.2, decay: float = 1e-4) -> Chain:
    """The chain model of labelled pages by gradient steps, one page at a time."""
    chain = Chain({}, [[0.0, 0.0], [0.0, 0.0]])
    w, t = chain.weights, chain.steps
    parsed = [b for b in map(blocks, pages) if b]
    for epoch in range(epochs):
        pace = rate / (1 + epoch)
        for page in parsed:
            found, s = chain.scores(page)
            n = len(page)
            ahead, behind = [[0.0, s[0]]], [[0.0, 0.0]]
            for i in range(1, n):
                p = ahead[-1]
                ahead.append([_log_sum(p[0] + t[0][b], p[1] + t[1][b]) + b * s[i] for b in (0, 1)])
            for i in range(n - 1, 0, -1):
                q = behind[-1]
                behind.append([_log_sum(t[a][0] + q[0], t[a][1] + s[i] + q[1]) for a in (0, 1)])
            behind.reverse()
            whole, old = _log_sum(*ahead[-1]), [t[0][:], t[1][:]]
            for i, block in enumerate(page):
                gap = pace * (block.label - math.exp(min(0.0, ahead[i][1] + behind[i][1] - whole)))
                for f in found[i]:
                    w[f] = w.get(f, 0.0) * (1 - decay) + gap
                if i:
                    for a in (0, 1):
                        for b in (0, 1):
                            p = math.exp(min(0.0, ahead[i - 1][a] + old[a][b] + b * s[i] + behind[i][b] - whole))
                            t[a][b] += pace * ((page[i - 1].label == a and block.label == b) - p)
    return chain


def main_text(chain: Chain, page: str) -> str:
    found = blocks(page, chain.weights)
    return " ".join(b.text for b, label in zip(found, chain.labels(found)) if label)


def _extracted(weights: dict, steps: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(weights, steps)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(chain, page or "") for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])
    return run


def extracted(pages: DataFrame, train_pages: int = 400, seed: int = 11) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    chain = trained(labelled_pages(train_pages, seed))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        _extracted(chain.weights, chain.steps), f"page_id {kind}, url string, text string, n_chars bigint")
