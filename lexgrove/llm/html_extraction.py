"""Main-text extraction from HTML by minimum-cut labelling.

A page is scanned once into text blocks (runs of text that no block element
interrupts), each with the elements it lies in.  A linear classifier turns a
block's features (length, share of link text, punctuation, kind of element, meaning
of the elements and class names around it) into a cost for each label, which become
the capacities of its edges to the two terminals.  Neighbouring blocks and blocks with
the same parent are joined by smoothness edges.  The minimum cut, found by maximum
flow, separates content from boilerplate.

Costs and edges are fitted to the pages at hand.  Pages carry no labels, so a bounded
sample of them gives weak ones by structure: the blocks that lie in the same elements
on several pages are content where their texts are long, hardly ever repeat and are no
links, and boilerplate where they repeat, are short or are links.  The classifier is the
posterior mode of a logistic regression on these labels around stated weights, and an
edge is the log odds that two blocks so related have one label.  The sample counts as
EVIDENCE blocks however large it is, so that odd pages move the weights only so far.

Before the flow is run, blocks whose own cost outweighs all their smoothness edges
are fixed (every minimum cut agrees with them) and folded into their neighbours'
costs; few blocks are usually left.  Where several cuts are minimal, the one with the
fewest content blocks is taken.

The text of a page: character references decoded, white space inside a block one
space, ends trimmed, content blocks in page order joined by one space.  A null or
empty page, and one without content, has the empty text.  Unclosed elements end with
their parents; an unfinished tag or comment at the end is dropped.  Extra columns are
ignored, repeated rows are each extracted, and an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkernel as K
from .columns import every, texts_of

# Element names and class words by meaning.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg annotation annotation-xml iframe object textarea select option head title canvas button video audio datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
APART = frozenset("nav footer aside form menu dialog search".split())
GOOD_WORDS = frozenset("article articlebody body content entry main post prose story text".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense alert banner bio breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright cta dialog discussion disqus dropdown footer footnav form gdpr login masthead menu meta modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promotion recommended recommendations related replies reply respond responses search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription tags teaser toolbar tooltip topbar warning widget widgets".split()
)
# Words that also name parts of an article: inside the main element they are evidence that length and sentences outweigh.
WEAK_WORDS = frozenset("alert banner bio byline copyright dialog discussion dropdown footer form meta notice overlay pager search tags teaser tooltip warning".split())
WEAK = -0.35
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

# The classifier before it has seen pages: what each feature adds to a block's score (above 0: content).
STATED = {
    "always": -1.5,
    "length, up to 12 words": 4.0,
    "a sentence's end": 1.0,
    "share of link text": -5.0,
    "in the main element": 3.0,
    "outside it where there is one": -5.0,
    "good class around it": 2.5,
    "heading": 1.0,
    "list item": -0.5,
    "table cell": -0.3,
    "rights": -3.0,
    "page header": -6.0,
    "element or class apart": -12.0,
}
WORDS_AT = 12
# Smoothness: page neighbours with the same parent, the same grandparent or neither; siblings.
EDGES = (1.0, 0.5, 0.15, 0.4)
SAME, NEAR, FAR, SIBLING = range(4)
#: Pages of the sample, bytes that a page of it has at most, and how many blocks the sample counts as.
SAMPLE_PAGES, LONGEST_PAGE, EVIDENCE = 300, 32 << 10, 200
#: Spread of the weights around the stated ones, and weight of a stated edge in pairs of blocks.
SPREAD, EDGE_PAIRS = 1.0, 100
UNIT = 1000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Element:
    """An open element: its parent, name, meaning (-1 apart, 0, 1 good) and whether main text or links hold it."""

    __slots__ = ("parent", "name", "bad", "good", "main", "header")

    def __init__(self, parent, name, bad, good, main, header):
        self.parent, self.name, self.bad, self.good, self.main, self.header = parent, name, bad, good, main, header


def _element(parent: Element, name: str, attributes: str) -> Element:
    bad, good, hidden, weak = 0.0, False, False, False
    if name in APART:
        bad = WEAK if name == "footer" and parent.main else -1.0
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))}
                if words & BAD_WORDS:
                    weak = True
                    if not parent.main or not words & BAD_WORDS <= WEAK_WORDS:
                        bad = min(bad, -1.0)
                good = good or bool(words & GOOD_WORDS)
            elif key == "role":
                bad = min(bad, -1.0) if value.lower() in BAD_ROLES else bad
                good = good or value.lower() == "main"
            elif key == "style":
                hidden = hidden or "display:none" in value.replace(" ", "").lower()
            else:
                hidden = hidden or key == "hidden" or value.lower() == "true"
    if weak and not good:
        bad = min(bad, WEAK)
    if name in ("html", "body", *MAIN) and not hidden:
        bad = bad if name in MAIN and bad else 0.0
    main = parent.main or (name in MAIN and not bad)
    return Element(parent, name, min(parent.bad, bad, -1.0 if hidden else 0.0), parent.good or (good and not bad and name not in ("html", "body")), main, parent.header or (name == "header" and not main))


class Weights:
    """The classifier's weights, in the order of STATED, and the edges' capacities."""

    __slots__ = ("score", "edges")

    def __init__(self, score=tuple(STATED.values()), edges=EDGES):
        self.score, self.edges = tuple(score), tuple(edges)


class Block:
    __slots__ = ("text", "words", "linked", "element")

    def __init__(self, text, words, linked, element):
        self.text, self.words, self.linked, self.element = text, words, linked, element


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    top = Element(None, "", 0.0, False, False, False)
    here, out = top, []
    text: list[str] = []
    links: list[str] = []
    in_link, at, end = 0, 0, len(page)
    skip = None

    def close() -> None:
        nonlocal in_link
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, joined.count(" ") + 1, len("".join(links).split()), here))
        text.clear(), links.clear()

    held: dict[str, int] = {}  # open elements by name, so that an unmatched end costs no walk

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if skip is None and stop > at:
            text.append(page[at:stop])
            if in_link:
                links.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if not name:
            if skip is None and m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        ends = page[m.start() + 1] == "/"
        if skip is not None:
            if name == skip[0]:
                skip = (name, skip[1] + (-1 if ends else 1))
                if not skip[1]:
                    skip = None
            elif skip[0] == "head" and name in ("body", *MAIN, "div", "p", "h1", "header", "nav"):
                skip = None
            if skip is not None or ends:
                continue
        if name in SKIPPED and not ends:
            if name in BLOCKS or name == "head":
                close()
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = found.end() if found else end
            elif not m[0].endswith("/>"):
                skip = (name, 1)
            continue
        if name == "a":
            in_link = 0 if ends else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        inline = name not in BLOCKS
        if inline and (name in VOID or not ends and "=" not in (m[2] or m[4] or "") and "hidden" not in (m[2] or m[4] or "")):
            continue  # an inline element without attributes changes nothing
        if not inline:
            close()
        if ends:
            if held.get(name):
                up, crossed = here, False
                while up.name != name:
                    crossed = crossed or up.name in BLOCKS
                    if inline and crossed:
                        break
                    up = up.parent
                if inline and crossed:
                    continue
                if inline and up.bad < up.parent.bad:
                    close()
                while here is not up.parent:
                    held[here.name] -= 1
                    here = here.parent
                if not inline:
                    in_link = 0
            continue
        if not inline:
            if here.name == "p" or name in _CLOSED_BY and here.name in _CLOSED_BY[name]:
                held[here.name] -= 1
                here = here.parent
            while here is not top and here.name not in BLOCKS:
                held[here.name] -= 1
                here = here.parent  # unclosed inline elements end with the block
        if name in VOID:
            continue
        new = _element(here, name, m[2] or m[4] or "")
        if inline:
            if new.bad >= here.bad:
                continue
            close()
        here = new
        held[name] = held.get(name, 0) + 1
    close()
    return out


def features(block: Block, has_main: bool) -> tuple[float, ...]:
    """What the classifier sees of a block, in the order of STATED."""
    e = block.element
    return (
        1.0,
        min(1.0, block.words / WORDS_AT),
        float(block.words >= 5 and block.text[-1] in ".!?…\"'»”:;。"),
        min(1.0, block.linked / block.words),
        float(e.main),
        float(has_main and not e.main),
        float(e.good),
        float(e.name in HEADINGS),
        float(e.name in ("li", "dt", "dd")),
        float(e.name in ("td", "th")),
        float(block.words <= 25 and ("©" in block.text or "all rights reserved" in block.text.lower())),
        float(e.header),
        -e.bad,
    )


def score(block: Block, has_main: bool, weights: Weights = Weights()) -> float:
    """How much the classifier favours content for a block."""
    return sum(w * x for w, x in zip(weights.score, features(block, has_main)))


def related(found: list[Block]) -> dict[tuple[int, int], int]:
    """Pairs of blocks that are joined, and how: SAME, NEAR, FAR or SIBLING."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.element.parent
        if i:
            a = found[i - 1].element
            near = a is b.element or a.parent is parent
            shares = near or a.parent is not None and parent is not None and a.parent.parent is parent.parent or a is parent or a.parent is b.element
            out[i - 1, i] = SAME if near else NEAR if shares else FAR
        key = id(parent)
        if key in last and last[key] != i - 1:
            out[last[key], i] = SIBLING
        last[key] = i
    return out


def edges(found: list[Block], weights: Weights = Weights()) -> dict[tuple[int, int], int]:
    """Smoothness capacities between blocks."""
    return {pair: round(UNIT * weights.edges[kind]) for pair, kind in related(found).items()}


def minimum_cut(costs: list[int], joined: dict[tuple[int, int], int]) -> list[bool]:
    """The labels (True: content) of a minimum cut with the fewest True.

    costs: above 0 what labelling a node False costs, below 0 what True costs.
    """
    n = len(costs)
    costs = list(costs)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in joined.items():
        around[i][j] = around[i].get(j, 0) + c
        around[j][i] = around[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    total = [sum(a.values()) for a in around]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or not (costs[i] > total[i] or costs[i] <= -total[i]):
            continue
        label[i] = costs[i] > total[i]
        for j, c in around[i].items():
            if label[j] is None:
                costs[j] += c if label[i] else -c
                total[j] -= c
                todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        place = {v: k for k, v in enumerate(left)}
        source, sink = len(left), len(left) + 1
        flow: list[dict[int, int]] = [{} for _ in range(len(left) + 2)]
        for i in left:
            if costs[i] > 0:
                flow[source][place[i]] = costs[i]
                flow[place[i]].setdefault(source, 0)
            elif costs[i] < 0:
                flow[place[i]][sink] = -costs[i]
                flow[sink].setdefault(place[i], 0)
            for j, c in around[i].items():
                if label[j] is None:
                    flow[place[i]][place[j]] = c
        reached = _max_flow(flow, source, sink)
        for i in left:
            label[i] = reached[place[i]]
    return label


def _max_flow(flow: list[dict[int, int]], source: int, sink: int) -> list[bool]:
    """Dinic's algorithm on residual capacities; which nodes the source still reaches."""
    while True:
        level = [-1] * len(flow)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in flow[i].items():
                if c > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if level[sink] < 0:
            return [x >= 0 for x in level]
        todo = [iter(list(f)) for f in flow]
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(flow[a][b] for a, b in zip(path, path[1:]))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    flow[a][b] -= push
                    flow[b][a] = flow[b].get(a, 0) + push
                    if cut is None and not flow[a][b]:
                        cut = k
                del path[cut + 1 :]
                todo[path[-1]] = iter(list(flow[path[-1]]))
                continue
            for j in todo[i]:
                if flow[i][j] > 0 and level[j] == level[i] + 1:
                    path.append(j)
                    break
            else:
                level[i] = -1
                path.pop()


def labelled(page: str | None, weights: Weights = Weights()) -> tuple[list[Block], list[bool], list[bool]]:
    """(blocks of a page, whether the cut makes each content, whether its own cost alone would)."""
    found = blocks(page or "")
    has_main = any(b.element.main and not b.element.bad for b in found)
    costs = [round(UNIT * score(b, has_main, weights)) for b in found]
    return found, minimum_cut(costs, edges(found, weights)), [c > 0 for c in costs]


def main_text(page: str | None, weights: Weights = Weights()) -> str:
    """The main text of one page."""
    found, labels, _ = labelled(page, weights)
    return " ".join(b.text for b, content in zip(found, labels) if content)


def _where(block: Block) -> int:
    """The elements that a block lies in, hashed."""
    names, e = [], block.element
    while e.parent is not None:
        names.append(e.name)
        e = e.parent
    return zlib.crc32("/".join(names).encode()) << 2 | block.element.good << 1 | (block.element.bad < 0)


def _structure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, its blocks' places, texts (hashed), features and relations."""
    for batch in batches:
        for part in K.slices(batch, 0):
            out = []
            for page in part.column(0).to_pylist():
                found = blocks(page or "")
                has_main = any(b.element.main and not b.element.bad for b in found)
                pairs = [(i, j, kind) for (i, j), kind in related(found).items()]
                out.append((np.array([features(b, has_main) for b in found], "<f4").tobytes(), np.array([(_where(b), zlib.crc32(b.text.encode())) for b in found], "<i8").tobytes(), np.array(pairs, "<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(c, pa.binary()) for c in zip(*out))], [*part.schema.names[1:], "seen", "places", "pairs"])


def fit(pages: DataFrame, ids: tuple[str, ...] = ("page_id", "url"), sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights fitted to the pages: sample_pages of them at most, of LONGEST_PAGE bytes at most, chosen by a hash.

    Pages that share a hash (repeated rows) count as one.
    """
    order = F.xxhash64(*every(ids), F.col("html").cast("string"))
    short = pages.where(F.octet_length(F.col("html").cast("string")) <= LONGEST_PAGE)
    # the hashes alone are put in order; their largest chosen one then picks the pages
    last = short.select(order.alias("h")).distinct().orderBy("h").limit(sample_pages).agg(F.max("h").alias("h")).first().h
    if last is None:
        return Weights()
    rows = short.where(order <= last).select(F.col("html").cast("string").alias("html"), order.alias("h")).dropDuplicates(["h"])
    got = rows.mapInArrow(_structure, "h long, seen binary, places binary, pairs binary").toArrow().sort_by([("h", "ascending"), ("seen", "ascending")])
    return learn([(np.frombuffer(a, "<f4").reshape(-1, len(STATED)), np.frombuffer(b, "<i8").reshape(-1, 2), np.frombuffer(c, "<i4").reshape(-1, 3)) for a, b, c in zip(*(got[x].to_pylist() for x in ("seen", "places", "pairs")))])


def weak_labels(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """1 content, 0 boilerplate, -1 unknown for all blocks of the pages, by what blocks in the same place are like.

    Places that elements or classes set apart stay unknown: comments are as long and as
    seldom repeated as an article, so nothing but these names tells them, and labels made of
    the names would only fit the names' own weights to themselves.
    """
    seen, places = np.concatenate([p[0] for p in pages]), np.concatenate([p[1] for p in pages])
    page = np.repeat(np.arange(len(pages)), [len(p[0]) for p in pages])
    place, which = np.unique(places[:, 0], return_inverse=True)
    n = np.bincount(which)
    mean = lambda column: np.bincount(which, seen[:, column]) / n
    texts = np.bincount(np.unique(np.stack([which, places[:, 1]], axis=1), axis=0)[:, 0], minlength=len(place)) / n
    on = np.bincount(np.unique(np.stack([which, page], axis=1), axis=0)[:, 0], minlength=len(place))
    length, links, told = mean(1), mean(3), mean(12) + mean(11)
    content = (texts >= 0.9) & (length >= 0.8) & (links <= 0.2)
    other = (texts <= 0.5) | (length < 0.4) & (links >= 0.5)
    label = np.where((on < 3) | (told > 0), -1, np.where(content, 1, np.where(other, 0, -1)))
    return label[which]


def learn(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Weights:
    """The weights of pages given as (features of the blocks, their places and texts, related pairs)."""
    pages = [p for p in pages if len(p[0])]
    stated = np.array(list(STATED.values()))
    if not pages:
        return Weights()
    label = weak_labels(pages)
    x, y = np.concatenate([p[0] for p in pages])[label >= 0].astype(np.float64), label[label >= 0]
    w = stated.copy()
    if len(y):
        many = np.array([(y == k).sum() for k in (0, 1)])
        share = EVIDENCE / (many > 0).sum() / many[y]  # either label weighs the same
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (share * (p - y)) + (w - stated) / SPREAD**2
            curve = x.T @ (x * (share * p * (1 - p))[:, None]) + np.eye(len(w)) / SPREAD**2
            step = np.linalg.solve(curve, slope)
            w -= step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
    first = np.cumsum([0, *(len(p[0]) for p in pages)])
    pairs = np.concatenate([p[2] + [[at, at, 0]] for p, at in zip(pages, first.tolist())])
    a, b = label[pairs[:, 0]], label[pairs[:, 1]]
    capacity = []
    for kind, before in enumerate(EDGES):
        known = (pairs[:, 2] == kind) & (a >= 0) & (b >= 0)
        n = min(int(known.sum()), EVIDENCE)
        agree = (a[known] == b[known]).mean() if n else 0.5
        share = (EDGE_PAIRS / (1 + np.exp(-before)) + n * agree) / (EDGE_PAIRS + n)
        capacity.append(max(0.0, float(np.log(share / (1 - share)))))
    return Weights(w.tolist(), capacity)


def _extract(batches: Iterator[pa.RecordBatch], weights: Weights, at: int, skip: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, at):
            texts = [main_text(x, weights) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[skip:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[skip:], "text", "n_chars"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), weights: Weights | None = None) -> DataFrame:
    """The columns to keep, with text and n_chars of each whole page, by the given weights or those fitted to the pages."""
    weights = fit(pages, keep) if weights is None else weights
    rows, schema, at, skip = texts_of(pages, keep, "html")
    return rows.mapInArrow(partial(_extract, weights=weights, at=at, skip=skip), StructType(list(schema)).add("text", "string").add("n_chars", "long")).toDF(*keep, "text", "n_chars")
