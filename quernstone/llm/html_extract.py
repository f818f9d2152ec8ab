"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed to a tree of elements (implied end tags and unknown markup are tolerated).
Each element has features: size and density of text and links in its subtree, its depth,
place among siblings and how they resemble it, its kind, the first token of its class, id and role (hashed),
and of all such tokens of it and its ancestors what they hint at (advertising, navigation, content ...). Boosted trees (numpy, logistic loss, histograms) say how likely an element is
main content. Hierarchical decoding then picks the set of elements that gains most, none of
which contains another: an element is taken whole, or its children are decided, never both.

The trees are fitted on a bounded sample of pages (MAX_PAGES) that say themselves where their content
is: elements inside `article` or `main` are content, those outside aren't. Features don't see
these two tags (nor `header`, `footer`, `nav`, `aside`), so the trees tell content on other pages too.

Defined results:
- `text` is the text of the picked elements in order, a line for each block; runs of spaces count as one.
- A null page has a null text; an empty one, or one without markup or content, the empty text.
- Whatever the markup is and however long or deep, parsing takes time in proportion; what can't be a tag is text.
- Without any page that says where its content is, all text of the body is content.
- Ids may repeat, as rows may; every row counts, and in the sample one page of an id. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.runtime import hashed, need, one_text, pick

#: Bound of the sample that the trees are fitted on.
MAX_PAGES = 400
TREES, DEPTH, RATE, BINS = 30, 4, 0.3, 32

#: Text, or a tag whose attributes have no `<`: nearly all there is.
_PLAIN = re.compile(r"([^<]+)|<(/?)([a-zA-Z][^\s/>\"'<]*)(?=[\s/>])((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title"))
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in _RAW}
_SILENT = frozenset(("script", "style", "noscript", "template", "head", "title", "svg", "select", "option", "button"))
#: An opening tag ends an open element of these kinds.
_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {b: frozenset(("p",)) for b in _BLOCK} | {"li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
_STOP = frozenset(("ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "nav", "td", "th", "blockquote", "aside", "header", "footer"))
_LINES = _BLOCK | {"li", "br", "tr", "td", "th", "dt", "dd", "body"}
_SHAPE = ("p", "div", "section", "li", "ul", "ol", "a", "b", "i", "em", "strong", "span", "h1", "h2", "h3", "h4", "table", "tr", "td", "pre", "blockquote", "img", "form", "figure", "body", "html")
_HINTS = tuple(re.compile(p) for p in (r"(?:^|\W)ads?(?:\W|$)|advert|sponsor|promo|banner", r"nav|menu|crumb", r"foot|copyright", r"head|logo|masthead", r"comment|reply", r"side|related|widget|share|social", r"content|article|post|body|entry|main|text|story"))
_SELF = frozenset(("article", "main"))


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    items: list[int | str] = field(default_factory=list)  # children's numbers and pieces of text


class Scanner:
    """Tags and text of a page, in one pass forward.

    What is looked for (the next `>`, quote, end of a name) is remembered until the scan has passed it, and a place
    from which a tag can't end isn't tried from again; so the time is linear, whatever the page is.
    """

    def __init__(self, page: str) -> None:
        self.page, self.size = page, len(page)
        self._next: dict[str, int] = {}
        self._from: dict[str, int] = {}
        self._name_end = -1
        self._dead: set[int] = set()

    def tag_end(self, start: int) -> int:
        """The `>` that ends the tag whose attributes begin at start, not in quotes; -1: there is none."""
        page, at, tried = self.page, start, []
        while True:
            end = self._ahead(">", at)
            quote = min(self._ahead('"', at), self._ahead("'", at))
            if end < quote:
                return end
            if end == self.size or quote in self._dead:
                break
            tried.append(quote)
            close = page.find(page[quote], quote + 1)
            if close < 0:
                break
            at = close + 1
        self._dead.update(tried)
        return -1

    def _ahead(self, what: str, start: int) -> int:
        """Where `what` is next, from start on, or the page's end; what was found from an earlier start holds up to there."""
        at = self._next.get(what, -1)
        if start <= at and self._from.get(what, 0) <= start:
            return at
        at = self.page.find(what, start)
        at = self.size if at < 0 else at
        self._next[what], self._from[what] = at, start
        return at

    def tokens(self) -> Iterator[tuple[int, str, str]]:
        """(kind, name or text, attributes) with kind 0 for text, 1 for an opening tag, 2 for a closing one, 3 for what is inside a raw element."""
        page, size, at = self.page, self.size, 0
        while at < size:
            m = _PLAIN.match(page, at)
            if m:
                at = m.end()
                if m[1] is not None:
                    yield 0, m[1], ""
                    continue
                shut, name, attributes = m[2], m[3].lower(), m[4]
            else:
                second = page[at + 1 : at + 2]
                if page.startswith("<!--", at):
                    end = self._ahead("-->", at + 4)
                    at = min(size, end + 3)
                    continue
                if second in ("!", "?"):
                    end = self._ahead(">", at + 1)
                    if end < size:
                        at = end + 1
                        continue
                shut = "/" if second == "/" else ""
                begin = at + 1 + len(shut)
                letter = page[begin : begin + 1]
                end = -1
                if letter.isascii() and letter.isalpha() and self._ahead(">", begin) < size:
                    if self._name_end < begin:
                        found = _NAME_END.search(page, begin)
                        self._name_end = found.start() if found else size
                    end = self.tag_end(self._name_end)
                if end < 0:  # no tag
                    yield 0, "<", ""
                    at += 1
                    continue
                name, attributes, at = page[begin : self._name_end].lower(), page[self._name_end : end], end + 1
            if shut:
                yield 2, name, ""
                continue
            yield 1, name, attributes
            if name in _RAW:
                found = _RAW_END[name].search(page, at)
                end = self._ahead(">", found.end()) if found else size
                yield 3, page[at : found.start() if end < size else size], ""
                at = min(size, end + 1)


class Open:
    """The open elements, with the places of those of each kind, so that none has to be looked for."""

    def __init__(self) -> None:
        self.numbers, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}
        self.stops: list[int] = []

    def push(self, number: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.numbers))
        if tag in _STOP:
            self.stops.append(len(self.numbers))
        self.numbers.append(number)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        """Closes the elements from that place on."""
        while len(self.numbers) > place:
            self.numbers.pop()
            self.places[self.tags.pop()].pop()
        while self.stops and self.stops[-1] >= place:
            self.stops.pop()

    def last(self, tags: frozenset[str] | tuple[str, ...]) -> int:
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)


def parse(page: str) -> list[Node]:
    """Elements in document order; the first is the root."""
    nodes = [Node("#root", -1, 0)]
    stack = Open()
    for kind, name, attributes in Scanner(page).tokens():
        if kind == 0:
            nodes[stack.numbers[-1]].items.append(name)
        elif kind == 3:
            nodes[-1].items.append(name)
        elif kind == 2:
            place = stack.last((name,))
            if place:
                stack.cut(place)
        else:
            ends = _ENDS.get(name)
            if ends:
                place = stack.last(ends)
                if place and place >= (stack.stops[-1] if stack.stops else 0):
                    stack.cut(place)
            n = len(nodes)
            nodes[stack.numbers[-1]].items.append(n)
            nodes.append(Node(name, stack.numbers[-1], len(stack.numbers), attributes))
            if name not in _RAW and name not in _VOID and not (attributes.endswith("/") and name not in _BLOCK):
                stack.push(n, name)
    return nodes


N_FEATURES = 25


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters of text in each subtree, characters directly in each element)."""
    n = len(nodes)
    direct, links, below, children, commas = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    silent, hint, attr = [False] * n, [0] * n, [0] * n
    place, same, kinds = [0] * n, [0] * n, {}
    for k, node in enumerate(nodes):
        up = node.parent
        silent[k] = node.tag in _SILENT or (up >= 0 and silent[up])
        own = hint[up] if up >= 0 else 0
        if node.attributes:
            tokens = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(node.attributes)).lower()
            if tokens:
                own |= sum(1 << i for i, h in enumerate(_HINTS) if h.search(tokens))
                attr[k] = 1 + zlib.crc32(tokens.split(" ")[0].encode()) % 15
        hint[k] = own
        if up >= 0:
            place[k] = children[up]
            children[up] += 1
            kinds[up, node.tag] = kinds.get((up, node.tag), 0) + 1
        if not silent[k]:
            for x in node.items:
                if x.__class__ is str:
                    x = x.strip()
                    direct[k] += len(x)
                    commas[k] += x.count(",") + x.count(".")
    text, linked, stops = direct[:], [d if v.tag == "a" else 0 for d, v in zip(direct, nodes)], commas[:]
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent
        if nodes[k].tag == "a":
            linked[k] = text[k]
        text[up] += text[k]
        linked[up] += linked[k]
        stops[up] += stops[k]
        below[up] += 1 + below[k]
    rows = []
    for k, node in enumerate(nodes):
        up = max(0, node.parent)
        t, b, u, c = text[k], below[k] + 1, text[up], children[up] or 1
        tag = node.tag
        rows.append((_SHAPE_NUMBER.get(tag, -1), _SHAPE_NUMBER.get(nodes[up].tag, -1), node.depth, t, direct[k], t / b, linked[k] / (t or 1), stops[k] / (t or 1), below[k], children[k], place[k], place[k] / c, c, kinds.get((up, tag), 0) / c, t / (u or 1), linked[up] / (u or 1), u, attr[k], *[hint[k] >> i & 1 for i in range(len(_HINTS))]))
    return np.array(rows, dtype=np.float32), np.array(text), np.array(direct)


_SHAPE_NUMBER = {t: n for n, t in enumerate(_SHAPE)}


@dataclass
class Boosted:
    """Trees as arrays: feature and cut of each inner node in heap order, values of the leaves."""

    base: float
    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base, dtype=np.float64), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, rate: float = RATE) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        margin, inner = np.full(len(y), base), 2**DEPTH - 1
        out: tuple[list, list, list] = ([], [], [])
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * p * (1 - p)
            feature, cut, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf, dtype=np.float32), np.zeros(len(y), dtype=np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for f in range(x.shape[1]):
                    cell = (at - first) * (BINS + 1) + binned[:, f]
                    gl, hl = (np.bincount(cell, weights=v, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for v in (g, h))
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = (gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1))[:, : len(cuts[f])]
                    if not gain.shape[1]:
                        continue
                    where = gain.argmax(axis=1)
                    top = gain[np.arange(width), where]
                    better = top > best
                    best = np.where(better, top, best)
                    feature[first : first + width][better] = f
                    cut[first : first + width][better] = cuts[f][where[better]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            at -= inner
            leaf = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + 1)
            margin += leaf[at]
            for o, v in zip(out, (feature, cut, leaf)):
                o.append(v)
        return cls(base, *(np.array(o) for o in out))


def decode(nodes: list[Node], gain: np.ndarray) -> list[int]:
    """The elements, none within another, whose gains add up to most; of equal choices the outer element."""
    best = [0.0] * len(nodes)
    below = [0.0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        best[k] = max(gain[k], below[k])
        if k:
            below[nodes[k].parent] += best[k]
    out, covered = [], [False] * len(nodes)
    for k, node in enumerate(nodes):
        up = node.parent
        if up >= 0 and covered[up]:
            covered[k] = True
        elif best[k] > 0 and gain[k] >= below[k]:
            out.append(k)
            covered[k] = True
        elif best[k] <= 0:
            covered[k] = True  # nothing below is worth taking
    return out


def _text(nodes: list[Node], chosen: list[int]) -> str:
    out: list[str] = []
    work: list[int | str] = list(reversed(chosen))
    while work:
        x = work.pop()
        if x.__class__ is str:
            out.append(x)
            continue
        node = nodes[x]
        if node.tag in _SILENT:
            continue
        if node.tag in _LINES:
            out.append("\n")
            work.append("\n")
        work.extend(reversed([entities.unescape(i).replace("\n", " ") if i.__class__ is str else i for i in node.items]))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def labels_of(nodes: list[Node]) -> np.ndarray | None:
    """1 for elements inside article or main, 0 outside; 0 for what contains these; None if there is neither."""
    out = np.zeros(len(nodes), dtype=np.int64)
    found = False
    for k, node in enumerate(nodes):
        out[k] = node.tag in _SELF or (node.parent >= 0 and out[node.parent])
        found |= bool(out[k])
    return out if found else None


def says(page: str) -> bool:
    """Whether parse(page) has an article or main element."""
    return any(kind == 1 and name in _SELF for kind, name, _ in Scanner(page).tokens())


def extract(page: str, trees: Boosted | None) -> str:
    nodes = parse(page)
    if trees is None:
        return _text(nodes, [k for k, v in enumerate(nodes) if v.tag == "body"][:1] or [0])
    x, text, direct = features(nodes)
    return _text(nodes, decode(nodes, _gains(trees.margin(x), nodes, text, direct)))


def _gains(margin: np.ndarray, nodes: list[Node], text: np.ndarray, direct: np.ndarray) -> np.ndarray:
    """What taking an element whole gains: each character in it counts by the mean opinion of the elements around it up to this one."""
    p = np.tanh(margin / 2)  # from -1 to 1
    # characters directly in an element are judged by its own margin; the whole element's judgement weighs as much
    below = (p * direct).tolist()
    for k in range(len(nodes) - 1, 0, -1):
        below[nodes[k].parent] += below[k]
    return (p * text + np.array(below)) / 2


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", max_pages: int = MAX_PAGES) -> Boosted | None:
    """Trees of at most max_pages of the pages that say where their content is; None if there is none in the whole table."""
    need(pages, key, page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = parse(value)
                y = labels_of(nodes)
                if y is not None:
                    x, text, _ = features(nodes)
                    use = text > 0
                    yield pa.RecordBatch.from_arrays([pa.array([str(k)]), pa.array([x[use].tobytes()], pa.binary()), pa.array([y[use].astype(np.uint8).tobytes()], pa.binary())], names=["key", "x", "y"])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["h"]).filter(pa.array([says(v) for v in batch.column(1).to_pylist()], pa.bool_()))

    known = pick(pages, key=key, page=page).filter("page is not null and key is not null")
    known = known.filter(F.col("page").rlike("(?i)<(?:article|main)"))  # all that may have such an element
    h = hashed(F.col("key"))
    top = known.select(h.alias("h"), "page").mapInArrow(labelled, "h long").orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    if top is None:
        return None
    got = one_text(known.filter(h <= F.lit(top)), "page", "key").mapInArrow(run, "key string, x binary, y binary").toArrow().to_pylist()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r["key"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, N_FEATURES)
    y = np.frombuffer(b"".join(r["y"] for r in got), np.uint8).astype(np.int64)
    return Boosted.fit(x, y, np.sqrt(1 + x[:, 3]).astype(np.float64))


def main_texts(pages: DataFrame, trees: Boosted | None, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, text) of every row of pages."""
    need(pages, key, page)
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            out: list[str | None] = []
            for i in range(0, len(values), 256):
                part = values[i : i + 256]
                parsed = [parse(v) if v is not None else None for v in part]
                made = [features(n) if n is not None and shared.value is not None else None for n in parsed]
                have = [m for m in made if m is not None]
                margin = shared.value.margin(np.concatenate([m[0] for m in have])) if have else None
                at = 0
                for nodes, m in zip(parsed, made):
                    if nodes is None:
                        out.append(None)
                    elif m is None:
                        out.append(_text(nodes, [k for k, v in enumerate(nodes) if v.tag == "body"][:1] or [0]))
                    else:
                        own, at = margin[at : at + len(nodes)], at + len(nodes)
                        out.append(_text(nodes, decode(nodes, _gains(own, nodes, m[1], m[2]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return pick(pages, key=key, page=page).mapInArrow(run, T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("text", T.StringType())]))
