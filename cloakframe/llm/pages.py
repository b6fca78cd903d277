"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their place in the element tree. A classifier says what it
costs to call a block content or boilerplate; these costs are the capacities from the source and
to the sink. Blocks that follow each other, and blocks that follow each other in the same element,
are joined by smoothness edges, stronger the nearer they are in the tree. The minimum cut between
source and sink, found by maximum flow, is the cheapest labelling.

The classifier is a logistic regression on the form of blocks (length, links, marks, element). It
learns from a bounded sample of pages (``SAMPLE``, in the order of a hash of the id), whose blocks
count as content inside ``article`` or ``main`` and as boilerplate inside menus, footers and the
like; these elements and telling class names also weigh in by themselves. A form or a class name
doesn't tell where it wraps the article or most of the text (``_settle``). Extraction is row-local.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.frames import importable, unused, utf8

SAMPLE = 256
#: Costs: of calling article text boilerplate, of calling told boilerplate content (more than the classifier's bound, less than
#: it and edges together), of cutting between neighbours at distance 0; the classifier's bound; and of a name that only hints.
CUE, TOLD, SMOOTH, BOUND, HINT = 8.0, 5.0, 1.0, 4.0, 1.0
#: Blocks so many steps apart in the tree aren't joined.
FAR = 32
_TOKEN = re.compile(  # no tag reaches over a "<", so broken markup costs no second scan
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>|<[!?/][^<>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
#: Elements whose content is no text of the page, where they have an end (fixed values); one that is closed at once or never has no content.
_SKIPPED = {"noscript", "template", "textarea", "select", "svg", "iframe", "title"}
_ENDS = re.compile(rf"</({'|'.join(sorted(_SKIPPED))})\s*>", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that begin and end blocks (fixed values of HTML).
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = {"article", "main"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button"}
#: Words of class, id and role names that tell boilerplate.
_WORDS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login search share sharing social related recommended comment comments disqus respond replies widget toolbar pagination pager complementary contentinfo".split()
)
#: Names that tell even of an element with most of the page's text.
#: Words of names that tell nothing by themselves, as in "cookie-box"; beside any other word ("social-history") a telling one is a hint only.
_PARTS = set(
    "box bar area wrap wrapper block section list link links icon icons button buttons btn container content top bottom left right item items form inner outer main site page header head global primary secondary tertiary row col column fixed sticky float floating overlay dialog panel holder unit slot side mobile desktop inline has no with is open closed layout body group small large wide articles posts stories videos products topics tags".split()
)
_TALK = {"comment", "comments", "disqus", "respond", "replies"}
LOOSE, FIRM = 1, 2


class _Node:
    """An element: what it and its ancestors tell (content, boilerplate), its depth and the blocks directly in it.

    ``told`` is FIRM for an element that tells boilerplate by itself, LOOSE for a form or a telling name, which a wrapper
    of the page may have too; ``scope`` is the nearest article or main around it.
    """

    __slots__ = ("tag", "parent", "depth", "content", "boiler", "last", "told", "scope", "shut", "size", "open", "holds", "around", "hint")

    def __init__(self, tag: str, parent: _Node | None, names: str):
        self.tag, self.parent, self.last = tag, parent, -1
        self.depth = parent.depth + 1 if parent else 0
        self.content = tag in _CONTENT or bool(parent and parent.content)
        self.scope = None if parent is None else parent if parent.tag in _CONTENT else parent.scope
        self.told = FIRM if tag in _BOILERPLATE and tag != "form" or tag == "header" and not self.content else LOOSE if tag == "form" else 0
        self.hint = bool(parent and parent.hint)
        if self.told < FIRM and names and tag not in ("html", "body", "article", "main"):
            names = names.lower()
            if not _TALK.isdisjoint(names.split()):
                self.told = FIRM
            else:
                for one in names.split():
                    words = {w for w in re.split(r"[^a-z]+", one) if w}
                    telling = words & _WORDS or words & {"header"} and not self.content
                    if telling and words <= _WORDS | _PARTS:
                        self.told = LOOSE
                    self.hint |= bool(telling)
        # below an element that surely tells (a main element is never meant to be)
        self.shut = tag != "main" and (self.told == FIRM or bool(parent and parent.shut))
        self.boiler = self.holds = self.around = False
        self.size = self.open = 0


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: _Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def _settle(nodes: list[_Node], found: list[Block]) -> None:
    """Which elements are boilerplate, once the text of all is known; ``nodes`` in page order.

    Boilerplate is what is in an element that tells. A form or a name doesn't tell where it wraps the
    content: around the page's articles or main element (the largest, and those half as large), or,
    if there are none, around most of the text; within an article or main, around most of its
    text with an article in it, or around nine tenths of it. Such an article or main element
    also cancels what it inherits, so an end tag that is missing before it costs nothing.
    """
    root = nodes[0]
    for b in found:
        b.node.size += len(b.text)
        b.node.open += len(b.text)
    for n in reversed(nodes[1:]):
        n.parent.size += n.size
        if n.told < FIRM:
            n.parent.open += n.open
            n.parent.holds |= n.holds or n.tag in _CONTENT
    top = [n for n in nodes if n.tag in _CONTENT and n.scope is None and n.size]
    chief = [n for n in top if not n.shut and n.open] or [n for n in top if 2 * n.size > root.size]
    most = max((n.open for n in chief), default=0)
    chief = {n for n in chief if 2 * n.open >= most}
    for n in chief:
        up = n.parent
        while up and not up.around:
            up.around, up = True, up.parent
    for n in nodes:
        told = n.told == FIRM
        if n.told == LOOSE and n.scope is None:
            told = not (n.around if chief else 2 * n.open > root.open)
        elif n.told == LOOSE:
            told = not (n.holds and 2 * n.open > n.scope.open or 10 * n.open >= 9 * n.scope.open)
        n.boiler = told or bool(n.parent and n.parent.boiler and n not in chief)


def blocks(page: str) -> list[Block]:
    """The text blocks in page order: references decoded, white space runs as one space. Never fails on broken markup."""
    root = _Node("html", None, "")
    at, out = root, []
    nodes = [root]
    parts: list[str] = []
    link, linked, pos = 0, 0, 0
    is_open: dict[str, int] = {}

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, at, linked))
            parts.clear()
        linked = 0

    ends = {t: [] for t in _SKIPPED}  # where the ends of elements that are skipped stand
    for m in _ENDS.finditer(page):
        ends[m[1].lower()].append((m.start(), m.end()))
    skip = 0
    for m in _TOKEN.finditer(page):
        if m.start() < skip:
            continue
        start = max(pos, skip)
        if m.start() > start:
            piece = page[start : m.start()]
            parts.append(piece)
            if link:
                linked += len(piece)
        pos = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ends:
            if not m[2] and not m[4].rstrip().endswith("/"):
                after = bisect_left(ends[tag], (pos, 0))
                if after < len(ends[tag]):
                    skip = ends[tag][after][1]
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if m[2] else 1
        elif tag in _BLOCK:
            end()
            link = 0
            if m[2]:
                while is_open.get(tag):  # an end tag without its start says nothing
                    is_open[at.tag] -= 1
                    last, at = at.tag, at.parent
                    if last == tag:
                        break
            else:
                if at.tag == "head" and tag not in _VOID:  # its end tag may be left out
                    is_open["head"] -= 1
                    at = at.parent
                if at.tag == "p" or at.tag == tag and tag in ("li", "td", "th", "tr", "dd", "dt"):
                    is_open[at.tag] -= 1
                    at = at.parent
                if tag in ("html", "body") and at.parent is None:
                    continue
                if tag not in _VOID:
                    attributes = m[4]
                    names = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes)) if "=" in attributes else ""
                    at = _Node(tag, at, names)
                    nodes.append(at)
                    is_open[tag] = is_open.get(tag, 0) + 1
    if max(pos, skip) < len(page):
        parts.append(page[max(pos, skip) :])
    end()
    _settle(nodes, out)
    return out


_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
FEATURES = 10


def forms(found: list[Block]) -> list[tuple[float, ...]]:
    """Numbers that describe the form of each block."""
    out = []
    for k, b in enumerate(found):
        n, tag = len(b.text), b.node.tag
        words = b.text.count(" ") + 1
        marks = b.text.count(".") + b.text.count(",")
        out.append((
            1.0, math.log1p(n) / 5, min(b.linked / n, 1.0), math.log1p(marks), n / words / 10, float(tag == "p"),
            float(tag in _HEADING), float(tag == "li"), float(tag == "div"), float(b.text[-1] in ".!?"),
        ))
    return out


def learn(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression (Newton steps with a ridge); zeros unless both classes occur."""
    w = np.zeros(FEATURES)
    if not len(y) or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(min(rounds, 25)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1.0 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(FEATURES)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: gain[i] > 0 is lost if i is not content, -gain[i] if it is; each edge between two labels costs its weight.

    Maximum flow from all blocks that gain to all that lose, by shortest augmenting phases.
    """
    n = len(gain)
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        head[a].append(len(to))
        to.append(b)
        room.append(w)
        head[b].append(len(to))
        to.append(a)
        room.append(w)
    supply = [max(g, 0.0) for g in gain]
    sink = [max(-g, 0.0) for g in gain]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if supply[i] > tiny]
        for i in queue:
            level[i] = 0
        reached = False
        for u in queue:
            reached = reached or sink[u] > tiny
            for e in head[u]:
                v = to[e]
                if room[e] > tiny and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in range(n):
            while supply[s] > tiny:
                path, u = [], s
                while sink[u] <= tiny:  # deeper, or back where there is no way on
                    moved = False
                    while tried[u] < len(head[u]):
                        e = head[u][tried[u]]
                        if room[e] > tiny and level[to[e]] == level[u] + 1:
                            path.append(e)
                            u = to[e]
                            moved = True
                            break
                        tried[u] += 1
                    if not moved:
                        if not path:
                            break
                        u = to[path.pop() ^ 1]
                        tried[u] += 1
                if sink[u] <= tiny:
                    break
                flow = min(supply[s], sink[u], *[room[e] for e in path]) if path else min(supply[s], sink[u])
                supply[s] -= flow
                sink[u] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def neighbours(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, in the page and within their element's parent."""
    out: list[tuple[int, int, float]] = []
    for i in range(len(found) - 1):
        a, b = found[i].node, found[i + 1].node
        steps = 0
        while a is not b and a is not None and b is not None and steps < FAR:  # steps to the nearest common element
            if a.depth >= b.depth:
                a = a.parent
            else:
                b = b.parent
            steps += 1
        if steps < FAR:
            out.append((i, i + 1, SMOOTH / (1 + steps)))
    for b in found:
        b.node.last = -1
        if b.node.parent:
            b.node.parent.last = -1
    for i, b in enumerate(found):
        home = b.node.parent or b.node
        if home.last >= 0 and home.last != i - 1:
            out.append((home.last, i, SMOOTH / 2))
        home.last = i
    return out


def label(found: list[Block], score: list[float]) -> list[bool]:
    """Which blocks are content, from the classifier's log odds and what their elements tell."""
    told = [-TOLD if b.node.boiler else CUE if b.node.content else -HINT * b.node.hint for b in found]
    edges = neighbours(found)
    out = cut([max(-BOUND, min(BOUND, s)) + t for s, t in zip(score, told, strict=True)], edges)
    open_scores = [s for s, t in zip(score, told, strict=True) if not t]
    if open_scores and not any(out):  # nothing tells content: blocks are judged against the page's best one
        shift = 1 - max(open_scores)
        out = cut([max(-BOUND, min(BOUND, s + shift)) + t for s, t in zip(score, told, strict=True)], edges)
    return out


def _texts(column: pa.Array, weights: np.ndarray) -> list[str]:
    pages = [blocks(p) if p else [] for p in column.to_pylist()]
    x = [f for p in pages for f in forms(p)]
    scores = (np.array(x) @ weights).tolist() if x else []
    out, at = [], 0
    for p in pages:
        ok = label(p, scores[at : at + len(p)]) if p else []
        at += len(p)
        out.append("\n".join(b.text for b, keep in zip(p, ok, strict=True) if keep))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights from at most ``sample`` pages; zeros if these tell no content or no boilerplate."""
    importable(pages.sparkSession)
    some = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).filter("html IS NOT NULL")
    some = some.orderBy(F.xxhash64("id"), "id").limit(sample).select("html")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                rows += [(float(not b.node.boiler), *f) for b, f in zip(found, forms(found), strict=True) if b.node.boiler or b.node.content]
            yield pa.record_batch([pa.array([np.array(rows).tobytes() if rows else b""], pa.binary())], ["rows"])

    got = b"".join(r["rows"] for r in some.mapInArrow(told, "rows binary").collect())
    table = np.frombuffer(got, np.float64).reshape(-1, FEATURES + 1)
    table = table[np.lexsort(table.T)]
    return learn(table[:, 1:], table[:, 0])


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``, the main text: blocks in page order, one line each. It replaces a column of that name.

    A null or empty page, or one without content, has an empty text.
    """
    from pyspark.sql.types import StringType, StructType

    importable(pages.sparkSession)
    page = unused(pages, "_html")
    rows = pages.withColumn(page, F.col(html_col).cast("string")).drop(out)
    schema = StructType([f for f in rows.schema.fields if f.name != page]).add(out, StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = utf8(batch.column(page))[1]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 20), "right")) - 1)
                part = batch.slice(a, b - a)
                a = b
                keep = [n for n in part.schema.names if n != page]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(_texts(part.column(page), weights), pa.string())], [*keep, out])

    return rows.mapInArrow(work, schema)
