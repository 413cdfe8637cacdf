"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes blocks of text in page order. A classifier fitted on a sample of pages
prices each block by its log odds: a positive price is the capacity of its edge from the
content terminal, a negative one of its edge to the boilerplate terminal. Blocks that follow each other or lie in the same
part of the document tree are joined by smoothness edges. The cheapest cut labels all
blocks of the page at once.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import text_slices, whole

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_OTHER = re.compile(r"<[!?/][^>]*+>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Names of HTML elements by their part in a page.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template svg math iframe object textarea title select canvas audio video".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_HEAD = set("base link meta noscript script style template title html head".split())
_AWAY = set("nav footer aside button menu dialog fieldset head".split())  # and a form, see blocks
_HOME = set("article main".split())
#: Words of class, id and role that say what a part is for.
_AWAY_WORDS = set(
    "nav navbar navigation menu sidebar sidebars aside footer footers foot masthead topbar toolbar ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "comment comments respond reply replies disqus discussion share sharing social related recommended breadcrumb "
    "breadcrumbs pagination pager newsletter subscribe subscription signup login popup modal overlay widget widgets "
    "copyright legal disclaimer search tags contentinfo complementary".split()
)
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
_MOST = 3.0  # log odds count no further
_HOME_WORDS = set("article articlebody content post entry story main maincontent".split())


@dataclass
class Block:
    text: str
    tag: str
    linked: int  # characters inside links
    home: int
    away: int
    parent: int  # number of the element around its own
    depth: int
    shared: int  # how many elements it shares with the block before it
    form: int = 0  # number of the form around it


@dataclass(slots=True)
class _Open:
    """An open element; an inline one keeps what its block says."""

    tag: str
    number: int = 0
    parent: int = 0
    depth: int = 0
    block: str = ""
    home: int = 0
    away: int = 0
    link: bool = False
    form: int = 0


def blocks(page: str) -> list[Block]:
    """Blocks of a page in page order, white space collapsed, character references decoded.

    A head ends at the first thing that cannot be in it, an option at the next block or
    at the end of what it lies in. A form speaks against its text, unless it holds an
    article or main element or more than half of the page's text.
    """
    found: list[Block] = []
    stack = [_Open("")]
    held: dict[str, int] = defaultdict(int)  # open elements by tag
    parts: list[str] = []
    linked = number = at = low = muted = 0  # muted: elements open where an option began
    bodies: set[int] = set()  # forms around an article or main element
    last = page.rfind(">")  # nothing behind it is a tag

    def close() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                found.append(Block(text, top.block, linked, top.home, top.away, top.parent, top.depth, min(low, top.depth), top.form))
                low = top.depth
            parts.clear()
        linked = 0

    def shut(depth: int) -> None:
        nonlocal low, muted
        for gone in stack[depth:]:
            held[gone.tag] -= 1
        del stack[depth:]
        muted = muted if depth >= muted else 0
        low = min(low, stack[-1].depth)

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            piece = page[at:start]
            while stack[-1].tag == "head" and piece.strip():
                shut(len(stack) - 1)
            if not muted:
                parts.append(piece)
                if stack[-1].link:
                    linked += len(piece.strip())
        if start == len(page):
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        match = start < last and (_TAG.match(page, start) or _LOOSE.match(page, start))
        if not match:
            other = start < last and _OTHER.match(page, start)
            if not other and not muted:
                parts.append("<")
            at = other.end() if other else start + 1
            continue
        at, closing, tag = match.end(), bool(match[1]), match[2].lower()
        if tag not in _INLINE:
            close()
            if tag not in _RAW and tag not in _VOID:
                muted = 0
        elif tag == "br":
            parts.append(" ")
        if closing:
            depth = len(stack) - 1
            while held[tag] and depth and stack[depth].tag != tag:
                # an inline end does not close a block
                depth = 0 if tag in _INLINE and stack[depth].tag not in _INLINE else depth - 1
            if held[tag] and depth:
                shut(depth)
            continue
        while stack[-1].tag == "head" and tag not in _HEAD:
            shut(len(stack) - 1)
        if tag in _CLOSES_P and held["p"]:
            depth = len(stack) - 1
            while depth and stack[depth].tag in _INLINE:
                depth -= 1
            if stack[depth].tag == "p":
                shut(depth)
        if tag == "option":
            muted = len(stack)
            continue
        if tag in _RAW and not (tag in ("svg", "math") and match[3].endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID or match[3].endswith("/"):
            continue
        top = stack[-1]
        held[tag] += 1
        if tag in _INLINE:
            stack.append(_Open(tag, top.number, top.parent, top.depth, top.block, top.home, top.away, top.link or tag == "a", top.form))
            continue
        number += 1
        home, away = _cues(tag, match[3], top.home)
        if tag in _HOME:
            bodies.add(top.form)
        form = top.form or (number if tag == "form" else 0)  # a form inside a form is none
        stack.append(_Open(tag, number, top.number, top.depth + 1, tag, top.home + home, top.away + away, top.link, form))
    close()
    inside: dict[int, int] = defaultdict(int)
    for block in found:
        inside[block.form] += len(block.text)
    total = sum(inside.values())
    for block in found:
        block.away += bool(block.form) and block.form not in bodies and 2 * inside[block.form] <= total
    return found


def _cues(tag: str, attributes: str, inside: int) -> tuple[int, int]:
    """What an element says for and against its text; ``inside``: what those around it say for it."""
    home, away = int(tag in _HOME), int(tag in _AWAY)
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words = set(re.findall(r"[a-z]+", value))
                away += bool(words & _AWAY_WORDS)
                home += bool(words & _HOME_WORDS) and not words & _AWAY_WORDS
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                away += 1
    if tag == "header" and not home and not inside:
        away += 1
    return home, away


FEATURES = (
    "one", "length", "link share", "ends a sentence", "marks a word", "paragraph", "heading", "list or cell",
    "copyright", "home", "away",
)
_CUES = [FEATURES.index(f) for f in ("home", "away")]
_TAGS = [FEATURES.index(f) for f in ("paragraph", "heading", "list or cell")]
#: Weights in the order of ``FEATURES``, as ``fitted`` gave them for 500 of the 2,500 pages of the given table.
DEFAULT = (0.289, 5.872, -7.401, -2.173, 2.544, 3.996, 2.961, 0.286, -5.677, 5.181, -8.614)


def features(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block of a page; what names say is two of them."""
    rows = []
    for block in found:
        size = max(len(block.text), 1)
        words = block.text.count(" ") + 1
        rows.append(
            (
                1.0, size / (size + 100), min(block.linked / size, 1.0), float(block.text[-1] in ".!?…。"),
                min(sum(map(block.text.count, ".,;:!?")) / words, 1.0), float(block.tag in ("p", "blockquote", "pre")),
                float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(block.tag in ("li", "dd", "dt", "td", "th")),
                float(size < 200 and bool(_RIGHTS.search(block.text))), float(block.home > 0 and not block.away), float(block.away > 0),
            )
        )
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


def fitted(pages: list[str], steps: int = 25, ridge: float = 2.0) -> tuple[float, ...]:
    """Weights of a logistic classifier of blocks, from what elements and names say of them.

    Blocks that something speaks for and nothing against are content, those that
    something speaks against are boilerplate, others teach nothing. Each block is shown
    as it is, twice with the tag of another block of its page, without those two
    features, and without its tag as well, so that no kind of evidence leans on another. Pages that show only one kind give ``DEFAULT``.
    """
    rows, labels = [], []
    for page in pages:
        found = blocks(page)
        told = [i for i, b in enumerate(found) if b.home or b.away]
        if told:
            shown = features(found)[told]
            unnamed = shown.copy()
            unnamed[:, _CUES] = 0
            bare = unnamed.copy()
            bare[:, _TAGS] = 0
            crossed = shown.copy()
            crossed[:, _TAGS] = shown[::-1, _TAGS]
            rows += [shown, crossed, crossed, unnamed, bare]
            labels += [not found[i].away for i in told] * 5
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return DEFAULT
    x, weights = np.concatenate(rows), np.zeros(len(FEATURES))
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (balance * (y - chance)) - ridge * weights
        bend = (x * (balance * chance * (1 - chance))[:, None]).T @ x + ridge * np.eye(len(weights))
        weights = weights + np.linalg.solve(bend, slope)
    return tuple(round(float(w), 3) for w in weights)


def learned(pages: DataFrame, sample: int = 500, longest: int = 200_000) -> tuple[float, ...]:
    """``fitted`` on at most ``sample`` rows of ``pages`` (html) of up to ``longest`` code points, drawn by a hash of their html."""
    rows = pages.select(whole("html").alias("html")).where(F.char_length("html").between(1, longest))
    count = rows.count()
    draw = F.pmod(F.xxhash64("html", F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = rows.where(draw < min(1.0, 2.0 * sample / max(count, 1))).orderBy(F.xxhash64("html", F.lit(5)), "html").limit(sample)
    return fitted([r["html"] for r in drawn.collect()])


def prices(found: list[Block], weights: tuple[float, ...] = DEFAULT) -> list[int]:
    """What each block is worth as content: its log odds in tenths, negative for boilerplate."""
    return np.rint(10 * np.clip(features(found) @ np.array(weights), -_MOST, _MOST)).astype(int).tolist()


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours and between blocks of one parent two places apart, in tenths as well."""
    edges = []
    for i in range(1, len(found)):
        a, b = found[i - 1], found[i]
        near = 8 * b.shared**2 // max(a.depth, b.depth, 1) ** 2
        edges.append((i - 1, i, near + (12 if a.parent == b.parent else 0)))
        if i > 1 and found[i - 2].parent == b.parent:
            edges.append((i - 2, i, 8))
    return edges


def minimum_cut(worth: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the content terminal.

    A node whose terminal edge outweighs all its other edges is on that side in some
    minimum cut and is settled first; what remains goes through augmenting paths.
    """
    worth = list(worth)
    around: list[dict[int, int]] = [{} for _ in worth]
    for i, j, weight in edges:
        around[i][j] = around[i].get(j, 0) + weight
        around[j][i] = around[j].get(i, 0) + weight
    side: list[bool | None] = [None] * len(worth)
    ready = deque(range(len(worth)))
    while ready:
        i = ready.popleft()
        if side[i] is not None or abs(worth[i]) < sum(around[i].values()):
            continue
        side[i] = worth[i] >= 0
        for j, weight in around[i].items():
            worth[j] += weight if side[i] else -weight
            del around[j][i]
            ready.append(j)
        around[i] = {}
    left = [i for i, s in enumerate(side) if s is None]
    if left:
        content = _max_flow(left, worth, around)
        for i in left:
            side[i] = i in content
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], worth: list[int], around: list[dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches once no path with room is left."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = defaultdict(dict)
    for i in nodes:
        for j, weight in around[i].items():
            room[i][j] = weight
        a, b = (source, i) if worth[i] > 0 else (i, sink)
        room[a][b], room[b][a] = abs(worth[i]), 0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            at = queue.popleft()
            for to, free in room[at].items():
                if free > 0 and to not in came:
                    came[to] = at
                    queue.append(to)
        if sink not in came:
            return set(came)
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0) + flow


def labelled(page: str, weights: tuple[float, ...] = DEFAULT) -> list[tuple[Block, bool, bool]]:
    """Blocks of a page with what the cut says and what their price alone says."""
    found = blocks(page)
    worth = prices(found, weights)
    return [(b, k, w > 0) for b, k, w in zip(found, minimum_cut(worth, smoothness(found)), worth)]


def main_text(page: str, weights: tuple[float, ...] = DEFAULT) -> str:
    return "\n\n".join(b.text for b, keep, _ in labelled(page, weights) if keep)


def extracted(pages: DataFrame, weights: tuple[float, ...] = DEFAULT) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    The whole html is read; null counts as empty. A page without content has an empty
    text. Broken markup is read as far as it makes sense: an unclosed comment or script
    reaches to the end. Repeated rows and pages are each answered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(h.as_py(), weights) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole("html").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
