"""Main text of web pages by minimum cut.

A page becomes blocks of text with their place in the document. A linear classifier gives each block a cost for either
label; the difference is its terminal capacity. Smoothness edges join blocks that follow one another and blocks of one
container (each container is a node of its own, joined to its blocks and to the container around it), so labels change
where both text and structure do. The minimum cut separates content from the rest.

Names of elements count against what is inside only as far as the page allows it: where the containers that share a name
hold most of the page's prose together, with next to none outside, they are no sidebars whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

# Element and word lists.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_SPACED = frozenset("br td th hr img input".split())
_DROPPED = frozenset("head title button select option label nav menu".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD_ELEMENTS = frozenset("footer aside search form fieldset dialog".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner banners breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer"
    " gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion"
    " recommended related share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets"
    " responses replies discussion alert".split()
)
# Words that tell little unless they are a whole name or its last part, and words of readers' own texts.
_WEAK_WORDS = frozenset("alert discussion header modal notice notices popup responses skip social tags toolbar topbar widget widgets".split())
_READER_WORDS = frozenset("comment comments disqus discussion replies responses".split())
_GOOD_WORDS = frozenset("article articlebody body content entry main post prose story text".split())
# Raw text up to the end tag (to the end of the page without one), and elements of no text that are passed over where they close.
_RAW = frozenset("script style textarea xmp".split())
_PASSED = frozenset("noscript template iframe svg math object video audio canvas noframes".split())

_STATE = re.compile(r"^(?:no|not|has|with|without|is|are|tag|category|cat|format|type|status)[-_]|[-_](?:open|opened|closed|enabled|disabled|active|inactive|on|off)$")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


class Container:
    """An element with text of its own around or below it, the number of the one around it, and what its names say.

    ``bad`` holds the names that go with boilerplate: words, "<tag>" or "hidden".
    """

    __slots__ = ("around", "article", "bad", "good", "tag")

    def __init__(self, tag: str, around: int, good: bool, bad: frozenset[str], article: bool):
        self.tag, self.around, self.good, self.bad, self.article = tag, around, good, bad, article


class Block(NamedTuple):
    """A run of text: how much of it is linked, its innermost block element, and the number of its container."""

    text: str
    linked: int
    tag: str
    container: int

    @property
    def head(self) -> bool:
        return self.tag in _HEADS

    def prose(self) -> int:
        """Characters that look like running text."""
        free = len(self.text) - self.linked
        return free if free * 2 > len(self.text) and (len(self.text) >= 80 or _ENDS.search(self.text)) else 0


_NONE: frozenset[str] = frozenset()


def _named(attributes: str) -> tuple[bool, frozenset[str]]:
    """Whether class, id or role names go with content, and which of their words go with boilerplate.

    A name counts as a whole and by its words, the weak ones only at its end (but for a number); names of a state
    ("comments-open", "no-sidebar", "tag-social") say nothing, nor does the header of an entry.
    """
    good, bad = False, set()
    for found in _NAMES.findall(attributes):
        for name in "".join(found).split():
            low = name.lower()
            parts = [w.lower() for w in _SPLIT.split(name) if w]
            words = set(parts) | {w for w in re.split(r"[^a-z0-9]+", low) if w}
            fits = not _GOOD_WORDS.isdisjoint(words)
            good |= fits
            if not _STATE.search(low):
                while parts and parts[-1].isdigit():
                    parts.pop()
                last = {low, parts[-1] if parts else low}
                bad |= {w for w in words & _BAD_WORDS if (w not in _WEAK_WORDS or w in last) and not (fits and w == "header")}
    return good and not bad, frozenset(bad)


def _tokens(page: str) -> Iterator[tuple[str | None, str, str, str]]:
    """(text, "", "", "") or (None, "/" of an end tag or "", tag, attributes), in one pass over the page.

    Values in quotes after "=" may hold ">"; where that would leave a tag open to the page's end, it ends at its first
    ">". What is inside scripts and the like is left out.
    """
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", "", ""
            return
        if lt > at:
            yield page[at:lt], "", "", ""
        at = lt
        if page.startswith("<!--", at):
            end = _COMMENT_END.search(page, at + 4)
            if end is None:
                return  # a comment without an end holds the rest
            at = end.end()
            continue
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        if not (after.isascii() and (after.isalpha() or after == "/")):
            yield "<", "", "", ""
            at += 1
            continue
        first = page.find(">", at)
        if first < 0:
            yield page[at:], "", "", ""  # no tag is closed from here on
            return
        m = _TAG.match(page, at) or _TAG.match(page, at, first + 1) or _LOOSE.match(page, at, first + 1)
        if m is None:
            at = first + 1  # "</" before anything but a name
            continue
        end, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        at = m.end()
        if not end and (tag in _RAW or tag in _PASSED) and not attributes.endswith("/"):
            closed = None if tag in unclosed else _CLOSING[tag].search(page, at)
            if closed is not None:
                at = closed.end()
            elif tag in _RAW:
                return
            else:
                unclosed.add(tag)
            yield " ", "", "", ""
            continue
        yield None, end, tag, attributes


# "<!-->" and "<!--->" are whole comments, and "--!>" ends one too.
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][\w:-]*)([^>]*)>")
_CLOSING = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW | _PASSED}


def blocks_of(page: str) -> tuple[list[Block], list[Container]]:
    """The blocks of text of a page in order, and its containers; the first is the page.

    A <p> ends where another block begins; an end tag that nothing opened is ignored, and one that closes over others
    closes them.
    """
    containers, out = [Container("", 0, False, _NONE, False)], []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, whether its text is dropped
    opened: dict[str, int] = {}
    words: list[str] = []
    links = linked = 0

    def flush():
        nonlocal words, linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text and not stack[-1][2]:
                out.append(Block(text, min(linked, len(text)), stack[-1][0], stack[-1][1]))
            words, linked = [], 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for text, end, tag, attributes in _tokens(page):
        if text is not None:
            words.append(text)
            if links and not text.isspace():
                linked += len(text.strip())
            continue
        if tag == "a":
            links = 0 if end else 1
            continue
        if tag in _SPACED:
            words.append(" ")
        plain = tag not in _BLOCKS and tag not in _DROPPED
        if end:
            if not plain and opened.get(tag):
                flush()
                while pop() != tag:
                    pass
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if plain:
            continue
        flush()
        if stack[-1][0] == "p" or stack[-1][0] == tag and tag in {"li", "dd", "dt", "tr", "option"}:
            pop()
        _, number, dropped = stack[-1]
        inside = containers[number].article
        good, bad = _named(attributes) if attributes else (False, _NONE)
        if tag in _BAD_ELEMENTS or tag == "header" and not inside:
            bad |= {f"<{tag}>"}
        if attributes and _HIDDEN.search(attributes):
            bad |= {"hidden"}
        leaf = tag in {"p", "li", "dd", "dt", "tr", "pre", "blockquote"} or tag in _HEADS
        if not leaf or bad:
            containers.append(Container(tag, number, good and not bad or containers[number].good, bad, inside or tag in {"article", "main"}))
            number = len(containers) - 1
        stack.append((tag, number, dropped or tag in _DROPPED))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out, containers


def boilerplate(blocks: list[Block], containers: list[Container]) -> list[int]:
    """For each container what it, or one around it, is named as: 2 boilerplate, 1 perhaps (weak words only), 0 neither.

    The page's <html> and <body> are named as nothing. A name says nothing on a page where the containers that have it
    hold at least half of the prose together, while what no named container holds is little (under 140 characters or a
    quarter of theirs; under 60 where the name is of readers' texts) and no article is among that.
    """
    own = [0] * len(containers)
    for b in blocks:
        own[b.container] += b.prose()
    total = sum(own)
    void: set[str] = set()

    def names(c: int) -> frozenset[str]:
        return _NONE if containers[c].tag in ("html", "body") else containers[c].bad - void

    def inherited() -> list[int]:
        out: list[int] = []
        for c in range(len(containers)):
            found = names(c)
            level = 0 if not found else 1 if found <= _WEAK_WORDS else 2
            out.append(max(level, out[containers[c].around]) if c else level)
        return out

    def held() -> dict[str, int]:
        """Prose below each name."""
        above: list[frozenset[str]] = []
        out: dict[str, int] = {}
        for c in range(len(containers)):
            above.append(names(c) | above[containers[c].around] if c else names(c))
            for name in above[c] if own[c] else ():
                out[name] = out.get(name, 0) + own[c]
        return out

    tried: set[str] = set()
    while True:
        prose = held()
        name = max((x for x in prose if x not in tried and prose[x] * 2 >= total > 0), key=lambda x: (prose[x], x), default=None)
        if name is None:
            return inherited()
        tried.add(name)
        bad = inherited()
        clean = sum(n for n, out in zip(own, bad, strict=True) if not out)
        articles = sum(n for k, n in enumerate(own) if not bad[k] and containers[k].article)
        whole = any(containers[c].tag in ("article", "main") and name in containers[c].bad for c in range(len(containers)))
        little = 60 if name in _READER_WORDS else max(140, prose[name] / 4)
        if whole or articles < 140 and clean < little:
            void.add(name)


def content_margin(block: Block, container: Container, bad: int, some_article: bool) -> float:
    """The classifier: cost of calling the block boilerplate less the cost of calling it content."""
    n = len(block.text)
    margin = -1.0 + min(n, 300) / 100 - 4.0 * block.linked / n
    if _ENDS.search(block.text):
        margin += 0.8
    if block.tag == "p" and block.linked * 2 < n:
        margin += 0.5
    if block.head:
        margin += 1.0
    if container.article:
        margin += 4.0 if some_article else 1.0
    elif some_article:
        margin -= 4.0
    if container.good:
        margin += 2.0
    margin -= 6.0 * bad
    if block.text.startswith(("©", "Copyright")):
        margin -= 4.0
    return margin


#: Weights of edges: neighbours in order, a block and its container, a container and the one around it.
NEXT, INSIDE, OUTER = 300, 500, 100


def minimum_cut(margins: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes fall on the content side of a minimum cut.

    margins: a node's capacity from the source (positive) or to the sink (negative); edges: undirected capacities.
    A node whose margin is at least all its edges together keeps its own side, and its edges become margins of its
    neighbours. That settles most of a page; what is left is solved by blocking flows in layers (Dinic).
    """
    n = len(margins)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    margin, side = list(margins), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(margin[i]) >= sum(near[i].values()):
            side[i] = margin[i] > 0
            for j, w in near[i].items():
                margin[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    inner = _source_side({i: margin[i] for i in left}, {i: near[i] for i in left})
    return [side[i] if side[i] is not None else i in inner for i in range(n)]


def _source_side(margin: dict[int, int], room: dict[int, dict[int, int]]) -> set[int]:
    """The nodes on the source's side of a minimum cut: blocking flows, one for each layering by distance to a sink.

    The number of layerings is at most that of the nodes, and each takes time in proportion to edges times nodes at worst.
    """
    while True:
        depth = {i: 0 for i in margin if margin[i] < 0}
        queue = deque(depth)
        while queue:
            j = queue.popleft()
            for i in room[j]:
                if i not in depth and room[i][j] > 0:
                    depth[i] = depth[j] + 1
                    queue.append(i)
        starts = [i for i in margin if margin[i] > 0 and i in depth]
        if not starts:
            break
        order, at = {i: list(room[i]) for i in depth}, dict.fromkeys(depth, 0)
        for start in starts:
            path = [start]
            while path and margin[start] > 0:
                i = path[-1]
                if margin[i] < 0:
                    flow = min(margin[start], -margin[i], *(room[a][b] for a, b in zip(path, path[1:])))
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] += flow
                    margin[start] -= flow
                    margin[i] += flow
                    path = [start]
                    continue
                while at[i] < len(order[i]) and not (room[i][order[i][at[i]]] > 0 and depth.get(order[i][at[i]], -1) == depth[i] - 1):
                    at[i] += 1
                if at[i] < len(order[i]):
                    path.append(order[i][at[i]])
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1
    seen = {i for i in margin if margin[i] > 0}
    queue = deque(seen)
    while queue:
        for j, w in room[queue.popleft()].items():
            if w > 0 and j not in seen:
                seen.add(j)
                queue.append(j)
    return seen


def main_text(page: str | None) -> list[str]:
    """The blocks of a page's main text, in order."""
    blocks, containers = blocks_of(page or "")
    if not blocks:
        return []
    bad = boilerplate(blocks, containers)
    prose = [0 if bad[b.container] else b.prose() for b in blocks]
    inside = sum(p for p, b in zip(prose, blocks, strict=True) if containers[b.container].article)
    some = 4 * inside > sum(prose) or not any(prose) and any(containers[b.container].article for b in blocks)
    n = len(blocks)
    margins = [round(1000 * content_margin(b, containers[b.container], bad[b.container], some)) for b in blocks] + [0] * len(containers)
    edges: dict[tuple[int, int], int] = {}
    for i, b in enumerate(blocks):
        edges[i, n + b.container] = INSIDE
        if i:
            edges[i - 1, i] = NEXT
    for c in range(1, len(containers)):
        edges[n + c, n + containers[c].around] = OUTER
    kept = minimum_cut(margins, edges)
    return [b.text for b, k in zip(blocks, kept[:n], strict=True) if k]


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars, blocks) for every row: the main text, its code points, and its blocks.

    Character references are decoded, white space inside a block is one space, blocks are trimmed and joined by an empty
    line. A page that is null, empty or without main text gets an empty text and no blocks. Whole pages are read,
    however long. Repeated rows are extracted each. Other columns are not read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py()) for p in batch.column(2)]
            texts = ["\n\n".join(b) for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.list_(pa.string()))],
                names=["id", "url", "text", "n_chars", "blocks"],
            )

    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    found = source.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long, blocks array<string>")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "blocks")


def op3_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(read(spark, sf_dir, "pages")).drop("blocks")
