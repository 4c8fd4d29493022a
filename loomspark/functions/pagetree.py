"""Pages as rows of elements, from one parse, and selectors matched while it runs."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pagehtml import TEXT, VOID, Reader

# Elements that no outline shows, elements whose whole text is kept, and endings of picture addresses.
GONE = frozenset("script style noscript svg iframe link meta template".split())
TOLD = frozenset("a button script title option h1 h2 h3".split())
_PICTURE = re.compile(r"\.(jpe?g|png|webp|gif|avif)(\?|#|$)", re.I)
_WORD = re.compile(r"\S+")
#: How many elements around one are listed with it, the nearest first.
AROUND = 4


class Element:
    __slots__ = ("around", "attrs", "children", "end", "gone", "n", "own", "parent", "place", "start", "stop", "tag", "depth")


def absolute(base: str, address: str) -> str | None:
    """An http address as it is on the page, or null."""
    try:
        found = urljoin(base, address.strip())
    except ValueError:
        return None
    return found if re.match(r"https?://", found, re.I) else None


class Tree(HTMLParser):
    """Elements in document order, each with the number behind its last descendant.

    A paragraph ends where another block begins, an item where another begins; an end tag that nothing opened is ignored,
    and one that closes over others closes them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.parts: list[str] = []
        self.length = 0

    def handle_starttag(self, tag, attrs):
        if self.open and (self.open[-1].tag == "p" and tag in TEXT or self.open[-1].tag == tag and tag in {"li", "dd", "dt", "tr", "option"}):
            self.close_one()
        e = Element()
        e.tag, e.attrs = tag, [(k, v or "") for k, v in attrs]
        above = self.open[-1] if self.open else None
        e.n, e.parent, e.depth = len(self.elements), above.n if above else None, above.depth + 1 if above else 0
        e.gone = tag in GONE or bool(above and above.gone)
        e.place = above.place_below() if above else ""
        e.around = [x.n for x in reversed(self.open[-AROUND:])]
        e.own, e.children, e.start = [], 0, self.length
        if above and not e.gone:
            above.children += 1
        e.stop = e.end = None
        self.elements.append(e)
        if tag in VOID:
            e.stop, e.end = e.n + 1, self.length
        else:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag:
            self.close_one()

    def close_one(self) -> Element:
        e = self.open.pop()
        e.stop, e.end = len(self.elements), self.length
        return e

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open):
            while self.close_one().tag != tag:
                pass

    def handle_data(self, data):
        if self.open:
            self.open[-1].own.append(data)
            if not self.open[-1].gone:
                self.parts.append(data)
                self.length += len(data)

    def read(self, page: str) -> Tree:
        self.feed(page)
        self.close()
        while self.open:
            self.close_one()
        return self


def _place_below(e: Element) -> str:
    """A short name for where the children of an element sit: its ancestors' and its own tags and ids."""
    own = next((v for k, v in e.attrs if k == "id" and v), None)
    step = f"{e.tag}#{own}" if own else e.tag
    return hashlib.md5(f"{e.place}<{step}".encode()).hexdigest()


Element.place_below = _place_below

_SCHEMA = (
    "id {kind}, n int, stop int, depth int, parent int, around array<int>, tag string, attrs array<struct<name:string,value:string>>, gone boolean,"
    " place string, own string, text string, raw int, chars int, children int, address string, pictures array<string>"
)
_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _rows(page: str, base: str) -> Iterator[tuple]:
    tree = Tree().read(page)
    body = "".join(tree.parts)
    spans = [m.span() for m in _WORD.finditer(body)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    ink = [0, *accumulate(b - a for a, b in spans)]

    def collapsed_length(a: int, b: int) -> int:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        if i >= j:
            return 0
        return ink[j] - ink[i] - max(0, a - starts[i]) - max(0, ends[j - 1] - b) + j - i - 1

    for e in tree.elements:
        own = " ".join(" ".join(e.own).split())
        named = dict(reversed(e.attrs))
        whole = None
        if e.tag in TOLD:
            whole = " ".join(("".join(e.own) if e.gone else body[e.start : e.end]).split())
        address = absolute(base, named["href"]) if e.tag == "a" and "href" in named else None
        pictures = None
        if e.tag == "img":
            found = [part.split()[0] for _, v in e.attrs for part in v.split(",") if part.strip()]
            pictures = [u for p in found if not p.startswith("data:") and _PICTURE.search(p) and (u := absolute(base, p))]
        yield e.n, e.stop, e.depth, e.parent, e.around, e.tag, [{"name": k, "value": v} for k, v in e.attrs], e.gone, e.place, own, whole, e.end - e.start, collapsed_length(e.start, e.end), e.children, address, pictures


def elements(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each element of each page: id, n and stop (its descendants are the rows between), depth, parent, around
    (the nearest four ancestors), tag, attrs, gone (in a script, style, picture or frame), place (equal for elements whose
    ancestors have equal tags and ids), own (text directly in it), text (whole, of links, buttons, headings, options and
    scripts), raw and chars (length of its text as it is and with white space collapsed), children, address (of a link)
    and pictures (addresses in an image). A null page has no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), _ATTRS, pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
    names = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", _SCHEMA.replace("array<struct<name:string,value:string>>", "x")).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a page at a time: its rows are many more than itself
                page, base = batch.column(2)[i].as_py(), batch.column(1)[i].as_py()
                rows = list(_rows(page or "", base or ""))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                ids = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, _SCHEMA.format(kind=kind))


class Selector:
    """Tags, classes and ids joined by white space (below) or ">" (right below), as in "#list > li.item a"; "," gives alternatives.

    While a page is parsed, each open element keeps two sets of bits: the steps that it completes, and those that it or an
    element around it completes. A step is completed by an element that fits it where the step before is in the parent's
    first set (">") or second set.
    """

    _PART = re.compile(r"([.#]?)([\w-]+|\*)")

    def __init__(self, text: str):
        self.steps: list[tuple[bool, bool, str, frozenset[str], frozenset[str]]] = []  # first?, right below?, tag, ids, classes
        self.goals = 0
        for option in text.split(","):
            first, child = True, False
            for step in option.replace(">", " > ").split():
                if step == ">":
                    child = True
                    continue
                parts = self._PART.findall(step)
                if "".join(a + b for a, b in parts) != step:
                    raise ValueError(f"not a selector: {text!r}")
                tag = next((b for a, b in parts if not a and b != "*"), "")
                self.steps.append((first, child, tag.lower(), frozenset(b for a, b in parts if a == "#"), frozenset(b for a, b in parts if a == ".")))
                first, child = False, False
            if first or child:
                raise ValueError(f"not a selector: {text!r}")
            self.goals |= 1 << (len(self.steps) - 1)

    def enter(self, above: tuple[int, int], tag: str, attrs: dict) -> tuple[int, int]:
        """The two sets of an element, from those of its parent ((0, 0) at the top)."""
        own, ids, classes = 0, {attrs.get("id") or ""}, set((attrs.get("class") or "").split())
        for k, (first, child, name, wanted, needed) in enumerate(self.steps):
            if (not name or name == tag) and wanted <= ids and needed <= classes and (first or above[0 if child else 1] >> (k - 1) & 1):
                own |= 1 << k
        return own, above[1] | own

    def hit(self, sets: tuple[int, int]) -> bool:
        return bool(sets[0] & self.goals)


class Picker(Reader):
    """Reads only what is inside elements that ``content`` selects; nothing in there counts as chrome but scripts and the like.

    The title is the text of the first element that ``title`` selects, else the page's; ``locked`` tells whether an element
    that its selector names is on the page.
    """

    def __init__(self, base: str, content: Selector, title: Selector, locked: Selector):
        super().__init__(base)
        self.wanted = (content, title, locked)
        self.sets: list[tuple[str, tuple, int]] = []  # tag, sets of the three, which of them it is inside of
        self.heading: list[str] | None = None
        self.headed = self.locked = False

    def within(self, k: int) -> bool:
        return bool(self.sets and self.sets[-1][2] >> k & 1)

    def hidden(self) -> bool:
        return not self.within(0) or any(t in GONE for t, _, _ in self.sets)

    def handle_starttag(self, tag, attrs):
        while self.sets and (self.sets[-1][0] == "p" and tag in TEXT or self.sets[-1][0] == tag and tag in {"li", "dd", "dt", "tr", "option"}):
            self.leave()
        above = self.sets[-1] if self.sets else ("", ((0, 0),) * 3, 0)
        named = dict(attrs)
        sets = tuple(s.enter(x, tag, named) for s, x in zip(self.wanted, above[1], strict=True))
        inside = above[2] | sum(1 << k for k, s in enumerate(self.wanted) if s.hit(sets[k]))
        self.locked = self.locked or bool(inside & 4)
        if inside & 1 and not above[2] & 1:
            self.flush_outside()
        if inside & 2 and not above[2] & 2 and not self.headed:
            self.heading = []
        if tag in VOID:
            held, self.sets = self.sets, [*self.sets, (tag, sets, inside)]
            super().handle_starttag(tag, attrs)
            self.sets = held
            return
        self.sets.append((tag, sets, inside))
        super().handle_starttag(tag, attrs)

    def flush_outside(self) -> None:
        self.held = []

    def leave(self) -> str:
        tag, _, inside = self.sets[-1]
        around = self.sets[-2][2] if len(self.sets) > 1 else 0
        if inside & 1 and not around & 1:
            self.flush()
        self.sets.pop()
        if inside & 2 and not around & 2 and self.heading is not None:
            self.headed = bool("".join(self.heading).strip())
            self.heading = self.heading if self.headed else None
        return tag

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if any(t == tag for t, _, _ in self.sets):
            while self.leave() != tag:
                pass

    def handle_data(self, data):
        if self.within(1) and not self.headed and self.heading is not None:
            self.heading.append(data)
        super().handle_data(data)

    def read(self, page: str) -> tuple[str, bool, list[dict]]:
        self.feed(page)
        self.close()
        self.close_whole()
        while self.sets:
            self.leave()
        title = " ".join("".join(self.heading or []).split()) or " ".join(self.title.split())
        return title, self.locked, self.blocks

