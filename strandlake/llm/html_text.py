"""Visible text of web pages, laid out as text.

A tree is built with the tags that HTML implies (a paragraph ends at the next block, a
list item at the next item, a cell or row at the next one, and so on). What a browser does
not show is left out: scripts, styles, head, templates, comments, elements with the hidden
attribute, and those that display: none or visibility: hidden holds for, in their style or
by rules of the page's style elements whose selectors are a tag, a class or id, or a tag with
one of these, as in p.note, or such ones as descendants and children, as in .menu > li a (other
selectors and at-rules are passed over). Of a select, the chosen options show, of a closed
details its summary, of an input its value where that is text. Drawings and formulas show
their text without titles and annotations.

Blocks stand on lines of their own, paragraphs and headings between blank lines; list items
have markers and indents; preformatted text keeps its spaces; cells are padded to their
columns, with room for columns and rows that others span. Columns are found
for every cell, whatever cells from above or of many columns take. White space has two bounds,
which the caller can lift (None): tables whose lines padding would make over growth times their
text keep their cells without padding; tables in over deep others, and lists in over deep others,
are laid out without further columns or indents. No text depends on them. The query op9_html
lifts growth, so it pads every table; its time and memory follow from the text it returns, which
a hostile page can make quadratic in its length.

Trees are built and rendered without recursion, in time linear in the page, but for a logarithm
for cells that span rows or columns: each tag knows where its last open element is. Null pages give null, empty ones empty text; very long ones go
whole. Other columns pass through, whatever their names; a column named text is replaced.
Repeated rows are rendered each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, quoted

GROWTH, DEEP = 16, 32  #: the bounds on white space
TOGETHER = 1 << 25  #: letters of text after which rows go on in a batch of their own
#: Fixed values of HTML: elements without content, without display, and those that form blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("head script style template title noscript iframe object datalist rp canvas audio video desc defs metadata symbol annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html hr legend li main nav option search section summary tbody td tfoot th thead tr".split())
#: Inputs whose value shows.
WRITTEN = frozenset("text search tel url email number date month week time datetime-local submit button reset".split())
#: A start tag ends open elements of its set, unless one of the barriers lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
}
_SPACE = re.compile(r"[ \t\n\f\r]+")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?", re.I)


def shown(style: str) -> tuple[bool | None, bool | None]:
    """What declarations say of display (False: none) and of visibility (False: hidden); None where they don't."""
    display = visibility = None
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        value = value.replace("!important", "").strip()
        if name.strip() == "display" and value:
            display = value != "none"
        elif name.strip() == "visibility" and value:
            visibility = value not in ("hidden", "collapse")
    return display, visibility


class Rules:
    """The rules of style elements that hide or show, by the selector's tag and its class or id."""

    def __init__(self) -> None:
        self.by: dict[tuple[str, str], tuple] = {}
        #: By a part's tag and name: its bit, the bit of the part before it (0: none), whether that must be the parent, and, of a last part, weight and declarations.
        self.parts: dict[tuple[str, str], list[tuple]] = {}
        self.n = self.bits = 0

    def read(self, sheet: str) -> None:
        depth = skipped = 0
        selectors = ""
        for part in re.split(r"([{}])", _COMMENT.sub("", sheet)):
            if part == "{":
                depth += 1
                if selectors.lstrip().startswith("@") and not skipped:
                    skipped = depth
            elif part == "}":
                depth = max(0, depth - 1)
                skipped = skipped if depth >= skipped else 0
            elif depth and not skipped:
                self.add(selectors, shown(part))
            else:
                selectors = part.rpartition(";")[2]

    def add(self, selectors: str, says: tuple) -> None:
        if says == (None, None):
            return
        for s in selectors.split(","):
            chain = s.replace(">", " > ").split()
            if len(chain) > 1:
                self.add_chain(chain, says)
                continue
            m = _SELECTOR.fullmatch(s.strip())
            if m and m[0]:
                tag, name = (m[1] or "").lower(), m[2] or ""
                self.n += 1
                before = self.by.get((tag, name), (0, (None, None)))[1]
                merged = tuple(old if new is None else new for old, new in zip(before, says, strict=True))
                self.by[tag, name] = ((name[:1] == "#", name != "", tag != "", self.n), merged)

    def add_chain(self, chain: list[str], says: tuple) -> None:
        """A selector of descendants and children, part by part."""
        found, child = [], False
        for word in chain:
            m = _SELECTOR.fullmatch(word)
            if word == ">":
                if child or not found:
                    return
                child = True
            elif m and m[0]:
                found.append(((m[1] or "").lower(), m[2] or "", child))
                child = False
            else:
                return
        if child:
            return
        self.n += 1
        weight = (sum(n[:1] == "#" for _, n, _ in found), sum(n != "" for _, n, _ in found), sum(t != "" for t, _, _ in found), self.n)
        before = 0
        for i, (tag, name, child) in enumerate(found):
            bit, self.bits = 1 << self.bits, self.bits + 1
            self.parts.setdefault((tag, name), []).append((bit, before, child, (weight, says) if i == len(found) - 1 else None))
            before = bit

    def says(self, node: Node, above: int, parent: int) -> tuple[list, int]:
        """display and visibility, each by the rule of the greatest weight; and the parts of selectors that the node meets, given those of all above it and of its parent."""
        keys = [(node.tag, ""), *((t, n) for n in node.names for t in ("", node.tag))]
        rules, met = [self.by[k] for k in keys if k in self.by], 0
        if self.parts:
            for k in keys:
                for bit, before, child, last in self.parts.get(k, ()):
                    if not before or (parent if child else above) & before:
                        met |= bit
                        if last:
                            rules.append(last)
        out = [None, None]
        for _, says in sorted(rules, key=lambda r: r[0]):
            out = [old if new is None else new for old, new in zip(out, says, strict=True)]
        return out, met


class Node:
    __slots__ = ("above", "children", "chosen", "closed", "display", "met", "names", "own", "parent", "rows", "span", "tag", "visibility")

    def __init__(self, tag: str, given: dict):
        self.tag, self.children = tag, []
        self.names = frozenset([f".{c}" for c in (given.get("class") or "").split()] + [f"#{i}" for i in [given.get("id")] if i])
        self.own = shown(given["style"]) if given.get("style") else (None, None)
        self.display = not (tag in INVISIBLE or "hidden" in given or (tag == "input" and given.get("type") == "hidden"))
        self.visibility, self.parent = None, None
        self.above = self.met = 0  # parts of selectors that those around it meet, and that it does
        self.closed = tag == "details" and "open" not in given
        self.span, self.rows = number(given.get("colspan"), 1000), number(given.get("rowspan"), 65534)
        self.chosen = "multiple" in given if tag == "select" else "selected" in given


def number(x: str | None, most: int) -> int:
    return max(1, min(int(x), most)) if x and x.isascii() and x.isdigit() and len(x) < 7 else 1


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # the places of open elements by tag
        self.nodes: list[Node] = []
        self.rules = Rules()

    def _last(self, names: set) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def _close(self, names: set, barriers: set, parents: bool = False) -> None:
        """Ends the last open element of these names, and with parents those right around it that have one of them."""
        first = self._last(names)
        if first <= self._last(barriers - names) or not first:
            return
        while parents and first > 1 and self.open[first - 1].tag in names:
            first -= 1
        for node in self.open[first:]:
            self.at[node.tag].pop()
        del self.open[first:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK and tag not in ("html", "body", "option"):
            self._close({"p"}, {"td", "th", "table", "li", "button", "div", "section", "article"})
        if tag in _ENDS:
            self._close(*_ENDS[tag], True)
        if tag == "body":
            self._close({"head"}, set())
        elif tag == "select":  # none lies in another
            self._close({"select"}, set())
        given = dict(attrs)
        node = Node(tag, given)
        if tag == "img" and given.get("alt"):
            node.children.append(given["alt"])
        elif tag == "input" and (given.get("type") or "text").lower() in WRITTEN and given.get("value"):
            node.children.append(given["value"])
        node.parent = self.open[-1]
        node.parent.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag not in VOID:
            barriers = set() if tag in ("table", "body", "html") else {"table"} if tag in ("tr", "tbody", "thead", "tfoot") else {"table", "td", "th"} - {tag}
            self._close({tag}, barriers)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            self.rules.read(data)
        self.open[-1].children.append(data)

    def settle(self) -> None:
        """What styles and choices show, once the whole page is read."""
        some = self.rules.by or self.rules.parts
        for node in self.nodes:
            sheet = (None, None)
            if some:  # parents come first
                node.above = node.parent.above | node.parent.met
                sheet, node.met = self.rules.says(node, node.above, node.parent.met)
            display, node.visibility = (a if a is not None else b for a, b in zip(node.own, sheet, strict=True))
            node.display = node.display and display is not False
        for select in (n for n in self.nodes if n.tag == "select" and not n.chosen):
            options, waiting = [], [select]
            while waiting:
                n = waiting.pop()
                options += [n] if n.tag == "option" else []
                waiting += [c for c in reversed(n.children) if not isinstance(c, str)]
            chosen = next((o for o in reversed(options) if o.chosen), options[0] if options else None)
            for o in options:
                o.display = o.display and o is chosen


class Out:
    """Text being laid out: inline text with single spaces, line breaks and blank lines owed before more text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent, self.marker = "", ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self._put(first)
            for x in rest:
                self.newline(True)
                self._put(x)
            return
        words = _SPACE.split(s)
        if not any(words):
            self.space |= bool(self.line)
            return
        if words[0] == "":
            self.space |= bool(self.line)
        self._put((" " if self.space and self.line else "") + " ".join(w for w in words if w))
        self.space = words[-1] == ""

    def _put(self, s: str) -> None:
        if s:
            self.line.append(s)

    def newline(self, always: bool = False) -> None:
        if self.line or always:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append(f"{self.indent}{self.marker}{''.join(self.line)}".rstrip())
            self.indent, self.marker = self.indent + " " * len(self.marker), ""
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.blank |= spaced and bool(self.lines)

    def result(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Taken:
    """The columns that cells from above take, each up to a last row: a tree of halves of the columns, of which only those that a span begins or ends in are made."""

    def __init__(self, columns: int) -> None:
        self.size = 1 << columns.bit_length()
        self.whole: dict[int, int] = {}  # the last row that all columns of a node are taken to
        self.least: dict[int, int] = {}  # the least last row of its columns
        self.until = -1

    def take(self, a: int, b: int, row: int) -> None:
        """Columns from a to before b, up to this row."""
        self.until = max(self.until, row)
        waiting, partly = [(1, 0, self.size)], []
        while waiting:
            node, low, high = waiting.pop()
            if a <= low and high <= b:
                self.whole[node] = max(self.whole.get(node, -1), row)
                self.least[node] = max(self.least.get(node, -1), row)
            elif low < b and a < high:
                middle = (low + high) // 2
                partly.append(node)
                waiting += [(2 * node, low, middle), (2 * node + 1, middle, high)]
        for node in reversed(partly):  # halves before what they are halves of
            self.least[node] = max(self.whole.get(node, -1), min(self.least.get(2 * node, -1), self.least.get(2 * node + 1, -1)))

    def free(self, at: int, row: int) -> int:
        """The first column from at on that isn't taken in this row."""
        waiting = [(1, 0, self.size)] if self.until >= row else []
        while waiting:
            node, low, high = waiting.pop()
            if high > at and self.least.get(node, -1) < row:
                if node not in self.least or high - low == 1:
                    return max(at, low)
                middle = (low + high) // 2
                waiting += [(2 * node + 1, middle, high), (2 * node, low, middle)]
        return at


def widened(widths: list[int], wide: list[tuple[int, int, int]]) -> list[int]:
    """widths of columns with room for wide cells (first and last column, length), one after the other: what is missing goes to a cell's last column. Sums come from a tree of sums."""
    n = len(widths)
    sums = [0, *widths]
    for i in range(1, n + 1):
        if i + (i & -i) <= n:
            sums[i + (i & -i)] += sums[i]
    out = widths[:]
    for first, last, longest in wide:
        room, i, j = 2 * (last - first - 1), last, first
        while i > j:
            room, i = room + sums[i], i & (i - 1)
        while j > i:
            room, j = room - sums[j], j & (j - 1)
        if longest > room:
            out[last - 1] += longest - room
            i = last
            while i <= n:
                sums[i] += longest - room
                i += i & -i
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]], growth: float = GROWTH) -> list[str]:
    """Rows of cells (lines, columns and rows spanned) as lines with padded columns, or without padding where that would be over growth times the text."""
    cells = sum(map(len, rows))
    size = sum(len(x) for row in rows for lines, *_ in row for x in lines) + cells
    taken = Taken(sum(span for row in rows for _, span, _ in row))
    placed: list[list[tuple[int, int, list[str]]]] = []
    for r, row in enumerate(rows):
        at, here = 0, []
        for lines, span, down in row:
            at = taken.free(at, r)
            here.append((at, at + span, lines))
            if down > 1 and r + 1 < len(rows):
                taken.take(at, at + span, r + down - 1)
            at += span
        placed.append(here)
    starts = sorted({a for row in placed for a, _, _ in row})
    column = {a: i for i, a in enumerate(starts)}
    widths, wide = [0] * len(starts), []
    for row in placed:
        for a, b, lines in row:
            first, last = column[a], max(column[a] + 1, bisect_left(starts, b))
            longest = max(map(len, lines), default=0)
            if last - first == 1:
                widths[first] = max(widths[first], longest)
            else:
                wide.append((first, last, longest))
    offset = [0]
    for w in widened(widths, wide):
        offset.append(offset[-1] + w + 2)
    out: list[list[tuple[int, str]]] = []  # each line's texts and where they stand
    for row in placed:
        here = [[] for _ in range(max((len(lines) for _, _, lines in row), default=0))]
        for a, _, lines in row:
            for line, x in zip(here, lines):
                line.append((offset[column[a]], x))
        out += here
    ends = (next((at + len(x) for at, x in reversed(line) if x), 0) for line in out)
    if sum(ends) > growth * size + 10_000:
        return [line for texts in out if (line := "  ".join(x for _, x in texts).rstrip())]
    return [spaced_out(line) for line in out]


def spaced_out(texts: list[tuple[int, str]]) -> str:
    """Texts at their places in one line."""
    parts, end = [], 0
    for at, x in texts:
        if x:
            parts += [" " * (at - end), x]
            end = at + len(x)
    return "".join(parts).rstrip()


def render(root: Node, growth: float = GROWTH, most: float = DEEP) -> str:
    outs = [Out()]
    lists: list[list] = []  # the open lists' next number, or None
    tables: list[list] = []  # the open tables' rows
    pre = deep = 0
    stack: list[tuple] = [(root, False, True)]
    while stack:
        node, leaving, visible = stack.pop()
        out = outs[-1]
        if isinstance(node, str):
            if visible:
                out.text(node, pre > 0)
            continue
        tag = node.tag
        if not node.display:
            continue
        if node.visibility is not None:
            visible = node.visibility
        cell = tag in ("td", "th") and tables and not deep
        if not leaving:
            if tag == "br":
                out.newline(True)
                continue
            if tag == "hr":
                out.block(True)
                continue
            if cell:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append(Out())
            elif tag == "table" and len(tables) < most:
                out.block(True)
                tables.append([])
                outs.append(Out())
            elif tag == "tr" and tables and not deep:
                tables[-1].append([])
            elif tag in BLOCK:
                deep += tag == "table"
                out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol"):
                lists.append([1 if tag == "ol" else None, out.indent])
            elif tag == "li":
                count = lists[-1][0] if lists else None
                out.indent = "  " * int(min(max(len(lists) - 1, 0), most))
                out.marker = "- " if count is None else f"{count}. "
                if count is not None:
                    lists[-1][0] += 1
            pre += tag in ("pre", "textarea")
            stack.append((node, True, visible))
            children = node.children
            if node.closed:  # its first summary alone shows
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            stack += [(c, False, visible) for c in reversed(children)]
            continue
        pre -= tag in ("pre", "textarea")
        if cell:
            tables[-1][-1].append((outs.pop().result(), node.span, node.rows))
        elif tag == "table" and not deep:
            stray, rows = outs.pop().result(), tables.pop()
            out = outs[-1]
            for line in [*stray, *aligned(rows, growth)]:
                out.line = [line]
                out.newline(True)
            out.block(True)
        elif tag in BLOCK:
            deep -= tag == "table"
            out.block(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol"):
            out.indent = lists.pop()[1]
        elif tag == "li":
            out.indent, out.marker = "", ""
    return "\n".join(outs[0].result())


def visible_text(html: str, growth: float | None = GROWTH, deep: float | None = DEEP) -> str:
    b = Builder()
    b.feed(html)
    b.close()
    b.settle()
    return render(b.root, *(math.inf if x is None else x for x in (growth, deep)))


def extract(pages: DataFrame, html: str = "html", growth: float | None = GROWTH, deep: float | None = DEEP) -> DataFrame:
    """pages with text, the visible text of html; html itself is dropped. growth and deep: the bounds on white space, None for none."""
    rest = [c for c in pages.columns if c not in (html, "text")]
    rows = pages.select(*(F.col(quoted(c)) for c in (*rest, html)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, texts, size = 0, [], 0
            for i, t in enumerate(batch.column(len(rest)).to_pylist(), 1):
                texts.append(None if t is None else visible_text(t, growth, deep))
                size += len(texts[-1] or "")
                if size > TOGETHER or i == batch.num_rows:
                    part = batch.slice(at, len(texts)).columns[: len(rest)]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(texts, pa.string())], names=[*rest, "text"])
                    at, texts, size = i, [], 0

    return map_arrow(rows, run, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())]))
