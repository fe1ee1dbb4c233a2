"""Visible text of HTML pages with its layout.

A tree builder applies the implied end tags, skips what is never rendered, and hides
subtrees by the visibility rules (hidden attribute, inline display:none or
visibility:hidden, closed details, inputs of type hidden). The renderer keeps block spacing,
list markers with nesting, preformatted text, and pads table cells so columns line up.
A line wider than COLUMN_WIDTH widens no column: what follows it in its row stands two
spaces behind. Columns that would begin beyond TABLE_WIDTH stand two spaces behind the cell
before. So a row gains at most TABLE_WIDTH spaces a line and level of table, and no text is lost.

Pages are independent: one pass in Arrow batches, no shuffle. All visible text is emitted;
nothing is scored or dropped as boilerplate.

Defined results: null html gives null text, an empty page the empty string; unclosed, stray
or badly nested tags give the tree the rules below lead to. Repeated rows and null ids are
rendered row by row. Only page_id and html are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element groups of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = set("head script style template noscript title meta link iframe object canvas audio video datalist".split())
# Of svg and math: what draws no text, elements whose content is html again, and html tags that end them.
FOREIGN = {"svg", "math"}
UNDRAWN = set("defs symbol clippath mask marker pattern filter lineargradient radialgradient metadata desc annotation annotation-xml mphantom".split())
INNER_HTML = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split()
)
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table ul".split()
)
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
LISTS = {"ul", "ol", "menu", "dir"}
CELLS = {"td", "th"}
GROUPS = {"thead", "tbody", "tfoot"}
# Parts of a table stand in the nearest of these; what was opened in between ends there.
STANDS_IN = {"td": GROUPS | {"tr", "table"}, "th": GROUPS | {"tr", "table"}, "tr": GROUPS | {"table"}}
STANDS_IN |= dict.fromkeys(GROUPS | {"caption", "colgroup", "col"}, {"table"})
# An opening tag closes these open elements, up to the nearest of the barriers.
CLOSES: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
for _name in ("thead", "tbody", "tfoot"):
    CLOSES[_name] = ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"})
for _name in ("h1", "h2", "h3", "h4", "h5", "h6"):
    CLOSES[_name] = ({"p", "h1", "h2", "h3", "h4", "h5", "h6"}, {"td", "th", "table", "button", "li", "div", "section", "article", "body"})
_P_BARRIERS = {"td", "th", "table", "button", "caption", "object"}
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
# Elements nested deeper stay flat: their text is kept, their nesting isn't.
DEPTH = 200
_GAP = re.compile(r"[ \t\n\r\f]+")
COLUMN_WIDTH = 80
TABLE_WIDTH = 240


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    foreign: bool = False  # an element of svg or math

    def hidden(self) -> bool:
        return (
            self.tag in UNSEEN
            or "hidden" in self.attrs
            or (self.tag == "dialog" and "open" not in self.attrs)
            or (self.foreign and (self.tag in UNDRAWN or self.attrs.get("display") == "none" or self.attrs.get("visibility") in {"hidden", "collapse"}))
            or bool(_HIDDEN_STYLE.search(self.attrs.get("style") or ""))
            or (self.tag == "input" and (self.attrs.get("type") or "").lower() == "hidden")
        )


class TreeBuilder(HTMLParser):
    """Element tree with the implied tags put in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _pop_to(self, at: int) -> None:
        del self.open[max(1, at) :]

    def _imply_ends(self, tag: str) -> None:
        closes, barriers = CLOSES.get(tag, (set(), set()))
        if tag in BLOCK and tag not in CLOSES:
            closes, barriers = {"p"}, _P_BARRIERS
        last = None
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].tag
            if name in barriers:
                break
            if name in closes:
                last = at
        if last is not None:
            self._pop_to(last)

    def _in_foreign(self) -> int:
        """Place of the svg or math whose own content is open; 0 in html."""
        inside = False
        for at in range(len(self.open) - 1, 0, -1):
            node = self.open[at]
            if not node.foreign or (node.tag in INNER_HTML and not inside):
                return 0
            inside = True
            if node.tag in FOREIGN:
                return at
        return 0

    def _end_strays(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in STANDS_IN[tag]:
                self._pop_to(at + 1)
                return
            if self.open[at].tag in CELLS | {"table", "caption"}:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        outer = self._in_foreign()
        if outer and (tag in BREAKOUT or (tag == "font" and {"color", "face", "size"} & dict(attrs).keys())):
            self._pop_to(outer)
            self.handle_starttag(tag, attrs)
            return
        if outer:
            node = Node(tag, dict(attrs), foreign=True)
            self.open[-1].children.append(node)
            if len(self.open) < DEPTH or node.hidden():
                self.open.append(node)
            return
        if tag == "html" or (tag == "body" and any(n.tag == "body" for n in self.open)):
            self.open[0].attrs |= dict(attrs)
            return
        self._imply_ends(tag)
        if tag in STANDS_IN:
            self._end_strays(tag)
        if tag in CELLS and self.open[-1].tag in {"table", "thead", "tbody", "tfoot"}:
            self.handle_starttag("tr", [])
        if self.open[-1].tag == "head" and tag not in UNSEEN | {"base", "meta"}:
            self._pop_to(len(self.open) - 1)
        if tag == "form" and self.open[-1].tag in GROUPS | {"table", "tr"}:
            return  # holds nothing there: cells and rows go on as if it weren't
        node = Node(tag, dict(attrs), foreign=tag in FOREIGN)
        self.open[-1].children.append(node)
        if tag not in VOID and (len(self.open) < DEPTH or node.hidden()):
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # The slash ends elements of svg and math; on html tags it means nothing.
        if self.open[-1].foreign and self.open[-1].tag == tag:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._pop_to(at)
                return
            if self.open[at].tag in CELLS | {"table"} and tag not in {"table", "tr", "tbody", "thead", "tfoot", "body", "html"}:
                return  # a stray end tag in a cell doesn't close what is outside

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


class Layout:
    """Collects lines; runs of white space shrink to one space outside preformatted text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = False  # a space is due before the next word
        self.blank = False  # an empty line is due before the next line
        self.indent = ""
        self.mark = ""  # list marker due on the next line

    def text(self, data: str, keep: bool = False) -> None:
        if keep:
            for i, piece in enumerate(data.split("\n")):
                if i:
                    self.newline(force=True)
                self.line += piece
            return
        words = _GAP.sub(" ", data)
        if self.line and not self.gap and words.startswith(" "):
            self.gap = True
        body = words.strip(" ")
        if body:
            self.line += (" " if self.gap and self.line else "") + body
            self.gap = words.endswith(" ")

    def newline(self, force: bool = False) -> None:
        if self.line.strip() or force:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            head = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.lines.append((head + self.line).rstrip())
            self.mark = ""
        self.line, self.gap = "", False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.blank |= spaced

    def result(self) -> list[str]:
        self.newline()
        return self.lines


def _drawing(node: Node, out: Layout) -> None:
    """Text of an svg: each text element apart, html of foreignObject."""
    for child in node.children:
        if isinstance(child, str) or child.hidden():
            continue
        if child.tag in {"text", "foreignobject"}:
            out.text(" ")
            render(child, out)
            out.text(" ")
        else:
            _drawing(child, out)


def render(node: Node, out: Layout, keep: bool = False, ordinal: list[int] | None = None) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child, keep)
            continue
        if child.hidden():
            continue
        tag = child.tag
        if tag == "svg":
            _drawing(child, out)
        elif tag == "br":
            out.newline(force=True)
        elif tag == "hr":
            out.block(True)
        elif tag == "img":
            out.text(child.attrs.get("alt") or "", keep)
        elif tag == "input" and (child.attrs.get("type") or "text").lower() in {"submit", "button", "reset"}:
            out.text(child.attrs.get("value") or "", keep)
        elif tag == "table":
            out.block(True)
            _table(child, out)
            out.block(True)
        elif tag in LISTS:
            out.block(out.indent == "")
            start = child.attrs.get("start") or ""
            render(child, out, keep, [int(start) if start.lstrip("-").isdigit() and tag == "ol" else 1] if tag == "ol" else [])
            out.block(out.indent == "")
        elif tag == "li":
            _item(child, out, keep, ordinal)
        elif tag == "details" and "open" not in child.attrs:
            out.block(False)
            render(Node("details", {}, [c for c in child.children if isinstance(c, Node) and c.tag == "summary"]), out, keep)
            out.block(False)
        elif tag in BLOCK:
            out.block(tag in SPACED)
            before = out.indent
            if tag in {"blockquote", "dd"}:
                out.indent += "  "
            render(child, out, keep or tag == "pre", ordinal if tag in {"div", "span"} else None)
            out.block(tag in SPACED)
            out.indent = before
        else:
            render(child, out, keep or tag in {"textarea"}, ordinal)


def _item(node: Node, out: Layout, keep: bool, ordinal: list[int] | None) -> None:
    out.block(False)
    mark = "- "
    if ordinal:
        value = node.attrs.get("value") or ""
        ordinal[0] = int(value) if value.lstrip("-").isdigit() else ordinal[0]
        mark, ordinal[0] = f"{ordinal[0]}. ", ordinal[0] + 1
    before = out.indent
    out.indent, out.mark = before + " " * len(mark), mark
    render(node, out, keep)
    out.block(False)
    out.indent, out.mark = before, ""


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and not child.hidden():
            if child.tag == "tr":
                yield child
            elif child.tag in GROUPS:
                yield from _rows(child)


def _strays(node: Node, parts: set[str]) -> Iterator[Node | str]:
    """What stands in a table, its row groups and rows without being a part of one."""
    for child in node.children:
        if isinstance(child, str) or child.tag not in parts:
            yield child
        elif child.tag not in CELLS | {"col"}:
            inner = list(_strays(child, {"tr": CELLS, "colgroup": {"col"}}.get(child.tag, {"tr"})))
            if any(c.strip() if isinstance(c, str) else True for c in inner):
                yield from (*inner, " ")


def _span(cell: Node) -> int:
    value = cell.attrs.get("colspan") or "1"
    return min(1000, int(value)) if value.isdigit() and int(value) else 1


def _table(node: Node, out: Layout) -> None:
    """Cells of a row side by side, each column as wide as the widest line it can hold."""
    stray = list(_strays(node, GROUPS | {"tr", "colgroup", "col"}))
    if any(c.strip() if isinstance(c, str) else True for c in stray):
        render(Node("caption", {}, stray), out)
        out.block(False)
    grid: list[list[tuple[int, int, list[str]]]] = []  # (first column, columns, lines)
    taken: dict[int, int] = {}  # columns a cell of an earlier row still covers
    for row in _rows(node):
        cells, column = [], 0
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in (c for c in row.children if isinstance(c, Node) and c.tag in CELLS and not c.hidden()):
            while column in taken:
                column += 1
            inner = Layout()
            render(cell, inner)
            wide, deep = _span(cell), cell.attrs.get("rowspan") or "1"
            cells.append((column, wide, inner.result()))
            if deep.isdigit() and int(deep) > 1:
                below |= dict.fromkeys(range(column, column + wide), min(int(deep), 65534) - 1)
            column += wide
        taken = below
        grid.append(cells)
    widths: dict[int, int] = {}
    for column, wide, lines in (cell for cells in grid for cell in cells):
        if wide == 1:
            fitting = (len(line) for line in lines if len(line) <= COLUMN_WIDTH)
            widths[column] = max(widths.get(column, 0), *fitting, 0, 0)
    columns, begins = sorted(widths), [0]
    for column in columns:
        begins.append(begins[-1] + widths[column] + 2)
    for cells in grid:
        lefts = [begins[bisect_left(columns, column)] for column, _, _ in cells]
        for at in range(max((len(lines) for _, _, lines in cells), default=0)):
            text = ""
            for left, (_, _, lines) in zip(lefts, cells, strict=True):
                if at < len(lines):
                    behind = len(text) > left or (left > TABLE_WIDTH and text)
                    text = (text + "  " if behind else text.ljust(min(left, TABLE_WIDTH))) + lines[at]
            out.line = text
            out.newline(force=bool(text))


def visible_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    out = Layout()
    render(builder.root, out)
    return "\n".join(out.result()).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [None if h is None else visible_text(h) for h in batch.column(1).to_pylist()]
                lines = [None if t is None else len(t.split("\n")) if t else 0 for t in texts]
                sizes = [None if t is None else len(t) for t in texts]
                yield pa.record_batch(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(sizes, pa.int64())],
                    ["page_id", "text", "n_lines", "n_chars"],
                )

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html")).mapInArrow(
        run, "page_id long, text string, n_lines long, n_chars long"
    )
