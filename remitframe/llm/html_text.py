"""Layout-aware HTML rendering: a tree with implied tags, visibility rules, blocks, lists, tables.

A page is tokenised by the standard library and built into a tree in which left-out tags are implied
(a ``p`` ends where a block starts, ``li``, ``dt``/``dd``, ``option``, ``tr`` and cells end their
predecessors, ``tbody`` and ``tr`` are supplied, stray end tags are ignored, everything is closed at
the end). The tree is then laid out as text:

* elements that show nothing are left out: ``head``, scripts, styles, templates, ``noscript``,
  embedded objects other than drawings and formulas, hidden inputs, the attribute ``hidden``, ``display:none``,
  ``visibility:hidden`` or ``collapse`` (children may be ``visible`` again), a closed ``dialog``, and
  all but the summary of closed ``details``;
* white space collapses except in ``pre`` and ``textarea``; blocks start new lines, and paragraphs,
  headings, lists, tables and the like keep an empty line around them;
* list items have ``- `` or their number and are indented by depth;
* table cells are padded to the widest cell of their column and joined by `` | ``; ``colspan``
  and ``rowspan`` keep later cells in their columns;
* a drawing (``svg``) shows its ``text`` elements and foreign objects, a formula (``math``) all but its
  annotations; what a ``use`` repeats is not followed;
* an image shows its ``alt`` text, ``br`` and ``hr`` break lines, form fields show their value.

What a page leaves unfinished at its end, a tag or a comment, shows nothing. Styles that come from
stylesheet rules are not applied.

All visible text is emitted, navigation and footers too: this is rendering, not article detection.

Defined results: a null or empty page gives an empty text; malformed markup never fails; pages are
rendered whole; the depth of the tree is not limited by recursion; repeated rows are rendered each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import send_by_value, text_of

send_by_value(__name__)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object embed canvas "
                   "audio video datalist title meta link base area param source track".split())
# In drawings these hold what is only shown by reference, or not at all; nothing else but these two
# holds text that is shown.
_UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
_DRAWN = frozenset(("text", "foreignobject"))
_GRAPHIC = frozenset("svg g a switch text tspan textpath foreignobject".split())
_UNREAD = frozenset("annotation annotation-xml mphantom desc".split())
# Parts of a formula that stand apart, though no white space divides them.
_APART = frozenset("mfrac msup msub msubsup munder mover munderover mroot mmultiscripts mtable mtr "
                   "mlabeledtr".split())
# Blocks that keep an empty line before and after them, and those that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset "
                   "menu dir".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside nav header footer main address form li dt dd tr td th "
    "caption thead tbody tfoot figcaption details summary dialog legend center hgroup search "
    "optgroup option".split())
# A start tag of the key ends an open element of these kinds, looked for up to one of the borders.
_P_ENDERS = BLOCKS - frozenset("html body li dt dd tr td th caption thead tbody tfoot option "
                               "optgroup legend summary figcaption".split())
_TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot".split())
_IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup"}, {"select"}), "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    **{part: (_TABLE_PARTS, {"table"}) for part in _TABLE_PARTS},
}
# An end tag doesn't reach beyond these.
_SCOPE = {"li": {"ul", "ol"}, "p": {"td", "th", "table"}, "td": {"table"}, "th": {"table"},
          "tr": {"table"}}
_COLLAPSE = re.compile(r"[ \t\n\f\r]+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the tree; ``close()`` has to be called before ``root`` is used."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]
        self.n_open: Counter[str] = Counter()   # open elements by tag

    # What a page leaves unfinished, a tag or a comment, takes the rest of it, and shows none of it.

    def _to_end(self, end: int) -> int:
        return end if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        return self._to_end(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._to_end(super().parse_endtag(i))

    def parse_comment(self, i, report=1):
        return self._to_end(super().parse_comment(i, report))

    def parse_html_declaration(self, i):
        return self._to_end(super().parse_html_declaration(i))

    def parse_pi(self, i):
        return self._to_end(super().parse_pi(i))

    def _end(self, depth: int) -> None:
        for element in self.open[depth:]:
            self.n_open[element.tag] -= 1
        del self.open[depth:]

    def _find(self, tags, borders) -> int | None:
        """Depth of the innermost open element of these tags within the borders."""
        if not any(self.n_open[tag] for tag in tags):
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                return depth
            if tag in borders:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self._merge(tag, dict(attrs))
            return
        if tag != "head" and self.open[-1].tag == "head" and tag not in UNSEEN:
            self._end(len(self.open) - 1)   # a left-out end of the head
        if tag in _P_ENDERS:
            depth = self._find({"p"}, {"td", "th", "table", "button", "object"})
            if depth:
                self._end(depth)
        if tag in _IMPLIED_ENDS:
            depth = self._find(*_IMPLIED_ENDS[tag])
            if depth:
                self._end(depth)
        inside = self.open[-1].tag
        if tag in ("td", "th") and inside != "tr" and self._find({"table"}, ()):
            self.handle_starttag("tr", [])
            inside = "tr"
        if tag == "tr" and inside == "table":
            self._push(Element("tbody", {}))
        if tag in VOID:
            self.open[-1].children.append(Element(tag, dict(attrs)))
        else:
            self._push(Element(tag, dict(attrs)))

    def _push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        self.open.append(element)
        self.n_open[element.tag] += 1

    def _merge(self, tag, attrs):
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
        else:
            if self.open[-1].tag == "head":
                self._end(len(self.open) - 1)
            if not self.n_open["body"]:
                self._push(Element("body", attrs))

    def handle_startendtag(self, tag, attrs):
        # A slash means nothing on an element that can have content, except in drawings.
        self.handle_starttag(tag, attrs)
        if self._find({"svg", "math"}, ()) and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return   # later content still belongs to the body
        depth = self._find({tag}, _SCOPE.get(tag, ()))
        if depth:
            self._end(depth)
        elif tag == "p":
            self.open[-1].children.append(Element("p", {}))
        elif tag == "br":
            self.open[-1].children.append(Element("br", {}))

    def unknown_decl(self, data):
        # Text of a drawing or formula; elsewhere it is a comment.
        if data.startswith("CDATA[") and self._find({"svg", "math"}, ()):
            self.handle_data(data[len("CDATA["):])

    def handle_data(self, data):
        if self.open[-1].tag == "head":
            if not data.strip():
                return
            self._end(len(self.open) - 1)
        self.open[-1].children.append(data)


def parse(page: str) -> Element:
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    return builder.root


# --- layout --------------------------------------------------------------------------------------

def _hides(element: Element) -> tuple[bool, str | None]:
    """Whether an element is taken out, and the visibility it sets for what is inside."""
    attrs = element.attrs
    if element.tag in UNSEEN or "hidden" in attrs:
        return True, None
    if element.tag == "input" and (attrs.get("type") or "").lower() in (
            "hidden", "password", "file", "checkbox", "radio", "image", "color", "range"):
        return True, None
    if element.tag == "dialog" and "open" not in attrs:
        return True, None
    visibility = None
    if element.tag in _GRAPHIC:   # attributes that a style goes before
        if (attrs.get("display") or "").strip().lower() == "none" and not re.search(
                r"(?:^|;)\s*display\s*:", attrs.get("style") or "", re.IGNORECASE):
            return True, None
        visibility = (attrs.get("visibility") or "").strip().lower() or None
    for name, value in _DECLARATION.findall(attrs.get("style") or ""):
        if name.lower() == "display":
            if value.lower() == "none":
                return True, None
        else:
            visibility = value.lower()
    return False, visibility


def _drawn(drawing: Element, shown: bool) -> Iterator[tuple[Element, bool]]:
    """What a drawing shows as text, in order, and whether it is visible."""
    left = [(drawing, shown)]
    while left:
        node, shown = left.pop()
        if isinstance(node, str) or node.tag in _UNDRAWN:
            continue
        gone, visibility = _hides(node)
        if gone:
            continue
        if node.tag in _DRAWN:
            yield node, shown
            continue
        if visibility:
            shown = visibility not in ("hidden", "collapse")
        left.extend((child, shown) for child in reversed(node.children))


class _Lines:
    """Text under construction: collapses white space and spaces blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False        # white space seen since the last text on this line
        self.blank = False        # an empty line is due before the next text
        self.mark = ""            # list marker due before the next text
        self.indent: list[int] = []

    def text(self, data: str) -> None:
        for k, part in enumerate(_COLLAPSE.split(data)):
            if k:
                self.space = True
            if part:
                if self.now and self.space:
                    self.now.append(" ")
                self._start()
                self.now.append(part)
                self.space = False

    def raw(self, data: str) -> None:
        for k, line in enumerate(data.split("\n")):
            if k:
                self.line(keep=True)
            if line:
                self._start()
                self.now.append(line)

    def _start(self) -> None:
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            width = sum(self.indent)
            if self.mark:
                self.now.append(" " * (width - len(self.mark)) + self.mark)
                self.mark = ""
            elif width:
                self.now.append(" " * width)
        
    def line(self, keep: bool = False) -> None:
        """Ends the line; ``keep`` keeps an empty one."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif keep and self.lines and not self.blank:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.line()
        self.blank = self.blank or spaced

    def done(self) -> str:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _width(text: str) -> int:
    """Columns of a text: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else
               2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _span(element: Element, name: str, most: int) -> int:
    value = (element.attrs.get(name) or "1").strip()
    return min(most, max(1, int(value))) if value.isdecimal() and len(value) < 7 else 1


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table. Cells are text, columns and rows spanned; empty rows are left out."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    ends: dict[int, int] = {}     # row up to which a column is taken by an earlier cell
    spanning: set[tuple[int, int]] = set()
    for r, row in enumerate(rows):
        column = 0
        for text, columns, spanned in row:
            while ends.get(column, 0) > r:
                column += 1
            grid[r][column] = text
            if columns > 1:
                spanning.add((r, column))
            for c in range(column, column + columns):
                ends[c] = r + spanned
            column += columns
    used = sorted({c for row in grid for c, text in row.items() if text})
    widths = dict.fromkeys(used, 0)
    split = [{c: text.split("\n") for c, text in row.items() if text} for row in grid]
    for r, row in enumerate(split):
        for c, lines in row.items():
            if (r, c) not in spanning:
                widths[c] = max(widths[c], *map(_width, lines))
    out = []
    for row in split:
        for k in range(max(map(len, row.values()), default=0)):
            cells = []
            for c in used:
                lines = row.get(c, ())
                cells.append(lines[k] if k < len(lines) else "")
            while cells and not cells[-1]:
                cells.pop()
            # The last cell is not padded, so what it ends in is its own.
            out.append(" | ".join([text + " " * max(0, widths[c] - _width(text))
                                   for c, text in zip(used, cells[:-1])] + cells[-1:]))
    return out


class _Table:
    """A table being laid out: its rows, and the lines that go on after it."""

    def __init__(self, outer: _Lines):
        self.outer, self.rows, self.captions = outer, [], []


def render(page: str | None) -> str:
    """The visible text of a page. Works on a stack of its own, so deep pages are no problem."""
    if not page:
        return ""
    out = _Lines()
    tables: list[_Table] = []
    lists: list[list] = []        # kind of list and the next number
    # Steps to do: (element or text, shown, preformatted) or a function that closes an element.
    steps: list = [(parse(page), True, False)]
    while steps:
        step = steps.pop()
        if callable(step):
            out = step(out)
            continue
        node, shown, raw = step
        if isinstance(node, str):
            if shown:
                out.raw(node) if raw else out.text(node)
            continue
        gone, visibility = _hides(node)
        if gone:
            continue
        if visibility:
            shown = visibility not in ("hidden", "collapse")
        tag, children = node.tag, node.children
        if tag == "br":
            if shown:
                out.line(keep=True)
            continue
        if tag in ("img", "input"):
            value = node.attrs.get("alt" if tag == "img" else "value")
            if shown and value:
                out.text(value)
            continue
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Element) and c.tag == "summary"][:1]
        raw = raw or tag in ("pre", "textarea")
        if raw and tag == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\n"), *children[1:]]
        close = None
        if tag == "svg":
            # Each piece stands for itself.
            steps.append(_apart)
            for piece, visible in reversed([*_drawn(node, shown)]):
                steps.extend(((piece, visible, False), _apart))
            continue
        if tag in _UNREAD:
            continue
        if tag == "tspan" and node.attrs.keys() & {"x", "y", "dx", "dy"}:
            out.space = True
        if tag in _APART:
            children = [part for c in children for part in (" ", c)] + [" "]
        if tag == "table":
            out.block(True)
            tables.append(_Table(out))
            close = _close_table(tables)
            out = _Lines()   # text between the cells comes before the table
        elif tables and tag == "tr":
            tables[-1].rows.append([])
        elif tables and tag in ("td", "th", "caption"):
            close = _close_cell(tables[-1], node, out)
            out = _Lines()
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(not lists)
            first = (node.attrs.get("start") or "1").strip()
            lists.append([tag, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
            close = _close_list(lists)
        elif tag == "li":
            out.block(False)
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
            out.indent.append(len(mark))
            out.mark = mark if shown else ""
            close = _close_indented
        elif tag in ("dd", "blockquote"):
            out.block(tag == "blockquote")
            out.indent.append(4 if tag == "dd" else 2)
            close = _close_indented if tag == "dd" else _close_quote
        elif tag in BLOCKS:
            spaced = tag in SPACED
            out.block(spaced)
            close = _close_spaced if spaced else _close_block
        if close:
            steps.append(close)
        steps.extend((child, shown, raw) for child in reversed(children))
    return out.done()


def _apart(out: _Lines) -> _Lines:
    out.space = True
    return out


def _close_block(out: _Lines) -> _Lines:
    out.block(False)
    return out


def _close_spaced(out: _Lines) -> _Lines:
    out.block(True)
    return out


def _close_indented(out: _Lines) -> _Lines:
    out.block(False)
    out.indent.pop()
    out.mark = ""
    return out


def _close_quote(out: _Lines) -> _Lines:
    out.block(True)
    out.indent.pop()
    return out


def _close_list(lists: list):
    def close(out: _Lines) -> _Lines:
        lists.pop()
        out.block(not lists)
        return out
    return close


def _close_cell(table: _Table, node: Element, outer: _Lines):
    def close(cell: _Lines) -> _Lines:
        text = cell.done()
        if node.tag == "caption":
            table.captions.append(text)
        else:
            if not table.rows:
                table.rows.append([])
            table.rows[-1].append((text, _span(node, "colspan", 1000),
                                   _span(node, "rowspan", 65534)))
        return outer
    return close


def _close_table(tables: list[_Table]):
    def close(between: _Lines) -> _Lines:
        table = tables.pop()
        for text in (between.done(), *table.captions, "\n".join(_table(table.rows))):
            if text:
                table.outer.raw(text)
                table.outer.block(False)
        table.outer.block(True)
        return table.outer
    return close


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: ``id``, ``text``, ``n_chars`` and ``n_lines`` (with text)."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sum(1 for line in t.split("\n") if line) for t in texts], pa.int64())],
                names=["id", "text", "n_chars", "n_lines"])
    return pages.select(F.col(id_col).alias("id"), text_of(html_col).alias("html")).mapInArrow(
        run, f"id {id_type}, text string, n_chars long, n_lines long")
