"""Layout-aware text of HTML pages.

A tree builder follows the page's tags, adds those that HTML implies (end tags of paragraphs,
items, cells and rows, rows without a tag, the end of the head), and keeps the open elements on
a stack. Visible text goes to a writer as elements open and close: blocks start lines and
leave a blank line where browsers leave a margin, list items get markers and indentation, and
table cells are laid out in aligned columns when their table ends. Nesting of any depth needs no
recursion.

Hidden are the head, scripts, styles, templates, fallback content (``noscript`` too, as scripts are
taken to run), elements with ``hidden`` or ``display: none``, closed details and dialogs; ``visibility``
is inherited and may be set back. Left out although browsers draw them: ``svg``, ``math``, embedded media,
``select`` lists and the preset text of ``textarea``.

The output grows with the page: indentation and the columns of a table are aligned up to
``MAX_INDENT``, ``MAX_COLUMN`` and ``MAX_START`` characters, and text beyond that follows after a gap; tables nested
deeper than ``MAX_TABLES`` give their rows as lines. No text is dropped for it.

Defined cases: a null or empty page gives an empty text; a tag that the page ends within is
dropped with what follows, as browsers do; end tags that match nothing are ignored; cells
outside of tables are plain text; pages are rendered whole, row by row; rows that repeat an id
are rendered each.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|(?<!=)[\"']|=?\"[^\"]*+\"|=?'[^']*+')*+)>"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+>|<(?=[a-zA-Z])",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)")
_INTEGER = re.compile(r"\s*([+-]?\d+)")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
_RAW = set("script style xmp iframe noembed noframes noscript textarea title".split())
_HEAD = set("title meta link style script base template noscript".split())
_HIDDEN = set(
    "head script style template title iframe noembed noframes noscript object video audio canvas "
    "datalist svg math applet embed textarea select rp".split()
)
#: Blocks with a margin, and blocks that only start a line.
_MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre xmp figure fieldset table hr listing".split())
_LINE = set(
    "address article aside body center dd details dialog dir div dt figcaption footer form header "
    "hgroup html legend li main nav option search section summary caption optgroup".split()
)
_BLOCK = _MARGIN | _LINE
#: Blocks that leave an open paragraph open, and the only tags that count within a list of options.
_WITHIN_P = {"option", "optgroup"}
_IN_SELECT = {"option", "optgroup", "hr", "select", "script", "template"}
_END_SELECT = {"input", "keygen", "textarea"}
_CELL = {"td", "th"}
_SECTION = {"thead", "tbody", "tfoot"}
_TABLE_PARTS = _CELL | _SECTION | {"tr", "caption", "col", "colgroup"}
_SCOPE = {"td", "th", "caption", "table", "html", "template", "button", "object"}
#: Open elements that a start tag ends, and those beyond which it does not look.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"} | _SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | _SCOPE),
    "dd": ({"dt", "dd"}, {"dl"} | _SCOPE),
    "option": ({"option"}, {"select"} | _SCOPE),
    "optgroup": ({"option", "optgroup"}, {"select"} | _SCOPE),
    "tr": ({"tr"}, {"table"}),
    "caption": ({"caption", "tr", *_SECTION}, {"table"}),
    **{name: (_CELL | {"caption"}, {"tr", "table"}) for name in _CELL},
    **{name: ({"caption", "tr", *_SECTION}, {"table"}) for name in _SECTION},
}
_GAP = "  "
MAX_INDENT, MAX_COLUMN, MAX_START, MAX_TABLES = 64, 120, 480, 32


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


class Writer:
    """Collects lines; knows pending space, margins, indentation and list markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.started = False
        self.margin = 0
        self.prefix = ""
        self.indents: list[int] = []  # what each open block adds to the prefix
        self.marker: str | None = None

    def _start(self) -> None:
        if self.lines and self.margin:
            self.lines.append("")
        self.margin = 0
        prefix = self.prefix
        if self.marker is not None:
            room = self.indents[-1] if self.indents else 0
            prefix, self.marker = prefix[: len(prefix) - room] + self.marker, None
        self.line, self.started = [prefix], True

    def indent(self, size: int) -> None:
        size = size if len(self.prefix) + size <= MAX_INDENT else 0
        self.prefix += " " * size
        self.indents.append(size)

    def dedent(self) -> None:
        self.prefix = self.prefix[: len(self.prefix) - self.indents.pop()]

    def text(self, data: str) -> None:
        """Text of running lines; white space is collapsed."""
        parts = _SPACE.sub(" ", data)
        if not parts:
            return
        body = parts.strip(" ")
        if not body:
            self.space = True
            return
        if not self.started:
            self._start()
        elif self.space or parts[0] == " ":
            self.line.append(" ")
        self.line.append(body)
        self.space = parts[-1] == " "

    def exact(self, data: str) -> None:
        """Preformatted text."""
        first, *rest = data.replace("\r\n", "\n").split("\n")
        for k, part in enumerate([first, *rest]):
            if k:
                self.newline()
            if part:
                if not self.started:
                    self._start()
                self.line.append(part)

    def newline(self) -> None:
        if not self.started:
            self._start()
        self.end()

    def end(self) -> None:
        """End the line if one has begun."""
        if self.started:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.started, self.space = [], False, False

    def block(self, margin: int) -> None:
        self.end()
        self.margin = max(self.margin, margin)

    def whole(self, lines: list[str]) -> None:
        for line in lines:
            self._start()
            self.line.append(line)
            self.end()

    def finish(self) -> list[str]:
        self.end()
        return self.lines


class Table:
    """Rows of cells, each with its lines and spans."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.open = False

    def row(self) -> None:
        self.rows.append([])
        self.open = True

    def add(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.open:
            self.row()
        self.rows[-1].append((lines, columns, rows))

    def layout(self) -> list[str]:
        """Lines with the cells of a column below one another."""
        taken: dict[int, int] = {}  # column: first row that is free again
        placed, wide = [], []
        widths: dict[int, int] = {}
        for number, row in enumerate(self.rows):
            column, cells = 0, []
            for lines, columns, rows in row:
                while taken.get(column, 0) > number:
                    column += 1
                size = min(max(map(_width, lines), default=0), MAX_COLUMN)
                if columns == 1:
                    widths[column] = max(widths.get(column, 0), size)
                elif size:
                    wide.append((column, columns, size))
                if rows > 1:
                    for k in range(column, column + columns):
                        taken[k] = number + rows
                cells.append((column, lines))
                column += columns
            placed.append(cells)
        for column, columns, size in wide:  # the last column that it spans takes what is missing
            filled = [k for k in range(column, column + columns) if widths.get(k)]
            missing = size - sum(widths[k] for k in filled) - len(_GAP) * max(0, len(filled) - 1)
            if missing > 0:
                last = filled[-1] if filled else column
                widths[last] = widths.get(last, 0) + missing
        at, start = 0, {}
        for column in sorted(widths):
            start[column] = min(at, MAX_START)
            at += widths[column] + len(_GAP) if widths[column] else 0
        out = []
        for cells in placed:
            for k in range(max((len(lines) for _, lines in cells), default=0)):
                text, end = [], 0
                for column, lines in cells:
                    if k < len(lines) and lines[k]:
                        place = max(start.get(column, end), end + len(_GAP) if end else 0)
                        text.append(" " * (place - end) + lines[k])
                        end = place + _width(lines[k])
                out.append("".join(text).rstrip())
        return out


class Element:
    __slots__ = ("name", "hidden", "invisible", "data", "writer")

    def __init__(self, name, hidden, invisible, data=None, writer=None):
        self.name, self.hidden, self.invisible = name, hidden, invisible
        self.data, self.writer = data, writer


def _number(value: str | None, default: int, low: int, high: int) -> int:
    found = _INTEGER.match(value or "")
    return min(max(int(found[1][:9]), low), high) if found else default


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self):
        self.stack: list[Element] = [Element("html", False, False)]
        self.open_at: dict[str, list[int]] = {"html": [0]}  # places of open elements in the stack, by name
        self.writer = Writer()
        self.tables: list[Table] = []
        self.exact = 0

    def render(self, source: str) -> str:
        at, size = 0, len(source)
        low = None
        while at < size:
            token = _TOKEN.search(source, at)
            if not token:
                self.data(source[at:])
                break
            if token.start() > at:
                self.data(source[at : token.start()])
            at = token.end()
            if token[1]:
                name = token[1].lower()
                self.start(name, token[2])
                if name in _RAW:
                    low = source.lower() if low is None else low
                    # Case folding may change a text's length in rare letters.
                    end = low.find(f"</{name}", at) if len(low) == size else _raw_end(source, name, at)
                    end = size if end < 0 else end
                    self.data(source[at:end], raw=name not in ("textarea", "title"))
                    at = end
            elif token[3]:
                self.end(token[3].lower())
            elif token[0] == "<":
                break  # the page ends within a tag
        while len(self.stack) > 1:
            self.pop()
        return "\n".join(self.writer.finish())

    def last(self, *names: str) -> int:
        """Place of the nearest open element of these names, or -1."""
        return max((self.open_at[n][-1] for n in names if self.open_at.get(n)), default=-1)

    def data(self, data: str, raw: bool = False) -> None:
        if self.stack[-1].name == "head" and data.strip():
            self.pop()
        top = self.stack[-1]
        if top.hidden or top.invisible:
            return
        data = data if raw or "&" not in data else html.unescape(data)
        if self.exact:
            self.writer.exact(data)
        else:
            self.writer.text(data)

    def start(self, name: str, source: str) -> None:
        if self.stack[-1].name == "head" and name not in _HEAD:
            self.pop()
        if self.last("select") > 0:
            if name in _END_SELECT:
                self.close({"select"}, {"html"})
            elif name == "select":
                return self.close({"select"}, {"html"})
            elif name not in _IN_SELECT:
                return None
        if name in _BLOCK and name not in _WITHIN_P and self.last("select") < 0:
            self.close({"p"}, _SCOPE)
        if name in _ENDS:
            self.close(*_ENDS[name])
        if name == "table" and len(self.tables) >= MAX_TABLES:
            name = "div"  # its parts are the lines of a block
        if name in _TABLE_PARTS and not self.within_table():
            if len(self.tables) >= MAX_TABLES and not self.stack[-1].hidden:
                self.writer.block(0)
            return None
        if name in _CELL and not self.within_row():
            self.start("tr", "")
        attributes = {}
        if source.strip(" /\n\t"):
            for key, *values in _ATTRIBUTE.findall(source):
                attributes.setdefault(key.lower(), html.unescape("".join(values)))
        parent = self.stack[-1]
        style = dict(_DECLARATION.findall(attributes.get("style", "").lower()))
        hidden = parent.hidden or name in _HIDDEN or "hidden" in attributes or style.get("display") == "none"
        hidden |= name == "dialog" and "open" not in attributes
        hidden |= parent.name == "details" and parent.data is None and name != "summary"
        invisible = style.get("visibility", "hidden" if parent.invisible else "visible") in ("hidden", "collapse")
        element = Element(name, hidden, invisible, attributes.get("open") if name == "details" else None)
        if name == "head":
            element.hidden = True
        if not element.hidden:
            self.open(element, attributes)
        if name not in _VOID:
            self.stack.append(element)
            self.open_at.setdefault(name, []).append(len(self.stack) - 1)
        return None

    def open(self, element: Element, attributes: dict[str, str]) -> None:
        """What a visible element does to the writer."""
        name, writer = element.name, self.writer
        if name == "br":
            if not element.invisible:
                writer.newline()
        elif name == "input":
            if attributes.get("type", "").lower() in ("submit", "button", "reset") and not element.invisible:
                writer.text(attributes.get("value", ""))
        elif name == "table":
            writer.block(1)
            self.tables.append(Table())
        elif name == "tr":
            self.tables[-1].row()
        elif name in _CELL:
            spans = [_number(attributes.get(s), 1, 1, high) for s, high in (("colspan", 1000), ("rowspan", 65534))]
            element.data, element.writer = (spans, self.exact), writer
            self.writer, self.exact = Writer(), 0
        elif name in _MARGIN:
            writer.block(0 if self.nested(name) else 1)
            if name in ("pre", "xmp", "listing"):
                self.exact += 1
            elif name == "ol":
                step = -1 if "reversed" in attributes else 1
                element.data = [_number(attributes.get("start"), 1, -(10**8), 10**8), step]
            elif name == "blockquote":
                writer.indent(2)
        elif name in _LINE:
            writer.block(0)
            if name == "li":
                self.item(element, attributes)
            elif name == "dd":
                writer.indent(4)

    def item(self, element: Element, attributes: dict[str, str]) -> None:
        of = self.stack[self.last("ul", "ol", "menu")]
        marker = "* "
        if of.name == "ol" and of.data:
            of.data[0] = _number(attributes.get("value"), of.data[0], -(10**8), 10**8)
            marker = f"{of.data[0]}. "
            of.data[0] += of.data[1]
        self.writer.indent(len(marker))
        self.writer.marker = marker
        element.data = marker

    def pop(self) -> None:
        element = self.stack.pop()
        self.open_at[element.name].pop()
        if element.hidden:
            return
        name, writer = element.name, self.writer
        if name in _CELL:
            (columns, rows), self.exact = element.data
            self.writer = element.writer
            self.tables[-1].add(writer.finish(), columns, rows)
        elif name == "tr":
            self.tables[-1].open = False
        elif name == "table":
            writer.block(0)
            writer.whole(self.tables.pop().layout())
            writer.block(1)
        elif name in _BLOCK:
            if name == "li" and writer.marker is not None and writer.marker is element.data:
                writer.newline()  # an empty item
            writer.block(1 if name in _MARGIN and not self.nested(name) else 0)
            if name in ("pre", "xmp", "listing"):
                self.exact -= 1
            elif name in ("li", "dd", "blockquote"):
                writer.dedent()

    def nested(self, name: str) -> bool:
        return name in ("ul", "ol", "menu") and self.last("li") >= 0

    def within_table(self) -> bool:
        """Whether a table is open in the cell or page that is being written."""
        return self.last("table") > self.last(*_CELL)

    def within_row(self) -> bool:
        return self.last("tr") > self.last("table")

    def close(self, names: set[str], stop: set[str]) -> None:
        """End the nearest open element of these names, and all within it."""
        k = self.last(*names)
        if k < 1 or self.last(*(stop - names)) > k:
            return
        name = self.stack[k].name
        while len(self.stack) > k:
            self.pop()
        if names & _SECTION and name == "tr":
            self.close(names, stop)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name == "p" and self.last("p") < 0:
            self.writer.block(1)
        elif name in _CELL or name in _SECTION or name in ("tr", "table"):
            self.close({name}, {"table"} - {name})
        elif name not in ("html", "body"):
            self.close({name}, (_SCOPE | ({"li"} if name == "p" else set())) - {name})


def _raw_end(source: str, name: str, at: int) -> int:
    found = re.compile(f"</{name}", re.I).search(source, at)
    return found.start() if found else -1


def render(page: str | None) -> str:
    """The text of one page."""
    return Page().render(page or "")


def layout_text(source: Column) -> Column:
    """The text of each page."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([render(page.as_py()) for page in pages], pa.string())

    return run(source)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text`` of every page."""
    return pages.select(F.col(f"`{id_col}`").alias(id_col), layout_text(F.col(f"`{html_col}`")).alias("text"))
