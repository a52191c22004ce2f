"""Visible text of web pages as it is laid out.

A tokenizer feeds a tree builder, which closes what HTML leaves open (paragraphs, list
items, rows and cells) and adds the rows and tables that cells imply. A walk over the
tree leaves out what a browser would not show, and writes the rest: blocks apart from
each other, list items with their marks, and table cells in aligned columns. Cells that
span columns or rows leave the places they cover blank; numbered lists follow their
``start``, ``reversed`` and the ``value`` of an item; an element of hidden visibility shows
those within it that are visible again.

Defined results: null and empty pages give an empty text; broken markup is text or
closed where HTML would close it; nesting of any depth is handled without recursion. No
visible text is cut, but what only aligns it has bounds, so that a page's text stays
within a multiple of the page: at most GAP characters between two cells, INDENT before a
list item, and columns only in TABLES tables within each other (in deeper ones the cells
are blocks). Cells span at most COLUMNS columns, and cells beyond that column one row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patronage.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe datalist object audio video canvas title meta link".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul xmp".split()
)
KEPT = frozenset("pre xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote article section figure form hr menu xmp".split())
#: What a start tag ends: open elements of these names, unless one of the walls stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    **{name: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for name in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, set()),
}
WALLS = frozenset("td th caption table button".split())
TOKEN = re.compile(
    r"""<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>""", re.S
)
#: Name and value of an attribute; the value is in double, single or no quotes.
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*+)))?""")
#: What an attribute text has to hold to be worth splitting.
TELLING = re.compile("hidden|style|open", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SPAN = re.compile(r"\s*+\+?(\d{1,5})")
INTEGER = re.compile(r"\s*+([+-]?\d{1,9})(?!\d)")
BLANKS = re.compile(r"[ \t\n\f\r]+")
#: Bounds of what only aligns text.
GAP = 200
INDENT = 80
TABLES = 8
COLUMNS = 1000
ROWS = 65534


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(page: str) -> Node:
    root = Node("html")
    open_, depth = [root], {"html": 1}

    def push(tag: str, attributes: str = "") -> None:
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        open_.append(node)
        depth[tag] = depth.get(tag, 0) + 1

    def pop_to(size: int) -> None:
        while len(open_) > size:
            depth[open_.pop().tag] -= 1

    def close(names: set[str], walls) -> None:
        """End the outermost of ``names`` that no wall encloses."""
        if not any(depth.get(name) for name in names):
            return
        last = 0
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in walls:
                break
            if open_[k].tag in names:
                last = k
        if last:
            pop_to(last)

    def text(part: str) -> None:
        if part:
            open_[-1].children.append(html.unescape(part) if "&" in part else part)

    at = 0
    while match := TOKEN.search(page, at):
        text(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = match.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                open_[-1].children.append(Node("br"))
            elif depth.get(tag) and tag != "html":
                walls = () if tag in WALLS else WALLS
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag == tag:
                        pop_to(k)
                        break
                    if open_[k].tag in walls:
                        break
            continue
        if tag == "html":
            continue
        if tag in BLOCKS and depth.get("p"):
            close({"p"}, WALLS)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th", "tr"):
            if not depth.get("table"):
                push("table")
            if tag != "tr" and open_[-1].tag != "tr":
                push("tr")
        if tag in VOID:
            open_[-1].children.append(Node(tag, attributes))
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node = Node(tag, attributes)
            inside = page[at : end.start() if end else len(page)]
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(inside))
            elif tag == "xmp":
                node.children.append(inside)
            open_[-1].children.append(node)
            at = end.end() if end else len(page)
        else:
            push(tag, attributes)
    text(page[at:])
    return root


def attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts, and one without a value is empty."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def declared(style: str) -> dict[str, str]:
    """The values that count in a style attribute, by lower-case name."""
    last: dict[str, tuple[bool, str]] = {}
    for declaration in COMMENT.sub(" ", style).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        name = name.strip()
        if bool(mark) >= last.get(name, (False, ""))[0]:
            last[name] = bool(mark), value.strip()
    return {name: value for name, (_, value) in last.items()}


def shown(node: Node) -> tuple[bool, bool | None]:
    """Is the element laid out, and is its text visible (None: as around it)?"""
    if node.tag in UNSEEN:
        return False, None
    if not node.attributes or not TELLING.search(node.attributes):
        return node.tag != "dialog", None
    found = attributes(node.attributes)
    if node.tag == "dialog" and "open" not in found:
        return False, None
    if node.tag == "input" and found.get("type", "").strip().lower() == "hidden":
        return False, None
    style = declared(found["style"]) if found.get("style") else {}
    visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""))
    return "hidden" not in found and style.get("display") != "none", visible


def number(node: Node, name: str, form: re.Pattern, default: int) -> int:
    """The number that an attribute begins with."""
    if name not in node.attributes.lower():
        return default
    match = form.match(attributes(node.attributes).get(name, ""))
    return int(match[1]) if match else default


class Lines:
    """Lines of one flow: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.margin = 0
        self.marks: list[str] = []  # of the open list items
        self.written = self.indent = 0  # marks that were written, and their length

    def add(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self.parts.append(first)
            for line in rest:
                self.end(keep=True)
                self.parts.append(line)
            return
        text = BLANKS.sub(" ", text)
        if text[:1] == " " and (not self.parts or self.parts[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.parts.append(text)

    def end(self, margin: int = 0, keep: bool = False) -> None:
        line = "".join(self.parts)
        line = line.rstrip() if keep else line.strip(" ")
        self.parts = []
        if line or keep:
            self.put(line)
        self.margin = max(self.margin, margin)

    def put(self, line: str) -> None:
        if self.lines and self.margin:
            self.lines.append("")
        self.margin = 0
        new = self.marks[self.written :]
        self.lines.append((" " * min(self.indent, INDENT) + "".join(new) + line).rstrip())
        self.written = len(self.marks)
        self.indent += sum(map(len, new))

    def close_mark(self) -> None:
        mark = self.marks.pop()
        if self.written > len(self.marks):
            self.written -= 1
            self.indent -= len(mark)


class Grid:
    """Cells of a table at their columns."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.sizes: list[int] = []  # columns of each row
        self.down: list[tuple[int, int, int]] = []  # columns that cells of earlier rows cover (first, end), and up to which row
        self.new: list[tuple[int, int, int]] = []
        self.passed = 0  # those that the row has passed

    def row(self) -> None:
        self.rows.append([])
        self.sizes.append(0)
        at = len(self.rows) - 1
        covered: list[tuple[int, int, int]] = []
        for first, end, until in sorted(x for x in self.down + self.new if x[2] > at):
            if covered and covered[-1][1:] == (first, until):
                first = covered.pop()[0]
            covered.append((first, end, until))
        self.down, self.new, self.passed = covered, [], 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        at = self.sizes[-1]
        while self.passed < len(self.down) and self.down[self.passed][0] <= at:
            at = max(at, self.down[self.passed][1])
            self.passed += 1
        self.rows[-1].append((at, lines))
        self.sizes[-1] = at + columns
        if rows > 1 and at < COLUMNS:
            self.new.append((at, min(at + columns, COLUMNS), len(self.rows) - 1 + rows))

    def lines(self) -> Iterator[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, lines in row:
                widths[column] = max(widths.get(column, 0), *map(len, lines), 0)
        for row, size in zip(self.rows, self.sizes, strict=True):
            left = row
            for i in range(max((len(lines) for _, lines in row), default=0)):
                left = [cell for cell in left if len(cell[1]) > i]
                parts, column, used = [], 0, 0
                for at, lines in left:
                    if lines[i]:
                        parts += [self._gap(widths, column, used, at), lines[i]]
                        column, used = at, len(lines[i])
                parts.append(self._gap(widths, column, used, size - 1))
                yield "".join(parts).rstrip()

    @staticmethod
    def _gap(widths: dict[int, int], column: int, used: int, to: int) -> str:
        """What lies between the text of a cell and the start of a later column."""
        if to <= column:
            return ""
        out = " " * min(widths.get(column, 0) - used, GAP)
        for k in range(column + 1, to):
            if len(out) >= GAP:
                break
            out += " | " + " " * min(widths.get(k, 0), GAP)
        return out[: GAP - 3] + " | "


def render(root: Node) -> str:
    flows = [Lines()]
    tables: list[Grid] = []
    deep = 0  # tables beyond TABLES
    lists: list[list] = []  # is it numbered, the next number, and the step
    visible = [True]
    kept = 0
    work: list[tuple[object, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if visible[-1]:
                flow.add(node, kept > 0)
            continue
        tag = node.tag
        if not leaving:
            laid_out, own = shown(node)
            if not laid_out:
                continue
            if tag == "br":
                flow.end(keep=bool(flow.parts) and kept > 0)
                continue
            if tag in BLOCKS and tag != "table":
                flow.end(int(tag in SPACED and not (flow.marks and tag in ("ul", "ol", "p"))))
            if tag == "li":
                numbered = lists[-1] if lists else [False, 1, 1]
                if numbered[0]:
                    numbered[1] = number(node, "value", INTEGER, numbered[1])
                flow.marks.append(f"{numbered[1]}. " if numbered[0] else "- ")
                numbered[1] += numbered[2]
            elif tag == "ol":
                step = -1 if "reversed" in node.attributes.lower() and "reversed" in attributes(node.attributes) else 1
                first = 1 if step == 1 else sum(isinstance(x, Node) and x.tag == "li" for x in node.children)
                lists.append([True, number(node, "start", INTEGER, first), step])
            elif tag in ("ul", "menu", "dir"):
                lists.append([False, 1, 1])
            elif tag in KEPT:
                kept += 1
            elif tag == "table":
                flow.end(1)
                if deep or len(tables) == TABLES:
                    deep += 1
                else:
                    tables.append(Grid())
            elif tag in ("tr", "td", "th", "caption") and (deep or tag == "caption"):
                flow.end()
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th") and tables:
                flows.append(Lines())
            visible.append(visible[-1] if own is None else own)
            work.append((node, True))
            closed = tag == "details" and "open" not in attributes(node.attributes)
            for child in reversed(node.children):
                if not closed or (isinstance(child, Node) and child.tag == "summary"):
                    work.append((child, False))
            continue
        visible.pop()
        if deep and tag in ("table", "tr", "td", "th"):
            flow.end(int(tag == "table"))
            deep -= tag == "table"
        elif tag in ("td", "th") and tables:
            flow.end(keep=False)
            flows.pop()
            rows = number(node, "rowspan", SPAN, 1)
            tables[-1].cell(flow.lines, min(max(number(node, "colspan", SPAN, 1), 1), COLUMNS), min(rows, ROWS) or ROWS)
        elif tag == "table":
            flow.end()
            for line in tables.pop().lines():
                flow.put(line)
            flow.end(1)
        elif tag == "caption":
            flow.end()
        elif tag in BLOCKS:
            flow.end(int(tag in SPACED and not (flow.marks and tag in ("ul", "ol", "p"))), keep=kept > 0 and bool(flow.parts))
            if tag == "li":
                flow.close_mark()
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in KEPT:
                kept -= 1
    flows[0].end()
    return "\n".join(flows[0].lines).replace("\xa0", " ").strip("\n")


def visible_text(page: str) -> str:
    return render(parse(page)) if page else ""


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``df`` and the visible text of ``page``; a column named as ``out`` is replaced."""
    rest = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, page):
                column = pa.array([visible_text(x or "") for x in part.column(page).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, out])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(out, StringType())]))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text and its length for every page."""
    found = extract(pages.select("page_id", "html"))
    return found.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
