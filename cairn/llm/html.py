"""Text of web pages as it is laid out: a tree with implied tags, then its rendering.

The tree builder puts in what authors leave out (ends of paragraphs, list items, table cells and
rows, missing table rows) and ignores ends that match nothing. The renderer drops what
is not shown (scripts, styles, the head, hidden elements), collapses white space as
browsers do, sets blocks apart, marks and indents list items, and aligns the columns of tables.
Formulas and drawings show their text, without what describes or defines it. Neither tree nor
rendering recurse, so elements may be nested as deep as a page has bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches

# Element names of the public HTML standard, by their role in parsing and layout.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"script", "style", "head", "title", "template", "noscript", "noframes", "datalist", "object", "iframe", "audio", "video", "canvas", "meta", "link", "base", "param", "rp"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "menu", "table", "blockquote", "pre", "figure", "hr", "fieldset"}
UNSEEN_IN_DRAWINGS = {"desc", "defs", "metadata", "symbol", "marker", "pattern", "mask", "clippath", "lineargradient", "radialgradient", "filter", "annotation", "annotation-xml"}
APART_IN_DRAWINGS = {"text", "textpath", "mfrac", "mtr", "mtd", "msqrt"}
PLAIN_BLOCKS = {"html", "body", "div", "article", "section", "nav", "aside", "header", "footer", "main", "address", "form", "figcaption", "details", "summary", "dialog", "legend", "center", "li", "dt", "dd", "optgroup", "option", "caption", "search", "hgroup"}
ENDS_PARAGRAPH = (SPACED | PLAIN_BLOCKS | {"dl", "hr"}) - {"html", "body", "option", "optgroup", "caption", "legend"}
HEAD_ONLY = {"meta", "link", "base", "title", "style", "script", "noscript", "template"}
# what a new element ends, and the elements beyond which it does not look
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPES = {"table", "td", "th", "caption", "html", "button", "template"}
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
#: Columns beyond which deeper lists are indented no more; their text goes on.
MOST_INDENT = 64


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder(HTMLParser):
    """Builds the tree; text is a str among the children. at: where in the open elements those of each tag are."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {"html": [0]}

    def _last(self, names: set[str]) -> int:
        """The place of the innermost open element of these names; 0, the root, if there is none."""
        at = self.at
        return max((at[n][-1] for n in names if at.get(n)), default=0)

    def _close(self, place: int) -> None:
        """Ends the element at place and all within it."""
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()

    def _end(self, names: set[str], scope: set[str]) -> None:
        """Ends the innermost open element of these, unless the scope comes first; and again, for nested ones."""
        while (place := self._last(names)) > self._last(scope - names):
            self._close(place)

    def _add(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.at.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _drawing(self) -> bool:
        return self._last({"svg", "math"}) > self._last({"foreignobject"})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            self.root.attrs |= dict(attrs)
            return
        if tag == "body":
            if self.at.get("head"):
                self._end({"head"}, set())
            self.root.attrs |= {k: v for k, v in attrs if k in ("hidden", "style")}
            return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._close(len(self.open) - 1)
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, SCOPES)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._add(Node("tr"))
        node = Node(tag, dict(attrs))
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._add(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self._drawing():  # there, and only there, a tag may end itself
            self.open[-1].children.append(Node(tag, dict(attrs)))
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                self.open[-1].children.append(Node("br"))
            return
        if tag == "table":
            scope = set()
        elif tag in ("caption", "thead", "tbody", "tfoot", "tr", "td", "th"):
            scope = {"table"}
        else:
            scope = {"td", "th", "caption", "table"}
        place = self._last({tag})
        if place and place >= self._last(scope):
            self._close(place)
            return
        if tag == "p":  # the end of no paragraph is an empty one
            self.open[-1].children.append(Node("p"))

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._close(len(self.open) - 1)
        self.open[-1].children.append(data)


def shown(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a:
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not HIDING.search(a.get("style") or "")


class Page:
    """Lines of text under way: what is collapsed, and how far blocks are apart."""

    def __init__(self):
        self.lines: list[str] = []
        self.now = ""
        self.gap = 0

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *more = data.split("\n")
            self._put(first, keep=True)
            for line in more:
                self.newline()
                self._put(line, keep=True)
            return
        data = SPACE.sub(" ", data)
        if not self.now or self.now.endswith(" "):
            data = data.lstrip(" ")
        self._put(data)

    def _put(self, data: str, keep: bool = False) -> None:
        if not data:
            return
        if not self.now and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.now += data

    def newline(self) -> None:
        """A line break that is shown even where the line is empty."""
        self.lines.append(self.now.rstrip(" "))
        self.now = ""

    def block(self, apart: int) -> None:
        """The end or the start of a block: apart blank lines at least."""
        if self.now.strip(" "):
            self.lines.append(self.now.rstrip(" "))
        self.now = ""
        while self.lines and not self.lines[-1]:
            self.lines.pop()
            self.gap = max(self.gap, 1)
        self.gap = max(self.gap, apart)

    def done(self) -> list[str]:
        self.block(0)
        return self.lines


def called(first):
    """Runs a generator that yields calls (generators too) and gets their results, to any depth."""
    stack, value = [first], None
    while stack:
        try:
            call = stack[-1].send(value)
            stack.append(call)
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def render(node: Node, page: Page, pre: bool = False, depth: int = 0, drawing: bool = False):
    for child in node.children:
        if isinstance(child, str):
            page.text(child, pre)
            continue
        tag = child.tag
        if not shown(child):
            continue
        if drawing:
            if tag in UNSEEN_IN_DRAWINGS:
                continue
            if tag in APART_IN_DRAWINGS:
                page.text(" ", False)
            yield render(child, page, pre, depth, tag != "foreignobject")
            if tag in APART_IN_DRAWINGS:
                page.text(" ", False)
        elif tag in ("svg", "math"):
            yield render(child, page, pre, depth, True)
        elif tag == "br":
            page.newline()
        elif tag == "hr":
            page.block(1)
        elif tag in ("ul", "ol", "menu"):
            page.block(0 if depth else 1)
            insert(page, (yield listed(child, pre, depth)))
            page.block(0 if depth else 1)
        elif tag == "table":
            page.block(1)
            insert(page, (yield tabled(child, pre)))
            page.block(1)
        elif tag in ("td", "th"):  # without a table
            yield render(child, page, pre, depth)
            page.text(" ", False)
        elif tag == "dd":
            page.block(0)
            insert(page, indented((yield inside(child, pre, depth + 1)), "  ", "  ", depth))
            page.block(0)
        elif tag in SPACED or tag in PLAIN_BLOCKS or tag == "tr":
            apart = 1 if tag in SPACED else 0
            page.block(apart)
            yield render(child, page, pre or tag == "pre", depth)
            page.block(apart)
        elif tag == "q":
            page.text("“", pre)
            yield render(child, page, pre, depth)
            page.text("”", pre)
        elif tag == "input":
            if (child.attrs.get("type") or "text").lower() in ("submit", "reset", "button") and child.attrs.get("value"):
                page.text(child.attrs["value"], pre)
        elif tag == "textarea":
            yield render(child, page, True, depth)
        else:
            yield render(child, page, pre, depth)


def insert(page: Page, lines: list[str]) -> None:
    for line in lines:
        if line:
            page._put(line, keep=True)
        page.newline()


def indented(lines: list[str], first: str, rest: str, depth: int) -> list[str]:
    """lines behind their mark; below MOST_INDENT columns of lists and definitions around them the mark stays and the indentation ends."""
    if 2 * depth >= MOST_INDENT:
        rest = ""
    lines = lines or [""]
    return [(first + lines[0]).rstrip(" "), *([rest + x if x else x for x in lines[1:]] if rest else lines[1:])]


def inside(node: Node, pre: bool, depth: int):
    page = Page()
    yield render(node, page, pre, depth)
    return page.done()


def listed(node: Node, pre: bool, depth: int):
    """Lines of a list: a mark before each item, its further lines indented."""
    out: list[str] = []
    start = str(node.attrs.get("start") or "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.append(SPACE.sub(" ", child).strip(" "))
            continue
        if not shown(child):
            continue
        if child.tag != "li":
            holder = Node("div")
            holder.children = [child]
            out += indented((yield inside(holder, pre, depth + 1)), "  ", "  ", depth)
            continue
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        out += indented((yield inside(child, pre, depth + 1)), mark, " " * len(mark), depth)
    return out


def wide(text: str) -> int:
    """Columns that text takes."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def number_of(node: Node, name: str, most: int) -> int:
    value = str(node.attrs.get(name) or "1")
    return min(max(int(value), 1), most) if re.fullmatch(r"\d{1,6}", value) else 1


def tabled(node: Node, pre: bool):
    """Lines of a table: its caption, then rows whose cells start in one column each, two spaces apart."""
    captions, rows = [], []

    def walk(n: Node):
        for child in n.children:
            if isinstance(child, str):
                if child.strip():
                    captions.append(SPACE.sub(" ", child).strip(" "))
            elif shown(child):
                if child.tag == "tr":
                    captions.extend(SPACE.sub(" ", c).strip(" ") for c in child.children if isinstance(c, str) and c.strip())
                    row = []
                    for c in child.children:
                        if not isinstance(c, str) and shown(c):
                            row.append(((yield inside(c, pre, 0)), number_of(c, "colspan", 1000), number_of(c, "rowspan", 65534)))
                    rows.append(row)
                elif child.tag in ("thead", "tbody", "tfoot"):
                    yield walk(child)
                elif child.tag not in ("col", "colgroup"):
                    captions.extend((yield inside(child, pre, 0)))

    yield walk(node)
    grid: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}  # columns that a cell of an earlier row still fills, and for how many rows
    for row in rows:
        line, column = [], 0
        for lines, across, down in row:
            while taken.get(column, 0):
                column += 1
            line.append((column, lines, across))
            if down > 1:
                taken |= {c: down for c in range(column, column + across)}
            column += across
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for column, lines, across in line:
            if across == 1:
                widths[column] = max(widths.get(column, 0), max(map(wide, lines), default=0))
    ends = sorted({c for line in grid for c, _, _ in line})
    at, place = {}, 0
    for column in ends:
        at[column] = place
        place += widths.get(column, 0) + 2
    out = list(captions)
    for line in grid:
        height = max((len(lines) for _, lines, _ in line), default=0)
        for i in range(height):
            text, filled = "", 0
            for column, lines, _ in line:
                part = lines[i] if i < len(lines) else ""
                if part:
                    gap = max(at[column] - filled, 2 if text else 0)
                    text, filled = text + " " * gap + part, filled + gap + wide(part)
            out.append(text)
    return out


def visible_text(html: str) -> str:
    """All text that a page shows, laid out in lines."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    if not shown(builder.root):
        return ""
    return "\n".join(called(inside(builder.root, False, 0)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (of text) for every row of pages (page_id, url, html).

    Null html counts as empty, and has an empty text. Null ids and repeated rows
    stay, one row out for each row in; other columns are not read; an empty table
    gives an empty one. Broken markup never fails: what cannot be read as a tag is
    text. Pages of any length and depth are read whole. Nothing is shuffled.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(cell.as_py() or "") for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    made = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return made.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
