"""Visible text of HTML pages, laid out as a browser would.

A forgiving tokenizer feeds a tree builder that closes and opens the tags authors leave out; visibility rules drop what a
reader never sees; the renderer keeps block spacing (blank lines between paragraphs, headings, lists and tables), list marks
with nesting, preformatted text, and aligned columns for tables. All visible text is emitted, navigation and footers too.
An open head ends at whatever cannot stand in it. Of an svg the text elements and embedded HTML are shown, of math all but
annotations, of a select every option on a line of its own.

A cell that spans rows shows its text in the first of them and keeps its columns in the others; wide characters count as two
columns. Null and empty pages give an empty text. Broken markup never fails and is read once, however often a tag is left open: an
unclosed comment or tag ends at the next ``>`` or, without one, is text; stray end tags are ignored. The tree is walked with explicit stacks, so depth is not limited, and columns of nested
tables are aligned inside their cell. Rows with equal ids are independent.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import pick

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title param source track area base link meta annotation annotation-xml mphantom".split())
#: What may stand in a head.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: HTML inside of these, although they stand in svg or math.
EMBEDS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Start tags that end an open svg or math.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Parts of an svg that are not drawn where they stand.
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset form hr".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body caption center dd details dialog div dt figcaption footer header hgroup html legend li main menu nav option optgroup search section summary tbody td tfoot th thead tr".split())
#: Start tags that end an open element of these kinds, unless one of the walls stands between.
ENDS = {
    **{tag: ({"p"}, {"button", "table", "td", "th"}) for tag in BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "body", "summary", "legend"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd", "p"}, {"dl", "table"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "p", "caption", "li"}, {"table"}),
    "td": ({"td", "th", "p", "li"}, {"tr", "table"}),
    "th": ({"td", "th", "p", "li"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "p"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "p"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Elements opened when a child comes without them.
NEEDS = {"td": ("tr", {"tr"}), "th": ("tr", {"tr"})}
#: End tags do not reach out of these.
WALLS = frozenset("table td th caption html".split())
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"""[^>"']+""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        #: Whether the children are svg or math, not HTML.
        self.foreign = False


class Ends:
    """Where tags end, in one pass over the page in all: what was read in vain is remembered."""

    def __init__(self, page: str) -> None:
        self.page = page
        #: Places outside of quotes from which no ``>`` outside of quotes follows.
        self.vain: set[int] = set()
        self.bracket = page.find(">")

    def following(self, at: int) -> int:
        """The next ``>``, or -1."""
        if 0 <= self.bracket < at:
            self.bracket = self.page.find(">", at)
        return self.bracket

    def of(self, at: int) -> int:
        """The ``>`` that ends a tag whose name ends at ``at``: the first outside of quotes, else the first, or -1."""
        first, read = self.following(at), []
        while first >= 0 and at not in self.vain and at < len(self.page):
            sign = self.page[at]
            if sign == ">":
                return at
            read.append(at)
            if sign in "\"'":
                at = self.page.find(sign, at + 1) + 1
                if not at:
                    break
            else:
                at = _PLAIN.match(self.page, at).end()
        self.vain.update(read)
        return first


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kinds ``text``, ``start`` and ``end``; comments and declarations are gone."""
    at, size, text_from = 0, len(page), 0
    ends, comments = Ends(page), True
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        follow = page[at + 1 : at + 2]
        if follow in ("!", "?"):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) if comments else -1
                comments = end >= 0
                end = end + 3 if comments else ends.following(at) + 1
            else:
                end = ends.following(at) + 1
            if end <= 0:
                break
            if at > text_from:
                yield "text", page[text_from:at], ""
            at = text_from = end
            continue
        if not (follow.isalpha() or follow == "/"):
            at += 1
            continue
        found = _NAME.match(page, at)
        if not found:
            at += 1
            continue
        end = ends.of(found.end())
        if end < 0:
            break
        source = page[found.end() : end]
        if at > text_from:
            yield "text", page[text_from:at], ""
        name = found[2].lower()
        yield ("end" if found[1] else "start"), name, source
        at = text_from = end + 1
        if not found[1] and name in RAW and not source.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else size
            if stop > at:
                yield "text", page[at:stop], ""
            at = text_from = stop
    if text_from < size:
        yield "text", page[text_from:], ""


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class Opened(list):
    """The open elements, the root first, with the depths of every tag, so that no search walks the stack."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.depths: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def cut(self, depth: int) -> None:
        """Close everything from this depth on."""
        while len(self) > depth:
            self.depths[self.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """The depth of the innermost element of these tags, 0 without one."""
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=0)

    def first_after(self, tags: Iterable[str], depth: int) -> int:
        """The depth of the outermost element of these tags inside of ``depth``, 0 without one."""
        found = 0
        for tag in tags:
            depths = self.depths.get(tag)
            if depths and depths[-1] > depth:
                place = depths[bisect_right(depths, depth)]
                found = min(found, place) if found else place
        return found


def build(page: str) -> Node:
    """The element tree, with implied start and end tags."""
    root = Node("html")
    stack = Opened(root)

    def close(kinds: set[str], walls: set[str]) -> None:
        lowest = stack.first_after(kinds - walls, stack.last(walls))
        if lowest:
            stack.cut(lowest)

    for kind, name, source in tokens(page):
        if stack[-1].tag == "head" and (name.strip(" \t\n\r\f") if kind == "text" else name not in IN_HEAD if kind == "start" else name == "br"):
            stack.cut(len(stack) - 1)
        if kind == "text":
            stack[-1].children.append(name if stack[-1].tag in RAW - {"textarea", "title"} else html.unescape(name))
        elif kind == "start":
            if name in ("html",):
                root.attributes.update(attributes_of(source))
                continue
            if name in BREAKOUT:
                while stack[-1].foreign:
                    stack.cut(len(stack) - 1)
            if name in ENDS and not stack[-1].foreign:
                close(*ENDS[name])
            if name in NEEDS and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                implied = Node(NEEDS[name][0])
                stack[-1].children.append(implied)
                stack.push(implied)
            node = Node(name, attributes_of(source))
            within = stack[-1].foreign
            node.foreign = name in ("svg", "math") or (within and name not in EMBEDS)
            stack[-1].children.append(node)
            if name not in VOID and not (source.endswith("/") and (within or node.foreign)):
                stack.push(node)
        else:
            if name == "br":
                stack[-1].children.append(Node("br"))
                continue
            depth = stack.last((name,))
            through = name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
            if depth and (through or depth >= stack.last(WALLS)):
                stack.cut(depth)
    return root


def visible(node: Node) -> bool:
    own = node.attributes
    return not (
        node.tag in INVISIBLE or "hidden" in own or own.get("aria-hidden", "").lower() == "true"
        or (node.tag == "input" and own.get("type", "text").lower() == "hidden")
        or ("style" in own and _HIDING.search(own["style"]))
        or (node.tag == "dialog" and "open" not in own)
    )


class Page:
    """Collects lines: inline text is collapsed, breaks are merged, every line gets the current indentation."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.mark: str | None = None

    def _open(self) -> None:
        if not self.parts:
            if self.lines and self.gap > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0

    def inline(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words.startswith(" ") or self.space:
            self.space = bool(self.parts)
        body = words.strip(" ")
        if body:
            self._open()
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(body)
            self.space = words.endswith(" ")
        elif words:
            self.space = bool(self.parts)

    def raw(self, text: str) -> None:
        first, *rest = text.split("\n")
        if first:
            self._open()
            self.parts.append(first)
        for line in rest:
            self.line()
            self._open()
            if line:
                self.parts.append(line)

    def line(self) -> None:
        """End the line, also an empty one."""
        body = "".join(self.parts).rstrip(" ")
        prefix = "".join(self.indent)
        if self.mark is not None and body:
            prefix = "".join(self.indent[:-1]) + self.mark
            self.mark = None
        self.lines.append((prefix + body).rstrip(" ") if body else "")
        self.parts, self.space = [], False

    def stop(self, gap: int = 1) -> None:
        """End the line if it has text, and keep at least ``gap - 1`` blank lines before the next."""
        if self.parts:
            self.line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.stop()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        start = 0
        while start < len(self.lines) and not self.lines[start]:
            start += 1
        return self.lines[start:]


def columns_of(text: str) -> int:
    """Columns that a text takes on a screen of equal columns: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def spread_rows(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int]]]:
    """Rows of (lines, columns, rows) cells as rows of (lines, columns), with an empty cell where one from above reaches down."""
    out, reaching = [], {}  # column -> (rows left, columns)
    for row in rows:
        placed, below, column, at = [], {}, 0, 0
        while at < len(row) or any(c >= column for c in reaching):
            if column in reaching:
                left, span = reaching[column]
                placed.append(([], span))
                if left > 1:
                    below[column] = (left - 1, span)
            elif at < len(row):
                lines, span, height = row[at]
                at += 1
                # a cell ends where one from above begins
                span = max(1, min([span] + [c - column for c in reaching if c > column]))
                placed.append((lines, span))
                if height > 1:
                    below[column] = (height - 1, span)
            else:
                span = min(c for c in reaching if c >= column) - column
                placed.append(([], span))
            column += span
        out.append(placed)
        reaching = below
    return out


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Table rows as lines with padded columns; cells may hold several lines and span columns."""
    widths: list[int] = []
    for row in rows:
        column = 0
        for lines, span in row:
            widths += [0] * (column + span - len(widths))
            if span == 1:
                widths[column] = max(widths[column], max(map(columns_of, lines), default=0))
            column += span
    for row in rows:  # what spans columns widens the last of them
        column = 0
        for lines, span in row:
            if span > 1:
                need = max(map(columns_of, lines), default=0) - sum(widths[column : column + span]) - 3 * (span - 1)
                widths[column + span - 1] += max(0, need)
            column += span
    out = []
    for row in rows:
        for height in range(max((len(lines) for lines, _ in row), default=0)):
            column, parts = 0, []
            for lines, span in row:
                width = sum(widths[column : column + span]) + 3 * (span - 1)
                line = lines[height] if height < len(lines) else ""
                parts.append(line + " " * (width - columns_of(line)))
                column += span
            out.append(" | ".join(parts).rstrip(" "))
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    pages = [Page()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[tuple[str, list[int]]] = []
    pre = 0
    drawing: list[bool] = []  # of each open svg, and of what shows text inside it: whether text is shown
    work: list[tuple[bool, Node | str]] = [(True, root)]
    while work:
        enter, node = work.pop()
        page = pages[-1]
        if isinstance(node, str):
            if not drawing or drawing[-1]:
                (page.raw if pre else page.inline)(node)
            continue
        tag = node.tag
        if enter:
            if not visible(node) or (drawing and tag in UNDRAWN):
                continue
            if tag == "br":
                page.line() if page.parts or page.lines else None
                continue
            if tag == "hr":
                page.stop(2)
                page.inline("---")
                page.stop(2)
                continue
            if tag == "img":
                page.inline(node.attributes.get("alt", ""))
                continue
            if tag == "input":
                page.inline(" " + node.attributes.get("value", "") + " ")
                continue
            work.append((False, node))
            children = node.children
            if tag == "svg" or (drawing and tag in ("text", "foreignobject")):
                drawing.append(tag != "svg")
                page.inline(" ")
            if tag in ("select", "optgroup"):
                children = [node.attributes.get("label", "")] * (tag == "optgroup") + [child for child in children if not isinstance(child, str)]
            elif tag == "option" and node.attributes.get("label"):
                children = [node.attributes["label"]]
            if tag in ("td", "th") and tables:
                pages.append(Page())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCKS:
                page.stop(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists) else 1)
            if tag == "table":
                tables.append([])
            elif tag in ("ul", "ol", "menu"):
                first = node.attributes.get("start", "1")
                lists.append((tag, [int(first) if first.lstrip("-").isdigit() and len(first) < 10 else 1]))
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1][0]}. "
                    lists[-1][1][0] += 1
                page.indent.append(" " * len(mark))
                page.mark = mark
            elif tag in ("blockquote", "dd"):
                page.indent.append("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "q":
                page.inline("“")
            work.extend((True, child) for child in reversed(children))
            continue
        if tag == "svg" or (drawing and tag in ("text", "foreignobject")):
            drawing.pop()
            page.inline(" ")
        if tag in ("td", "th") and tables:
            lines = pages.pop().done()
            span = node.attributes.get("colspan", "1")
            tall = node.attributes.get("rowspan", "1")
            cell = (lines, *(min(max(int(n), 1), 1000) if n.isascii() and n.isdigit() and len(n) < 6 else 1 for n in (span, tall)))
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append(cell)
        elif tag == "table":
            for line in aligned(spread_rows([row for row in tables.pop() if row])):
                page.raw(line)
                page.stop()
            page.stop(2)
        elif tag in BLOCKS and not (tag == "tr" and tables):
            page.stop(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and len(lists) > 1) else 1)
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            page.indent.pop()
            page.mark = None
        elif tag in ("blockquote", "dd"):
            page.indent.pop()
        elif tag == "pre":
            pre -= 1
        elif tag == "q":
            page.inline("”")
    return "\n".join(pages[0].done())


def visible_text(page: str | None) -> str:
    return render(build(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""))) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, text (the visible text), n_chars, n_lines (lines with text)."""

    @F.pandas_udf("string")
    def laid_out(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([visible_text(source) for source in sources], dtype=object)

    table = pick(pages, page_id=id_col, html=html_col).select("page_id", laid_out("html").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    return table.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(lines).cast("long").alias("n_lines"))
