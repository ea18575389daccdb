"""HTML extraction by layout-aware rendering of the visible text.

A tree builder puts in what HTML lets authors leave out (end tags, table rows),
visibility rules drop what a browser would not show, and a renderer walks the
tree with an explicit stack: blocks are set apart, lists get markers, table cells
are aligned in columns, preformatted text keeps its blanks.  Blocks inside a cell
keep their lines; a cell that spans rows keeps its columns free below it.

What hides: elements that show no text, the attribute ``hidden``, closed details
and dialogs, and display and visibility as given by style attributes and by rules
of style elements for a tag, a class, an id or a tag with a class, outside @media.
Inside a hidden part, ``visibility: visible`` shows again; ``display`` does not.

Time and output are linear in the page: a table's columns are set by cells of at
most ``WIDE`` characters, nothing is aligned further right than ``FAR``, a cell
spans 1000 columns at most, as in browsers, and in tables inside more than
``DEEP`` others each cell is a block of its own.  No text is left out for that.

Defined cases: a null or empty page is the empty text; markup that never ends is
closed at the end; pages of any length or depth are rendered whole; repeated rows
are rendered alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_path, pick


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


VOID = _names("area base br col embed hr img input link meta param source track wbr")
#: Elements with a blank line around them, and those that only start a line.
APART = _names("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure form fieldset hr")
LINES = _names(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer header hgroup html legend li main menu nav "
    "option search section summary tbody td tfoot th thead tr"
) | APART
HIDDEN = _names("head title script style template noscript iframe object canvas audio video svg math datalist noembed noframes")
#: What a head may hold; any other tag, or text, ends it.
IN_HEAD = _names("base basefont bgsound head link meta noframes noscript script style template title")
#: An opening tag ends these open elements, looking no further up than the named borders.
ENDS = {
    **{t: (_names("p"), _names("button td th li table caption object template")) for t in LINES - _names("html body option tr td th tbody thead tfoot caption")},
    "li": (_names("li p"), _names("ul ol menu table td th")),
    "dt": (_names("dt dd p"), _names("dl table td th")),
    "dd": (_names("dt dd p"), _names("dl table td th")),
    "tr": (_names("tr td th caption p"), _names("table")),
    "td": (_names("td th p caption"), _names("tr table")),
    "th": (_names("td th p caption"), _names("tr table")),
    **{t: (_names("tbody thead tfoot tr td th caption p"), _names("table")) for t in ("tbody", "thead", "tfoot")},
    "option": (_names("option"), _names("select datalist")),
    "optgroup": (_names("option optgroup"), _names("select")),
    "body": (_names("head"), _names("template")),
}
#: Characters up to which a cell sets its column's width, and places up to which cells are aligned; tables in tables that are laid out.
WIDE, FAR, DEEP = 80, 240, 30
_CELLS = _names("td th table")
_PAST_CELLS = _names("table tr tbody thead tfoot body html")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds a tree of nodes and strings; missing and stray tags do no harm.

    The places of open elements are kept by tag, so that no tag has to look
    through all that is open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.styles: list[Node] = []

    def _last(self, tag: str) -> int:
        """Where the innermost open element of a tag is; 0 if there is none."""
        held = self.places.get(tag)
        return held[-1] if held else 0

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _imply_end(self, tag: str) -> None:
        ends, borders = ENDS.get(tag, ((), ()))
        border = max(map(self._last, borders), default=0)
        inside = [held[at] for t in ends if (held := self.places.get(t)) and (at := bisect_right(held, border)) < len(held)]
        if inside:
            self._close(min(inside))

    def _end_head(self) -> None:
        """End the head if it is the innermost open element."""
        if self.open[-1].tag == "head":
            self._close(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and self.places.get(tag):
            return
        if tag not in IN_HEAD:
            self._end_head()
        if ENDS.get(tag):
            self._imply_end(tag)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag == "style":
            self.styles.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends only void elements

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        place = self._last(tag)
        # An end tag in a cell does not close what holds the cell.
        if place and (tag in _PAST_CELLS or place >= max(map(self._last, _CELLS))):
            self._close(place)

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        self.open[-1].children.append(data)


def _declared(text: str) -> dict[str, str]:
    """The display and visibility that declarations give, the last of each."""
    out = {}
    for part in text.split(";"):
        name, _, value = part.partition(":")
        if (name := name.strip().lower()) in ("display", "visibility"):
            out[name] = value.replace("!important", "").strip().lower()
    return out


_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.IGNORECASE | re.ASCII)


class Rules:
    """What style elements say of display and visibility, by simple selectors."""

    def __init__(self, sheets: list[str]):
        self.found: dict[tuple[str, str, str], tuple[int, dict[str, str]]] = {}
        for sheet in sheets:
            depth, outer = 0, ""  # braces open, and what stands before the outermost
            for block in re.sub(r"(?s)/\*.*?\*/", " ", sheet).split("}"):
                parts = block.split("{")
                if not depth and len(parts) > 1:
                    outer = parts[0].strip()
                if not outer.startswith("@") and len(parts) == 2:
                    for selector in parts[0].split(","):
                        m = _SELECTOR.fullmatch(selector.strip())
                        if m and m[0] and (says := _declared(parts[1])):
                            key = ((m[1] or "").lower(), m[2] or "", m[3] or "")
                            self.found[key] = len(self.found), self.found.get(key, (0, {}))[1] | says
                depth = max(0, depth + len(parts) - 2)

    def of(self, node: Node) -> dict[str, str]:
        """What holds for an element: tags first, then classes, then the id, then its own style; of equals, the later."""
        out: dict[str, str] = {}
        if self.found:
            keys = [("", ".", c) for c in (node.attrs.get("class") or "").split()] + [("", "#", node.attrs.get("id") or "")]
            keys = [(node.tag, "", "")] + keys + [(node.tag, *k[1:]) for k in keys]
            order = sorted((k[1] == "#", k[1] == ".", k[0] != "", self.found[k][0], k) for k in set(keys) if k in self.found)
            for *_, key in order:
                out |= self.found[key][1]
        if style := node.attrs.get("style"):
            out |= _declared(style)
        return out


def displayed(node: Node, parent: Node, says: dict[str, str]) -> bool:
    """Whether an element is laid out at all."""
    if node.tag in HIDDEN or "hidden" in node.attrs or says.get("display") == "none":
        return False
    if node.tag == "dialog" and "open" not in node.attrs or node.tag == "input":
        return False
    return not (parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary")


class Flow:
    """Text in lines: blanks collapse, and blocks ask for line breaks before what follows."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = 0
        self.blank = False

    def ask(self, breaks: int) -> None:
        self.blank = False
        if self.parts:
            self.breaks = max(self.breaks, breaks)

    def _start(self) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
            self.breaks, self.blank = 0, False

    def say(self, text: str) -> None:
        words = text.split(None)
        if not words:
            self.blank = self.blank or bool(text)
            return
        self._start()
        if (self.blank or text[0].isspace()) and self.parts and not self.parts[-1].endswith(("\n", " ")):
            self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.blank = text[-1].isspace()

    def exact(self, text: str) -> None:
        if text:
            self._start()
            if self.blank and self.parts and not self.parts[-1].endswith(("\n", " ")):
                self.parts.append(" ")
            self.parts.append(text)
            self.blank = False

    def line_break(self) -> None:
        self.breaks = min(self.breaks + 1, 2) if self.parts else 0
        self.blank = False

    def text(self) -> str:
        return "".join(self.parts)


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name) or ""
    return min(int(value[:6]), 1000) if value.isascii() and value.isdigit() and int(value[:6]) else 1


class Grid:
    """A table's cells by row and column."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, str]]] = []  # column, columns, text
        self.taken: dict[int, tuple[int, int]] = {}  # by column: the next one that is not, until a row, of a cell above
        self.leap: dict[int, tuple[int, int]] = {}  # the same, for whole stretches of such cells
        self.next = 0

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def _free(self, at: int) -> int:
        row, begin, until = len(self.rows) - 1, at, 1 << 60
        while True:
            for held in (self.leap.get(at), self.taken.get(at)):
                if held and held[1] > row:
                    at, until = held[0], min(until, held[1])
                    break
            else:
                break
        if at > begin:
            self.leap[begin] = at, until
        return at

    def cell(self, text: str, node: Node) -> None:
        if not self.rows:
            self.row()
        at, across, down = self._free(self.next), _span(node, "colspan"), _span(node, "rowspan")
        self.rows[-1].append((at, across, text))
        self.next = at + across
        if down > 1:
            self.taken[at] = at + across, len(self.rows) - 1 + down

    def text(self) -> str:
        """Lines with aligned columns; a row has as many as its highest cell."""
        widths: dict[int, int] = {}
        lined = [[(at, across, text.split("\n")) for at, across, text in row] for row in self.rows]
        single = {at for row in self.rows for at, across, _ in row if across == 1}
        for row in lined:
            for at, across, lines in row:
                # A cell over several columns sets the first one's width where no other cell does.
                fit = [len(line) for line in lines if len(line) <= WIDE] if across == 1 or at not in single else []
                widths[at] = max(widths.get(at, 0), max(fit, default=0))
        starts, here = {}, 0
        for at in sorted(widths):
            starts[at] = here
            here += widths[at] + 2
        out = []
        for row in lined:
            by_line: dict[int, list[tuple[int, str]]] = {}
            for at, _, lines in row:
                for k, line in enumerate(lines):
                    if line:
                        by_line.setdefault(k, []).append((starts[at], line))
            for k in sorted(by_line):
                parts, n = [], 0
                for start, line in by_line[k]:
                    gap = start - n if n <= start - 2 * (n > 0) and start <= FAR else 2 * (n > 0)
                    parts += [" " * gap, line]
                    n += gap + len(line)
                out.append("".join(parts))
        return "\n".join(out)


def _lines_of(text: str) -> str:
    """A cell's lines that are not empty."""
    return "\n".join(line.rstrip() for line in text.strip().split("\n") if line.strip()) if "\n" in text else text.strip()


def render(page: str | None) -> str:
    """The visible text of a page."""
    builder = TreeBuilder()
    builder.feed(page or "")
    builder.close()
    rules = Rules(["".join(c for c in node.children if isinstance(c, str)) for node in builder.styles])
    flows, tables, lists = [Flow()], [], []
    pre = deep = 0
    # Work to do, last first: a string or node, its parent, whether to enter or to leave it, and whether text shows there.
    todo: list[tuple[object, Node, bool, bool]] = [(builder.root, builder.root, True, True)]
    while todo:
        item, parent, enter, shown = todo.pop()
        flow = flows[-1]
        if isinstance(item, str):
            if not shown or parent.tag == "details" and "open" not in parent.attrs:
                continue
            if parent.tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                flow.exact(item) if pre else flow.say(item)
            elif item.strip():
                flow.say(item)
            continue
        tag = item.tag
        if enter:
            says = rules.of(item)
            if item is not builder.root and not displayed(item, parent, says):
                continue
            if "visibility" in says:
                shown = says["visibility"] not in ("hidden", "collapse")
            if tag == "br":
                flow.line_break()
                continue
            if tag == "wbr":
                continue
            if tag in LINES:
                in_list = tag in ("ul", "ol") and lists
                flow.ask(1 if in_list or tag not in APART else 2)
            if tag in ("ul", "ol", "menu"):
                start = item.attrs.get("start") or ""
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if shown:
                    flow.exact("  " * max(0, min(len(lists), DEEP) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
                kind[1] += 1
            elif tag == "dd" and shown:
                flow.exact("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                if len(tables) < DEEP:
                    tables.append(Grid())
                else:
                    deep += 1
            elif tag == "tr" and tables and not deep:
                tables[-1].row()
            elif tag in ("td", "th") and tables:
                if deep:
                    flow.ask(1)
                else:
                    flows.append(Flow())
            todo.append((item, parent, False, shown))
            todo.extend((c, item, True, shown) for c in reversed(item.children))
            continue
        if tag in ("td", "th") and tables and not deep:
            tables[-1].cell(_lines_of(flows.pop().text()), item)
        elif tag == "table":
            if deep:
                deep -= 1
            else:
                flow.exact(tables.pop().text())
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "pre":
            pre -= 1
        if tag in LINES and flows:
            flows[-1].ask(2 if tag in APART and not (tag in ("ul", "ol") and lists) else 1)
    lines = "".join(f.text() for f in flows).split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(s.rstrip() for s in lines)).strip("\n")


def _render_batches(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([render(p.as_py()) for p in batch], pa.string())


def extract_text(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per row of df: its key, the visible text and the text's length in characters."""
    on_path(df.sparkSession)
    text = F.arrow_udf(_render_batches, "string")(html)
    return pick(df, key, html).select(key, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
