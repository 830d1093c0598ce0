"""HTML to text by layout-aware rendering.

A tree builder applies void elements, implied end tags (paragraphs, list items, table parts, options, definition terms)
and raw-text elements; a renderer walks the tree and emits all visible text: blocks on lines of their own, a blank line
around paragraphs, headings, lists and tables, list items with their mark and indentation, preformatted text as it is,
and table cells in aligned columns (column and row spans included).

Not visible: head, script, style, template, noscript, comments, elements with ``hidden``, ``display: none`` or
``visibility: hidden`` (a descendant may be ``visible`` again), closed dialogs, hidden inputs.

Each page is rendered alone, in the scan's partitions. Neither the builder nor the renderer nests calls, so elements may be
open to any depth: the builder finds open elements by name in sorted lists of their levels, and the renderer's steps are
generators that hand the elements inside to one loop.

Defined cases: a null page gives null, an empty or tagless one its text with white space joined; broken markup never
raises; equal pages give equal texts; an empty table gives an empty result. Extra columns pass through; one that bears
the output's name is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm import textbytes as tb

GUTTER = "  "  # between table columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table ul
xmp tr tbody thead tfoot caption""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr xmp".split())
CLOSES_P = BLOCK - frozenset("html body tr tbody thead tfoot caption legend optgroup dialog".split())
#: An opening tag ends these open elements, looked for up to the nearest element of the second set.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr", "caption"), ("tbody", "thead", "tfoot", "table")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), ("table",))),
    "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
}
SCOPE = frozenset("table td th caption button object template html".split())  # end tags do not reach beyond these

#: Inputs whose value is not shown as text.
SILENT = frozenset("hidden password checkbox radio file image color range".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot html body".split())  # their end tags reach over other elements

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)


@dataclass
class Node:
    name: str
    attributes: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # Node or str


class Open:
    """The open elements, innermost last, with the levels at which each name is open."""

    def __init__(self, root: Node):
        self.stack, self.levels = [root], {}

    def push(self, node: Node) -> None:
        self.levels.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, level: int) -> None:
        """End the element at a level and all inside it."""
        while len(self.stack) > level:
            self.levels[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """Level of the innermost element of one of the names, 0 if none is open."""
        return max((self.levels[n][-1] for n in names if self.levels.get(n)), default=0)

    def first(self, names, inside: int) -> int:
        """Level of the outermost element of one of the names that is inside a level, 0 if there is none."""
        found = [at[k] for n in names if (at := self.levels.get(n)) and (k := bisect_right(at, inside)) < len(at)]
        return min(found, default=0)


def build(page: str) -> Node:
    """Tree of a page; never raises on broken markup."""
    root = Node("html")
    tree, at, n = Open(root), 0, len(page)
    last = page.rfind(">")  # no tag ends beyond it
    while at < n:
        hit = TOKEN.search(page, at) if at <= last else None
        if hit is None:
            tree.stack[-1].children.append(unescape(page[at:].partition("<!--")[0]))  # an open comment hides the rest
            break
        if hit.start() > at:
            text = page[at:hit.start()]
            tree.stack[-1].children.append(unescape(text) if "&" in text else text)
        at = hit.end()
        slash, name, raw = hit.group(1, 2, 3) if hit[2] else hit.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if slash:
            _end(tree, name)
            continue
        attributes = {}
        if raw and not raw.isspace():
            for a in ATTRIBUTE.finditer(raw):
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                attributes.setdefault(a[1].lower(), unescape(value))
        if name in ("html", "body"):
            root.attributes |= {k: v for k, v in attributes.items() if k in ("hidden", "style")}
            continue
        _imply(tree, name)
        node = Node(name, attributes)
        tree.stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            inside = page[at:close.start() if close else n]
            node.children.append(unescape(inside) if name in ("textarea", "title") else inside)
            at = close.end() if close else n
        elif name not in VOID:
            tree.push(node)
    return root


def _imply(tree: Open, name: str) -> None:
    """Close what the opening tag ends by implication."""
    if name in CLOSES_P and (level := tree.last(("p",))) > tree.last(SCOPE):
        tree.close(level)
    if tree.stack[-1].name == "head" and name in BLOCK:
        tree.close(len(tree.stack) - 1)
    if name in IMPLIED:
        ends, limit = IMPLIED[name]
        if level := tree.first(ends, tree.last(limit)):
            tree.close(level)


def _end(tree: Open, name: str) -> None:
    if name == "br":
        tree.stack[-1].children.append(Node("br"))
        return
    level = tree.last((name,))
    if level and (name in TABLE_PARTS or level >= tree.last(SCOPE)):
        tree.close(level)


class Lines:
    """Output of a block container: finished lines and the line being written."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False  # a blank line is due before the next text
        self.mark = ""  # list mark for the next line

    def text(self, words: str) -> None:
        """Append text whose white space collapses."""
        words = SPACES.sub(" ", words)
        if not self.line:
            words = words.lstrip(" ")
        elif self.line.endswith(" "):
            words = words.lstrip(" ")
        if words:
            self._open()
            self.line += words

    def _open(self) -> None:
        if self.gap and self.lines and not self.line:
            self.lines.append("")
        self.gap = False

    def end(self) -> None:
        """End the line, if there is one."""
        if self.line.strip(" "):
            self.lines.append(self.line.rstrip(" "))
        self.line = ""

    def blank(self) -> None:
        self.end()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        """Append finished lines."""
        self.end()
        if lines:
            self._open()
            self.lines += lines

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _shown(node: Node, visible: bool) -> bool | None:
    """None if the element and all in it are not rendered, else whether its own text is visible."""
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a or (node.name == "dialog" and "open" not in a):
        return None
    style = a.get("style", "")
    if style:
        if DISPLAY.search(style):
            return None
        if found := VISIBILITY.search(style):
            return found[1].lower() == "visible"
    return visible


def _run(step: Iterator):
    """Result of a step; a step yields the steps it needs and gets their results."""
    waiting, result = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as end:
            waiting.pop()
            result = end.value
    return result


def _render(node: Node, out: Lines, visible: bool) -> Iterator:
    for child in node.children:
        if isinstance(child, str):
            if visible:
                out.text(child)
            continue
        name = child.name
        shown = _shown(child, visible)
        if shown is None:
            continue
        if name == "br":
            if not out.line.strip(" "):
                out.gap = out.gap or bool(out.lines)
            out.end()
        elif name == "hr":
            out.blank()
        elif name in ("ul", "ol", "menu", "dir"):
            if node.name == "li":
                out.end()
            else:
                out.blank()
            out.block((yield _list(child, shown)))
            out.gap = out.gap or node.name != "li"
        elif name in ("pre", "xmp", "textarea"):
            out.blank()
            if shown:
                text = (yield _plain(child)).expandtabs(8).split("\n")
                out.block([t.rstrip() for t in (text[1:] if text and not text[0].strip() else text)])
            out.blank()
        elif name == "table":
            out.blank()
            out.block((yield _table(child, shown)))
            out.blank()
        elif name in ("blockquote", "dd"):
            (out.blank if name == "blockquote" else out.end)()
            out.block(["  " + t if t else t for t in (yield _inner(child, shown))])
            (out.blank if name == "blockquote" else out.end)()
        elif name == "input":
            if shown and child.attributes.get("type", "text").strip().lower() not in SILENT:
                out.text(" " + child.attributes.get("value", "") + " ")
        elif name in ("option", "td", "th", "button"):
            out.text(" ")
            yield _render(child, out, shown)
            out.text(" ")
        elif name in BLOCK:
            (out.blank if name in SPACED else out.end)()
            yield _render(child, out, shown)
            (out.blank if name in SPACED else out.end)()
        else:
            yield _render(child, out, shown)


def _inner(node: Node, visible: bool) -> Iterator:
    """Lines of an element's content."""
    out = Lines()
    yield _render(node, out, visible)
    return out.done()


def _plain(node: Node) -> Iterator:
    """Text of preformatted content, as written."""
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.name == "br":
            parts.append("\n")
        elif _shown(child, True):
            parts.append((yield _plain(child)))
    return "".join(parts)


def _list(node: Node, visible: bool) -> Iterator:
    """Lines of a list."""
    try:
        number = int(node.attributes.get("start", "1"))
    except ValueError:
        number = 1
    lines: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            if visible and child.strip():
                lines.append(SPACES.sub(" ", child).strip())
            continue
        shown = _shown(child, visible)
        if shown is None:
            continue
        if child.name != "li":
            lines += ["  " + t if t else t for t in (yield _inner(Node("div", {}, [child]), shown))]
            continue
        mark = f"{number}. " if node.name == "ol" else "- "
        number += 1
        inside = yield _inner(child, shown)
        if inside:
            lines += [(mark if i == 0 else " " * len(mark)) + t if t else t for i, t in enumerate(inside)]
    return lines


def _rows(node: Node, visible: bool):
    """(row, visible) of a table's own rows and its captions' lines; loose content comes as rows of one cell."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield Node("tr", {}, [Node("td", {}, [child])]), visible
            continue
        shown = _shown(child, visible)
        if shown is None or child.name in ("colgroup", "col"):
            continue
        if child.name == "tr":
            yield child, shown
        elif child.name in ("tbody", "thead", "tfoot"):
            yield from _rows(child, shown)
        elif child.name in ("td", "th"):
            yield Node("tr", {}, [child]), shown
        else:
            yield Node("tr", {}, [Node("td", {"colspan": "0"}, [child])]), shown


def _span(cell: Node, key: str) -> int:
    try:
        return max(1, min(1000, int(cell.attributes.get(key, "1"))))
    except ValueError:
        return 1


def _table(node: Node, visible: bool) -> Iterator:
    """Rows of aligned columns: a column is as wide as its widest cell of one column."""
    grid: list[list[tuple[int, int, list[str]]]] = []  # per row: (column, span, lines)
    taken: dict[int, int] = {}  # column -> rows it is still taken by a row span
    for row, shown in _rows(node, visible):
        cells, at = [], 0
        ahead = {c: r - 1 for c, r in taken.items() if r > 1}
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                cell = Node("td", {}, [cell])
            seen = _shown(cell, shown)
            if seen is None:
                continue
            while at in taken:
                at += 1
            lines = yield _inner(cell if cell.name in ("td", "th") else Node("td", {}, [cell]), seen)
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
            loose = cell.attributes.get("colspan") == "0"
            cells.append((at, 1000 if loose else wide, lines))
            if high > 1:
                ahead.update(dict.fromkeys(range(at, at + wide), high - 1))
            at += wide
        taken = ahead
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for at, span, lines in cells:
            if span == 1:
                width[at] = max([width.get(at, 0), *map(len, lines)])
    out = []
    for cells in grid:
        for k in range(max([len(lines) for _, _, lines in cells], default=0)):
            line = ""
            for at, _, lines in cells:
                begin = sum(width.get(c, 0) + len(GUTTER) for c in range(at) if c in width)
                if k < len(lines) and lines[k]:
                    line = line.ljust(begin) if len(line) <= begin or not line else line + GUTTER
                    line += lines[k]
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str | None:
    """Visible text of a page."""
    if page is None:
        return None
    root = build(page)
    shown = _shown(root, True)
    return "" if shown is None else "\n".join(_run(_inner(root, shown)))


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """The pages with their visible text appended."""

    def compute(batch: pa.RecordBatch) -> list:
        return [[render(page) for page in tb.column(batch, html).to_pylist()]]

    return tb.with_columns(pages, [(into, T.StringType())], compute)
