"""Operator 10, HTML extraction by layout-aware rendering.

Markup becomes a tree with the implied tags an author may leave out (a new paragraph, list item, table row or cell
closes the open one), invisible parts are left out (head, scripts, styles, templates, `hidden`, `display: none`,
`visibility: hidden`), and all other text is laid out: inline text flows with white space collapsed, blocks start
new lines, paragraphs and headings keep a blank line around them, list items get a marker and an indent per level,
table cells are padded to the width of their column (columns that a cell above takes by `rowspan` stay empty),
preformatted text stays as it is. Option labels are lines; texts of drawings and the fallback of an object flow.

Each page is rendered whole in its own row; no exchange, and one Arrow batch in memory. Parsing and rendering walk the
tree without recursion, tables in tables too, so deep nesting is no problem; indents stop at `INDENT` characters. A page
of unclosed tags or of end tags that close nothing takes time in proportion to its length. Defined results: null and empty pages give an empty text,
repeated rows are rendered one by one, an empty table gives an empty result, and only the key and the page are read.
Broken markup never fails: a lone `<` is text, unknown tags are inline, end tags without a start are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormweave.llm.scan import per_text

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: Attributes up to the end of a tag, and one piece of them.
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_PIECE = re.compile(r"[^<>\"']++|<|\"[^\"]*\"|'[^']*'")
_LONG_NUMBER = re.compile(r"&#[0-9]{4000,};?")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INVISIBLE = frozenset(
    "head script style template noscript title meta link datalist audio video canvas iframe".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul caption "
    "tr".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
_CLOSES_P = BLOCK - {"html", "body", "caption", "tr", "option", "optgroup"}
_PARTS = frozenset(("thead", "tbody", "tfoot"))
#: A start tag closes these open elements, searched upwards to the nearest boundary.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("optgroup",)), frozenset(("select", "datalist"))),
    **{part: (_PARTS | {"caption", "colgroup"}, frozenset(("table",))) for part in _PARTS},
}
#: An inline element that holds blocks or a paragraph that was left open ends where these open.
_P_BOUNDARY = frozenset(("td", "th", "table", "button", "caption", "html", "body", "li", "dd", "blockquote", "div", "article"))


#: Parts of a drawing that are not drawn where they stand. Columns of a table that cells of earlier rows are kept in.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
COLUMNS = 1000
#: Characters of indent at most, so that a page of very deep lists stays of its size.
INDENT = 80


class Element:
    """A node of the tree: its children are elements and texts in order."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _unescape(text: str) -> str:
    # A number of thousands of digits is no character; `html` refuses to read it.
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), _unescape(double or single or bare))
    return found


class Tags:
    """The tags of a page in order, each place of which is read a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        # Places between attributes from which no end of a tag is reached.
        self.dead: set[int] = set()

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next tag or comment with its slash, name and attributes (a comment has no name)."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, len(source) if end < 0 else end + 3, "", "", ""
            if start > self.last:
                # No tag ends behind here, but a comment may begin.
                at = source.find("<!--", start)
                if at < 0:
                    return None
                continue
            if source[start + 1] in "!?":
                return start, source.index(">", start) + 1, "", "", ""
            name = _NAME.match(source, start)
            if not name:
                at = start + 1
                continue
            end = self._end(name.end())
            if end:
                return start, end, name[1], name[2], source[name.end() : end - 1]
            # A `<` within the name would lead to the same place.
            at = name.end()
        return None

    def _end(self, at: int) -> int:
        """The place after the `>` of a tag whose attributes begin at `at`; 0 if there is none."""
        if not self.dead:
            found = _REST.match(self.source, at)
            if found:
                return found.end()
        passed = []
        while at not in self.dead:
            passed.append(at)
            piece = _PIECE.match(self.source, at)
            if not piece:
                if at < len(self.source) and self.source[at] == ">":
                    return at + 1
                break
            at = piece.end()
        self.dead.update(passed)
        return 0


class Open:
    """The stack of open elements, with the places of each tag in it."""

    def __init__(self, root: Element):
        self.elements, self.places = [root], {}

    @property
    def top(self) -> Element:
        return self.elements[-1]

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.elements))
        self.elements.append(element)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of one of the tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, at: int) -> None:
        """Close the element at this place and all within."""
        while len(self.elements) > at:
            self.places[self.elements.pop().tag].pop()


def build_tree(source: str) -> Element:
    """The tree of a page, with implied end tags."""
    root = Element("#root", {})
    open_, tags, at = Open(root), Tags(source), 0
    while found := tags.after(at):
        start, end, slash, name, rest = found
        if start > at:
            open_.top.children.append(_unescape(source[at:start]))
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            _close(open_, tag)
            continue
        _imply(open_, tag)
        element = Element(tag, _attributes(rest) if rest.strip(" /") else {})
        open_.top.children.append(element)
        if tag in UNDRAWN and open_.last(("svg",)):
            element.attributes["hidden"] = ""
        if tag in RAW:
            closing = re.compile(rf"</{tag}\b", re.I).search(source, at)
            end = source.find(">", closing.end()) if closing else -1
            raw = source[at : closing.start() if end >= 0 else len(source)]
            element.children.append(raw if tag in ("script", "style", "xmp") else _unescape(raw))
            at = end + 1 if end >= 0 else len(source)
        elif tag not in VOID:
            open_.push(element)
    if at < len(source):
        open_.top.children.append(_unescape(source[at:]))
    return root


def _close(open_: Open, tag: str) -> None:
    at = open_.last((tag,))
    # The end of an inline element doesn't reach beyond its table cell.
    if at and (tag in BLOCK or tag in _PARTS or at >= open_.last(("td", "th"))):
        open_.cut(at)
    elif tag == "p":
        open_.top.children.append(Element("p", {}))


def _imply(open_: Open, tag: str) -> None:
    if tag in _CLOSES_P and (at := open_.last(("p",))) > open_.last(_P_BOUNDARY):
        open_.cut(at)
    if rule := IMPLIED.get(tag):
        closes, boundary = rule
        if (at := open_.last(closes)) > open_.last(boundary):
            open_.cut(at)
    if tag == "body" and (at := open_.last(("head",))):
        open_.cut(at)


def visible(element: Element) -> bool:
    if element.tag in INVISIBLE:
        return False
    a = element.attributes
    return not a or not ("hidden" in a or ("style" in a and _HIDDEN_STYLE.search(a["style"])))


class Canvas:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.space = False
        self.indent = ""
        self.marker = ""

    def flow(self, text: str) -> None:
        """Inline text: runs of white space are one blank, none at the start of a line."""
        pieces = _SPACES.sub(" ", text)
        if pieces.startswith(" "):
            self.space = True
            pieces = pieces[1:]
        if not pieces:
            return
        trailing = pieces.endswith(" ")
        if self.now and self.space:
            self.now.append(" ")
        self.now.append(pieces[:-1] if trailing else pieces)
        self.space = trailing

    def verbatim(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.now.append(first)
        for line in rest:
            self.end_line(keep=True)
            self.now.append(line)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.now)
        if not keep:
            line = line.rstrip(" ")
        if line or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.indent + self.marker + line).rstrip() if not keep else self.indent + line)
            if self.marker:
                self.deepen(len(self.marker))
                self.marker = ""
        self.now, self.space = [], False

    def deepen(self, n: int) -> None:
        self.indent += " " * min(n, INDENT - len(self.indent))

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(root: Element) -> str:
    """All visible text of a tree, laid out."""
    page = Canvas()
    # A frame per open element: its children still to come, what to do at its end, and where and how its text goes.
    stack: list[tuple] = [(iter(root.children), None, False, page, [])]
    while stack:
        children, leave, pre, canvas, lists = stack[-1]
        node = next(children, None)
        if node is None:
            stack.pop()
            if leave:
                leave()
        elif isinstance(node, str):
            canvas.verbatim(node) if pre else canvas.flow(node)
        elif visible(node):
            _enter(node, canvas, stack, lists, pre)
    return page.text()


def _enter(node: Element, canvas: Canvas, stack: list, lists: list, pre: bool) -> None:
    tag = node.tag
    if tag == "br":
        canvas.end_line()
        return
    if tag == "hr":
        canvas.block(True)
        return
    if tag in ("img", "area") and node.attributes.get("alt"):
        canvas.flow(node.attributes["alt"])
        return
    if tag == "option" and not any(not isinstance(c, str) or c.strip() for c in node.children) and node.attributes.get("label"):
        canvas.block(False)
        canvas.flow(node.attributes["label"])
        canvas.end_line()
        return
    if tag == "optgroup" and node.attributes.get("label"):
        canvas.block(False)
        canvas.flow(node.attributes["label"])
    if tag == "table":
        canvas.block(True)
        _table(node, canvas, stack)
        return
    if tag not in BLOCK:
        # Texts of a drawing stand apart.
        if tag == "text":
            canvas.flow(" ")
        stack.append((iter(node.children), (lambda: canvas.flow(" ")) if tag == "text" else None, pre, canvas, lists))
        return
    spaced = tag in SPACED and not (lists and tag in ("ul", "ol", "p"))
    canvas.block(spaced)
    indent = canvas.indent

    def leave() -> None:
        canvas.end_line()
        canvas.blank = canvas.blank or spaced
        canvas.indent, canvas.marker = indent, ""
        if tag in ("ul", "ol"):
            lists.pop()

    if tag in ("ul", "ol"):
        start = node.attributes.get("start", "1")
        lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        canvas.deepen(2 if len(lists) > 1 else 0)
    elif tag == "li":
        if lists and lists[-1][0] == "ol":
            canvas.marker = f"{lists[-1][1]}. "
            lists[-1][1] += 1
        else:
            canvas.marker = "- "
    elif tag in ("dd", "blockquote"):
        canvas.deepen(2)
    stack.append((iter(node.children), leave, pre or tag == "pre", canvas, lists))


def _table(table: Element, canvas: Canvas, stack: list) -> None:
    """Put the parts of a table on the stack, each with a canvas of its own, and its lines on `canvas` at their end."""
    # Cells with their columns and rows; None ends a group of rows, beyond which no cell reaches.
    rows: list[list[tuple[Canvas, int, int]] | None] = []
    captions: list[str | Canvas] = []
    parts: list[tuple[Element, Canvas]] = []

    def held(part: Element) -> Canvas:
        parts.append((part, Canvas()))
        return parts[-1][1]

    todo: list = [table]
    while todo:
        part = todo.pop()
        if part is None:
            rows.append(None)
        elif isinstance(part, str):
            captions.append(part)
        elif part is table or part.tag in _PARTS:
            ends = [] if part is table else [None]
            todo += ends + [c for c in reversed(part.children) if isinstance(c, str) or visible(c)] + ends
        elif part.tag == "tr":
            cells = [c for c in part.children if not isinstance(c, str) and visible(c)]
            rows.append([(held(c), _span(c), _span(c, "rowspan")) for c in cells])
            captions += [c for c in part.children if isinstance(c, str)]
        elif part.tag in ("td", "th"):
            rows.append([(held(part), 1, 1)])
        else:
            captions.append(held(part))

    def leave() -> None:
        for line in _aligned(rows, captions):
            canvas.now.append(line)
            canvas.end_line()
        canvas.block(True)

    stack.append((iter(()), leave, False, canvas, []))
    # The stack takes its last frame first.
    stack.extend((iter(part.children), None, False, own, []) for part, own in reversed(parts))


def _aligned(rows: list, captions: list) -> list[str]:
    """Rows with each column padded to its widest cell; nested tables become the text of their cell."""
    # Columns that cells of earlier rows still take, with the rows to come; below 0 for all of the group. Columns from
    # `COLUMNS` on are not kept aligned, so that a page of wild spans stays small.
    taken: dict[int, int] = {}
    placed: list[list[tuple[int, int, str]]] = []
    widths: dict[int, int] = {}
    for row in rows:
        if row is None:
            taken = {}
            continue
        at, line, fresh = 0, [], {}
        for cell, span, down in row:
            while at in taken:
                at += 1
            text = " ".join(cell.text().split())
            line.append((at, span, text))
            if span == 1:
                widths[at] = max(widths.get(at, 0), len(text))
            if down != 1:
                fresh |= dict.fromkeys(range(at, min(at + span, COLUMNS)), down - 1)
            at += span
        taken = {k: left - 1 for k, left in taken.items() if left != 1} | fresh
        placed.append(line)
    texts = (" ".join((c if isinstance(c, str) else c.text()).split()) for c in captions)
    lines = [c for c in texts if c]
    for row in placed:
        at, cells = 0, []
        for start, span, text in row:
            # A column that a cell above takes stays empty here.
            cells += ["".ljust(widths.get(k, 0)) for k in range(at, start)]
            cells.append(text.ljust(sum(widths.get(k, 0) for k in range(start, start + span)) + 3 * (span - 1)))
            at = start + span
        if any(text for _, _, text in row):
            lines.append(" | ".join(cells).rstrip())
    return lines


def _span(cell: Element, of: str = "colspan") -> int:
    span = cell.attributes.get(of, "1")
    # A `rowspan` of 0 reaches to the end of the group.
    least = 0 if of == "rowspan" else 1
    return min(max(int(span), least), 65534 if of == "rowspan" else 1000) if re.fullmatch(r"[0-9]{1,6}", span) else 1


def _first(root: Element, tag: str) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            return " ".join("".join(c for c in node.children if isinstance(c, str)).split())
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return None


RENDERED = "page_id bigint, title string, text string, n_lines bigint, n_chars bigint"


def renderer() -> Callable[[str], tuple]:
    def page(source: str) -> tuple:
        root = build_tree(source)
        text = render(root)
        return _first(root, "title"), text, text.count("\n") + 1 if text else 0, len(text)

    return page


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id with the title and the visible text of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return per_text(rows, renderer, RENDERED)
