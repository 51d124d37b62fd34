"""Visible text of HTML pages by layout-aware rendering.

A tokenizer cuts a page into tags, comments and text; a tree builder adds implied tags (a paragraph ends at a
block, list items, table parts and options end at their like, end tags close what is open inside them);
visibility rules leave out what a browser does not show: head, script, style, template and other content without a
box, ``hidden``, ``display:none``, ``visibility:hidden``, also by a class or id that a style element hides outside
any ``@`` rule, closed dialogs and hidden inputs. The renderer walks the tree without recursion and emits all other
text, labels of buttons and texts in place of images included: blocks on lines of their own, paragraphs and headings
with an empty line around them, list items with a bullet or their number and indented by depth, ``pre`` as it stands,
``br`` and ``hr`` as line breaks, and tables with cells padded to their columns, which spans of columns and rows shift.
Blocks and lists inside a cell keep their lines: narrow cells stand side by side, and a row with a cell of several
lines that is wide, as in pages that are laid out by a table, puts one cell below the other. Cells wider than ``WIDE`` do
not widen a column, so output stays in proportion to the input.

Work is linear in the page: the places of open elements are kept by name, so an end tag costs no search, and
an unclosed quote or comment is looked for once.

Defined cases: null and empty pages give an empty text; text outside any element, and pages cut off anywhere, are
rendered as far as they go; repeated rows are rendered one by one; a null page_id stays; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import slices, texts

WIDE, GAP = 40, "  "
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head title script style template noembed noframes iframe object audio video canvas svg math datalist param meta link base area map".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main menu nav option optgroup search section select summary caption tr td th thead tbody tfoot".split())
#: An opening tag closes the innermost open element of the first set, looked for up to one of the second set.
_LISTS, _CELLS = ("ul", "ol", "menu"), ("td", "th", "caption")
IMPLIED = {
    "li": (("li",), _LISTS),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "caption", "colgroup"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
}
_P_ENDS = (BLOCK - frozenset("body html option optgroup caption tr td th thead tbody tfoot legend".split())) | {"hr"}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_STOP = re.compile(r"[\"'>]")
_NONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"(?:^|;)\s*visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


#: Spans count up to these; tables of more columns than the second have none.
SPAN, COLUMNS = 1000, 200
_NUMBER = re.compile(r"\s*([0-9]{1,4})")


class Node:
    """An element; ``span`` is a cell's number of columns and rows."""

    __slots__ = ("children", "name", "shown", "span", "start")

    def __init__(self, name: str, shown: bool = True, start: int = 1, span: tuple[int, int] = (1, 1)):
        self.name, self.shown, self.start, self.span, self.children = name, shown, start, span, []


def hidden_names(page: str) -> frozenset[str]:
    """The ``.class`` and ``#id`` selectors that the page's style elements do not show, outside ``@`` rules."""
    out, low, at = set(), page.lower() if "<style" in page or "<STYLE" in page or "<Style" in page else "", 0
    while (at := low.find("<style", at)) >= 0:
        begin, end = low.find(">", at), low.find("</style", at)
        if begin < 0:
            break
        end = len(page) if end < 0 else end
        depth, last, selector = 0, begin + 1, None
        for m in _BRACE.finditer(page, begin + 1, end):
            if m.group() == "{":
                depth += 1
                selector = page[last : m.start()] if depth == 1 else None
            else:
                if depth == 1 and selector is not None and _NONE.search(page[last : m.start()]):
                    out.update(x.strip() for x in selector.split(",") if _SIMPLE.fullmatch(x.strip()))
                depth, selector = max(depth - 1, 0), None
            last = m.end()
        at = max(end, begin)
    return frozenset(out)


_BRACE, _SIMPLE = re.compile(r"[{}]"), re.compile(r"[.#][A-Za-z_-][\w-]*")


def _tag_end(page: str, at: int, gone: dict) -> int:
    """Where the tag that is open at ``at`` ends; a quote that never closes counts as a letter."""
    while m := _STOP.search(page, at):
        if m.group() == ">":
            return m.end()
        close = -1 if m.group() in gone else page.find(m.group(), m.end())
        if close < 0:
            gone[m.group()] = True
        at = m.end() if close < 0 else close + 1
    return len(page)


def _attributes(text: str) -> dict:
    out: dict = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _visible(name: str, attributes: dict, hidden: frozenset = frozenset()) -> bool:
    if name in HIDDEN or "hidden" in attributes or _NONE.search(attributes.get("style", "")):
        return False
    if hidden and (f"#{attributes.get('id', '')}" in hidden or any(f".{c}" in hidden for c in attributes.get("class", "").split())):
        return False
    return not (name == "dialog" and "open" not in attributes or name == "input" and attributes.get("type", "").lower() == "hidden")


def tree(page: str) -> Node:
    """The page's tree; children are nodes and strings."""
    root, hidden = Node("html"), hidden_names(page)
    stack, places = [root], defaultdict(list)  # the open elements, and the places of each name among them
    gone: dict = {}

    def add_text(text):
        if text:
            stack[-1].children.append(html.unescape(text))

    def innermost(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def pop_to(names, stops=()):
        """Close the innermost open element of ``names``, unless one of ``stops`` is nearer."""
        at = innermost(names)
        if at and innermost(stops) <= at:
            while len(stack) > at:
                places[stack.pop().name].pop()

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            add_text(page[at:])
            break
        add_text(page[at:lt])
        if page.startswith("<!--", lt):
            end = -1 if "--" in gone else page.find("-->", lt + 4)
            if end < 0:
                gone["--"] = True
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            else:
                at = end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            add_text("<")
            at = lt + 1
            continue
        at, name = _tag_end(page, m.end(), gone), m.group(2).lower()
        if m.group(1):
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not places["p"]:
                stack[-1].children.append(Node("p"))
            elif name not in ("html", "body"):
                pop_to((name,), () if name in ("table", *_CELLS) else ("table", *_CELLS) if name not in ("tr", "thead", "tbody", "tfoot") else ("table",))
            continue
        attributes = _attributes(page[m.end() : at - 1]) if at - m.end() > 1 else {}
        if name in ("html", "body"):
            root.shown &= _visible(name, attributes, hidden)
            if name == "body":
                pop_to(("head",))
            continue
        if name in _P_ENDS:
            pop_to(("p",), ("button", "table", *_CELLS))
        if name in BLOCK and places["head"]:
            pop_to(("head",))
        if name in IMPLIED:
            pop_to(*IMPLIED[name])
        start = attributes.get("start", "1") if name == "ol" else "1"
        node = Node(name, _visible(name, attributes, hidden), int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1)
        if name in ("td", "th"):
            node.span = tuple(min(max(int(m.group(1)), 1), SPAN) if (m := _NUMBER.match(attributes.get(a, ""))) else 1 for a in ("colspan", "rowspan"))
        elif name == "img" and attributes.get("alt"):
            node.children.append(attributes["alt"])
        elif name == "input" and attributes.get("type", "").lower() in ("submit", "reset", "button") and attributes.get("value"):
            node.children.append(attributes["value"])
        if not node.shown and name in BLOCK and _SPACE.search(attributes.get("style", "")):
            stack[-1].children.append(Node(name))  # takes its place all the same
        stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at) if name not in gone else None
            stop = close.start() if close else len(page)
            if name == "textarea" or name == "xmp":
                node.children.append(html.unescape(page[at:stop]) if name == "textarea" else page[at:stop])
            at = _tag_end(page, close.end(), gone) if close else len(page)
        elif name not in VOID and not page.startswith("/", at - 2) or name in BLOCK and name != "hr":
            places[name].append(len(stack))
            stack.append(node)
    return root


class _Lines:
    """Lines being written: pending breaks, pending blank, indent and the marker of a list item."""

    def __init__(self):
        self.lines, self.now, self.blank, self.gap, self.indent, self.marker = [], [], False, 0, 0, ""

    def text(self, s: str):
        parts = _BLANKS.split(s)
        for i, part in enumerate(parts):
            if i and self.now:
                self.blank = True
            if part:
                self.word(part)

    def word(self, part: str):
        if not self.now:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.now.append("  " * self.indent + self.marker)
            self.marker, self.blank = "", False
        if self.blank:
            self.now.append(" ")
            self.blank = False
        self.now.append(part)

    def end(self, spaced: bool = False):
        """End the line; ``spaced`` asks for an empty line before the next one."""
        if self.now:
            self.lines.append("".join(self.now))
            self.now, self.blank = [], False
        self.gap = max(self.gap, int(spaced))

    def hard(self):
        """A line break that also makes empty lines."""
        if self.now:
            self.end()
        elif self.lines:
            self.gap = min(self.gap + 1, 1)

    def line(self, s: str):
        """A whole line as it is; an empty one asks for an empty line."""
        self.end()
        if s.strip():
            self.word("")
            self.now.append(s)
            self.end()
        elif self.lines:
            self.gap = 1

    def pre(self, s: str):
        self.end()
        for line in s.expandtabs(8).replace("\r\n", "\n").strip("\n").split("\n"):
            if line.strip():
                self.word("")
                self.now.append(line)
                self.end()
            elif self.lines:
                self.gap += 1


def _own_text(node: Node) -> str:
    """All visible text below a node, as one string for ``pre``."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.shown:
            if x.name == "br" or (x.name in BLOCK and x is not node and out and not out[-1].endswith("\n")):
                out.append("\n")
            todo.extend(reversed(x.children))
    return "".join(out)


def _rows(table: Node) -> list[list[Node]]:
    """Rows of cells of a table; what stands in no cell becomes a row of its own."""
    rows: list[list[Node]] = []
    loose = None
    todo = [("table", c) for c in reversed(table.children)]
    while todo:
        where, x = todo.pop()
        if isinstance(x, str):
            if not x.strip():
                continue
        elif not x.shown:
            continue
        elif x.name in ("thead", "tbody", "tfoot", "colgroup"):
            todo.extend(("table", c) for c in reversed(x.children))
            continue
        elif x.name == "tr":
            rows.append([])
            loose = None
            todo.extend(("tr", c) for c in reversed(x.children))
            continue
        elif x.name in ("td", "th"):
            if where == "table" and (not rows or loose is not None):
                rows.append([])
            loose = None
            rows[-1].append(x) if rows else rows.append([x])
            continue
        if loose is None:
            loose = Node("td")
            if where == "tr" and rows:
                rows[-1].append(loose)
            else:
                rows.append([loose])
        loose.children.append(x)
    return [r for r in rows if r]


_OPEN, _CLOSE = 0, 1


def render(root: Node) -> str:
    """The text of a tree. Tables are laid out when all their cells are rendered, innermost first."""
    out, frames = _Lines(), []
    todo: list = [(_OPEN, root, None)]
    while todo:
        step, x, info = todo.pop()
        if isinstance(x, str):
            out.text(x)
        elif step == _OPEN:
            if not x.shown:
                continue
            if x.name == "br":
                out.hard()
                continue
            if x.name == "table":
                frames.append((out, [], _rows(x)))
                todo.append((_CLOSE, x, None))
                for i, row in reversed(list(enumerate(frames[-1][2]))):
                    for cell in reversed(row):
                        todo.append((_CLOSE, cell, ("cell", i)))
                        todo.extend((_OPEN, c, None) for c in reversed(cell.children))
                        todo.append((_OPEN, Node("#cell"), None))
                continue
            if x.name == "#cell":
                out = _Lines()
                continue
            if x.name in BLOCK:
                out.end(x.name in SPACED and not (x.name in _LISTS and out.indent))
            if x.name in ("pre", "textarea", "xmp"):
                out.pre(_own_text(x))
                out.end(True)
                continue
            if x.name in _LISTS:
                out.indent += 1
                number = x.start
                todo.append((_CLOSE, x, None))
                steps = []
                for c in x.children:
                    mark = None
                    if isinstance(c, Node) and c.name == "li":
                        mark = f"{number}. " if x.name == "ol" else "- "
                        number += 1
                    steps.append((_OPEN, c, mark))
                todo.extend(reversed(steps))
                continue
            if x.name == "li":
                out.marker = info or "- "
            elif x.name in ("dd", "blockquote"):
                out.indent += 1
            todo.append((_CLOSE, x, None))
            todo.extend((_OPEN, c, None) for c in reversed(x.children))
        elif info and info[0] == "cell":
            out.end()
            frames[-1][1].append((info[1], x.span, [line.rstrip() for line in out.lines]))
        elif x.name == "table":
            out, cells, _ = frames.pop()
            _lay_out(out, cells)
        else:
            if x.name in _LISTS or x.name in ("dd", "blockquote"):
                out.indent -= 1
            if x.name == "li":
                out.marker = ""
            if x.name in BLOCK:
                out.end(x.name in SPACED and not (x.name in _LISTS and out.indent))
    out.end()
    return "\n".join(line.rstrip() for line in out.lines)


def _placed(cells: list) -> list[list[tuple[int, tuple[int, int], list[str]]]]:
    """Rows of ``(column, span, lines)``; what a span from above takes is left out."""
    rows: dict[int, list] = defaultdict(list)
    for i, span, lines in cells:
        rows[i].append((span, lines))
    spans = max((sum(c for (c, _), _ in row) for row in rows.values()), default=0) <= COLUMNS
    out, taken = [], {}
    for number, i in enumerate(sorted(rows)):
        at, placed = 0, []
        for (columns, down), lines in rows[i]:
            while spans and at < COLUMNS and taken.get(at, 0) > number:
                at += 1
            if not spans:
                columns = down = 1
            placed.append((at, (columns, down), lines))
            if down > 1:
                taken.update(dict.fromkeys(range(at, at + columns), number + down))
            at += columns
        out.append(placed)
    return out


def _lay_out(out: _Lines, cells: list) -> None:
    rows = _placed(cells)
    widths: dict[int, int] = defaultdict(int)
    for row in rows:
        for at, (columns, _), lines in row[:-1]:
            size = max(map(len, lines), default=0)
            if columns == 1 and size <= WIDE:
                widths[at] = max(widths[at], size)
    offsets = [0]
    for c in range(max((at for row in rows for at, _, _ in row), default=0)):
        offsets.append(offsets[-1] + widths[c] + len(GAP))
    out.end(True)
    for row in rows:
        height, size = max(len(lines) for _, _, lines in row), sum(len(x) for _, _, lines in row for x in lines)
        narrow = all(len(x) <= WIDE for _, _, lines in row for x in lines)
        if height > 1 and not (narrow and len(row) > 1 and height * (offsets[row[-1][0]] + WIDE) <= 8 * size + 2000):
            for _, _, lines in row:
                for line in lines:
                    out.line(line)
                out.end(True)
            continue
        for i in range(height):
            text = ""
            for at, _, lines in row:
                part = lines[i] if i < len(lines) else ""
                if part:
                    text = (text + GAP if text else "").ljust(offsets[at]) + part
            out.line(text)
    out.end(True)


def visible_text(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, text)`` for each row of ``pages(page_id, html)``."""

    def run(batches):
        for part in slices(batches, "html"):
            found = [visible_text(t) for t in texts(part, "html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(found, pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
