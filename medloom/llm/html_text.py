"""Visible text of HTML pages: a tree with implied tags, then a layout-aware rendering.

Blocks stand on lines of their own with a blank line between paragraphs, list items carry a bullet
or a number and are indented by depth, and the cells of a table are padded to the column's width.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video datalist select title".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
# blocks with a blank line around them, and blocks that only break the line
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset form".split())
BLOCKS = SPACED | frozenset("address article aside body caption center dd details dialog div dt figcaption footer header html li main menu nav section summary tr".split())
# an opening tag ends these open elements, unless one of the walls stands between
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
# what may stand in a head; anything else ends it
IN_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
ENDS_P = BLOCKS - {"body", "html", "tr", "caption"}
WALLS = frozenset("table td th caption button object html body".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>]*+)|[^>=]++)*+)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
HIDES = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
UNSHOWN = frozenset("desc metadata defs annotation annotation-xml".split())  # of drawings and formulas
START = re.compile(r"\bstart\s*=\s*[\"']?(-?\d+)", re.I)
DEEPEST_TABLE = 40  # tables nested deeper are laid out as plain blocks
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """Element tree; text nodes are strings. Unclosed and wrongly nested tags are closed as needed."""
    root = Node("#root")
    stack = [root]
    at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        close, opened = m.group(1), m.group(2)
        if opened:
            tag, attrs = opened.lower(), m.group(3)
            _leave_head(stack, tag)
            rule = IMPLIED.get(tag)
            if rule:
                _close_implied(stack, *rule)
            if tag in ("td", "th", "tr"):
                _open_implied(stack, tag)
            if tag in ENDS_P:
                _close_implied(stack, {"p"}, WALLS)
            node = Node(tag, "hidden" if tag in UNSHOWN and any(n.tag in ("svg", "math") for n in stack) else attrs)
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                inner = source[at : end.start() if end else len(source)]
                node.children.append(html.unescape(inner).removeprefix("\n") if tag == "textarea" else inner)
                at = end.end() if end else len(source)
            elif tag not in VOID and not attrs.rstrip().endswith("/"):
                stack.append(node)
        elif close:
            tag = close.lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
        elif m.group(0)[:2] not in ("<!", "<?"):
            if m.group(0).strip():
                _leave_head(stack, "")
            stack[-1].children.append(html.unescape(m.group(0)))
        elif m.group(0).startswith("<![CDATA["):
            stack[-1].children.append(m.group(0)[9:].removesuffix("]]>"))
    return root


def _leave_head(stack: list[Node], tag: str) -> None:
    """Anything that cannot stand in the head ends it; a template keeps its content."""
    if tag not in IN_HEAD and stack[-1].tag == "head":
        stack.pop()


def _open_implied(stack: list[Node], tag: str) -> None:
    """Open the group and the row that a row or a cell directly in a table or group leaves out."""
    for outer, missing in (({"table"}, "tbody"), ({"tbody", "thead", "tfoot"}, "tr")):
        if stack[-1].tag in outer and missing != tag:
            node = Node(missing)
            stack[-1].children.append(node)
            stack.append(node)


def _close_implied(stack: list[Node], ends, walls) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in walls:
            return
        if stack[k].tag in ends:
            outer = k
            while outer > 1 and stack[outer - 1].tag in ends and stack[outer - 1].tag not in walls:
                outer -= 1
            del stack[outer:]
            return


class _Page:
    """Lines of a page under construction."""

    def __init__(self, level: int = 0):
        self.level = level  # tables around this page
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.indent = ""
        self.mark = ""  # bullet of the list item that begins
        self.exact = False  # the line has preformatted text

    def text(self, s: str, pre: bool) -> None:
        if pre:
            head, *rest = s.split("\n")
            self.now.append(head)
            self.exact = True
            for line in rest:
                self.end_line(keep=True)
                self.now.append(line)
                self.exact = True
        else:
            self.now.append(SPACE.sub(" ", s))

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.now)
        keep = keep or self.exact and bool(line.strip())
        self.now, self.exact = [], False
        line = line.rstrip() if keep else SPACE.sub(" ", line).strip("  " if not line.strip() else " ")
        if line.strip() or (keep and self.lines):
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.indent + self.mark + line if line else "")
            if self.mark:
                self.mark = " " * len(self.mark)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced


def _width(s: str) -> int:
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _visible(node: Node) -> bool:
    return node.tag not in HIDDEN and not (node.attrs and _hides(node.attrs))


def _hides(attrs: str) -> bool:
    """By the attribute ``hidden`` or by style; of attributes of one name the first counts."""
    low = attrs.lower()
    if "hidden" not in low and "style" not in low:
        return False
    given = {}
    for m in ATTRIBUTE.finditer(low):
        given.setdefault(m.group(1), m.group(2) or m.group(3) or m.group(4) or "")
    return "hidden" in given or bool(HIDES.search(html.unescape(given.get("style", ""))))


def _rows(table: Node):
    waiting = list(reversed(table.children))
    while waiting:
        child = waiting.pop()
        if isinstance(child, str) or not _visible(child):
            continue
        if child.tag == "tr":
            yield [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and _visible(c)]
        elif child.tag in ("thead", "tbody", "tfoot"):
            waiting.extend(reversed(child.children))


def _outside(table: Node):
    """Captions and what stands in a table but in none of its cells: shown before the rows."""
    waiting = list(reversed(table.children))
    while waiting:
        child = waiting.pop()
        if isinstance(child, str):
            if child.strip():
                yield child
        elif child.tag in ("tr", "thead", "tbody", "tfoot"):
            if _visible(child):
                waiting.extend(reversed(child.children))
        elif child.tag not in ("td", "th", "colgroup", "col"):
            yield child


def _table(page: _Page, table: Node) -> None:
    page.level += 1
    for child in _outside(table):
        if isinstance(child, str):
            page.text(child, False)
        else:
            _element(page, child, False, 0)
    page.level -= 1
    page.end_line()
    rows = [[render(cell, page.level + 1).replace("\n\n", "\n").split("\n") for cell in row] for row in _rows(table)]
    if len(rows) == 1 and len(rows[0]) == 1:  # a frame, not a table
        grid = rows
    else:
        grid = [r for r in rows if r]
    columns = max((len(r) for r in grid), default=0)
    widths = [max((_width(line) for r in grid if k < len(r) for line in r[k]), default=0) for k in range(columns)]
    for r in grid:
        for i in range(max(len(c) for c in r)):
            cells = [c[i] if i < len(c) else "" for c in r]
            page.now = ["  ".join(c + " " * (w - _width(c)) for c, w in zip(cells, widths))]
            page.end_line(keep=True)


def _element(page: _Page, top: Node, pre: bool, depth: int) -> None:
    """Walk with an own stack: pages may nest deeper than Python recurses."""
    work: list = [("open", top, pre, depth, None)]
    while work:
        step, node, pre, depth, more = work.pop()
        if step == "text":
            page.text(node, pre)
            continue
        if step == "close":
            page.block(node.tag in SPACED and not (node.tag in ("ul", "ol", "menu") and depth > 1))
            if more is not None:
                page.indent, page.mark = more
            continue
        if not _visible(node):
            continue
        tag = node.tag
        if tag == "br":
            page.end_line()
            continue
        if tag == "table" and page.level < DEEPEST_TABLE:
            page.block(True)
            _table(page, node)
            page.block(True)
            continue
        is_list = tag in ("ul", "ol", "menu")
        inner = depth + 1 if is_list else depth
        saved = None
        if tag in BLOCKS:
            page.block(tag in SPACED and not (is_list and depth > 0))
            saved = (page.indent, page.mark)
            if tag in ("blockquote", "dd"):
                page.indent += "  "
        pre = pre or tag in ("pre", "listing", "textarea")
        if tag in BLOCKS:
            work.append(("close", node, pre, inner, saved))
        elif tag in ("td", "th"):
            page.now.append(" ")
        number = int(m.group(1)) if tag == "ol" and (m := START.search(node.attrs or "")) else 1
        steps = []
        for child in node.children:
            if isinstance(child, str):
                steps.append(("text", child, pre, inner, None))
            elif child.tag == "li":
                steps.append(("item", child, pre, inner, f"{number}. " if tag == "ol" else "- "))
                number += 1
            else:
                steps.append(("open", child, pre, inner, None))
        if step == "item":
            page.indent = "  " * max(depth - 1, 0)
            page.mark = more
        work.extend(reversed(steps))


def render(node: Node, level: int = 0) -> str:
    page = _Page(level)
    shown = Node("#cell")
    shown.children = node.children
    _element(page, shown, False, 0)
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def visible_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def _texts(batches):
    for batch in batches:
        texts = pa.array([visible_text(s.as_py()) for s in batch.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_lines, n_chars for every page.

    Null and empty pages have empty text; repeated rows repeat; ids and urls may be null. A page is
    rendered alone, so nothing but its own size sets the memory of a task.
    """
    given = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = given.schema["page_id"].dataType.simpleString()
    out = given.mapInArrow(_texts, f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"), F.length("text").alias("n_chars"))
