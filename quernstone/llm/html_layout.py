"""HTML extraction by layout: a tree with implied tags, visibility, and all visible text with its block structure.

Tokens come from one regular expression. The builder keeps a stack of open elements: void elements close at once, a start tag closes what it
implies closed (a list item the item before, a block the paragraph, a row the cell ...) within its list or table, an end tag closes up to its
element if that is open, and the end closes all. Script, style and the like hold raw text and are never visible; nor are the head, templates,
hidden inputs, descriptions inside drawings and formulas, and what the hidden attribute or an inline style hides. Rendering puts blocks on lines of their own and paragraphs, headings,
lists and tables apart by an empty line, marks list items and indents nested lists, aligns table cells in columns (cells may span columns and
rows), and keeps preformatted text as it is. Elements are handled one after the other with an explicit stack, so nesting of any depth works.

Bounds of the layout, which cost no text: an indent of INDENT characters grows no further, tables in more than TABLES tables are plain blocks, and of
cells that span rows SPANS at most take their place in later rows at a time. With them the work is linear in the page."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
#: Elements whose raw content is text with character references.
TEXT = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title meta link base datalist object audio video canvas".split())
#: Drawings and formulas show their text, but not what these elements inside them describe.
FOREIGN = ("svg", "math")
NOTES = frozenset("title desc metadata annotation annotation-xml".split())
#: Blocks that stand apart by an empty line, and blocks that only take lines of their own.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure article section hr form fieldset details".split())
BLOCK = APART | frozenset("html body div address aside center dd dt figcaption footer header hgroup legend li main nav optgroup option summary search menu dir caption tr".split())
_LISTS = frozenset("ul ol menu dir dl".split())
_TABLE = frozenset("table".split())
_CELLS = frozenset("table td th".split())
_TABLE_PARTS = _CELLS | frozenset("tr thead tbody tfoot body html".split())
#: What a start tag closes, and the elements that it does not reach beyond.
CLOSES = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), _LISTS), "dd": (frozenset(["dt", "dd"]), _LISTS),
    "td": (frozenset(["td", "th"]), _TABLE), "th": (frozenset(["td", "th"]), _TABLE), "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), _TABLE),
    **{t: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()), "a": (frozenset(["a"]), frozenset(["table", "td", "th", "caption", "object"])),
}
_PARAGRAPH = (frozenset(["p"]), frozenset(["table", "td", "th", "caption", "button", "object"]))
#: Comments, declarations, tags. A tag's quoted values may hold > (in values of 2,048 characters, among 400 parts); a tag with more, or with an open quote, ends at the first >.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']+|"[^"]{0,2048}"|"[^">]*"|'[^']{0,2048}'|'[^'>]*'){0,400})(?=>|\Z)|[^>]*)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])", re.A)
INDENT, TABLES, SPANS = 80, 16, 256


class Node:
    __slots__ = ("tag", "children", "hidden", "start", "span")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1, span: tuple[int, int] = (1, 1)):
        self.tag, self.children, self.hidden, self.start, self.span = tag, [], hidden, start, span


def number(value: str | None, otherwise: int, least: int, most: int) -> int:
    """The whole number at the start of an attribute's value, within bounds."""
    m = NUMBER.match(value or "")
    return min(most, max(least, int(m[1]))) if m else otherwise


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def tree(html: str) -> Node:
    root = Node("html")
    stack, pos, n = [root], 0, len(html)
    opened: dict[str, list[int]] = {}  # the places of a tag's open elements in the stack

    def cut(k: int) -> None:
        for x in stack[:k - 1 if k else None:-1]:
            opened[x.tag].pop()
        del stack[k:]

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(s)

    def last(tags: frozenset[str]) -> int:
        """The innermost open element of the tags, 0 if none is open."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(names: frozenset[str], stops: frozenset[str]) -> None:
        """Closes the outermost of the named elements that is open within the stops."""
        if not any(map(opened.get, names)):
            return
        stop = last(stops)
        found = [own[k] for t in names if (own := opened.get(t)) and (k := bisect_right(own, stop)) < len(own)]
        if found:
            cut(min(found))

    while pos < n:
        m = TOKEN.search(html, pos)
        if not m:
            break
        if m.start() > pos:
            text(unescape(html[pos : m.start()]))
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("p", "br") and not (tag == "p" and opened.get("p")):
                stack[-1].children.append(Node(tag))
                continue
            if opened.get(tag) and (tag in _TABLE_PARTS or opened[tag][-1] > last(_CELLS)):
                cut(opened[tag][-1])
            continue
        if tag == "html":
            continue
        own = attributes(m[3]) if m[3] else {}
        foreign = tag in FOREIGN or any(map(opened.get, FOREIGN))
        hidden = tag in HIDDEN or (foreign and tag in NOTES) or "hidden" in own or bool(own.get("style") and UNSEEN.search(own["style"])) or (tag == "input" and own.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in own)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK and tag not in ("tr", "caption", "option", "optgroup", "html"):
            close(*_PARAGRAPH)
        if tag in BLOCK and stack[-1].tag == "head":
            cut(len(stack) - 1)
        span = (number(own.get("colspan"), 1, 1, 1000), number(own.get("rowspan"), 1, 0, 65534)) if own and tag in ("td", "th") else (1, 1)
        node = Node(tag, hidden, number(own.get("start"), 1, -(10**9), 10**9), span)
        stack[-1].children.append(node)
        if tag == "img" and own.get("alt"):
            node.children.append(own["alt"])
        if tag == "input" and own.get("type", "").lower() in ("submit", "button", "reset") and own.get("value"):
            node.children.append(own["value"])
        if tag in VOID or (foreign and m[0].endswith("/>")):
            continue
        if tag in RAW or tag in TEXT:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, pos)
            inner = html[pos : end.start() if end else n]
            if tag in TEXT:
                node.children.append(unescape(inner))
            pos = html.find(">", end.start()) + 1 if end else n
            if not pos:
                pos = n
            continue
        if tag != "body":
            stack.append(node)
            opened.setdefault(tag, []).append(len(stack) - 1)
    if pos < n:
        text(unescape(html[pos:]))
    return root


class Lines:
    """Text under construction: lines, with at most one empty line between blocks, and the margins that the next line gets."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.apart = self.space = False
        #: For each margin: what stands before its first line, before its others (with the margins around it), and before empty lines; first line's number;
        #: whether it stands apart.
        self.margins: list[tuple[str, str, str, int, bool]] = []
        self.fresh = 0  # innermost margins without a line yet
        self.low = 0  # fewest margins since the last line

    def push(self, mark: str, rest: str, quote: bool) -> None:
        _, around, empty, *_ = self.margins[-1] if self.margins else ("", "", "")
        if len(around) >= INDENT:
            mark = rest = ""
        inside = around + rest
        self.margins.append((mark, inside, inside.rstrip() if quote else empty, len(self.lines), self.apart))
        self.fresh += 1

    def pop(self) -> None:
        *_, first, apart = self.margins.pop()
        self.apart = apart if self.fresh else False
        while len(self.lines) > first and not self.lines[-1]:
            self.lines.pop()
        self.fresh = max(0, self.fresh - 1)
        self.low = min(self.low, len(self.margins))

    def started(self) -> bool:
        """Whether the innermost margin (or the whole) has a line or a part of one."""
        return bool(self.now) or (not self.fresh and bool(self.lines))

    def add(self, s: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if k:
                    self.end(True)
                if part:
                    self._put(part)
            return
        words = SPACE.sub(" ", s)
        if words == " ":
            self.space = self.space or bool(self.now)
            return
        if words.startswith(" "):
            self.space = self.space or bool(self.now)
            words = words[1:]
        if words:
            tail = words.endswith(" ")
            self._put(words[:-1] if tail else words)
            self.space = tail

    def _put(self, s: str) -> None:
        if self.apart and self.lines and self.lines[-1]:
            self.lines.append(self.margins[self.low - 1][2] if self.low else "")
        self.apart = False
        if self.space and self.now:
            self.now.append(" ")
        if not self.now and self.margins:
            steady = len(self.margins) - self.fresh
            self.now.append((self.margins[steady - 1][1] if steady else "") + "".join(m[0] for m in self.margins[steady:]))
            self.fresh, self.low = 0, len(self.margins)
        self.space = False
        self.now.append(s)

    def end(self, even_empty: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now))
        elif even_empty:
            self.lines.append(self.margins[-1][2] if self.margins else "")
        self.now, self.space = [], False

    def block(self, apart: bool) -> None:
        self.end()
        self.apart = self.apart or (apart and not self.fresh)  # nothing stands apart from its own margin

    def extend(self, lines: list[str]) -> None:
        for x in lines:
            if x:
                self._put(x)
                self.end()
            else:
                self.apart = True

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, int]]]:
    """First column and the one after the last of each cell; cells of earlier rows that span rows keep their columns."""
    held: list[tuple[int, int, int]] = []  # first column, the one after the last, the row after the last; by column
    out = []
    for r, cells in enumerate(rows):
        held = [h for h in held if h[2] > r]
        at, k, own, new = 0, 0, [], []
        for c in cells:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            wide, high = c.span
            stop = min(at + wide, held[k][0]) if k < len(held) else at + wide
            own.append((at, stop))
            below = len(rows) if high == 0 else min(len(rows), r + high)
            if below > r + 1 and len(held) + len(new) < SPANS:
                new.append((at, stop, below))
            at = stop
        held = sorted(held + new) if new else held
        out.append(own)
    return out


def _aligned(rows: list[list[str]], places: list[list[tuple[int, int]]]) -> list[str]:
    """Rows as lines, each column as wide as it needs; columns in which no cell begins take no room."""
    column = {s: k for k, s in enumerate(sorted({s for r in places for s, _ in r}))}
    starts = sorted(column)
    ends = [[bisect_left(starts, e) for _, e in r] for r in places]
    wide = [0] * len(starts)
    for cells, r, stops in zip(rows, places, ends):
        for text, (s, _), e in zip(cells, r, stops):
            if e - column[s] == 1:
                wide[column[s]] = max(wide[column[s]], len(text))
    for cells, r, stops in zip(rows, places, ends):
        for text, (s, _), e in list(zip(cells, r, stops))[:-1]:  # what ends a row pushes nothing
            if e - column[s] > 1:
                wide[e - 1] += max(0, len(text) - sum(wide[column[s] : e]) - 2 * (e - column[s] - 1))
    offset = [0]
    for w in wide:
        offset.append(offset[-1] + w + 2)
    out = []
    for cells, r in zip(rows, places):
        line, size = [], 0
        for text, (s, _) in zip(cells, r):
            gap = max(offset[column[s]] - size, 2 if size else 0) if text else 0
            line.append(" " * gap + text)
            size += gap + len(text)
        out.append("".join(line).rstrip())
    return out


def _cells(table: Node) -> tuple[list[list[Node]], list[Node]]:
    """Rows of cells, and the other elements of a table (captions), both in order."""
    rows: list[list[Node]] = []
    other: list[Node] = []
    todo: list[tuple[Iterator, list[Node] | None]] = [(iter(table.children), None)]
    while todo:
        children, row = todo[-1]
        c = next(children, None)
        if c is None:
            todo.pop()
        elif isinstance(c, str):
            if c.strip():
                other.append(_wrap(c))
        elif c.hidden or c.tag in ("colgroup", "col"):
            continue
        elif c.tag in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
                todo[-1] = (children, row)
            row.append(c)
        elif c.tag == "tr":
            rows.append([])
            todo[-1] = (children, None)
            todo.append((iter(c.children), rows[-1]))
        elif c.tag in ("thead", "tbody", "tfoot", "form"):
            todo.append((iter(c.children), row if c.tag == "form" else None))
        else:
            other.append(c)
    return [r for r in rows if r], other


def _wrap(s: str) -> Node:
    node = Node("span")
    node.children.append(s)
    return node


def render(root: Node) -> list[str]:
    """Lines of the visible text. A frame is an element, its children still to do, the lines it writes to, whether it is preformatted, what to do at its
    end, and the tables around it."""
    frames: list[tuple] = [(root, iter(root.children), Lines(), False, None, 0)]
    while True:
        node, children, out, pre, finish, tables = frames[-1]
        child = next(children, None)
        if child is None:
            frames.pop()
            if finish:
                finish()
            if not frames:
                return out.done()
            continue
        if isinstance(child, str):
            out.add(child, pre)
            continue
        if child.hidden:
            continue
        tag = child.tag
        if tag == "br":
            out.end(out.started())
        elif tag == "table" and tables < TABLES:
            _table(child, out, frames, tables + 1)
        elif tag in ("li", "dd", "blockquote"):
            _indented(child, node, out, pre, frames, tables)
        elif tag in BLOCK:
            apart = tag in APART and not (tag in _LISTS and node.tag in ("li", "dd"))
            out.block(apart)
            frames.append((child, iter(child.children), out, pre or tag == "pre", lambda out=out, apart=apart: out.block(apart), tables))
        else:
            if tag in ("td", "th"):
                out.space = out.space or bool(out.now)
            frames.append((child, iter(child.children), out, pre or tag in ("textarea", "listing"), None, tables))


def _indented(child: Node, parent: Node, out: Lines, pre: bool, frames: list[tuple], tables: int) -> None:
    quote = child.tag == "blockquote"
    if child.tag == "li":
        parent.start, place = parent.start + 1, parent.start
        mark = f"{place}. " if parent.tag == "ol" else "- "
    else:
        mark = "> " if quote else "    "
    out.block(quote)
    out.push(mark, mark if quote else " " * len(mark), quote)

    def finish() -> None:
        out.end()
        out.pop()
        out.block(quote)

    frames.append((child, iter(child.children), out, pre, finish, tables))


def _table(table: Node, out: Lines, frames: list[tuple], tables: int) -> None:
    rows, other = _cells(table)
    made: list[list[Lines]] = [[Lines() for _ in r] for r in rows]

    def finish() -> None:
        out.block(True)
        grid = [[" ".join(x for x in c.done() if x) for c in r] for r in made]
        out.extend([x for x in _aligned(grid, _placed(rows)) if x])
        out.block(True)

    out.block(True)
    frames.append((table, iter(()), out, False, finish, tables))
    for r, lines in zip(reversed(rows), reversed(made)):
        for cell, text in zip(reversed(r), reversed(lines)):
            frames.append((cell, iter(cell.children), text, False, None, tables))
    if other:
        captions = Lines()

        def captioned() -> None:
            out.extend(captions.done())
            out.block(True)

        box = Node("div")
        box.children = other
        frames.append((box, iter(other), captions, False, captioned, tables))


def text_of(html: str | None) -> str:
    return "\n".join(render(tree(html or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    Null or empty html: empty text. Broken markup: what a reader would see of it; a number that is none counts as absent. Very long pages and deep
    nesting: linear work and no recursion. Repeated rows: a row each. Null ids: kept. Empty table: empty result. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
