"""HTML to text, laid out as a browser would space it.

Tags are read one after another in one pass (attributes by what quotes, spaces
and slashes delimit them, without going back). A tree builder closes what start
tags imply to be closed (a paragraph before a block, an item before the next
one, cells and rows of a table, the head before what it cannot hold), opens rows
for cells without one, moves what a table cannot hold before it, and lets end
tags close the nearest element of their name in scope. Not shown are scripts,
styles, the head, templates, closed details and dialogs, ``hidden``, and what
``display`` or ``visibility`` hide, be it in ``style`` attributes or in rules of
style elements whose selectors are an element's name, classes and id (rules with
combinators, pseudo-classes or within at-rules are passed over).

What is shown is written line by line: white space collapses except in
preformatted text, blocks begin on lines of their own, paragraphs, headings,
lists and tables have an empty line around them, items have bullets or numbers
and hang from them, and the cells of a table stand in aligned columns, tables
within tables included; heads and feet of tables stand first and last. Values of
buttons and text fields, options and alternative texts count as text,
placeholders do not.

Edge cases: a null page gives null, an empty or invisible one the empty string;
text without tags is kept; ``<`` before anything but a letter, ``/``, ``!`` or ``?``
and broken entities are text; a tag that the page's end cuts off is dropped, as in
browsers; elements beyond ``DEEPEST`` levels stand side by side, as there; the
time is in proportion to the page; repeated rows get equal texts; null ids are
passed on; extra columns are passed by.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Columns are padded to this width at most.
WIDTH = 60
#: Elements nested deeper stand beside each other, as browsers have it.
DEEPEST = 512

# Elements by the roles that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist defs desc metadata annotation annotation-xml area base link meta param source track col colgroup rp".split())
IN_HEAD = frozenset("base link meta title style script noscript template noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure form fieldset hr menu dir xmp listing".split())
LINES = frozenset("div section article aside header footer main nav address li dt dd tr caption figcaption details summary legend html body center hgroup dialog search option text thead tbody tfoot td th".split())
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
ENDS_P = SPACED | LINES - frozenset("tr td th thead tbody tfoot caption html body legend option text".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
SECTIONS = frozenset("tbody thead tfoot".split())
#: What a table takes; all else moves before it.
IN_TABLES = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
KEPT = frozenset("pre textarea listing xmp".split())
SPOKEN_INPUTS = frozenset("text search email url tel number date month week time datetime-local submit reset button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element, the start tags that close it, and the elements that keep it open.
CLOSED_BY = {
    "p": (ENDS_P, frozenset("table td th caption button object template html".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset("option optgroup".split()), frozenset("select table td th".split())),
    "td": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "tr": (frozenset("tr tbody thead tfoot".split()), frozenset(["table"])),
    "tbody": (SECTIONS, frozenset(["table"])),
    "thead": (SECTIONS, frozenset(["table"])),
    "tfoot": (SECTIONS, frozenset(["table"])),
    "caption": (frozenset("tr td th tbody thead tfoot".split()), frozenset(["table"])),
    "h1": (HEADINGS, ENDS_P - HEADINGS | frozenset("td th".split())),
}
CLOSED_BY |= {h: CLOSED_BY["h1"] for h in HEADINGS}
#: For each start tag the open elements it may close.
_CLOSES = {start: frozenset(e for e, (starts, _) in CLOSED_BY.items() if start in starts) for start in frozenset().union(*(starts for starts, _ in CLOSED_BY.values()))}

_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
_ATTRIBUTE = re.compile(r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+)?(["'])?))?""")
_BETWEEN = re.compile(r"[ \t\n\f\r/]*+")
_RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.I) for name in RAW}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


def declared(style: str) -> dict[str, str]:
    """``display`` and ``visibility`` among declarations; the last of each, an important one before others."""
    out: dict[str, str] = {}
    strong: set[str] = set()
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, (value, mark, _) = name.strip(), value.partition("!")
        if name in ("display", "visibility") and value.strip() and (mark or name not in strong):
            out[name] = value.strip()
            if mark:
                strong.add(name)
    return out


class Rules:
    """Rules of style elements that show or hide, by simple selectors."""

    def __init__(self) -> None:
        #: By what an element must have (an id, a class, a name or nothing): selectors and what they say.
        self.rules: dict[str, dict[tuple, tuple[tuple, dict[str, str]]]] = {}
        self.found: dict[tuple, dict[str, str]] = {}
        self.n = 0

    def add(self, sheet: str) -> None:
        for selectors, style in _RULE.findall(self.without_at_rules(_COMMENT.sub(" ", sheet))):
            said = declared(style)
            for one in selectors.split(",") if said else ():
                found = _SELECTOR.fullmatch(one.strip())
                if found and one.strip():
                    marks = re.findall(r"[.#][\w-]+", found[2])
                    ids, classes = (frozenset(m[1:] for m in marks if m[0] == c) for c in "#.")
                    name = (found[1] or "*").lower()
                    key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else name
                    here = self.rules.setdefault(key, {})
                    before = here.pop((name, ids, classes), (None, {}))[1]
                    self.n += 1
                    here[name, ids, classes] = (len(ids), len(classes), name != "*", self.n), before | said

    @staticmethod
    def without_at_rules(sheet: str) -> str:
        """A sheet without at-rules and what is in their braces."""
        out, at = [], 0
        while True:
            start = sheet.find("@", at)
            out.append(sheet[at : start if start >= 0 else len(sheet)])
            if start < 0:
                return "".join(out)
            depth, at = 0, start
            for found in re.finditer(r"[{};]", sheet[start:]):
                depth += {"{": 1, "}": -1, ";": 0}[found[0]]
                if depth <= 0:
                    at = start + found.end()
                    break
            else:
                return "".join(out)

    def of(self, node: Node) -> dict[str, str]:
        """What the rules say of an element, the weightier and later of them last."""
        if not self.rules:
            return {}
        own = node.name, node.attributes.get("id", ""), node.attributes.get("class", "")
        if own not in self.found:
            name, id_, classes = own[0], own[1], frozenset(own[2].split())
            keys = ["*", name, f"#{id_}", *(f".{c}" for c in classes)]
            fit = [value for key in keys for (n, i, c), value in self.rules.get(key, {}).items() if n in ("*", name) and i <= {id_} and c <= classes]
            self.found[own] = {k: v for _, said in sorted(fit, key=lambda f: f[0]) for k, v in said.items()}
        return dict(self.found[own])


class Node:
    """An element: its name, attributes, what is in it (nodes and texts), and how it is shown."""

    __slots__ = ("attributes", "inside", "kept", "lines", "mark", "name", "seen", "visible")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.inside = name, attributes or {}, []
        self.seen, self.visible, self.kept, self.mark = True, True, False, "- "
        self.lines: list[str] | None = None


class Builder:
    """Builds the tree of a page."""

    def __init__(self) -> None:
        self.root, self.rules = Node("#root"), Rules()
        self.open, self.count = [self.root], Counter()
        self.fresh = False

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.name] += 1

    def cut(self, first: int, last: int | None = None) -> None:
        """Close the open elements from ``first`` (to ``last``)."""
        gone = self.open[first:last]
        for node in gone:
            self.count[node.name] -= 1
        del self.open[first:last]

    def build(self, page: str) -> Node:
        at, n = 0, len(page)
        while at < n:
            here = page.find("<", at)
            if here < 0:
                self.text(page[at:])
                break
            after = page[here + 1 : here + 2]
            if after.isascii() and after.isalpha() or after and after in "/!?":
                if here > at:
                    self.text(page[at:here])
                at = self.tag(page, here, after)
            else:
                self.text(page[at : here + 1])
                at = here + 1
        return self.root

    def tag(self, page: str, here: int, after: str) -> int:
        """Take the tag or comment at ``here``; where it ends."""
        n = len(page)
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            return n if end < 0 else end + 3
        closing = after == "/"
        found = _NAME.match(page, here + 1 + closing)
        if not found:
            end = page.find(">", here)
            return n if end < 0 else end + 1
        at, attributes = found.end(), {}
        while True:
            at = _BETWEEN.match(page, at).end()
            if at >= n:
                return n
            if page[at] == ">":
                break
            one = _ATTRIBUTE.match(page, at)
            if one[5]:
                #: A quote that nothing closes.
                return n
            at = one.end()
            attributes.setdefault(one[1].lower(), one[2] or one[3] or one[4] or "")
        name = found[0].lower()
        if closing:
            self.end(name)
            return at + 1
        closed = page[at - 1] == "/"
        self.start(name, {k: unescape(v) if "&" in v else v for k, v in attributes.items()}, closed)
        at += 1
        if name in RAW and self.open[-1].name == name:
            end = _RAW_END[name].search(page, at)
            raw = page[at : end.start() if end else n]
            if name == "style":
                self.rules.add(raw)
            elif name in ("textarea", "xmp"):
                self.open[-1].inside.append(unescape(raw) if name == "textarea" else raw)
            self.cut(len(self.open) - 1)
            at = n if not end else page.find(">", end.end()) + 1 or n
        return at

    def place(self, item: Node | str) -> None:
        """Put into the open element, or before the table if that takes only rows and cells."""
        top = self.open[-1]
        stray = top.name in TABLE_PARTS and (item.strip() if isinstance(item, str) else item.name not in IN_TABLES and item.name not in UNSEEN)
        if stray and self.count["table"]:
            i = len(self.open) - 1
            while self.open[i].name != "table":
                i -= 1
            above, table = self.open[i - 1].inside, self.open[i]
            where = next((k for k in range(len(above) - 1, -1, -1) if above[k] is table), len(above))
            above.insert(where, item)
            return
        top.inside.append(item)

    def text(self, raw: str) -> None:
        if self.fresh:
            #: A line end right after a start tag of preformatted text is none.
            raw, self.fresh = raw.removeprefix("\r").removeprefix("\n"), False
        if self.open[-1].name == "head" and raw.strip():
            self.cut(len(self.open) - 1)
        if raw:
            self.place(unescape(raw) if "&" in raw else raw)

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        self.fresh = name in ("pre", "listing")
        if self.open[-1].name == "head" and name not in IN_HEAD:
            self.cut(len(self.open) - 1)
        if name == "form" and self.open[-1].name in TABLE_PARTS:
            return
        while name in _CLOSES and self.closes(name):
            pass
        if name == "table" and self.open[-1].name in TABLE_PARTS and self.count["table"]:
            #: A table right in another ends that.
            self.end("table")
        if name in IN_TABLES and self.count["table"]:
            #: A part of the table ends stray content that is still open.
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].name in TABLE_PARTS:
                    self.cut(i + 1)
                if self.open[i].name in TABLE_PARTS or self.open[i].name in ("td", "th", "caption"):
                    break
        if name in ("td", "th") and self.open[-1].name in TABLE_PARTS and self.open[-1].name != "tr":
            self.start("tr", {}, False)
        node = Node(name, attributes)
        self.place(node)
        if (len(self.open) < DEEPEST or name in RAW) and name not in VOID and not (closed and name not in ENDS_P):
            self.push(node)

    def closes(self, name: str) -> bool:
        """Close the nearest element that this start tag implies to be closed."""
        may = [e for e in _CLOSES[name] if self.count[e]]
        for i in range(len(self.open) - 1, 0, -1):
            if not may:
                break
            here = self.open[i].name
            if here in may:
                self.cut(i)
                return True
            may = [e for e in may if here not in CLOSED_BY[e][1]]
        return False

    def end(self, name: str) -> None:
        if name == "br":
            self.place(Node("br"))
            return
        if not self.count[name]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i].name
            if here == name:
                self.cut(i, i + 1 if name in FORMATS else None)
                return
            if here == "table" or here in ("td", "th") and name not in TABLE_PARTS:
                return


def judge(root: Node, rules: Rules) -> list[Node]:
    """Mark what is shown, visible and preformatted, from the outside in; the tables, outer ones before those in them."""
    tables, work = [], [root]
    while work:
        node = work.pop()
        if node.name == "table":
            tables.append(node)
        for one in node.inside:
            if isinstance(one, Node):
                a = one.attributes
                said = rules.of(one)
                if "style" in a:
                    said |= declared(a["style"])
                one.seen = one.name not in UNSEEN and said.get("display", "none" if "hidden" in a else "") != "none" and not (one.name == "dialog" and "open" not in a)
                one.visible = said["visibility"] not in ("hidden", "collapse") if "visibility" in said and said["visibility"] != "inherit" else node.visible
                one.kept = node.kept or one.name in KEPT
                if one.seen:
                    work.append(one)
    return tables


class Page:
    """Lines of text, the line being written, and what is due before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.space, self.gap, self.hang = "", False, 0, []
        self.parts: list[str] = []

    def write(self, text: str, kept: bool) -> None:
        if kept:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.add(first)
            for line in more:
                self.line()
                self.add(line)
            return
        words = _SPACE.split(text)
        if len(words) > 1 and not words[0]:
            self.space = True
        joined = " ".join([w for w in words if w])
        if joined:
            self.add(joined)
            self.space = not words[-1]

    def add(self, text: str) -> None:
        if not text:
            return
        if self.parts:
            if self.space:
                self.parts.append(" ")
        else:
            if self.lines and self.gap > 1:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.parts.append("".join([h[0] if i == len(self.hang) - 1 or h[2] else h[1] for i, h in enumerate(self.hang)]) if self.hang else "")
            for h in self.hang:
                h[0], h[2] = h[1], False
        self.parts.append(text)
        self.space = False

    def line(self) -> None:
        """End the line, written or not."""
        self.lines.append("".join(self.parts).rstrip(" "))
        self.parts, self.space = [], False

    def block(self, gap: int) -> None:
        """The next text begins a line, after ``gap - 1`` empty ones at least."""
        if self.parts:
            self.line()
        self.space = False
        self.gap = max(self.gap, gap)


def rendered(root: Node) -> list[str]:
    """The lines of what is shown in a node; tables within have theirs already."""
    page = Page()
    work: list = [(x, root) for x in reversed(root.inside)]
    while work:
        item, above = work.pop()
        if above is None:
            item()
            continue
        if isinstance(item, str):
            if above.visible:
                page.write(item, above.kept)
            continue
        if not item.seen:
            continue
        name = item.name
        if name == "br":
            page.line() if page.parts or page.lines else None
            continue
        if name in ("img", "input"):
            if item.visible:
                page.write(spoken(item), False)
            continue
        if name == "table" and item.lines is not None:
            page.block(2)
            for text in item.lines:
                page.add(text)
                page.line()
            page.block(2)
            continue
        gap = 2 if name in SPACED and not (name in ("ul", "ol", "menu", "dir") and page.hang) else 1 if name in SPACED or name in LINES else 0
        if gap:
            page.block(gap)
            work.append((lambda g=gap: page.block(g), None))
        if name == "li":
            mark = item.mark
            page.hang.append([mark, " " * len(mark), True])
            work.append((page.hang.pop, None))
        elif name in ("dd", "blockquote"):
            page.hang.append(["  ", "  ", True])
            work.append((page.hang.pop, None))
        elif name == "ol":
            number = int(item.attributes["start"]) if re.fullmatch(r"-?\d{1,9}", item.attributes.get("start", "")) else 1
            for one in item.inside:
                if isinstance(one, Node) and one.name == "li" and one.seen:
                    one.mark = f"{number}. "
                    number += 1
        inside = item.inside
        if name == "details" and "open" not in item.attributes:
            inside = [n for n in inside if isinstance(n, Node) and n.name == "summary"][:1]
        work += [(x, item) for x in reversed(inside)]
    if page.parts:
        page.line()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def spoken(node: Node) -> str:
    """What an image or a field shows."""
    kind = node.attributes.get("type", "text").lower()
    if node.name == "img" or kind == "image":
        return node.attributes.get("alt", "")
    return node.attributes.get("value", "") if kind in SPOKEN_INPUTS else ""


def rows_of(table: Node) -> list[Node]:
    """Rows and captions; those of the first head come first, those of the first foot last."""
    head, rows, foot = None, [], None
    for node in table.inside:
        if isinstance(node, Node) and node.seen:
            if node.name in ("tr", "caption"):
                rows.append(node)
            elif node.name in SECTIONS:
                here = [n for n in node.inside if isinstance(n, Node) and n.name in ("tr", "caption") and n.seen]
                if node.name == "thead" and head is None:
                    head = here
                elif node.name == "tfoot" and foot is None:
                    foot = here
                else:
                    rows += here
    return (head or []) + rows + (foot or [])


def span(node: Node, name: str) -> int:
    text = node.attributes.get(name, "1")
    return min(max(int(text), 1), 1000) if re.fullmatch(r"[0-9]{1,4}", text) else 1


def table_lines(table: Node) -> list[str]:
    """A table's rows, cells padded to the width of their columns; captions come first."""
    out, grid, taken = [], [], {}
    for row in rows_of(table):
        if row.name == "caption":
            out += [line for line in rendered(row) if line]
            continue
        column, cells = 0, []
        for cell in row.inside:
            if not isinstance(cell, Node) or cell.name not in ("td", "th") or not cell.seen:
                continue
            while taken.get(column, 0):
                column += 1
            width, rows = span(cell, "colspan"), span(cell, "rowspan")
            cells.append((column, width, [line for line in rendered(cell) if line]))
            for c in range(column, column + width) if rows > 1 else ():
                taken[c] = max(taken.get(c, 0), rows)
            column += width
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, width, lines in cells:
            if width == 1:
                widths[column] = max(widths.get(column, 0), min(WIDTH, max(map(len, lines), default=0)))
    columns, starts = sorted(widths), [0]
    for column in columns:
        starts.append(starts[-1] + widths[column] + 2)
    for cells in grid:
        for i in range(max((len(lines) for *_, lines in cells), default=0)):
            line: list[str] = []
            length = 0
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    start = starts[bisect_left(columns, column)]
                    pad = start - length if not length else max(2, start - length)
                    line += [" " * pad, lines[i]]
                    length += pad + len(lines[i])
            out.append("".join(line).rstrip(" "))
    return [line for line in out if line]


def page_text(page: str | None) -> str | None:
    if page is None:
        return None
    builder = Builder()
    root = builder.build(page.replace("\x00", "\ufffd"))
    #: Inner tables are laid out before those that hold them.
    for table in reversed(judge(root, builder.rules)):
        table.lines = table_lines(table)
    return "\n".join(rendered(root))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and ``text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                texts = [page_text(h) for h in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(texts, pa.string())], ["_id", "text"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)
