"""Layout-aware text of HTML pages.

A tag scanner feeds a tree builder that closes what HTML lets authors leave open (p, li, td, tr, option, ...). Elements
that a browser does not show (head, script, template, `hidden`, display:none, ...) give no text; form controls and the
texts of svg and math do, with every option of a select. Blocks end lines, and
paragraphs are set apart by an empty line; list items are marked and indented by depth, to `DEEPEST` levels; the cells of a
table's columns, spanning ones included, are padded to one width; white space collapses but in pre. A row that holds a cell of
several lines, or a table, is layout: its cells stand below each other, with their lines and spacing. What is `visibility:hidden` gives no text, but a descendant that is visible again does; a dialog that is not open is not shown, and
details are shown opened.

A page takes time in proportion to its length: where each name is open is known, so nothing looks through the open
elements. Nor does layout multiply a page: a table whose padding would be over `PADDING` times its cells' text, or whose
spans take as many steps, is shown without padding, with the same cells in the same order.

Defined cases: a null or empty page is the empty text; broken markup never fails (an unclosed tag ends at the next `<`
outside of quotes); equal pages give equal texts; a kept column named `text` gives way to the page's text; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from quillstone.llm.common import col, map_column

#: A quote opens a value only after an equals sign; in a value, < and > stand for themselves.
TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>?|<[!?/][^<>]*>?|[^<]+|<""")
COMMENT_END = re.compile("--!?>")
#: Fixed values of HTML: elements by what they do to layout, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object datalist audio video canvas".split())
#: Not shown inside of svg and math; elsewhere these are unknown names, whose text is shown.
UNSEEN_FOREIGN = frozenset("desc defs metadata symbol marker pattern mask clippath annotation annotation-xml".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Lines of their own that do not end a paragraph.
CONTROLS = frozenset("select option optgroup textarea".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "body": ("head",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
MAYBE_HIDDEN = re.compile("hidden|none|collapse|visib", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"[ \t\r\n\f]+")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
#: Inputs that show their value, or else their placeholder.
SHOWN_INPUTS = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset"))
CELLS = ("td", "th", "table")
PARTS = frozenset("td th tr table tbody thead tfoot body html".split())
DEEPEST = 32
PADDING = 16
#: Fixed values of HTML: the largest spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def values(attributes: str) -> dict[str, str]:
    """The attributes by name in lower case; of equal names the first one holds."""
    own: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return own


def number(text: str, least: int, most: int, default: int) -> int:
    text = text.strip()
    return min(most, max(least, int(text))) if text.isascii() and text.isdigit() and len(text) < 10 else default


def sight(attributes: str, foreign: bool) -> tuple[bool, str]:
    """Whether an element takes no room by its own attributes (hidden, or its display), and its own visibility, if it has one. Names are parsed, values are not searched."""
    if not MAYBE_HIDDEN.search(attributes):
        return False, ""
    own = values(attributes)
    if "hidden" in own or (foreign and own.get("display", "").strip().lower() == "none"):
        return True, ""
    style: dict[str, tuple[bool, str]] = {}
    for declaration in own.get("style", "").lower().split(";"):
        name, _, value = declaration.partition(":")
        value, important, _ = value.partition("!")
        if bool(important) >= style.get(name.strip(), (False, ""))[0]:
            style[name.strip()] = bool(important), value.strip()
    seen = style.get("visibility", (False, ""))[1]
    return style.get("display", (False, ""))[1] == "none", seen if seen in ("hidden", "collapse", "visible") else ""


#: A cell's lines, the columns and rows that it spans, and whether it holds a table.
Cell = tuple[list[str], int, int, bool]


class Page:
    """Open elements and the lines so far. A table keeps its own rows until it is closed."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.open: list[str] = []
        #: Where in `open` each name stands, lowest first.
        self.at: dict[str, list[int]] = defaultdict(list)
        self.lists: list[int | None] = []
        self.unseen: int | None = None
        #: Rows of cells, the lines around, loose lines, the lists around, spans of the open cell and whether it holds a table.
        self.tables: list[tuple[list[list[Cell]], list[str], list[str], list[int | None], list[tuple[int, int, bool]]]] = []
        #: Open elements with a visibility of their own: how many elements are open with it, and whether it shows.
        self.seen: list[tuple[int, bool]] = []
        self.pre = 0
        self.mark = ""

    def top(self, names: tuple[str, ...] | frozenset[str]) -> int:
        """Place of the innermost open element with one of the names; -1 without any."""
        return max((self.at[x][-1] for x in names if self.at[x]), default=-1)

    def visible(self) -> bool:
        return not self.seen or self.seen[-1][1]

    def foreign(self) -> bool:
        return bool(self.at["svg"] or self.at["math"])

    def push(self, name: str) -> None:
        self.at[name].append(len(self.open))
        self.open.append(name)

    def flush(self, gap: bool = False) -> None:
        text = "".join(self.line)
        text = text if self.pre else SPACES.sub(" ", text).strip(" ")
        self.line = []
        if text.strip():
            depth = min(len(self.lists), DEEPEST)
            self.lines.append("  " * max(0, depth - 1) + self.mark + text if self.mark else "  " * depth + text)
            self.mark = ""
        if gap and self.lines and self.lines[-1]:
            self.lines.append("")

    def start(self, name: str, attributes: str) -> None:
        if name == "head" and len(self.open) > len(self.at["html"]):
            return
        if name not in HEAD and self.open and self.open[-1] == "head":
            self.end_top()
        # an element that the page leaves open is closed whether it is shown or not
        if name in BLOCKS:
            self.close(("p",), ("table", "td", "th"))
        if name in CLOSES:
            self.close(CLOSES[name], LIMITS.get(name, ()))
        if self.unseen is not None:
            if name not in VOID:
                self.push(name)
            return
        if name == "br":
            if self.pre:
                self.line.append("\n")
            else:
                self.flush()
            return
        if name == "hr":
            self.flush(True)
            return
        if name == "input":
            own = values(attributes)
            gone, seen = sight(attributes, False)
            if own.get("type", "").strip().lower() in SHOWN_INPUTS and not gone and (seen == "visible" if seen else self.visible()):
                self.line.append(f" {html.unescape(own.get('value') or own.get('placeholder', ''))} ")
            return
        if name in VOID:
            return
        self.push(name)
        foreign = self.foreign()
        gone, seen = sight(attributes, foreign) if attributes else (False, "")
        if gone or name in UNSEEN or (foreign and name in UNSEEN_FOREIGN) or (name == "dialog" and "open" not in values(attributes)):
            self.unseen = len(self.open)
            return
        if seen:
            self.seen.append((len(self.open), seen == "visible"))
        if name in CONTROLS or (name == "text" and foreign):
            self.flush()
        elif name in BLOCKS:
            self.flush(name in SPACED and not (name in ("ul", "ol", "dl") and self.lists))
        if name in ("ul", "menu", "dl"):
            self.lists.append(None)
        elif name == "ol":
            self.lists.append(number(values(attributes).get("start", ""), 0, 10**9, 1) - 1 if attributes else 0)
        elif name == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                if attributes:
                    self.lists[-1] = number(values(attributes).get("value", ""), 0, 10**9, self.lists[-1])
                self.mark = f"{self.lists[-1]}. "
            else:
                self.mark = "- "
        elif name in ("pre", "textarea"):
            self.pre += 1
        elif name == "table":
            self.tables.append(([], self.lines, [], self.lists, []))
            self.lines, self.lists = [], []
        elif name == "tr" and self.tables:
            self.tables[-1][0].append([])
        elif name in ("td", "th") and self.tables:
            rows, _, loose, _, spans = self.tables[-1]
            if not rows:
                rows.append([])
            # what stands outside of the cells (a caption, text between rows) is shown above the rows
            loose.extend(x for x in self.lines if x)
            self.lines = []
            own = values(attributes) if attributes else {}
            spans.append((number(own.get("colspan", ""), 1, MOST_COLUMNS, 1), number(own.get("rowspan", ""), 0, MOST_ROWS, 1) or MOST_ROWS, False))

    def close(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        barrier = -1 if names == ("head",) else self.top((*limits, "table", "html", "body"))
        k = self.top(names)
        while k > barrier:
            while len(self.open) > k:
                self.end_top()
            k = k - 1 if names != ("td", "th") and self.open and self.open[-1] in names else -1

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        k = self.top((name,))
        if k > (-1 if name in PARTS else self.top(CELLS)):
            while len(self.open) > k:
                self.end_top()

    def end_top(self) -> None:
        name = self.open.pop()
        self.at[name].pop()
        if self.seen and len(self.open) < self.seen[-1][0]:
            self.seen.pop()
        if self.unseen is not None:
            if len(self.open) < self.unseen:
                self.unseen = None
            return
        if name in CONTROLS or (name == "text" and self.foreign()):
            self.flush()
        elif name in BLOCKS:
            self.flush(name in SPACED and not (name in ("ul", "ol", "dl") and len(self.lists) > 1))
        if name in ("ul", "ol", "menu", "dl") and self.lists:
            self.lists.pop()
        elif name == "li":
            self.mark = ""
        elif name in ("pre", "textarea"):
            self.pre = max(0, self.pre - 1)
        elif name in ("td", "th") and self.tables and self.tables[-1][4]:
            rows, spans = self.tables[-1][0], self.tables[-1][4]
            rows[-1].append((trimmed([y for x in self.lines for y in x.split("\n")]), *spans.pop()))
            self.lines = []
        elif name == "table" and self.tables:
            rows, outer, loose, lists, _ = self.tables.pop()
            loose, self.lines, self.lists = loose + [x for x in self.lines if x], outer, lists
            if self.lines and self.lines[-1] and rows:
                self.lines.append("")
            self.lines += loose + aligned(rows)
            if rows:
                self.lines.append("")
            if self.tables and self.tables[-1][4] and rows:
                spans = self.tables[-1][4]
                spans[-1] = (*spans[-1][:2], True)

    def text(self, data: str) -> None:
        if self.open and self.open[-1] == "head" and data.strip(" \t\r\n\f"):
            self.end_top()
        if self.unseen is None and self.visible():
            self.line.append(html.unescape(data) if "&" in data else data)


def trimmed(lines: list[str]) -> list[str]:
    """The lines without empty ones at either end, and with one at most between others; a single line has no blanks around it."""
    out: list[str] = []
    for x in lines:
        if x or (out and out[-1]):
            out.append(x)
    while out and not out[-1]:
        out.pop()
    return [out[0].strip()] if len(out) == 1 else out


def is_layout(row: list[Cell]) -> bool:
    return any(table or len(lines) > 1 for lines, _, _, table in row)


def stacked(row: list[Cell]) -> list[str]:
    """The cells of a layout row below each other."""
    return [y for lines, *_ in row if lines for y in ("", *lines, "")]


def placed(rows: list[list[Cell]], budget: int) -> list[list[tuple[int, int, str]]] | None:
    """First and next column and line of each row's cells, beside the cells that reach down from above; None beyond the budget of steps."""
    taken: dict[int, int] = {}
    out = []
    for r in rows:
        budget -= len(taken)
        if budget < 0:
            return None
        blocked, taken = taken, {c: n - 1 for c, n in taken.items() if n > 1}
        at, cells = 0, []
        for lines, columns, deep, _ in r:
            while at in blocked:
                at += 1
            cells.append((at, at + columns, lines[0] if lines else ""))
            if deep > 1:
                budget -= columns
                if budget < 0:
                    return None
                taken |= dict.fromkeys(range(at, at + columns), deep - 1)
            at += columns
        while cells and not cells[-1][2]:
            cells.pop()
        out.append(cells)
    return out


def filled(row: list[Cell]) -> list[Cell]:
    """The cells up to the last one with text."""
    n = len(row)
    while n and not row[n - 1][0]:
        n -= 1
    return row[:n]


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Cells of a column have one width; a spanning cell has that of its columns; the last cell of a row is not padded."""
    plain = [stacked(r) if is_layout(r) else [" | ".join(c[0][0] if c[0] else "" for c in cells)] if (cells := filled(r)) else [] for r in rows]
    budget = 65536 + PADDING * sum(len(x) + 3 for lines in plain for x in lines)
    grid = placed(rows, budget)
    shown = None if grid is None else padded([[] if is_layout(r) else cells for r, cells in zip(rows, grid, strict=True)], budget)
    if shown is None:
        return trimmed_all(plain)
    return trimmed_all([lines if is_layout(r) else shown[k] for k, (r, lines) in enumerate(zip(rows, plain, strict=True))])


def trimmed_all(parts: list[list[str]]) -> list[str]:
    """All lines of a table; empty ones set layout rows apart."""
    lines = [x for part in parts for x in part]
    out = trimmed(lines)
    return lines if len(out) == len(lines) == 1 else out


def padded(rows: list[list[tuple[int, int, str]]], budget: int) -> list[list[str]] | None:
    """The line of each row, padded by column; none for a row without cells. None beyond the budget of characters."""
    grid = [r for r in rows if r]
    # columns in which no cell begins take no room
    begins = sorted({a for r in grid for a, _, _ in r})
    column = {a: k for k, a in enumerate(begins)}
    width = [0] * len(begins)
    wide = []
    for r in grid:
        for n, (a, b, text) in enumerate(r):
            k = column[a]
            end = bisect_left(begins, b)
            if end == k + 1:
                width[k] = max(width[k], len(text))
            elif n < len(r) - 1:
                wide.append((k, end, len(text)))
    for k, end, size in wide:
        budget -= end - k
        if budget < 0:
            return None
        width[end - 1] += max(0, size - sum(width[k:end]) - 3 * (end - k - 1))
    left = [0]
    for w in width:
        left.append(left[-1] + w + 3)
    out = []
    for r in rows:
        line = ""
        for n, (a, _, text) in enumerate(r):
            if n or a > begins[0]:
                room = left[column[a]] - 3 - len(line)
                budget -= room
                if budget < 0:
                    return None
                line += " " * room + " | "
            line += text
        out.append([line.rstrip()] if r else [])
    return out


def render(page: str) -> str:
    out, at, n = Page(), 0, len(page)
    match = TOKEN.match
    while at < n:
        m = match(page, at)
        at, name = m.end(), m[2]
        if name:
            name = name.lower()
            if m[1]:
                out.end(name)
                continue
            out.start(name, m[3])
            if m[3].endswith("/") and out.foreign():
                out.end(name)
            elif name in RAW:
                found = RAW_ENDS[name].search(page, at)
                close = found.start() if found else n
                if name == "textarea":
                    out.text(page[at:close].removeprefix("\n"))
                at = close
        elif m[0] == "<!--":
            early = 1 if page.startswith(">", at) else 2 if page.startswith("->", at) else 0
            close = None if early else COMMENT_END.search(page, at)
            at = at + early if early else close.end() if close else n
        elif not m[0].startswith(("<!", "<?", "</")):
            out.text(m[0])
    while out.open:
        out.end_top()
    out.flush()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, markup: str, keep: list[str]) -> DataFrame:
    """`keep` and text for every page."""
    return map_column(pages, keep, F.coalesce(col(markup), F.lit("")), [StructField("text", StringType())], lambda column: [pa.array([render(x) for x in column.to_pylist()], pa.string())])
