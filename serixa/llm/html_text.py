"""Layout-aware rendering of web pages to text.

A tokenizer and a tree builder with implied end tags feed a renderer as a stream
of properly nested opens, closes and texts.  The renderer keeps a stack of flows:
blocks end lines, blocks with margins leave an empty line between, list items hang
from a bullet or their number, and the cells of a table are laid out in aligned
columns when the table closes.  Invisible elements give nothing.

Defined results: a null or empty page gives an empty text; unclosed elements end
with the page; a tag that never ends takes the rest of the page, as in browsers;
stray end tags are ignored; nesting of any depth is handled without recursion, and pages
of any length in one pass.  Ties can't occur; columns other than the two named are not read.
Repeated rows get a row each; an empty table gives no rows; a null id stays null.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Quotes delimit a value directly after = only; elsewhere they are part of a name or an unquoted value.
_B = r"[ \t\n\r\f]*+"
TAG = re.compile(
    rf"""<(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\r\f/]|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:{_B}={_B}(?:"[^"]*"|'[^']*'|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+|(?=>))|(?!{_B}=)))*+)>"""
)
ATTRIBUTE = re.compile(rf"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:{_B}={_B}(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)|$))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)

#: Element classes of HTML.
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template title noembed noframes iframe datalist object audio video canvas".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dl figure table fieldset listing xmp hr".split())
BLOCK = MARGIN | frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption tr td th thead tbody tfoot colgroup frameset".split())
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
PREFORMATTED = frozenset("pre listing xmp textarea".split())
#: An opening tag first closes these, up to one of the elements after the bar.
IMPLIED = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    **{t: ("tr td th caption colgroup thead tbody tfoot", "table") for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
    "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
CLOSE_P = (BLOCK - TABLE_PARTS - frozenset("body html option optgroup frameset".split())) | {"hr"}
P_SCOPE = frozenset("table td th caption button object template html".split())
HEAD_ONLY = frozenset("head base link meta title style script noscript template html".split())


def width(text: str) -> int:
    """Columns a text takes in a fixed-width face."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def spans(value: str | None, least: int, most: int) -> int:
    """How many columns or rows a cell says it takes up."""
    found = re.match(r"[ \t\n\r\f]*\+?(\d{1,9})", value or "", re.A)
    return min(int(found[1]), most) if found and int(found[1]) >= least else 1


class Flow:
    """Lines of one container, with the one under way."""

    def __init__(self, kind: str = "", mark: str = ""):
        self.kind, self.mark = kind, mark
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap = False, 0
        self.count = 0  # items of a list so far
        self.spans = (1, 1)  # columns and rows of a cell; 0 rows are all that follow

    def words(self, text: str) -> None:
        parts = [p for p in (text.split() if text.isascii() and "\x0b" not in text else BLANKS.split(text)) if p]
        if not parts:
            self.space = self.space or bool(text)
            return
        if self.line and (self.space or text[0] in " \t\n\r\f"):
            self.line.append(" ")
        self.line.append(" ".join(parts))
        self.space = text[-1] in " \t\n\r\f"

    def exact(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for line in rest:
            self.end(True)
            self.line.append(line)

    def end(self, always: bool = False) -> None:
        line = "".join(self.line).rstrip(" ")
        if line or always:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.lines.append(line)
            self.gap = 0
        self.line, self.space = [], False

    def block(self, margin: bool) -> None:
        self.end()
        if margin:
            self.gap = 1

    def take(self, lines: list[str]) -> None:
        self.end()
        if lines:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.lines.extend(lines)
            self.gap = 0


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []  # lines, columns and rows of each cell
        self.captions: list[str] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """(first column, columns, lines) of the cells of each row; what a cell above spans is left free."""
        taken: dict[int, int] = {}  # column: the row after the last that a cell from above takes up
        out = []
        for r, row in enumerate(self.rows):
            cells, at = [], 0
            for lines, span, down in row:
                while taken.get(at, 0) > r:
                    at += 1
                cells.append((at, span, lines))
                if down != 1:
                    upto = r + down if down else len(self.rows)
                    taken.update((c, max(upto, taken.get(c, 0))) for c in range(at, at + span))
                at += span
            out.append(cells)
        return out

    def laid_out(self) -> list[str]:
        """Cells padded to their column's width; a cell of several lines makes its row as high."""
        rows = self.placed()
        widths = [0] * max((at + span for row in rows for at, span, _ in row), default=0)
        for row in rows:
            for at, span, lines in row:
                if span == 1:
                    widths[at] = max([widths[at], *map(width, lines)])
        for row in rows:  # what spans columns widens the last of them
            for at, span, lines in row:
                if span > 1:
                    has = sum(widths[at : at + span]) + 2 * (span - 1)
                    widths[at + span - 1] += max(0, max(map(width, lines), default=0) - has)
        begins = [0]
        for w in widths:
            begins.append(begins[-1] + w + 2)
        out = list(self.captions)
        for row in rows:
            for i in range(max((len(lines) for *_, lines in row), default=0)):
                line, has = [], 0
                for at, _, lines in row:
                    if i < len(lines) and lines[i]:
                        line.append(" " * (begins[at] - has) + lines[i])
                        has = begins[at] + width(lines[i])
                out.append("".join(line).rstrip(" "))
        return out


class Page:
    """Tree builder and renderer at once: the open elements, and the open flows."""

    def __init__(self):
        self.open: list[str] = []
        self.counts: Counter[str] = Counter()  # of the open elements, so that deep pages aren't searched for what isn't there
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.hidden: list[int] = []  # depths of the elements without boxes that are open
        self.unseen: list[tuple[int, bool]] = []  # depths where visibility changes, and whether to unseen
        self.closed: list[list] = []  # depth of closed details, and whether their summary, which alone shows, has come
        self.preformatted = 0

    def text(self, data: str) -> None:
        if self.hidden or not data or self.unseen and self.unseen[-1][1] or self.closed and self.closed[-1][0] == len(self.open):
            return
        if "&" in data:
            data = html.unescape(data)
        if self.preformatted:
            self.flows[-1].exact(data)
        elif self.open and self.open[-1] in ("table", "thead", "tbody", "tfoot", "tr") and not data.strip():
            return
        else:
            self.flows[-1].words(data)

    def start(self, tag: str, attributes: str) -> None:
        if self.open and self.open[-1] == "head" and tag not in HEAD_ONLY:
            self.end("head")
        if tag in IMPLIED:
            self.close_until(*IMPLIED[tag])
        if tag in CLOSE_P:
            self.close_until(frozenset(("p",)), P_SCOPE)
        if tag in ("html", "body") and self.counts[tag]:
            return
        if tag in ("td", "th") and self.counts["table"] and self.last("tr") < self.last("table"):
            self.start("tr", "")
        known = dict((k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)) if attributes and not attributes.isspace() else {}
        style = known.get("style", "")
        unseen = tag in INVISIBLE or "hidden" in known or tag == "dialog" and "open" not in known or bool(UNSEEN.search(style))
        if self.closed and self.closed[-1][0] == len(self.open):
            unseen = unseen or tag != "summary" or self.closed[-1][1]
            self.closed[-1][1] |= tag == "summary"
        if tag in VOID:
            if not self.hidden and not unseen:
                self.void(tag, known)
            return
        self.open.append(tag)
        self.counts[tag] += 1
        if found := VISIBILITY.findall(style):
            self.unseen.append((len(self.open), found[-1].lower() != "visible"))
        if tag == "details" and "open" not in known:
            self.closed.append([len(self.open), False])
        if unseen or self.hidden:
            if unseen:
                self.hidden.append(len(self.open))
            return
        flow = self.flows[-1]
        if tag in PREFORMATTED:
            self.preformatted += 1
        if tag == "table":
            flow.block(True)
            self.tables.append(Table())
            self.flows.append(Flow("table"))
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and self.tables:
            self.flows.append(Flow(tag))
            self.flows[-1].spans = spans(known.get("colspan"), 1, 1000), spans(known.get("rowspan"), 0, 65534)
        elif tag in ("ul", "ol", "menu"):
            flow.block(not any(f.kind == "li" for f in self.flows))
            self.flows.append(Flow(tag))
            first = known.get("start", "1")
            self.flows[-1].count = (int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1) - 1
        elif tag == "li":
            flow.block(False)
            flow.count += 1
            value = known.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                flow.count = int(value)
            self.flows.append(Flow("li", f"{flow.count}. " if flow.kind == "ol" else "- "))
        elif tag in ("dd", "blockquote"):
            flow.block(tag in MARGIN)
            self.flows.append(Flow(tag, "  "))
        elif tag in BLOCK:
            flow.block(tag in MARGIN)

    def void(self, tag: str, known: dict[str, str]) -> None:
        if tag == "br":
            self.flows[-1].end(True)
        elif tag == "hr":
            self.flows[-1].block(True)
        elif tag == "input" and known.get("type", "").lower() in ("submit", "button", "reset"):
            self.text(known.get("value", ""))

    def last(self, tag: str) -> int:
        if not self.counts[tag]:
            return -1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] == tag:
                return i
        return -1

    def close_until(self, tags: frozenset, scope: frozenset) -> None:
        """Closes the open elements down to the outermost of `tags` within the scope."""
        if not any(self.counts[t] for t in tags):
            return
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in scope:
                break
            if self.open[i] in tags:
                at = i
        while at is not None and len(self.open) > at:
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        if not self.counts[tag]:
            return
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            own = self.open[i]
            if own == tag:
                at = i
                break
            if own == "table" or own in ("td", "th", "caption") and tag not in TABLE_PARTS and tag != "table":
                return
        if at is None:
            return
        if tag not in BLOCK and any(t in BLOCK for t in self.open[at + 1 :]):
            self.drop(at)
            return
        while len(self.open) > at:
            self.pop()

    def drop(self, at: int) -> None:
        """Ends an inline element around open blocks, which stay open."""
        self.counts[self.open.pop(at)] -= 1
        self.hidden = [d - (d > at + 1) for d in self.hidden if d != at + 1]
        self.closed = [[d - (d > at + 1), s] for d, s in self.closed if d != at + 1]
        self.unseen = [(d - (d > at + 1), u) for d, u in self.unseen if d != at + 1]

    def pop(self) -> None:
        depth, tag = len(self.open), self.open.pop()
        self.counts[tag] -= 1
        if self.unseen and self.unseen[-1][0] == depth:
            self.unseen.pop()
        if self.closed and self.closed[-1][0] == depth:
            self.closed.pop()
        if self.hidden:
            if self.hidden[-1] == depth:
                self.hidden.pop()
            return
        if tag in PREFORMATTED:
            self.preformatted -= 1
        flow = self.flows[-1]
        if tag == "table" and flow.kind == "table":
            self.flows.pop()
            stray = (flow.end(), flow.lines)[1]  # text between cells goes before the table
            self.flows[-1].take(stray)
            self.flows[-1].take(self.tables.pop().laid_out())
            self.flows[-1].block(True)
        elif tag in ("td", "th", "caption") and flow.kind == tag:
            self.flows.pop()
            flow.end()
            table = self.tables[-1]
            if tag == "caption":
                table.captions += flow.lines
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((flow.lines, *flow.spans))
        elif tag in ("ul", "ol", "menu") and flow.kind == tag:
            self.flows.pop()
            flow.end()
            self.flows[-1].take(flow.lines)
            self.flows[-1].block(not any(f.kind == "li" for f in self.flows))
        elif tag in ("li", "dd", "blockquote") and flow.kind == tag:
            self.flows.pop()
            flow.end()
            hang = " " * len(flow.mark)
            self.flows[-1].take([((flow.mark if i == 0 else hang) + x) if x else x for i, x in enumerate(flow.lines)])
            self.flows[-1].block(tag in MARGIN)
        elif tag in BLOCK:
            flow.block(tag in MARGIN)

    def finish(self) -> str:
        while self.open:
            self.pop()
        flow = self.flows[0]
        flow.end()
        return "\n".join(flow.lines).strip("\n")


def render(source: str | None) -> str:
    """All visible text of a page."""
    page, at = Page(), 0
    source = source or ""
    n = len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            page.text(source[at:])
            break
        found = TAG.match(source, start)
        if found:
            if start > at:
                page.text(source[at:start])
            closing, tag, attributes = found.groups()
            tag, at = tag.lower(), found.end()
            if closing:
                page.end(tag)
                continue
            page.start(tag, attributes)
            if tag in RAW and page.open and page.open[-1] == tag:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else n
                page.text(source[at:stop])
                at = stop
                if not end:
                    break
            continue
        after = source[start + 1 : start + 2]
        if source.startswith("<!--", start):
            page.text(source[at:start])
            end = source.find("-->", start + 4 if source[start + 4 : start + 5] != ">" else start + 2)
            at = end + 3 if end >= 0 else n
        elif after and after in "!?" or after == "/" and not source[start + 2 : start + 3].isalpha():
            page.text(source[at:start])
            end = source.find(">", start)
            at = end + 1 if end >= 0 else n
        elif after.isascii() and after.isalpha() or after == "/":
            page.text(source[at:start])  # the tag never ends
            break
        else:
            page.text(source[at : start + 1])
            at = start + 1
    return page.finish()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines): the visible text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x) for x in batch.column("html").to_pylist()]
            counts = [len(t) for t in texts], [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
