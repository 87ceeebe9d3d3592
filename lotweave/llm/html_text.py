"""Layout-aware text of HTML pages.

A tree builder with implied tags (a head ends at text or a tag that may not stand in it, an open
paragraph ends at a block, list items, rows and cells end at the next one, rows are made where a cell lacks one) feeds a renderer that drops what a reader
doesn't see (head, scripts, styles, templates, ``hidden``, ``display:none``, ``visibility:hidden`` up to a
``visibility:visible``; title, desc, metadata and annotations of drawings and formulas) and keeps all other text: blocks on lines of their own, paragraphs apart by an empty line, list
marks with indents, preformatted text as it is, and table cells padded to their column.

Nothing is run or loaded here: ``noscript`` and the fallback inside ``object`` are seen. Browsers never
show what stands in audio, video, canvas, iframe, noembed and noframes, nor a datalist before one
types; these go. All options of a list count as seen, a line each, and so do labels of a drawing.
Numbers over, under and beside each other in a formula are kept apart by a space.

Both work without recursion, so nesting of any depth is safe, and in one pass over the page. A page
is one row; rows are spread by the scan.

Defined results. A null or empty page is the empty text. Broken markup never raises: a ``<`` that
starts no tag is text, an unmatched end tag is ignored, open elements end with the page. Repeated
rows and a null id give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_MAY_HIDE = re.compile("hidden|none|visib", re.I)
_VISIBILITY = re.compile(r"(?:^|;)visibility:(hidden|visible)")
_SPACES = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe datalist audio video canvas noembed noframes".split())
APART = frozenset("p blockquote ul ol dl pre table h1 h2 h3 h4 h5 h6 figure".split())
BLOCK = APART | frozenset("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav optgroup option search section summary tr".split())
#: Drawings and formulas: what isn't shown, what holds HTML again, what ends them, and formula parts set around each other.
FOREIGN = frozenset(("svg", "math"))
NOTES = frozenset("title desc metadata annotation annotation-xml".split())
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAK_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
AROUND = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtr".split())
#: What may stand in an open head; any other tag, or text, ends it.
IN_HEAD = frozenset("head title meta link base basefont bgsound style script template noscript noframes".split())
#: What an opening tag ends, and the elements that the search for it doesn't leave.
_ITEM, _CELL = ("ul", "ol", "menu", "dir"), ("table",)
ENDS = {"li": (("li",), _ITEM), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("optgroup",), ("select",)), "tr": (("tr",), _CELL),
        "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), **{t: (("thead", "tbody", "tfoot", "caption"), _CELL) for t in ("thead", "tbody", "tfoot")}}


class Sink:
    """Lines of one flow of text."""

    def __init__(self):
        self.lines, self.line, self.gap, self.indent, self.mark = [], [], 0, 0, None

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *more = s.split("\n")
            self._add(first)
            for m in more:
                self.end(0, True)
                self._add(m)
            return
        s = _SPACES.sub(" ", s)
        if not self.line or self.line[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self._add(s)

    def _add(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.line.append(" " * max(0, self.indent - len(self.mark or "")) + (self.mark or ""))
            self.mark = None
        self.line.append(s)

    def end(self, apart: int = 0, always: bool = False) -> None:
        """End the line; ``apart`` empty lines go before the next text."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif always:
            self.lines.append("")
        self.gap = max(self.gap, apart)

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _shown(raw: str) -> tuple[bool, str]:
    """Whether an element is taken out with all below it, and its own visibility."""
    if not raw or not _MAY_HIDE.search(raw):
        return False, ""
    attributes = _attributes(raw)
    style = _SPACES.sub("", attributes.get("style", "").lower())
    return "hidden" in attributes or "display:none" in style, (_VISIBILITY.findall(style) or [""])[-1]


def _cells(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells, each a list of lines, as text aligned by column."""
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
            widths[k] = max(widths[k], max(map(len, cell), default=0))
    out = []
    for row in rows:
        for i in range(max((len(cell) for cell in row), default=0)):
            parts = [(cell[i] if i < len(cell) else "").ljust(widths[k]) for k, cell in enumerate(row)]
            out.append("  ".join(parts).rstrip(" "))
    return out


class Page:
    """Tree builder and renderer in one pass: a stack of open elements and of text flows."""

    def __init__(self):
        self.open: list[tuple[str, bool, bool, str]] = []  # tag, unseen here or above, invisible, drawing or formula around what follows
        self.sinks, self.tables, self.lists, self.pre = [Sink()], [], [], 0
        self.heads = self.templates = 0  # open ones

    def _end_head(self) -> None:
        if self.heads and not self.templates:
            self._pop_to(("head",))

    @property
    def foreign(self) -> str:
        return self.open[-1][3] if self.open else ""

    def text(self, s: str, plain: bool = False) -> None:
        if self.heads and s.strip(" \t\n\f\r"):
            self._end_head()
        if s and not (self.open and (self.open[-1][1] or self.open[-1][2])):
            self.sinks[-1].text(unescape(s) if "&" in s and not plain else s, self.pre > 0)

    def _within(self, tags, stops) -> bool:
        for tag, _, _, _ in reversed(self.open):
            if tag in tags:
                return True
            if tag in stops:
                return False
        return False

    def _pop_to(self, tags) -> None:
        while self.open:
            tag = self.open[-1][0]
            self._leave()
            if tag in tags:
                return

    def start(self, tag: str, raw: str) -> None:
        if self.heads and tag not in IN_HEAD:
            self._end_head()
        if self.heads and tag == "head":
            return
        if tag in BREAK_OUT:
            while self.foreign:
                self._leave()
        if tag == "optgroup" and self._within(("option",), ("select",)):
            self._pop_to(("option",))
        if tag in BLOCK and self._within(("p",), ("table", "td", "th", "caption", "button")):
            self._pop_to(("p",))
        if tag in ENDS:
            ended, stops = ENDS[tag]
            if tag in ("tr", "thead", "tbody", "tfoot") and self._within(("td", "th"), ("tr", "table")):
                self._pop_to(("td", "th"))
            if tag in ("thead", "tbody", "tfoot") and self._within(("tr",), _CELL):
                self._pop_to(("tr",))
            if self._within(ended, stops):
                self._pop_to(ended)
        if tag in ("td", "th") and self.tables and not self._within(("tr",), _CELL):
            self._enter("tr", "")
        self._enter(tag, raw)
        if tag in VOID or raw.endswith("/") and (tag in FOREIGN or len(self.open) > 1 and self.open[-2][3]):
            self._leave()

    def finish(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "body" and self.heads:
            self._end_head()
        elif tag == "p" and not self._within(("p",), ("table",)):
            self.start("p", "")
            self._pop_to(("p",))
        elif self._within((tag,), () if tag in ("table", "body", "html") else ("table",) if tag in ("tr", "td", "th", "tbody", "thead", "tfoot") else ("td", "th", "table")):
            self._pop_to((tag,))

    def _enter(self, tag: str, raw: str) -> None:
        _, above, invisible, around = self.open[-1] if self.open else ("", False, False, "")
        gone, visibility = _shown(raw)
        unseen = above or tag in UNSEEN or gone or bool(around) and tag in NOTES
        invisible = visibility == "hidden" if visibility else invisible
        self.open.append((tag, unseen, invisible, tag if tag in FOREIGN else "" if tag in HTML_AGAIN else around))
        self.heads += tag == "head"
        self.templates += tag == "template"
        if unseen:
            return
        sink = self.sinks[-1]
        if tag == "br":
            sink.end(0, not sink.line and not invisible)
        elif tag == "text" and around == "svg":
            sink.end()
        elif tag in ("td", "th") and self.tables:
            self.sinks.append(Sink())
            return
        elif tag in BLOCK:
            sink.end(1 if tag in APART and not (tag in ("ul", "ol") and self.lists) else 0)
        if tag in ("ul", "ol", "menu", "dir"):
            sink.indent += 2 if tag != "ol" else 3
            first = _attributes(raw).get("start", "") if tag == "ol" and "start" in raw else ""
            self.lists.append([tag, int(first) - 1 if first.isascii() and first.isdigit() and len(first) < 9 else 0])
        elif tag == "li":
            sink.mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                sink.mark = f"{self.lists[-1][1]}. "
        elif tag in ("blockquote", "dd"):
            sink.indent += 2
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.tables.append([[], len(self.sinks)])
        elif tag == "tr" and self.tables:
            self.tables[-1][0].append([])

    def _leave(self) -> None:
        tag, unseen, _, _ = self.open.pop()
        self.heads -= tag == "head"
        self.templates -= tag == "template"
        if unseen:
            return
        if tag in ("td", "th") and self.tables and len(self.sinks) > self.tables[-1][1]:
            lines = self.sinks.pop().done()
            if not self.tables[-1][0]:
                self.tables[-1][0].append([])
            self.tables[-1][0][-1].append(lines)
            return
        sink = self.sinks[-1]
        if (around := self.foreign) and (tag == "text" and around == "svg" or tag == "mtr"):
            sink.end()
        elif around == "math" and self.open[-1][0] in AROUND and not self.open[-1][2]:
            sink.text(" ", False)
        if tag in BLOCK:
            sink.end(1 if tag in APART and not (tag in ("ul", "ol") and len(self.lists) > 1) else 0)
        if tag in ("ul", "ol", "menu", "dir"):
            sink.indent -= 2 if tag != "ol" else 3
            sink.mark = None
            if self.lists:
                self.lists.pop()
        elif tag == "li":
            sink.mark = None
        elif tag in ("blockquote", "dd"):
            sink.indent -= 2
        elif tag == "pre":
            self.pre -= 1
        elif tag == "table" and self.tables:
            rows, _ = self.tables.pop()
            for line in _cells([r for r in rows if r]):
                sink.text(line, True)
                sink.end(0, True)
            sink.end(1)

    def render(self) -> str:
        while self.open:
            self._leave()
        return "\n".join(self.sinks[0].done()).strip("\n")


def render(html: str | None) -> str:
    """All visible text of a page."""
    page, at, n = Page(), 0, len(html or "")
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        page.text(html[at:m.start()])
        at = m.end()
        if m[1]:
            page.finish(m[1].lower())
        elif page.foreign and html.startswith("<![CDATA[", m.start()):
            close = html.find("]]>", m.start() + 9)
            page.text(html[m.start() + 9:close if close >= 0 else n], True)
            at = close + 3 if close >= 0 else n
        elif tag := (m[2] or m[4] or "").lower():
            foreign = page.foreign
            page.start(tag, m[3] or m[5] or "")
            if tag in RAW and not (foreign and (m[3] or m[5] or "").endswith("/")):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                if tag in ("textarea", "xmp"):
                    page.text(html[at:close.start() if close else n])
                at = close.end() if close else n
                page.finish(tag)
    return page.render()


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``text`` of every page."""
    def run(batches):
        for batch in batches:
            texts = [render(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return pages.select(F.col(key).cast("bigint"), F.col(html).cast("string")).mapInArrow(run, f"`{key}` bigint, text string")
