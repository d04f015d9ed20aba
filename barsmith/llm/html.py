"""Layout-aware text of web pages.

Method. A tokenizer feeds a tree builder that keeps the stack of open elements, closes elements whose end tags may be left
out (p, li, dt, dd, tr, td, option ...) and matches end tags to open elements. Entering and leaving elements drives a
renderer: hidden elements (by name, by an attribute named hidden or by their style) and their children give nothing, but for
children set visible in what is only invisible; of svg
only text elements show, blocks start on new lines, paragraphs and headings stand between
blank lines, list items get marks (numbers go by start and value) and indents, pre keeps its white space, and table cells are padded
to columns by display width, spanned ones left empty. Columns are padded to WIDEST at most, and a table that would take more blanks
than four times the page (and 100,000) has its cells one after another instead, so a page's text stays in proportion to it.
A closed dialog is hidden; the content of details is shown, open or not.

Cases. Null or empty html: empty text. Anything unclosed ends with the page; a stray < is text. Depth is not limited and
nothing recurses. Repeated rows give repeated results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from unicodedata import combining

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import map_texts, texts_of

# Element names of HTML by their part in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object embed noembed noframes audio video canvas datalist annotation annotation-xml".split())
SVG_HIDDEN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html legend li main menu nav option section summary tbody tfoot thead tr".split())
CLOSES_P = BLOCK - frozenset("option caption tbody tfoot thead tr".split())
CLOSED_BY = {  # start tag: (open elements that it ends, elements that stop the search)
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "body": ("head", "html"),
}
CLOSED_BY = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSED_BY.items()}
SCOPE = frozenset("table td th caption button object".split())
UNSCOPED = frozenset("table tr tbody thead tfoot body html".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
HINT = re.compile("hidden|style|display|visibility", re.I)
NO_DECLARATION = re.compile(r"""/\*.*?\*/|"[^"]*"|'[^']*'|\([^)]*\)""", re.S)
WIDE = re.compile("[\u1100-\u115f\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6\U0001f300-\U0001faff\U00020000-\U0003fffd]")
COLUMNS, ROWS, WIDEST, DEEPEST = 1000, 1000, 60, 40  # spans; the widest padded column; the deepest indent
BLANKS = re.compile(r"[ \t\n\r\f]+")


def parsed(attributes: str) -> dict[str, str]:
    """Values by name in lower case, empty where there is none; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values))
    return found


def visibility(attributes: str, svg: bool) -> tuple[bool, bool | None]:
    """Whether an attribute named hidden or a display hides an element with all it holds; whether it is set visible, None if not said.

    A display in the style outweighs the attribute hidden; in svg both properties may be attributes too. Visibility is inherited, so
    what is invisible may hold visible elements.
    """
    if not HINT.search(attributes):
        return False, None
    found = parsed(attributes)
    said = {k: found.get(k, "").strip().lower() if svg else "" for k in ("display", "visibility")}
    forced: set[str] = set()
    for part in NO_DECLARATION.sub(" ", entities.unescape(found.get("style", ""))).lower().split(";"):
        name, _, value = part.partition(":")
        value, strong = value.replace("!important", "").strip(), "!important" in value
        if (name := name.strip()) in said and value and (strong or name not in forced):
            said[name] = value
            forced |= {name} if strong else set()
    seen = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(said["visibility"])
    return said["display"] == "none" or "hidden" in found and not said["display"], seen


class Table:
    """Rows of cells; a cell has its lines, the columns and the rows that it spans, and lists are filled as it ends."""

    def __init__(self, outer: Buffer) -> None:
        self.outer, self.before = outer, []
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def grid(self) -> list[list[list[str]]]:
        """Rows of the lines of each column; spanned places are empty. Spans end at column COLUMNS."""
        held: dict[int, int] = {}  # rows still to leave empty by column
        out = []
        for row in self.rows:
            line: list[list[str]] = []

            def skip(line: list = line) -> None:
                while held.get(len(line)):
                    held[len(line)] -= 1
                    line.append([])

            for lines, columns, rows in row:
                skip()
                columns = max(1, min(columns, COLUMNS - len(line)))
                if rows > 1 and len(line) < COLUMNS:
                    held |= dict.fromkeys(range(len(line), len(line) + columns), rows - 1)
                line += [lines] + [[]] * (columns - 1)
            skip()
            out.append(line)
        return out

    def text(self, most: int) -> str:
        """Rows with cells padded to the widest of their column; cells one after another where that takes over `most` blanks."""
        rows, widths = self.grid(), []
        spanning = {id(lines) for row in self.rows for lines, columns, _ in row if columns > 1}
        for row in rows:
            widths += [0] * (len(row) - len(widths))
            for i, lines in enumerate(row):
                if lines and id(lines) not in spanning:
                    widths[i] = min(WIDEST, max([widths[i], *map(width, lines)]))
        upto = [0]
        for n in widths:
            upto.append(upto[-1] + n + 2)
        blanks = sum(upto[max((i for i, c in enumerate(row) if c), default=0)] * max(map(len, row), default=0) for row in rows)
        out = []
        for row in rows:
            if blanks > most:
                out += [x for lines in row for x in lines]
                continue
            for k in range(max(map(len, row), default=0)):
                cells = [(lines[k] if k < len(lines) else "") for lines in row]
                out.append("  ".join(c + " " * (n - width(c)) for c, n in zip(cells, widths)).rstrip())
        return "\n".join([*self.before, *out])


def width(text: str) -> int:
    """Columns that a line takes: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return len(text) + len(WIDE.findall(text)) - sum(map(bool, map(combining, text)))


def number(value: str | None, least: int, most: int) -> int | None:
    found = re.match(r"\s*([+-]?[0-9]{1,9})", value or "")
    return min(most, max(least, int(found[1]))) if found else None


class Buffer:
    """Lines of text with collapsed white space. breaks: line ends due before the next word, 2 for a blank line."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.blank, self.mark = 0, False, ""

    def gap(self, n: int) -> None:
        self.breaks, self.blank = max(self.breaks, n), False

    def line_end(self, indent: str) -> None:
        if self.parts or self.mark:
            self.parts.append(self._due(indent) + "\n" if self.mark or self.breaks else "\n")
        self.breaks, self.blank = 0, False
        self.fresh = True

    fresh = True

    def _due(self, indent: str) -> str:
        out = ("\n" * self.breaks if self.parts else "") + (self.mark if self.mark else indent if self.breaks or self.fresh or not self.parts else "")
        self.breaks, self.mark, self.fresh = 0, "", False
        return out

    def words(self, text: str, indent: str) -> None:
        flat = BLANKS.sub(" ", text)
        if flat in ("", " "):
            self.blank = self.blank or bool(flat)
            return
        due = self.breaks or self.mark or self.fresh or not self.parts
        before = self._due(indent) if due else " " if self.blank or flat[0] == " " else ""
        self.parts.append(before + flat.strip(" "))
        self.blank = flat[-1] == " "

    def exact(self, text: str, indent: str) -> None:
        if text:
            self.parts.append((self._due(indent) if self.breaks or self.mark else "") + text.replace("\r\n", "\n"))
            self.fresh = self.blank = False

    def text(self) -> str:
        return "\n".join(x.rstrip() for x in "".join(self.parts).split("\n")).strip("\n")


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self, size: int = 0) -> None:
        self.padding = 4 * size + 100_000  # blanks that may still go into tables
        self.open: list[tuple[str, bool, bool, bool]] = []  # (name, whether it hides, whether it is visible, whether it was entered)
        self.at: dict[str, list[int]] = {}  # places of open elements by name, so that none is looked for by walking the stack
        self.hidden, self.pre = 0, 0
        self.lists: list[int | None] = []  # the number of the last item; None without numbers
        self.buffer = Buffer()
        self.tables: list[Table] = []

    def indent(self) -> str:
        return "  " * min(DEEPEST, len(self.lists))

    def start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and self.at.get("p"):
            self.end("p")
        if name in CLOSED_BY:
            ends, stops = CLOSED_BY[name]
            self.close_implied(ends, stops)
        svg = bool(self.at.get("svg"))
        if svg and name in LEAVES_SVG and not self.at.get("foreignobject"):
            self.end("svg")
            svg = False
        hides, seen = visibility(attributes, svg or name == "svg") if attributes else (False, None)
        hides = hides or name in HIDDEN or svg and name in SVG_HIDDEN or name == "input" or name == "dialog" and "open" not in parsed(attributes)
        visible = self.visible() if seen is None else seen
        if name in VOID:
            if not self.hidden and not hides and visible:
                if name == "br":
                    self.buffer.line_end(self.indent())
                elif name == "hr":
                    self.buffer.gap(2)
            return
        if attributes.endswith("/") and (svg and not self.at.get("foreignobject") or self.at.get("math") or name in ("svg", "math")):
            return  # only elements of svg and math close themselves
        self.hidden += hides
        enters = not self.hidden and visible
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, hides, visible, enters))
        if enters:
            self.enter(name, attributes)

    def visible(self) -> bool:
        return not self.open or self.open[-1][2]

    def last(self, names: frozenset) -> int:
        """The place of the innermost open element with one of the names, -1 if there is none."""
        return max((places[-1] for x in names if (places := self.at.get(x))), default=-1)

    def close_implied(self, ends: frozenset, stops: frozenset) -> None:
        while (i := self.last(ends)) > self.last(stops):
            self.pop_to(i)

    def end(self, name: str) -> None:
        places = self.at.get(name)
        if places and (name in UNSCOPED or places[-1] >= self.last(SCOPE)):
            self.pop_to(places[-1])

    def pop_to(self, i: int) -> None:
        while len(self.open) > i:
            name, hides, _, entered = self.open.pop()
            self.at[name].pop()
            if entered:
                self.leave(name)
            self.hidden -= hides

    def enter(self, name: str, attributes: str) -> None:
        b = self.buffer
        if name == "table":
            b.gap(2)
            self.tables.append(Table(b))
            self.buffer = Buffer()
        elif name == "tr" and self.tables:
            self.spill()
            self.tables[-1].rows.append([])
        elif name in ("td", "th") and self.tables:
            self.spill()
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            said = parsed(attributes) if "span" in attributes.lower() else {}
            self.tables[-1].rows[-1].append(([], number(said.get("colspan"), 1, COLUMNS) or 1, number(said.get("rowspan"), 1, ROWS) or 1))
        elif name in BLOCK:
            b.gap(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)
            if name in ("ul", "ol", "menu"):
                first = number(parsed(attributes).get("start"), -(10**9), 10**9) if name == "ol" and attributes else None
                self.lists.append((1 if first is None else first) - 1 if name == "ol" else None)
            elif name == "li":
                if self.lists and self.lists[-1] is not None and attributes and (own := number(parsed(attributes).get("value"), -(10**9), 10**9)) is not None:
                    self.lists[-1] = own - 1
                if self.lists and self.lists[-1] is not None:
                    self.lists[-1] += 1
                mark = f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "- "
                b.mark = "  " * min(DEEPEST, max(0, len(self.lists) - 1)) + mark
            elif name == "pre":
                self.pre += 1
            elif name == "blockquote":
                self.lists.append(None)
        elif name == "mtr":
            b.gap(1)
        elif name == "mtd" or name == "text" and self.at.get("svg"):
            b.blank = True

    def spill(self) -> None:
        """Text of a table that stands outside its cells goes before the table, as browsers put it."""
        if text := self.buffer.text():
            self.tables[-1].before.append(text)
        self.buffer = Buffer()

    def leave(self, name: str) -> None:
        if name in ("td", "th") and self.tables and self.tables[-1].rows and self.tables[-1].rows[-1]:
            self.tables[-1].rows[-1][-1][0].extend(self.buffer.text().split("\n"))
            self.buffer = Buffer()
        elif name == "table" and self.tables:
            self.spill()
            table = self.tables.pop()
            self.buffer = table.outer
            text = table.text(self.padding)
            self.padding -= max(0, len(text) - sum(len(x) for row in table.rows for lines, _, _ in row for x in lines))
            self.buffer.exact(text, "")
            self.buffer.gap(2)
        elif name in BLOCK:
            if name in ("ul", "ol", "menu", "blockquote") and self.lists:
                self.lists.pop()
            elif name == "li":
                self.buffer.mark = ""
            elif name == "pre":
                self.pre = max(0, self.pre - 1)
            self.buffer.gap(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)

    def text(self, text: str) -> None:
        if self.hidden or not text or not self.visible():
            return
        if self.at.get("svg") and not (self.at.get("text") or self.at.get("foreignobject")):
            return  # svg draws only what stands in its text elements
        if "&" in text:
            text = entities.unescape(text)
        if self.pre:
            self.buffer.exact(text, self.indent())
        else:
            self.buffer.words(text, self.indent())


def render(page: str) -> str:
    """All visible text of a page."""
    if "\x00" in page:
        page = page.replace("\x00", "�")
    p, at, n = Page(len(page)), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            p.text(page[at:])
            break
        if lt > at:
            p.text(page[at:lt])
        name = NAME.match(page, lt)
        if not name:
            mark = page[lt + 1 : lt + 2]
            if mark in ("!", "?", "/") and mark:
                close = "-->" if page.startswith("<!--", lt) else ">"
                end = page.find(close, lt + (4 if close == "-->" else 1))
                at = n if end < 0 else end + len(close)
            else:
                p.text("<")
                at = lt + 1
            continue
        end = page.find(">", name.end())
        if end < 0:
            break
        attributes = page[name.end() : end]
        if '"' in attributes or "'" in attributes:
            whole = ATTRIBUTES.match(page, name.end())
            if whole:
                end = whole.end() - 1
                attributes = page[name.end() : end]
        at, tag = end + 1, name[1].lower()
        if page[lt + 1] == "/":
            if tag == "br":
                p.start("br", "")
            else:
                p.end(tag)
            continue
        p.start(tag, attributes)
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag == "textarea":
                p.text(page[at : stop.start() if stop else n])
            at = stop.start() if stop else n
    p.pop_to(0)
    return p.buffer.text()


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines for each row of pages (page_id, html)."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(x) for x in texts_of(batch.column("html"))]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return map_texts(narrow, of_batch, "page_id long, text string, n_chars long, n_lines long")
