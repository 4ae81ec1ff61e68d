"""Visible text of HTML pages, laid out as a browser would show it.

A small tree builder adds the tags that pages leave out; visibility rules drop what is not shown;
a renderer emits all other text: blocks on lines of their own with space between, lists with marks
and indents, table cells padded to aligned columns. Hidden is what the ``hidden`` attribute, inline
styles and the rules of the page's own ``style`` elements hide, as far as their selectors are a name,
classes, ids or a name with some of these; of several fitting rules the weightiest counts.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import small_batches

#: Names of elements by how they nest and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style title template noembed noframes iframe object audio video canvas datalist area base link meta param source track col colgroup rp desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr caption tbody thead tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr".split())
CLOSES_P = BLOCK - frozenset("html body li dd dt caption tr tbody thead tfoot legend summary figcaption".split())
#: An opening tag ends open elements of these names, not looking beyond the given bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag doesn't look for its element beyond these; those of tables and list items have bounds of their own.
FENCE = frozenset("table td th caption".split())
FENCES = {"table": frozenset(), "li": FENCE | {"ul", "ol", "menu", "dir"}} | dict.fromkeys(("tr", "tbody", "thead", "tfoot", "td", "th", "caption"), frozenset({"table"}))
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template".split())
#: Blanks of HTML, and an attribute as its tokenizer reads it: quotes open a value only behind ``=``; elsewhere they are characters of names and values.
WS = r"[ \t\n\r\f]"
VALUE = rf"(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f\"'>][^ \t\n\r\f>]*+))"
NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
ATTRIBUTE = re.compile(rf"({NAME})(?:{WS}*+={WS}*+{VALUE}?+)?+")
ATTRIBUTES = re.sub(r"\((?=\[|" + re.escape(NAME) + r"\))", "(?:", rf"(?:[ \t\n\r\f/]++|{NAME}(?:{WS}*+={WS}*+{VALUE}?+)?+)*+")
#: A comment (``<!-->`` and ``<!--->`` are whole ones), what is read as one, or a tag.
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:!|\?|/[^a-zA-Z>])[^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)({ATTRIBUTES})(?:>|\Z)", re.S)
DISPLAY = re.compile(r"(?:^|[;{\s])display\s*:\s*([a-z-]+)([^;]*)", re.I)
SEEN = re.compile(r"(?:^|[;{\s])visibility\s*:\s*(hidden|collapse|visible)([^;]*)", re.I)
SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9]*|\*)?((?:[.#][A-Za-z0-9_-]+)*)")
PARTS = re.compile(r"([.#])([A-Za-z0-9_-]+)")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Rules of these blocks hold on a screen: ``@media`` without a condition but the kind of medium.
SCREEN = re.compile(r"\s*(?:only\s+)?(?:all|screen)\s*", re.I)
#: HTML's white space; other blanks, as the non-breaking one, are text.
BLANK = " \t\n\r\f"
BLANKS = re.compile(f"[{BLANK}]+")
NUMBER = re.compile(rf"[{BLANK}]*([+-]?[0-9]{{1,9}})(?![0-9])")
#: Lists and tables nested deeper than this are laid out as plain blocks: their text stays, without marks and columns.
NESTED = 64


def number(value: str | None, default: int) -> int:
    """The whole number that an attribute begins with; numbers of more than nine digits are none."""
    m = NUMBER.match(value or "")
    return int(m[1]) if m else default


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def hidden(self, rules: Rules = ()) -> bool:
        """Whether the element and all in it take no place: by its style, else by the page's rules, else by its attributes."""
        if self.tag in HIDDEN:
            return True
        said = self.styled(DISPLAY) if self.attrs else None
        if rules and (said is None or any(r.important for r in rules)):
            said = self.ruled(rules, 0, said)
        if said is not None:
            return said == "none"
        if not self.attrs:
            return self.tag == "dialog"
        return self.attribute("hidden") is not None or (self.tag == "dialog" and self.attribute("open") is None)

    def seen(self, rules: Rules, inherited: bool) -> bool:
        """Whether the element's own text is visible, given whether its parent's is."""
        said = self.styled(SEEN) if self.attrs else None
        if rules and (said is None or any(r.important for r in rules)):
            said = self.ruled(rules, 1, said)
        return inherited if said is None else said == "visible"

    def styled(self, what: re.Pattern) -> str | None:
        """What the element's own style says last."""
        found = [m[1].lower() for m in what.finditer(self.attribute("style") or "")]
        return found[-1] if found else None

    def ruled(self, rules: Rules, which: int, own: str | None) -> str | None:
        """What the weightiest fitting rule says: 0 for display, 1 for visibility. The element's own style stands between plain and important ones."""
        out, classes, id = own, None, None
        for r in rules:
            if r.says[which] is None or (r.tag and r.tag != self.tag) or (own is not None and not r.important):
                continue
            if r.marks:
                if classes is None:
                    classes, id = (self.attribute("class") or "").split(), self.attribute("id")
                if not all(name in classes if mark == "." else name == id for mark, name in r.marks):
                    continue
            out = r.says[which]
        return out


@dataclass(frozen=True)
class Rule:
    """A selector's name, classes and ids, and what it says of display and visibility."""

    important: bool
    weight: tuple[int, int, int]
    tag: str
    marks: tuple[tuple[str, str], ...]
    says: tuple[str | None, str | None]


Rules = list[Rule] | tuple[()]


def style_rules(css: str) -> Rules:
    """Rules of simple selectors that hide or show elements on a screen, the weightiest last.

    Blocks of other ``@`` rules than ``@media`` for all or for screens, and of media with conditions, are left out.
    """
    out: list[Rule] = []
    css = COMMENT.sub(" ", css)
    at, open_media = 0, 0
    while at < len(css):
        brace = css.find("{", at)
        close = css.find("}", at)
        if open_media and 0 <= close and (close < brace or brace < 0):
            open_media, at = open_media - 1, close + 1
            continue
        if brace < 0:
            break
        head = css[at:brace].rpartition(";")[2].strip()
        if head.startswith("@"):
            name, _, query = head.partition(" ")
            if name.lower() == "@media" and any(SCREEN.fullmatch(q) for q in query.split(",")):
                open_media, at = open_media + 1, brace + 1
                continue
            depth, at = 1, brace + 1
            while depth and at < len(css):  # to the end of the block
                nearest = [i for i in (css.find("{", at), css.find("}", at)) if i >= 0]
                if not nearest:
                    return sorted(out, key=lambda r: (r.important, r.weight))
                at = min(nearest) + 1
                depth += 1 if css[at - 1] == "{" else -1
            continue
        end = close if close > brace else len(css)
        body, at = css[brace + 1 : end], end + 1
        for which, pattern in enumerate((DISPLAY, SEEN)):
            for m in pattern.finditer(body):
                says = (m[1].lower(), None) if which == 0 else (None, m[1].lower())
                for selector in head.split(","):
                    found = SELECTOR.fullmatch(selector.strip())
                    if found and found[0]:
                        marks = tuple(PARTS.findall(found[2]))
                        tag = "" if found[1] in (None, "*") else found[1].lower()
                        weight = (sum(k == "#" for k, _ in marks), sum(k == "." for k, _ in marks), int(tag != ""))
                        out.append(Rule("!important" in m[2].replace(" ", "").lower(), weight, tag, marks, says))
    return sorted(out, key=lambda r: (r.important, r.weight))


def tree(page: str) -> tuple[Node, int, Rules]:
    """The elements of a page, with the tags added that it leaves out; how deep they nest; its style rules."""
    root = Node("html")
    open_nodes, deepest, css = [root], 1, []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name, outermost first

    def end_from(cut: int) -> None:
        for n in open_nodes[cut:]:
            places[n.tag].pop()
        del open_nodes[cut:]

    def close(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str], innermost: bool = False) -> None:
        """End every open element from the outermost of ``names`` within ``bounds`` on, or from the innermost."""
        fence = max((places[b][-1] for b in bounds if places[b]), default=0)
        found = [p[-1] if innermost else p[bisect_right(p, fence)] for n in names if (p := places[n]) and p[-1] > fence]
        if found:
            end_from(max(found) if innermost else min(found))

    def start(tag: str, attrs: str = "", leaf: bool = False) -> Node:
        nonlocal deepest
        node = Node(tag, attrs)
        open_nodes[-1].children.append(node)
        if not leaf:
            places[tag].append(len(open_nodes))
            open_nodes.append(node)
            deepest = max(deepest, len(open_nodes))
        return node

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if open_nodes[-1].tag == "head" and not text.isspace():
                end_from(len(open_nodes) - 1)
            open_nodes[-1].children.append(unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places["p"]:
                start("p", leaf=True)  # an end tag alone makes an empty paragraph
            elif tag not in ("html", "body"):
                close({tag}, FENCES.get(tag, FENCE), innermost=True)
            continue
        if tag == "html":
            continue
        if tag not in HEAD_ONLY and tag != "head" and open_nodes[-1].tag == "head":
            end_from(len(open_nodes) - 1)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in CLOSES_P:
            close({"p"}, FENCE)
        if tag in ("td", "th") and open_nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
            start("tr")
        if tag in RAW:
            node = start(tag, m[3], leaf=True)
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at) if tag != "plaintext" else None
            body = page[at : end.start() if end else len(page)]
            node.children.append(unescape(body) if tag == "textarea" else body)
            if tag == "style":
                css.append(body)
            at = end.start() if end else len(page)
            if end and (stop := page.find(">", at)) >= 0:
                at = stop + 1
            continue
        start(tag, m[3], leaf=tag in VOID)
    return root, deepest, style_rules("\n".join(css))


class _Lines:
    """Text being laid out: words flow into a line, blocks break it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.space = False
        self.mark = ""

    def put(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self._add(first)
            for r in rest:
                self.lines.append("".join(self.line))
                self.line = []
                self._add(r)
            return
        words = BLANKS.sub(" ", text).strip(" ")
        if not words:
            self.space = self.space or bool(text)
            return
        lead = (self.space or text[0] in BLANK) and self.line
        self._add((" " if lead else "") + words)
        self.space = text[-1] in BLANK

    def _add(self, text: str) -> None:
        if text:
            if not self.line:
                if self.gap and self.lines and self.lines[-1]:
                    self.lines.append("")
                self.gap = False
                text, self.mark = self.mark + text, ""
            self.line.append(text)

    def end(self, spaced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = self.gap or spaced


@dataclass(frozen=True)
class Place:
    """Where a node stands: inside preformatted text, its text visible, in how many lists and tables."""

    rules: Rules = ()
    pre: bool = False
    seen: bool = True
    depth: int = 0


def _lay_out(node: Node, out: _Lines, at: Place) -> None:
    for child in node.children:
        if isinstance(child, str):
            if at.seen:
                out.put(child, at.pre)
            continue
        tag = child.tag
        if child.hidden(at.rules):
            continue
        here = at if (seen := child.seen(at.rules, at.seen)) == at.seen else replace(at, seen=seen)
        nested = here.depth < NESTED
        if tag == "br":
            if out.line:
                out.end()
            else:
                out.lines.append("")
        elif tag == "table" and nested:
            out.end(True)
            _block(_table(child, replace(here, depth=here.depth + 1)), out)
            out.end(True)
        elif tag in ("ul", "ol", "menu", "dir") and nested:
            out.end(tag not in ("menu",))
            _list(child, out, replace(here, depth=here.depth + 1))
            out.end(True)
        elif tag in BLOCK or tag == "option":
            spaced = tag in SPACED
            out.end(spaced)
            _lay_out(child, out, replace(here, pre=True) if tag == "pre" else here)
            out.end(spaced)
        elif tag in ("textarea", "xmp", "plaintext"):
            if here.seen:
                out.put("".join(c for c in child.children if isinstance(c, str)), True)
        elif tag == "input":
            if here.seen and (child.attribute("type") or "").lower() in ("button", "submit", "reset"):
                out.put(child.attribute("value") or "", False)
        elif tag in ("td", "th"):
            out.space = True
            _lay_out(child, out, here)
            out.space = True
        else:
            _lay_out(child, out, here)


def _block(lines: list[str], out: _Lines, first: str = "", indent: str = "") -> None:
    for i, line in enumerate(lines):
        out._add((first if i == 0 else indent if line else "") + line)
        if not line:
            out.lines.append("")
        out.end()


def _list(node: Node, out: _Lines, at: Place) -> None:
    n = number(node.attribute("start"), 1)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            wrapped = Node("div")
            wrapped.children = [child]
            _lay_out(wrapped, out, at)
        elif not child.hidden(at.rules):
            n = number(child.attribute("value"), n) if child.attrs else n
            seen = child.seen(at.rules, at.seen)
            lines = _inside(child, replace(at, seen=seen))
            mark = f"{n}. " if node.tag == "ol" else "- "
            n += 1
            out.end()
            if lines or seen:
                _block(lines or [""], out, mark if seen else " " * len(mark), " " * len(mark))


def _inside(node: Node, at: Place) -> list[str]:
    """The lines of a node's contents, laid out by themselves."""
    part = _Lines()
    _lay_out(node, part, at)
    part.end()
    lines = part.lines
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return lines


def _span(cell: Node, name: str = "colspan") -> int:
    return max(1, min(number(cell.attribute(name), 1), 1000)) if cell.attrs and cell.tag in ("td", "th") else 1


def _stray(text: str, at: Place) -> list[str]:
    """Text of a table outside its cells, as a line if there is any."""
    line = BLANKS.sub(" ", text).strip(" ")
    return [line] if line and at.seen else []


def _table(node: Node, at: Place) -> list[str]:
    """Lines of a table: captions and stray contents first, then rows with aligned cells."""
    before, rows = [], []
    held: dict[int, int] = {}  # rows below that cells above take of a column

    def walk(part: Node, at: Place) -> None:
        for child in part.children:
            if isinstance(child, str):
                before.extend(_stray(child, at))
                continue
            if child.hidden(at.rules):
                continue
            here = replace(at, seen=child.seen(at.rules, at.seen))
            if child.tag in ("tbody", "thead", "tfoot"):
                held.clear()  # cells end with their part of the table
                walk(child, here)
                held.clear()
            elif child.tag == "tr":
                cells, taken, column = [], {c for c, n in held.items() if n}, 0
                for c in taken:
                    held[c] -= 1
                for cell in child.children:
                    if isinstance(cell, str):
                        before.extend(_stray(cell, here))
                    elif not cell.hidden(at.rules):
                        while column in taken:
                            column += 1
                        cells.append((_inside(cell, replace(here, seen=cell.seen(at.rules, here.seen))), column, _span(cell)))
                        if (deep := _span(cell, "rowspan")) > 1:
                            held.update((c, deep - 1) for c in range(column, column + _span(cell)))
                        column += _span(cell)
                rows.append(cells)
            else:
                before.extend(_inside(child, here))

    walk(node, at)
    widths: dict[int, int] = {}  # of columns with cells of their own; others take no place
    for cells in rows:
        for lines, column, span in cells:
            if span == 1:
                widths[column] = max(widths.get(column, 0), *map(len, lines), 0)
    columns = sorted(widths)
    starts = [0]
    for c in columns:
        starts.append(starts[-1] + widths[c] + 2)
    out = list(before)
    for cells in rows:
        for i in range(max([len(lines) for lines, *_ in cells], default=0)):
            line = ""
            for lines, column, _ in cells:
                if i < len(lines) and lines[i]:
                    start = starts[bisect_left(columns, column)]
                    line = (line.ljust(start) if len(line) + 2 <= start or not line else line + "  ") + lines[i]
            out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str:
    """All visible text of a page; empty for a null page."""
    root, deepest, rules = tree((page or "").replace("\r\n", "\n").replace("\0", ""))
    # The layout calls itself for each level of nesting; such calls use no C stack
    if sys.getrecursionlimit() < (needed := 4 * deepest + 1000):
        sys.setrecursionlimit(needed)
    return "\n".join(_inside(root, Place(rules)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text, n_chars`` of every whole page, one row per input row.

    Null, empty and invisible pages give an empty text. Text that is no HTML is shown as it is.
    Elements may nest to any depth; attributes that are no numbers count as left out. Repeated rows
    each give their row; other columns are not read, whatever their names; an empty table gives an
    empty result.
    """
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(work, "page_id long, text string, n_chars long")
