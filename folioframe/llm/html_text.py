"""HTML extraction by rendering: a tree builder, visibility rules and a text layout.

The tree builder works on any input: it closes elements whose end tags HTML lets one leave
out, supplies table rows, ignores stray end tags and never fails. Invisible are what
browsers never show (head, scripts, templates, ...), elements with the ``hidden``
attribute, those that inline styles or plain rules of the page's own style sheets (tag,
class and id selectors) set to ``display: none``, and all of a closed ``details`` but its
summary. Under ``visibility: hidden`` what is set to be visible again shows. Of rules the
last in the cascade counts; rules in at-rules count only if these hold on any screen
(``@media screen`` or ``all``, ``@layer``). A drop-down shows its selected option. What a
user edits, the text of a ``textarea``, is shown if ``form_text`` asks for it.

The layout collapses white space as inline text does, but not in ``pre``; sets blocks on
lines of their own, with a blank line around paragraphs, headings, lists and tables; marks
and indents list items (no further than ``MOST_NESTED`` levels); and pads table cells to the
width of their column, with cells that span columns or rows in their places (tables deeper
than ``MOST_NESTED`` are laid out as blocks). Nothing else of the visible text is left out.

Time and size grow in proportion to the page, whatever its nesting, its unclosed tags and
quotes: nothing recurses, and no tag, block or line is gone through again for each of those
that hold it.

Defined results: a null page gives null; an empty one, or one without visible text, an empty
text; repeated rows give repeated results, and rows of one id with unlike pages are
extracted each by its own page; an empty table gives an empty result. Only the id and HTML
columns are read; others may have any names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names with special parts in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe noembed noframes datalist audio video canvas".split())
HEAD_PARTS = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
UNSEEN_IN = {"svg": frozenset("desc metadata defs symbol clippath".split()), "math": frozenset(("annotation", "annotation-xml"))}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "html body address article aside details dialog dd div dt figcaption footer form header hgroup li main nav section summary caption tr legend center search optgroup option".split()
)
ENDS_P = (BLOCK | frozenset(("hr",))) - frozenset(("tr", "caption", "option", "optgroup", "html", "body", "legend"))
TABLE_PARTS = frozenset("thead tbody tfoot".split())

MOST_NESTED = 20
_MOST_SPAN, _MOST_COLUMNS = 100, 1000  # columns or rows of a cell, columns of a table whose cells may span any

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(f"=[ \t\n\r\f]*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_CSS = re.compile(r"([^{};]*)([{};])")
_SIMPLE = re.compile(r"[a-zA-Z0-9]*[.#]?[\w-]*\Z")
_BLANKS = " \t\n\r\f"
_INLINE = re.compile(f"[^{_BLANKS}]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")


_LI, _LI_WALLS = frozenset(("li",)), frozenset(("ul", "ol", "menu", "td", "th", "table"))


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


class TreeBuilder:
    """Elements of a page, with implied ends and table rows supplied."""

    def __init__(self) -> None:
        self.root = self.top = Node("#root", {}, None)
        self.styles: list[str] = []
        self.open: dict[str, list[int]] = {}  # depths of the open elements by tag
        self.depth = 0

    def _push(self, tag: str, given: dict[str, str]) -> Node:
        node = Node(tag, given, self.top)
        self.top.children.append(node)
        self.top = node
        self.depth += 1
        self.open.setdefault(tag, []).append(self.depth)
        return node

    def _pop(self) -> None:
        if self.depth:
            self.open[self.top.tag].pop()
            self.depth -= 1
            self.top = self.top.parent or self.root

    def _nearest(self, tags: frozenset[str] | set[str]) -> int:
        depth = 0
        for tag in tags:
            at = self.open.get(tag)
            if at and at[-1] > depth:
                depth = at[-1]
        return depth

    def _close(self, tags: frozenset[str] | set[str], within: frozenset[str] | set[str]) -> bool:
        """Closes the nearest open element of ``tags``, if no element of ``within`` is nearer."""
        at = self._nearest(tags)
        if not at or self._nearest(within) > at:
            return False
        while self.depth >= at:
            self._pop()
        return True

    def start(self, tag: str, given: dict[str, str]) -> None:
        if self.top.tag == "head" and tag not in HEAD_PARTS:
            self._pop()
        if tag == "select" and self.open.get("select"):
            self._close({"select"}, frozenset())
            return
        if tag in ENDS_P and self.open.get("p"):
            self._close({"p"}, {"button", "td", "th", "table", "caption"})
        if tag == "li":
            self._close(_LI, _LI_WALLS)
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, {"dl", "td", "th", "table"})
        elif tag in ("option", "optgroup"):
            self._close({"option"}, {"select", "datalist"})
        elif tag in TABLE_PARTS:
            self._close(TABLE_PARTS, {"table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"} | TABLE_PARTS)
            self._close({"caption"}, {"table"})
        elif tag in ("td", "th"):
            if not self._close({"td", "th"}, {"table", "tr"}) and self.top.tag in {"table"} | TABLE_PARTS:
                self._push("tr", {})
        elif tag == "body":
            self._close({"head"}, frozenset())
        elif tag in BLOCK and self.open.get("head"):
            self._close({"head"}, {"body"})
        if tag in VOID:
            self.top.children.append(Node(tag, given, self.top))
        else:
            self._push(tag, given)

    def text(self, raw: str) -> None:
        if self.top.tag == "head" and raw.strip(_BLANKS):
            self._pop()
        self.top.children.append(html.unescape(raw))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not self.open.get("p"):
            self.start("p", {})
            self._pop()
        else:
            walls = frozenset() if tag in TABLE_PARTS | {"table", "body", "html"} else frozenset(("table", "td", "th")) - {tag}
            self._close({tag}, walls)

    def feed(self, page: str) -> Node:
        at, low, last = 0, "", page.rfind(">")
        text_from = 0  # what of the page is not yet in the tree
        while 0 <= (at := page.find("<", at)) < last:
            if page.startswith("<!--", at):
                stop = page.find("-->", at)
                self._text_until(page, text_from, at)
                at = text_from = stop + 3 if stop >= 0 else len(page)
                continue
            if page[at + 1] in "!?":
                self._text_until(page, text_from, at)
                at = text_from = page.find(">", at) + 1
                continue
            m = _TAG.match(page, at)
            if not m:
                at += 1
                continue
            self._text_until(page, text_from, at)
            tag, ending = m[1].lower(), page[at + 1] == "/"
            stop = _tag_end(page, m.end())
            inside = page[m.end() : stop]
            at = text_from = stop + 1
            if ending:
                self.end(tag)
                continue
            self.start(tag, attributes(inside) if inside else {})
            if inside.endswith("/") and tag not in VOID and (self.open.get("svg") or self.open.get("math")):
                self._pop()
                continue
            if tag in RAW or tag in ("title", "textarea"):
                low = low or page.lower()
                stop = low.find(f"</{tag}", at) if len(low) == len(page) else _later(page, tag, at)
                stop = len(page) if stop < 0 else stop
                inner = page[at:stop]
                if tag == "style":
                    self.styles.append(inner)
                self.top.children.append(inner if tag in RAW else html.unescape(inner))
                at = text_from = stop
        if not page.startswith("<!--", max(at, 0)) or at < 0:
            self._text_until(page, text_from, len(page))
        else:  # a comment without an end
            self._text_until(page, text_from, at)
        return self.root

    def _text_until(self, page: str, at: int, stop: int) -> None:
        if at < stop:
            self.text(page[at:stop])


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``; a ``>`` within the quotes of a value is none, if they are closed. There is one later."""
    while True:
        end = page.find(">", at)
        quote = _VALUE.search(page, at, end)
        close = page.find(quote[1], quote.end()) if quote else -1
        if close < 0 or page.find(">", close) < 0:
            return end
        at = close + 1


def _later(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
    return m.start() if m else -1


_ALWAYS = re.compile(r"@media\s*(?:(?:only\s+)?(?:all|screen))?\s*\Z|@layer\b", re.I)


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on any screen; others stand in at-rules and are passed over."""
    stack: list[tuple[str, bool]] = []  # of open blocks: what stands before them, whether they hold
    body: list[str] = []
    for m in _CSS.finditer(sheet + "}"):
        head, mark = m[1].strip(), m[2]
        holds = not stack or stack[-1][1]
        inside = bool(stack) and not stack[-1][0].startswith("@")
        if mark == "{":
            if inside:
                holds = False  # nested rules
            stack.append((head, holds and (not head.startswith("@") or any(_ALWAYS.match(q.strip() if i == 0 else "@media " + q.strip()) for i, q in enumerate(head.split(","))))))
            if not inside:
                body = []
        elif inside and holds:
            body.append(head)
        if mark == "}" and stack:
            name, held = stack.pop()
            if held and not name.startswith("@"):
                yield name, ";".join(body)


Weight = tuple[bool, int, int]  # of a declaration: important, by selector, by order; the greatest counts


def _declarations(body: str) -> Iterator[tuple[str, bool, bool]]:
    """Property, whether it hides, whether it is important."""
    for m in _DECLARED.finditer(body):
        kind, value = m[1].lower(), m[2].lower()
        yield kind, value == "none" if kind == "display" else value in ("hidden", "collapse"), bool(m[3])


def hiding_selectors(styles: list[str]) -> dict[str, dict[str, tuple[Weight, bool]]]:
    """What the style sheets say of display and visibility, by plain selector; empty if they hide nothing."""
    found: dict[str, dict[str, tuple[Weight, bool]]] = {}
    order = 0
    for sheet in styles:
        for names, body in _rules(_QUOTED.sub("''", _COMMENT.sub("", sheet))):
            for name in (x.strip() for x in names.split(",")):
                if name and _SIMPLE.match(name):
                    rank = 100 * ("#" in name) + 10 * ("." in name) + (name[0] not in "#.")
                    for kind, hides, important in _declarations(body):
                        order += 1
                        own = found.setdefault(name, {})
                        own[kind] = max(own.get(kind, ((False, 0, 0), False)), ((important, rank, order), hides))
    return found if any(hides for own in found.values() for _, hides in own.values()) else {}


def visible(node: Node, hiding: dict[str, dict[str, tuple[Weight, bool]]]) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether it is set to be visible (None: as its parent)."""
    given = node.attributes
    if node.tag in HIDDEN or "hidden" in given:
        return False, None
    style = given.get("style", "")
    if not hiding and not style:
        return True, None
    best: dict[str, tuple[Weight, bool]] = {}
    for i, (kind, hides, important) in enumerate(_declarations(style)):
        best[kind] = max(best.get(kind, ((False, 0, 0), False)), ((important, 1000, i), hides))
    if hiding:
        names = ["." + c for c in given.get("class", "").split()] + ["#" + given.get("id", "")]
        for name in (node.tag, *names, *(node.tag + n for n in names)):
            for kind, said in hiding.get(name, {}).items():
                best[kind] = max(best.get(kind, ((False, 0, 0), False)), said)
    return not best.get("display", ((), False))[1], not best["visibility"][1] if "visibility" in best else None


def shown_children(node: Node) -> list[Node | str]:
    if node.tag == "select":
        return shown_options(node)
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


def shown_options(node: Node) -> list[Node | str]:
    """What a select shows: its list, or of a drop-down one the option selected last, else the first."""
    size = node.attributes.get("size", "1")
    if "multiple" in node.attributes or re.fullmatch(r"\d+", size) and int(size) > 1:
        return node.children
    options, stack = [], list(reversed(node.children))
    while stack:
        at = stack.pop()
        if isinstance(at, Node):
            if at.tag == "option":
                options.append(at)
            stack.extend(reversed(at.children))
    return [x for x in options if "selected" in x.attributes][-1:] or options[:1]


class Lines:
    """Collects laid-out text: lines, pending spaces, blank lines and marks of list items."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.blank = False
        self.marks: list[str] = []  # of items that have no line yet
        self.indents: list[str] = []  # by open item

    def text(self, raw: str, keep: bool) -> None:
        if keep:
            first, *rest = raw.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.end(True)
                self._put(line)
            return
        words = _INLINE.findall(raw)
        if raw[:1] in _BLANKS and self.parts:
            self.space = True
        if words:
            self._put(" ".join(words))
            self.space = raw[-1] in _BLANKS

    def _put(self, piece: str) -> None:
        if piece:
            self._blank_line()
            if self.space and self.parts:
                self.parts.append(" ")
            self.space = False
            self.parts.append(piece)

    def _blank_line(self) -> None:
        if self.blank and self.lines and not self.marks:
            self.lines.append("")
        self.blank = False

    def _add(self, line: str) -> None:
        """A line behind the marks that wait for one, or indented as its item is."""
        if self.marks:
            outer = self.indents[-len(self.marks) - 1] if len(self.indents) > len(self.marks) else ""
            line = (outer + "".join(self.marks) + line).rstrip(" " if not line else "")
            self.marks = []
        elif line and self.indents:
            line = self.indents[-1] + line
        self.lines.append(line)

    def end(self, force: bool = False) -> None:
        if self.parts:
            self._add("".join(self.parts))
        elif force and not self.marks:
            self.lines.append("")
        self.parts, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = True

    def item(self, mark: str) -> int:
        """Opens a list item; returns what closes it."""
        self.end()
        self._blank_line()
        self.marks.append(mark)
        outer = self.indents[-1] if self.indents else ""
        self.indents.append(outer + " " * len(mark) if len(self.indents) < MOST_NESTED else outer)
        return len(self.lines)

    def end_item(self, start: int, shown: bool) -> None:
        self.end()
        if self.marks:
            if shown:
                self._add("")
            else:
                self.marks.pop()
        while len(self.lines) > start and not self.lines[-1]:
            self.lines.pop()
        self.indents.pop()
        self.blank = False

    def block(self, lines: list[str]) -> None:
        self.end()
        if lines:
            self._blank_line()
        self.blank = False
        for line in lines:
            self._add(line)

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _span(node: Node, name: str) -> int:
    given = node.attributes.get(name, "1").strip()
    return max(1, min(int(given), _MOST_SPAN)) if re.fullmatch(r"\d{1,9}", given) else 1


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []  # cells: lines, columns and rows that they span

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """Cells by row with their first column and number of columns, past what cells above span."""
        out, taken = [], {}  # taken: column to rows that it is still taken for
        for row in self.rows:
            wide = sum(c for _, c, _ in row) <= _MOST_COLUMNS
            at, cells, new = 0, [], {}
            for lines, columns, rows in row:
                while at in taken:
                    at += 1
                columns = columns if wide else 1
                cells.append((at, columns, lines))
                if rows > 1 and wide and at + columns <= _MOST_COLUMNS:
                    new |= dict.fromkeys(range(at, at + columns), rows)
                at += columns
            out.append(cells)
            taken = {c: n - 1 for c, n in (taken | new).items() if n > 1} if len(taken) + len(new) <= _MOST_SPAN else {}
        return out

    def lines(self) -> list[str]:
        rows = self.placed()
        widths: dict[int, int] = {}
        for row in rows:
            for at, columns, cell in row:
                widths[at] = max(widths.get(at, 0), max(map(len, cell), default=0) if columns == 1 else 0)
        for row in rows:
            for at, columns, cell in row:
                if columns > 1:
                    inside = [c for c in range(at, at + columns) if c in widths]
                    room = sum(widths[c] for c in inside) + 2 * (len(inside) - 1)
                    widths[inside[-1]] += max(0, max(map(len, cell), default=0) - room)
        starts, place = {}, 0
        for c in sorted(widths):
            starts[c] = place
            place += widths[c] + 2
        out = []
        for row in rows:
            for k in range(max((len(cell) for _, _, cell in row), default=0)):
                line = ""
                for at, _, cell in row:
                    if k < len(cell) and cell[k]:
                        line = line.ljust(starts[at]) + cell[k]
                out.append(line.rstrip())
        return out


def render(root: Node, hiding: dict[str, dict[str, tuple[Weight, bool]]], form_text: bool = False) -> str:
    """The visible text of a tree, laid out."""
    out, held = Lines(), []  # held: what encloses the current cell or table
    tables: list[Table] = []
    counters: list[list] = []
    items: list[tuple[Lines, int, bool]] = []
    pre = 0
    drawn: list[str] = []  # open svg and math elements
    stack: list[tuple[Node | str, bool, bool]] = [(root, False, True)]
    while stack:
        node, leaving, shown = stack.pop()
        if isinstance(node, str):
            if shown:
                out.text(node, pre > 0)
            continue
        tag = node.tag
        laid_out = len(tables) <= MOST_NESTED  # as a table; deeper ones are blocks
        if not leaving:
            displayed, set_to = visible(node, hiding)
            if not displayed or drawn and tag in UNSEEN_IN[drawn[-1]] or tag == "textarea" and not form_text:
                continue
            shown = shown if set_to is None else set_to
            if tag == "br":
                out.end(True)
                continue
            if tag in BLOCK or tag == "textarea":
                out.gap() if tag in SPACED and not (tag in ("ul", "ol", "menu") and counters) else out.end()
            if tag in VOID:
                continue
            if tag in UNSEEN_IN:
                drawn.append(tag)
            elif drawn and tag in ("text", "mtr"):
                out.end()
            elif drawn and tag == "mtd":
                out.space = True
            if tag in ("pre", "textarea"):
                pre += 1
            elif tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                counters.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if counters and counters[-1][0] == "ol":
                    mark = f"{counters[-1][1]}. "
                    counters[-1][1] += 1
                items.append((out, out.item(mark), shown))
            elif tag == "table":
                tables.append(Table())
                if laid_out and len(tables) <= MOST_NESTED:
                    held.append(out)
                    out = Lines()
            elif tag == "tr" and tables and laid_out:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                if laid_out:
                    if not tables[-1].rows:
                        tables[-1].rows.append([])
                    held.append(out)
                    out = Lines()
                else:
                    out.end()
            stack.append((node, True, shown))
            stack.extend((c, False, shown) for c in reversed(shown_children(node)))
            continue
        if tag in UNSEEN_IN:
            drawn.pop()
        elif drawn and tag in ("text", "mtr"):
            out.end()
        if tag in ("pre", "textarea"):
            pre -= 1
        elif tag in ("ul", "ol", "menu"):
            counters.pop()
        elif tag == "li":
            of, start, any_shown = items.pop()
            of.end_item(start, any_shown)
        elif tag in ("td", "th") and tables and laid_out:
            inner = out.result()
            out = held.pop()
            tables[-1].rows[-1].append((inner.split("\n"), _span(node, "colspan"), _span(node, "rowspan")))
        elif tag == "table":
            table = tables.pop()
            if laid_out:
                loose = out.result()  # text in a table but in no cell stands before it
                out = held.pop()
                out.block([*(loose.split("\n") if loose else []), *table.lines()])
        if tag in BLOCK or tag == "textarea":
            out.gap() if tag in SPACED and not (tag in ("ul", "ol", "menu") and counters) else out.end()
    return out.result()


def extract_text(page: str | None, form_text: bool = False) -> str | None:
    if page is None:
        return None
    builder = TreeBuilder()
    root = builder.feed(page)
    return render(root, hiding_selectors(builder.styles), form_text)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", form_text: bool = False) -> DataFrame:
    """``page_id, text, n_chars``: each page's visible text, with that of text areas if ``form_text``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [extract_text(p, form_text) for p in part.column(1).to_pylist()]
                sizes = [None if t is None else len(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "text", "n_chars"])

    frame = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return frame.mapInArrow(emit, "page_id long, text string, n_chars long")
