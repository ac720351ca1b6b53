"""HTML extraction by layout-aware rendering.

A tolerant tree builder (implied end tags, void and raw-text elements, unclosed and misnested tags) gives the tree of a
page; what its visibility rules hide is left out, be they attributes or style sheets of the page; the rest is laid out as
text: blocks stand on lines of their own with blank lines where margins are, lists keep bullets, numbers and nesting, and
table cells stand in aligned columns, over several of them or several rows where they span these.

Of style sheets, rules of display and visibility count whose selectors are an element, classes and ids, joined (``p.x#y``); of
at-rules, the content of ``@media`` for all or for screens. Of equal properties the more important, more specific, later one wins.
Pages are rendered where they lie, one at a time; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from albumetry.llm.tables import text_batches

DEEPEST = 512  # elements nested deeper become siblings, as in browsers
MOST_COLUMNS = 1000  # that a cell may span, by the HTML standard
WIDEST = 60  # lines of cells before the last one of a row are folded at spaces to this width

# Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style title template noscript noembed noframes iframe object video audio canvas datalist "
    "meta link base param source track area map rp dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul xmp".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote figure table hr fieldset xmp".split())
LISTS = frozenset("ul ol menu dir".split())
ENDS_P = BLOCK - frozenset("body html li dd dt tbody td tfoot th thead tr option optgroup legend".split())
BOXES = frozenset("select button ruby".split())
INNER = frozenset("tr td th tbody thead tfoot caption".split())
CELLS = frozenset(("td", "th"))
FOREIGN = frozenset(("svg", "math"))
ABOUT = frozenset("metadata desc annotation annotation-xml".split())  # describe a drawing or a formula, unseen there
# start tag -> (elements that it ends, elements beyond which it does not look)
ENDS = {
    "li": ({"li"}, LISTS | {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "rp": ({"rp", "rt"}, {"ruby"}),
    "rt": ({"rp", "rt"}, {"ruby"}),
}

# A quote opens a value directly after "=" only, and only if it is closed somewhere; elsewhere it is a plain character.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|=\s*+[^\s"'>][^\s>]*+|[^>])*+)>""")
SHORT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s>/=]++)(?:\s*+=\s*+(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>][^\s>]*+)))?""")
DECLARED = re.compile(r"(?:^|;)\s*+(display|visibility)\s*+:\s*+([a-zA-Z-]+)\s*+(!\s*+important)?", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
AT_RULE = re.compile(r"@([^{};]*)(?:;|\{((?:[^{}]*\{[^{}]*\})*[^{}]*)\})")
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def tree(page: str) -> Element:
    """Element tree of a page: tags and strings, never failing."""
    root = Element("#root", {})
    stack = [root]
    at, end = 0, len(page)
    syntax = TAG

    def put(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text))

    def close(names: set, beyond: frozenset | set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in beyond:
                return

    def end_row_content() -> None:
        """A cell ends all that is open in its row; what is hidden as a whole keeps its cells."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "tr":
                del stack[k + 1:]
                return
            if stack[k].tag == "table" or stack[k].tag in HIDDEN:
                return

    def foreign() -> bool:
        return next((e.tag in FOREIGN for e in reversed(stack) if e.tag in FOREIGN or e.tag == "foreignobject"), False)

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            put(page[at:])
            break
        put(page[at:mark])
        follow = page[mark + 1: mark + 2]
        if follow in ("!", "?") and follow:
            if page.startswith("<!--", mark):
                stop = page.find("-->", mark + 4)
                at = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", mark)
                at = end if stop < 0 else stop + 1
            continue
        found = syntax.match(page, mark)
        if found is None and syntax is TAG:
            # quotes pair up beyond the last tag's end: from here on a tag ends at its first ">"
            syntax = SHORT_TAG
            found = syntax.match(page, mark)
        if found is None:
            if follow.isascii() and (follow.isalpha() or (follow == "/" and page[mark + 2: mark + 3].isalpha())):
                break  # the page ends within a tag
            put("<")
            at = mark + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            if tag in INNER:
                close({tag}, {"table"} - {tag})
            elif tag not in VOID:
                # the end of an inline element does not end a block within it
                close({tag}, set() if tag in ("table", "body", "html") else {"table"} if tag in BLOCK or tag in BOXES else BLOCK)
            continue
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "li", "button", "caption"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in CELLS:
            end_row_content()
        one = Element(tag, _attributes(found[3]) if found[3] else {})
        stack[-1].children.append(one)
        if tag in VOID:
            continue
        if tag in ABOUT and foreign():
            one.attrs["hidden"] = ""
        if found[3].endswith("/") and foreign():
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            inside = page[at: stop.start()] if stop else page[at:]
            if tag in ("textarea", "xmp", "style"):
                one.children.append(html.unescape(inside) if tag == "textarea" else inside)
            last = page.find(">", stop.end()) if stop else -1
            at = last + 1 if last >= 0 else end
            continue
        if len(stack) < DEEPEST:
            stack.append(one)
    return root


def visible(e: Element) -> bool:
    if e.tag in HIDDEN and not (e.tag == "dialog" and "open" in e.attrs):
        return False
    if "hidden" in e.attrs or (e.tag == "input" and e.attrs.get("type", "").lower() == "hidden"):
        return False
    return True


def _declared(text: str) -> dict[str, tuple[bool, str]]:
    """Last value of display and visibility, and whether it is marked as important."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARED.findall(text):
        name = name.lower()
        if important or not out.get(name, (False, ""))[0]:
            out[name] = (bool(important), value.lower())
    return out


def _rules(sheets: list[str]) -> dict[str, list[tuple[tuple, str, frozenset, dict]]]:
    """Rules of the style sheets by one name they ask for: (specificity and place, element, classes and ids, declarations)."""
    out: dict[str, list] = {}
    place = 0
    for sheet in sheets:
        sheet = AT_RULE.sub(lambda m: m[2] or "" if m[1].strip().lower() in ("media all", "media screen") else "", COMMENT.sub(" ", sheet))
        for selectors, body in RULE.findall(sheet):
            declared = _declared(body)
            for selector in selectors.split(",") if declared else ():
                found = SELECTOR.fullmatch(selector.strip())
                if found and found[0]:
                    place += 1
                    names = frozenset(re.findall(r"[.#][\w-]+", found[2]))
                    tag = (found[1] or "*").lower()
                    ids = sum(n[0] == "#" for n in names)
                    rank = (ids, len(names) - ids, tag != "*", place)
                    out.setdefault(min(names) if names else tag, []).append((rank, tag, names, declared))
    return out


def _styled(root: Element) -> None:
    """Applies the page's styles: what has no display is marked hidden; of what is not visible, its own text goes."""
    sheets, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.tag == "style":
            sheets += [c for c in e.children if isinstance(c, str)]
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    rules = _rules(sheets)
    stack = [(root, True)]
    while stack:
        e, seen = stack.pop()
        found = [((important, (1 << 30,)), name, value) for name, (important, value) in _declared(e.attrs.get("style", "")).items()]
        if rules:
            own = {f".{c}" for c in e.attrs.get("class", "").split()} | ({f"#{e.attrs['id']}"} if e.attrs.get("id") else set())
            for key in (*own, e.tag, "*"):
                found += [((important, rank), name, value) for rank, tag, names, declared in rules.get(key, ())
                          if tag in ("*", e.tag) and names <= own for name, (important, value) in declared.items()]
        won = {name: value for _, name, value in sorted(found, key=lambda f: f[0])}
        if won.get("display") == "none":
            e.attrs["hidden"] = ""
        elif "display" in won and won["display"] != "inherit":
            e.attrs.pop("hidden", None)  # an author's display beats the attribute
        if won.get("visibility") in ("hidden", "collapse", "visible"):
            seen = won["visibility"] == "visible"
        if not seen:
            e.children = [c for c in e.children if isinstance(c, Element)]
            if e.tag == "input":
                e.attrs["hidden"] = ""
        stack += [(c, seen) for c in e.children if isinstance(c, Element)]


def cells_of(text: str) -> int:
    """Columns that a text takes up: two for wide letters, none for marks."""
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def folded(line: str, width: int = WIDEST) -> list[str]:
    """A line cut at spaces to the width; a longer word stands alone. Leading spaces stay, also of what follows."""
    if cells_of(line) <= width:
        return [line]
    indent = line[: len(line) - len(line.lstrip(" "))]
    out, at, size = [], [], len(indent)
    for word in line.split():
        n = cells_of(word)
        if at and size + 1 + n > width:
            out.append(indent + " ".join(at))
            at, size = [], len(indent)
        size += n + (1 if at else 0)
        at.append(word)
    return [*out, indent + " ".join(at)]


class Page:
    """Lines of text under way: inline text runs on, blocks begin lines, margins leave one blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent: list[str] = []  # prefixes of open list items
        self.bullet = ""  # stands before the next text
        self.blank = False
        self.space = False

    def text(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text[:1] == " " and self.line:
            self.space = True
        body = text.strip(" ")
        if not body:
            return
        if not self.line:
            self._begin()
        elif self.space:
            self.line.append(" ")
        self.line.append(body)
        self.space = text[-1] == " "

    def _begin(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if self.bullet:
            self.line.append("".join(self.indent[:-1]) + self.bullet)
            self.bullet = ""
        else:
            self.line.append("".join(self.indent))

    def end(self, margin: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.blank |= margin

    def rows(self, lines: list[str]) -> None:
        """Lines as they are (preformatted text, tables)."""
        for line in lines:
            self._begin()
            self.line.append(line)
            self.end()

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _number(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None else default
    except ValueError:
        return default


def _grid(table: Element) -> tuple[list[Element], list[list[Element]]]:
    """(captions and other content, rows of cells) of a table; nested tables are left alone."""
    other, rows, todo = [], [], list(reversed(table.children))
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            if e.strip():
                other.append(e)
        elif not visible(e):
            continue
        elif e.tag == "tr":
            rows.append([c for c in e.children if isinstance(c, Element) and c.tag in CELLS and visible(c)])
            other += [c for c in e.children if (c.strip() if isinstance(c, str) else c.tag not in CELLS and visible(c))]
        elif e.tag in ("tbody", "thead", "tfoot"):
            todo += reversed(e.children)
        elif e.tag in CELLS:
            rows.append([e])
        else:
            other.append(e)
    return other, rows


def _table(out: Page, table: Element, depth: int) -> None:
    other, rows = _grid(table)
    for e in other:
        _lay_out(out, [e], depth)
        out.end()
    # places of the cells: (first column, columns, lines); a cell over several rows keeps its columns in these
    placed: list[list[tuple[int, int, list[str]]]] = []
    kept: dict[int, int] = {}  # column -> rows that it is still taken for
    for r, row in enumerate(rows):
        at, here, taken = 0, [], dict(kept)
        for k, c in enumerate(row):
            while taken.get(at, 0) > 0:
                at += 1
            span = max(1, min(MOST_COLUMNS, _number(c.attrs.get("colspan"), 1)))
            down = _number(c.attrs.get("rowspan"), 1)
            down = len(rows) - r if down == 0 else max(1, min(down, len(rows) - r))
            lines = _rendered(c, depth)
            here.append((at, span, lines if k == len(row) - 1 else [x for line in lines for x in folded(line)]))
            if down > 1:
                kept |= dict.fromkeys(range(at, at + span), down)
            at += span
        placed.append(here)
        kept = {c: n - 1 for c, n in kept.items() if n > 1}
    width: dict[int, int] = {}
    for one in (True, False):  # cells of one column first; wider ones then widen their last column
        for row in placed:
            for k, (at, span, lines) in enumerate(row):
                if (span == 1) == one and k < len(row) - 1:
                    longest = max((n for n in map(cells_of, lines) if n <= WIDEST), default=0)
                    room = sum(width.get(c, 0) for c in range(at, at + span - 1)) + 2 * (span - 1)
                    width[at + span - 1] = max(width.get(at + span - 1, 0), longest - room)
    # the last cell of a row is not padded, so it widens its column only as far as short lines go
    for row in placed:
        if row and row[-1][1] == 1:
            longest = max((n for n in map(cells_of, row[-1][2]) if n <= WIDEST), default=0)
            width[row[-1][0]] = max(width.get(row[-1][0], 0), longest)
    begin, total = [0], 0
    for c in range(max((at + span for row in placed for at, span, _ in row), default=0)):
        total += width.get(c, 0) + 2
        begin.append(total)
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for at, _, lines in row:
                piece = lines[k] if k < len(lines) else ""
                if piece:
                    line += " " * (begin[at] - cells_of(line) if begin[at] > cells_of(line) else 2 if line else 0) + piece
            out.rows([line])


def _rendered(e: Element, depth: int) -> list[str]:
    page = Page()
    _lay_out(page, e.children, depth)
    text = page.result()
    return text.split("\n") if text else []


def _margin(e: Element, parent: Element | None) -> bool:
    """Whether blank lines surround the element; lists within items have none."""
    return e.tag in MARGIN and not (e.tag in LISTS and parent is not None and parent.tag == "li")


def _lay_out(out: Page, nodes: list, depth: int) -> None:
    """Lays out nodes in order, without recursion but for table cells."""
    todo: list = [("in", n, None) for n in reversed(nodes)]
    while todo:
        step, e, parent = todo.pop()
        if step == "out":
            out.end(_margin(e, parent))
            if e.tag in ("li", "blockquote", "dd"):
                out.indent.pop()
                out.bullet = ""
            continue
        if isinstance(e, str):
            out.text(e)
            continue
        if not visible(e):
            continue
        tag = e.tag
        if tag == "br":
            if out.line:
                out.end()
            else:
                out.blank = True
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "input":
            if e.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email"):
                out.text(e.attrs.get("value", ""))
            continue
        if tag in CELLS or tag == "text":  # outside a laid-out table; labels of a drawing
            out.text(" ")
        if tag not in BLOCK:
            todo += [("in", c, e) for c in reversed(e.children)]
            continue
        out.end(_margin(e, parent))
        if tag == "hr":
            continue
        if tag in ("pre", "xmp"):
            raw = "".join(_strings(e)).removeprefix("\n").expandtabs(8).rstrip()
            out.rows([line.rstrip() for line in raw.split("\n")] if raw else [])
            out.end(True)
            continue
        if tag == "table":
            _table(out, e, depth + 1)
            out.end(True)
            continue
        if tag == "li":
            bullet = f"{_item_number(parent, e)}. " if parent is not None and parent.tag == "ol" else "- "
            out.bullet = bullet
            out.indent.append(" " * len(bullet))
        elif tag in ("blockquote", "dd"):
            out.indent.append("  ")
        todo.append(("out", e, parent))
        children = e.children
        if tag == "details" and "open" not in e.attrs:
            children = [c for c in children if isinstance(c, Element) and c.tag == "summary"]
        if tag == "ol":
            _count_items(e)
        todo += [("in", c, e) for c in reversed(children)]


def _count_items(ol: Element) -> None:
    """Writes each item's number into its value attribute."""
    items = [c for c in ol.children if isinstance(c, Element) and c.tag == "li" and visible(c)]
    step = -1 if "reversed" in ol.attrs else 1
    n = _number(ol.attrs.get("start"), len(items) if step < 0 else 1)
    for item in items:
        n = _number(item.attrs.get("value"), n)
        item.attrs["value"] = str(n)
        n += step


def _item_number(ol: Element, item: Element) -> str:
    return item.attrs.get("value", "1")


def _strings(e: Element) -> Iterator[str]:
    todo = list(reversed(e.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            yield c
        elif c.tag == "br":
            yield "\n"
        elif visible(c):
            todo += reversed(c.children)


def render(page: str) -> str:
    """Visible text of a page, laid out; blank lines never come twice."""
    out, root = Page(), tree(page.replace("\r\n", "\n").replace("\r", "\n"))
    _styled(root)
    _lay_out(out, root.children, 0)
    return out.result().replace("\xa0", " ")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text): the laid-out visible text of every page.

    Null html gives null text, empty html or a page without visible text the empty text; broken markup is repaired, a
    page that ends within a tag loses that tag only; repeated rows each get their row; an empty table gives none; other
    columns are not read. Pages of any length are rendered whole.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [render(p) if isinstance(p, str) else None for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "text": pd.Series(text, dtype=object)})

    return text_batches(pages).select("page_id", "html").mapInPandas(rendered, f"page_id {kind}, text string")
