"""HTML to visible text with its layout: tokeniser, tree builder, renderer.

A small helper for one page at a time: no network, no styles beyond the ``style``
and ``hidden`` attributes.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left

#: Deeper elements become siblings, as browsers do it; their text is kept.
MAX_DEPTH = 200
#: Lines of cells that have others to their right are folded at words to this width; a longer word runs over it.
MAX_CELL_WIDTH = 120
#: Formatting elements that a page may have repeated inside a block, to keep the tree shallow.
MAX_CLONES = 200

# A quote opens a value only right after `=`; elsewhere it belongs to a name or to an unquoted value.
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_VALUE = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"({0}[^\"]*+)\"?|'({0}[^']*+)'?|({0}[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+))?"
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)"
    rf"((?:[ \t\n\r\f/]|{_NAME}(?:{_VALUE.format('?:')})?)*+)>?", re.S)
ATTR = re.compile(rf"({_NAME})(?:{_VALUE.format('')})?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(("head script style template title noscript iframe noembed noframes object audio video canvas "
                    "datalist meta link base map area param source track").split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu".split())
BLOCK = SPACED | frozenset(("html body address article aside center dd details dialog dir div dt figcaption footer form "
                            "header hgroup legend li main nav section search summary caption thead tbody tfoot tr td "
                            "th optgroup option").split())
CLOSES_P = BLOCK - frozenset("td th tr thead tbody tfoot caption option optgroup html body legend".split())
#: A start tag ends the open elements named first, up to the elements named second.
IMPLIED_END = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"), "optgroup": ("option optgroup", "select"),
    "body": ("head", "html"),
}
IMPLIED_END = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED_END.items()}
#: Elements that end an open ``head`` by standing in it.
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
#: An end tag does not reach past these.
SCOPE = frozenset("table td th caption template".split())
#: Where a part of a table may stand; elements above such a place end before it.
TABLE_PLACE = {
    "caption": "table", "colgroup": "table", "col": "colgroup table", "thead": "table", "tbody": "table", "tfoot": "table",
    "tr": "thead tbody tfoot table", "td": "tr thead tbody tfoot table", "th": "tr thead tbody tfoot table",
}
TABLE_PLACE = {k: frozenset(v.split()) for k, v in TABLE_PLACE.items()}
#: Text and other elements do not stand here: they go before the table.
NO_TEXT = frozenset("table thead tbody tfoot tr".split())
#: The end tag of a formatting element leaves open blocks open; that of any other inline element is no tag there.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = BLOCK | HIDDEN | frozenset("button select marquee colgroup textarea xmp input img br".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(source: str) -> Node:
    """The tree of a page.  Never fails: what cannot be a tag is text."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(source)
    clones = 0

    def last(tag: str) -> int:
        return next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)

    def place(k: int, child: Node | str) -> None:
        """Put ``child`` into the open element ``k``, or before its table if it cannot stand there."""
        if stack[k].tag in NO_TEXT and len(stack) < MAX_DEPTH - 3:
            t = k
            while stack[t].tag != "table" and t > 1:
                t -= 1
            inside, table = stack[t - 1].children, stack[t]
            for j in range(len(inside) - 1, -1, -1):
                if inside[j] is table:
                    inside.insert(j, child)
                    return
        stack[k].children.append(child)

    def text(s: str) -> None:
        if s:
            blank = not s.strip(" \t\n\r\f")
            if stack[-1].tag == "head" and not blank:
                stack.pop()
            s = html.unescape(s) if "&" in s else s
            if blank:
                stack[-1].children.append(s)
            else:
                place(len(stack) - 1, s)

    def end_inline(tag: str) -> None:
        """Close an inline element.  Blocks opened inside a formatting element leave it and stay open."""
        nonlocal clones
        block = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                break
            if stack[k].tag in SCOPE:
                return
            if stack[k].tag in SPECIAL:
                block = k
                if tag not in FORMATTING:
                    return
        else:
            return
        element = stack[k]
        while block:
            inner, parent = stack[block], stack[block - 1]
            if parent.children and parent.children[-1] is inner:
                parent.children.pop()
                place(k - 1, inner)
            if not {"hidden", "style"}.isdisjoint(element.attrs) and clones < MAX_CLONES:
                clones += 1
                copy = Node(element.tag, element.attrs)
                copy.children, inner.children = inner.children, [copy]
            else:
                copy = inner
            # ``copy`` takes the element's place under the block, as the parent of what is still open in it
            stack[k:block + 1] = [inner, copy]
            k += 1
            block = next((j for j in range(k + 1, len(stack)) if stack[j].tag in SPECIAL), 0)
        del stack[k:]

    def end(names: frozenset, stop: frozenset) -> None:
        """Close the outermost open element of ``names`` above the nearest ``stop``."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stop:
                return
            if stack[k].tag in names:
                lowest = k
                while lowest > 1 and stack[lowest - 1].tag in names:
                    lowest -= 1
                del stack[lowest:]
                if not names & {x.tag for x in stack[1:]}:
                    return
                end(names, stop)
                return

    while at < n:
        m = TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in VOID:
                pass
            elif tag not in SPECIAL:
                end_inline(tag)
            else:
                stop = frozenset() if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot", "body", "html") else SCOPE
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in stop or tag != "table" and stack[k].tag == "table":
                        break
            if tag == "br":
                place(len(stack) - 1, Node("br", {}))
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        deep = len(stack) >= MAX_DEPTH - 3
        if tag in TABLE_PLACE and not deep:
            table = last("table")
            if not table:
                continue
            while stack[-1].tag not in TABLE_PLACE[tag] and len(stack) > table + 1:
                stack.pop()
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
        elif tag == "table" and stack[-1].tag in NO_TEXT and not deep:
            del stack[last("table"):]
        if tag in CLOSES_P:
            end(frozenset(("p",)), SCOPE | {"button"})
        if tag in IMPLIED_END:
            end(*IMPLIED_END[tag])
        raw = m[3] or ""
        node = Node(tag, _attrs(raw) if raw.strip(" \t\r\n/") else {})
        if tag in TABLE_PLACE or tag in HIDDEN:
            stack[-1].children.append(node)
        else:
            place(len(stack) - 1, node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            stop_at = close.start() if close else n
            body = source[at:stop_at]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = close.end() if close else n
        elif raw.endswith("/") and tag in ("svg", "path", "circle", "rect", "g", "use"):
            continue
        elif len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def _visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN:
        return False
    if a:
        if "hidden" in a and a["hidden"].lower() != "until-found" or HIDDEN_STYLE.search(a.get("style", "")):
            return False
        if node.tag == "input" and a.get("type", "").lower() in ("hidden", "checkbox", "radio", "file", "password", "range"):
            return False
    return not (node.tag == "dialog" and "open" not in a)


def _drop_invisible(root: Node) -> None:
    """Take out text of elements with ``visibility: hidden``, but for those inside that are visible again."""
    todo = [(root, False)]
    while todo:
        node, gone = todo.pop()
        if said := VISIBILITY.findall(node.attrs.get("style", "")):
            gone = said[-1].lower() in ("hidden", "collapse")
        if gone:
            node.children = [c for c in node.children if isinstance(c, Node)]
            if node.tag in ("q", "input"):
                node.tag = "span"
        todo.extend((c, gone) for c in node.children if isinstance(c, Node))


class _Lines:
    """Lines of a flow of blocks; ``gap`` asks for blank lines before the next text."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.open: list[str] = []
        self.gap = 0

    def word(self, s: str) -> None:
        if self.open and self.open[-1].endswith(" ") or not self.open:
            s = s.lstrip(" ")
        if s:
            self.open.append(s)

    def flush(self) -> None:
        line = "".join(self.open).rstrip(" ")
        self.open = []
        if line:
            self.line(line)

    def line(self, line: str) -> None:
        if self.done and self.gap:
            self.done.extend([""] * self.gap)
        self.gap = 0
        self.done.append(line)

    def lines(self, lines: list[str]) -> None:
        self.flush()
        while lines and not lines[0]:
            lines = lines[1:]
        for line in lines:
            self.line(line)


def _block(node: Node, pre: bool) -> list[str]:
    out = _Lines()
    _flow(node, out, pre)
    out.flush()
    return out.done


def _list(node: Node, pre: bool) -> list[str]:
    out, n, ordered = [], 1, node.tag == "ol"
    start = node.attrs.get("start", "")
    if ordered and re.fullmatch(r"-?\d{1,9}", start):
        n = int(start)
    loose = Node("div", {})
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if not _visible(child):
                continue
            mark = f"{n}. " if ordered else "- "
            lines = _block(child, pre)
            n += 1
            if lines:
                out.extend([mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])])
        else:
            loose.children = [child]
            out.extend(_block(loose, pre))
    return out


def _rows(node: Node) -> list[tuple[int, list | Node]]:
    """Rows of a table in order of captions, thead, bodies, tfoot, each with the number of its
    group; what is no row (captions, strays of a tree cut at its depth) stands as an element."""
    parts: dict[str, list] = {"caption": [], "head": [], "body": [], "foot": []}

    def add(part: str, group: int, child: Node | str) -> None:
        if isinstance(child, Node) and not _visible(child):
            return
        if isinstance(child, Node) and child.tag == "tr":
            parts[part].append((group, child.children))
        elif isinstance(child, Node) and child.tag in ("td", "th"):
            parts[part].append((group, [child]))
        elif isinstance(child, Node) or child.strip():
            box = Node("div", {})
            box.children = [child]
            parts[part].append((group, box))

    for group, child in enumerate(node.children, 1):
        tag = child.tag if isinstance(child, Node) else ""
        if tag in ("thead", "tbody", "tfoot"):
            if _visible(child):
                for row in child.children:
                    add({"thead": "head", "tbody": "body", "tfoot": "foot"}[tag], group, row)
        elif tag == "caption":
            add("caption", 0, child)
        elif tag not in ("colgroup", "col"):
            add("body", 0, child)
    return parts["caption"] + parts["head"] + parts["body"] + parts["foot"]


def _span(node: Node, name: str = "colspan") -> int:
    s = node.attrs.get(name, "1")
    return min(int(s), 1000) if re.fullmatch(r"[1-9]\d{0,8}", s) else 1


def _fold(lines: list[str], width: int) -> list[str]:
    """``lines`` cut at spaces to ``width`` where words allow it."""
    out = []
    for line in lines:
        while len(line) > width:
            margin = len(line) - len(line.lstrip(" "))
            at = line.rfind(" ", margin, width + 1)
            at = line.find(" ", width) if at < 0 else at
            if at < 0:
                break
            out.append(line[:at].rstrip(" "))
            line = line[at:].lstrip(" ")
        out.append(line)
    return out


class _Cell:
    __slots__ = ("col", "end", "last", "lines")

    def __init__(self, col: int, end: int, last: int, lines: list[str]):
        self.col, self.end, self.last, self.lines = col, end, last, lines


def _grid(rows: list[tuple[int, list | Node]], pre: bool) -> list[list[_Cell] | list[str]]:
    """The cells that stand in each row, those from rows above included; elements as their lines."""
    until = {group: k for k, (group, row) in enumerate(rows) if not isinstance(row, Node)}
    out, above = [], []
    for k, (group, row) in enumerate(rows):
        if isinstance(row, Node):
            out.append(_block(row, pre))
            continue
        above = [c for c in above if c.last >= k]
        taken = {x for c in above for x in range(c.col, c.end)}
        cells, col = list(above), 0
        for child in row:
            cell = isinstance(child, Node) and child.tag in ("td", "th")
            if isinstance(child, Node) and not _visible(child) or not isinstance(child, Node) and not child.strip():
                continue
            while col in taken:
                col += 1
            if cell:
                lines, end = _block(child, pre), col + _span(child)
                rest = child.attrs.get("rowspan") == "0"
                down = until[group] if rest else min(until[group], k + _span(child, "rowspan") - 1)
            else:
                box = Node("div", {})
                box.children = [child]
                lines, end, down = _block(box, pre), col + 1, k
                if not lines:
                    continue
            cells.append(_Cell(col, end, down, lines))
            col = end
        out.append(sorted(cells, key=lambda c: c.col))
        above = [c for c in cells if c.last > k]
    return out


def _table(node: Node, pre: bool) -> list[str]:
    rows = _grid(_rows(node), pre)
    cells = list({id(c): c for row in rows for c in row if isinstance(c, _Cell)}.values())
    right = max((c.end for c in cells), default=0)
    #: only columns in which a cell begins take room
    columns = sorted({c.col for c in cells})
    width = dict.fromkeys(columns, 0)
    for c in sorted(cells, key=lambda c: c.end - c.col):
        if c.end < right:
            c.lines = _fold(c.lines, MAX_CELL_WIDTH)
            under = columns[bisect_left(columns, c.col):bisect_left(columns, c.end)]
            need = max((len(x) for x in c.lines if len(x) <= MAX_CELL_WIDTH), default=0)
            need -= sum(width[x] for x in under) + 2 * (len(under) - 1)
            if need > 0:
                width[under[-1]] += need
    start, at = {}, 0
    for x in columns:
        start[x] = at
        at += width[x] + 2
    out = []
    for k, row in enumerate(rows):
        if not row or not isinstance(row[0], _Cell):
            out.extend(row)
            continue
        # a cell over several rows shows its lines beside all of them, the rest in its last one
        height = max((len(c.lines) for c in row if c.last == k), default=0)
        for j in range(height):
            line = ""
            for c in row:
                if j < len(c.lines) and c.lines[j]:
                    line = (line + "  " if line else "").ljust(start[c.col]) + c.lines[j]
            out.append(line.rstrip())
        for c in row:
            c.lines = c.lines[height:]
    while out and not out[-1]:
        out.pop()
    return out


def _flow(node: Node, out: _Lines, pre: bool) -> None:
    children = node.children
    if node.tag == "details" and "open" not in node.attrs:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    for child in children:
        if not isinstance(child, Node):
            if pre:
                first, *rest = child.replace("\r\n", "\n").split("\n")
                out.open.append(first)
                for line in rest:
                    out.line("".join(out.open).rstrip())
                    out.open = [line]
            else:
                out.word(SPACE.sub(" ", child))
            continue
        tag = child.tag
        if not _visible(child):
            continue
        if tag == "br":
            had = bool(out.open)
            out.flush()
            if not had and out.done:
                out.gap = max(out.gap, 1)
        elif tag == "input":
            out.word(child.attrs.get("value") or child.attrs.get("placeholder", ""))
        elif tag == "textarea":
            _flow(child, out, True)
        elif tag == "q":
            out.open.append("“")
            _flow(child, out, pre)
            out.open.append("”")
        elif tag in ("ul", "ol", "menu", "dir", "table", "pre", "blockquote", "dd") or tag == "li":
            out.flush()
            gap = 0 if tag in ("dd", "li") or node.tag in ("li", "dd") and tag in ("ul", "ol", "menu", "dir") else 1
            out.gap = max(out.gap, gap)
            if tag in ("ul", "ol", "menu", "dir"):
                lines = _list(child, pre)
            elif tag == "table":
                lines = _table(child, pre)
            elif tag == "pre":
                lines = _block(child, True)
            elif tag == "li":
                lines = _block(child, pre)
                lines = ["- " + lines[0], *("  " + x if x else x for x in lines[1:])] if lines else []
            else:
                lines = ["  " + x if x else x for x in _block(child, pre)]
            out.lines(lines)
            out.gap = max(out.gap, gap)
        elif tag in BLOCK:
            out.flush()
            gap = 1 if tag in SPACED else 0
            out.gap = max(out.gap, gap)
            _flow(child, out, pre)
            out.flush()
            out.gap = max(out.gap, gap)
        else:
            _flow(child, out, pre)


def render(source: str | None) -> str:
    """The visible text of a page, lines as laid out."""
    if not source:
        return ""
    if sys.getrecursionlimit() < 8 * MAX_DEPTH:
        sys.setrecursionlimit(8 * MAX_DEPTH + 1000)
    tree = parse(source)
    _drop_invisible(tree)
    lines = _block(tree, False)
    return "\n".join(x.replace("\xa0", " ").rstrip() for x in lines).strip("\n")
