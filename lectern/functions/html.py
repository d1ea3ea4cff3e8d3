"""HTML to Markdown: a forgiving tree of a page, and the renderers that walk it without recursion.

The tree follows the tags as they stand: an end tag closes up to its innermost open start tag, a
stray one closes nothing, void elements hold nothing, and nothing is closed by implication.  Every
element knows its span in the source, so that parts can be cut out of a page byte for byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.tokens import by_slice

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
#: Elements whose own text is not the text of what holds them.
APART = frozenset("script style template rt rp".split())
_KEEPING_SPACE = frozenset(("pre", "textarea"))
_ASCII_SPACE = " \n\t\f\r"


class Node:
    """An element, or a piece of text (``name`` is then "" and ``kind`` tells what text it is)."""

    __slots__ = ("name", "attrs", "children", "parent", "text", "kind", "begin", "end")

    def __init__(self, name: str = "", attrs: dict[str, str] | None = None, text: str = "", kind: str = ""):
        self.name, self.attrs, self.text, self.kind = name, attrs or {}, text, kind
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.begin = self.end = 0

    def add(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """All nodes within, in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name and (not names or n.name in names)]

    def within(self, root: Node) -> bool:
        node: Node | None = self
        while node is not None and node is not root:
            node = node.parent
        return node is root

    def above(self, name: str) -> Node | None:
        node = self.parent
        while node is not None and node.name != name:
            node = node.parent
        return node

    def put_in_place_of(self, old: Node) -> None:
        self.parent, where = old.parent, old.parent.children
        where[next(i for i, c in enumerate(where) if c is old)] = self
        old.parent = None

    def leave(self) -> None:
        self.parent.children = [c for c in self.parent.children if c is not self]
        self.parent = None

    def strings(self) -> list[str]:
        """The text within; comments and, unless this is one, what elements of APART hold are left out."""
        own = self.name if self.name in APART else ""
        return [n.text for n in self.walk() if not n.name and n.kind == own]


class _Builder(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=False)
        self.root = Node("[document]")
        self.open, self.held, self.done = [self.root], [], []
        self.apart: list[Node] = []
        self.count: dict[str, int] = {}
        self.page = page
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.feed(page)
        self.close()
        self._text("")
        for node in self.open:
            node.end = len(page)

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _text(self, kind: str) -> None:
        if not self.held:
            return
        text, self.held = "".join(self.held), []
        if not text.strip(_ASCII_SPACE) and not any(self.count.get(n) for n in _KEEPING_SPACE):
            text = "\n" if "\n" in text else " "
        if not kind and self.apart:
            kind = self.apart[-1].name
        self.open[-1].add(Node(text=text, kind=kind))

    def _begin(self, name: str, attrs: list[tuple[str, str | None]], empty: bool) -> None:
        self._text("")
        node = Node(name, {k: v or "" for k, v in attrs})
        node.begin = self._here()
        self.open[-1].add(node)
        self.open.append(node)
        self.count[name] = self.count.get(name, 0) + 1
        if name in APART:
            self.apart.append(node)
        if empty:
            self._finish(name, node.begin + len(self.get_starttag_text() or ""))

    def _finish(self, name: str, at: int) -> None:
        self._text("")
        if not self.count.get(name):
            return
        while len(self.open) > 1:
            node = self.open.pop()
            self.count[node.name] -= 1
            node.end = at
            if self.apart and self.apart[-1] is node:
                self.apart.pop()
            if node.name == name:
                return

    def handle_starttag(self, tag, attrs):
        self._begin(tag, attrs, tag in VOID)
        if tag in VOID:
            self.done.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs, True)

    def handle_endtag(self, tag):
        if tag in self.done:  # the end tag of a void element, which is closed already
            self.done.remove(tag)
            return
        stop = self.page.find(">", self._here())
        self._finish(tag, len(self.page) if stop < 0 else stop + 1)

    def handle_data(self, data):
        self.held.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            text = bytes([code]).decode("cp1252") if code < 256 else chr(code)
        except (ValueError, OverflowError):
            try:
                text = chr(code)
            except (ValueError, OverflowError, UnboundLocalError):
                text = "�"
        self.held.append("�" if "\ud800" <= text <= "\udfff" else text)

    def handle_entityref(self, name):
        self.held.append(html5.get(f"{name};", f"&{name}"))

    def _other(self, data: str, kind: str) -> None:
        self._text("")
        self.held.append(data)
        if data:
            self._text(kind)
        self.held = []

    def handle_comment(self, data):
        self._other(data, "#comment")

    def handle_decl(self, decl):
        self._other(decl[len("DOCTYPE ") :], "#doctype")

    def handle_pi(self, data):
        self._other(data, "#instruction")

    def unknown_decl(self, data):
        cdata = data.upper().startswith("CDATA[")
        self._other(data[6:] if cdata else data, "" if cdata else "#declaration")


def tree(page: str) -> Node:
    return _Builder(page).root


def spaced(text: str) -> str:
    return " ".join(text.split())


_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


def inline(nodes: list[Node]) -> str:
    """Inline Markdown of some siblings: emphasis, code, links, images and breaks; other tags leave no trace."""
    out: list[str] = []
    frames: list[list[str]] = []  # what stood before each open link
    stack: list[tuple[Node | None, str]] = [(n, "") for n in reversed(nodes)]
    while stack:
        node, closing = stack.pop()
        if node is None:
            out.append(closing)
        elif closing == "a":
            label, href = "".join(out).strip(), node.attrs.get("href", "")
            out = frames.pop()
            out.append(f"[{label or href}]({href})" if href else label)
        elif not node.name:
            out.append(node.text)
        elif node.name == "br":
            out.append("  \n")
        elif node.name == "img":
            alt, src = (node.attrs.get(k, "").strip() for k in ("alt", "src"))
            out.append(f"![{alt}]({src})" if src else "")
        else:
            if node.name == "a":
                frames.append(out)
                out = []
                stack.append((node, "a"))
            elif node.name in _MARKS:
                out.append(_MARKS[node.name])
                stack.append((None, _MARKS[node.name]))
            stack.extend((c, "") for c in reversed(node.children))
    return "".join(out)


def _number(value: str | None, default: int) -> int:
    return int(value) if value is not None and value.strip().isdigit() else default


def list_lines(top: Node) -> str:
    """A list in Markdown.  At depth d a line is indented by d * d + 3 * d: each level indents its inner lines once more."""
    out: list[str] = []

    def emit(depth: int, line: str) -> None:
        if not depth:
            out.append(line)
            return
        again = " " * (depth * (depth + 1))
        for k, part in enumerate(line.splitlines()):
            out.append(again + (" " * (2 * depth) if not k else "") + part)

    def items(node: Node, depth: int) -> Iterator[tuple[Node, int]]:
        """Renders the list's own lines; gives the lists within when their turn has come."""
        turn = _number(node.attrs.get("start"), 1) if node.name == "ol" else 0
        for li in [c for c in node.children if c.name == "li"]:
            marker = "- "
            if node.name == "ol":
                turn = _number(li.attrs.get("value"), turn)
                marker, turn = f"{turn}. ", turn + 1
            before, inner = len(out), []
            for child in li.children:
                if child.name not in ("ul", "ol"):
                    inner.append(child)
                    continue
                if text := inline(inner).strip():
                    emit(depth, marker + text)
                    marker = "  "
                inner = []
                yield child, depth + 1
            if text := inline(inner).strip():
                emit(depth, marker + text)
            if len(out) == before:
                emit(depth, marker)

    stack = [items(top, 0)]
    while stack:
        deeper = next(stack[-1], None)
        if deeper is None:
            stack.pop()
        else:
            stack.append(items(*deeper))
    return "\n".join(out)


def _cell(cell: Node) -> str:
    parts: list[str] = []
    for child in cell.children:
        if child.name in ("ul", "ol"):
            parts.append(list_lines(child).replace("\n", "<br>"))
        elif child.name == "br":
            parts.append("<br>")
        elif child.name == "p":
            if text := inline(child.children).strip():
                parts.append(text + "<br>")
        else:
            parts.append(inline([child]))
    text = re.sub(r"[ \t\f\v]+", " ", "".join(parts)).replace(" <br>", "<br>").replace("<br> ", "<br>")
    return text.strip().replace("|", "\\|").removesuffix("<br>")


def table_lines(table: Node) -> str:
    """A pipe table.  The header is the head's first row, else the first row with a header cell, else the
    first row; only in the last case is that row left out of the body."""
    rows = table.elements("tr")
    if not rows:
        return ""
    head = next((r for t in table.elements("thead")[:1] for r in t.elements("tr")), None)
    head = head or next((r for r in rows if r.elements("th")), None)
    if head is None:
        head, rows = rows[0], rows[1:]
    line = lambda cells: f"| {' | '.join(cells)} |"
    cells = lambda row: [_cell(c) for c in row.elements("th", "td")]
    first = cells(head)
    out = [line(first), line(["---"] * len(first))] if first else []
    return "\n".join([*out, *(line(c) for c in map(cells, rows) if c)])


def _own_href(a: Node) -> str:
    """The id that a link within the page points to; empty for any other."""
    href = a.attrs.get("href", "")
    return href[1:] if href.startswith("#") else ""


def inline_footnotes(root: Node) -> None:
    """Puts the text of a link's target, wherever it is in the page, in the place of the link.

    The whole superscript goes with its link; a second link in a superscript that is gone changes
    nothing.  Targets leave the page, and so do lists and sections that are left without elements.
    """
    links = root.elements("a")
    wanted = {t: None for a in links if (t := _own_href(a))}
    by_id: dict[str, list[Node]] = {}
    for node in root.elements() if wanted else []:
        if node.attrs.get("id") in wanted:
            by_id.setdefault(node.attrs["id"], []).append(node)
    first = lambda t: next((n for n in by_id.get(t, ()) if n.within(root)), None)
    notes: dict[str, str] = {}
    for target in wanted:
        if (node := first(target)) is None:
            continue
        for back in node.elements("a"):
            if back.attrs.get("href", "").startswith("#footnote-ref") and back.within(root):
                back.leave()
        if text := spaced(" ".join(s for s in map(str.strip, node.strings()) if s)):
            notes[target] = text
    for a in links:
        note = notes.get(_own_href(a))
        place = (a.above("sup") or a) if note else None
        if place is not None and place.parent is not None:
            Node(text=f" [Note: {note}]").put_in_place_of(place)
    for target in notes:
        if (node := first(target)) is None:
            continue
        holder = node.parent
        node.leave()
        while holder is not None and holder.name in ("ol", "ul", "section", "div") and holder.parent is not None and not any(c.name for c in holder.children):
            upper = holder.parent
            holder.leave()
            holder = upper


def _block(node: Node, counters: list[int]) -> str:
    name = node.name
    if len(name) == 2 and name[0] == "h" and name[1] in "123456":
        level = int(name[1])
        counters[level - 1] += 1
        counters[level:] = [0] * (6 - level)
        number = ".".join(str(n) for n in counters[:level] if n)
        return f"{'#' * level} {number} {inline(node.children).strip()}\n"
    if name == "pre":
        return f"```\n{''.join(node.strings()).rstrip()}\n```\n"
    if name == "blockquote":
        return "\n".join(f"> {x}".rstrip() for x in inline(node.children).splitlines()) + "\n"
    if name in ("ul", "ol"):
        return list_lines(node) + "\n"
    if name == "hr":
        return "---\n"
    text = inline(node.children).strip() if name == "p" else table_lines(node) if name == "table" else "".join(node.strings()).strip()
    return f"{text}\n" if text else ""


def markdown(page: str) -> str:
    """A page's body in Markdown: its children block by block, blank lines between them, headings numbered."""
    root = tree(page)
    body = next((n for n in root.walk() if n.name == "body"), root)
    inline_footnotes(body)
    counters, out, last = [0] * 6, [], ""
    for child in body.children:
        if child.name:
            block = _block(child, counters)
        else:
            block = f"{text}\n" if (text := child.text.strip()) else ""
        if not block:
            continue
        if not last.endswith("\n") and not block.startswith("\n"):
            out.append("\n")
        out.append(block)
        last = block
        if not block.endswith("\n\n"):
            out.append("\n")
            last = "\n\n"
    lines, blank = [], 0
    for line in map(str.rstrip, "".join(out).splitlines()):
        blank = 0 if line else blank + 1
        if blank <= 2:
            lines.append(line)
    return "\n".join(lines).strip() + "\n"


_TOC_CLASS, _TOC_PARAGRAPH, _TOC_LINK = (re.compile(p, re.I) for p in (r"\b(?:toc|table-of-contents)\b", r"\b(?:msotoc\d*|toc|table-of-contents)\b", r"#_?toc"))
_TOC_TITLES = ("table des matières", "sommaire", "table of contents")


def without_contents(page: str) -> str:
    """The page less its table of contents; whatever stays is what stood in the source, byte for byte.

    Goes: divisions of such a class, paragraphs of such a class or whose links all point to its
    entries, lists of which the same holds, and the first heading or paragraph left that is its title.
    """
    root = tree(page)
    cut: list[Node] = []
    for names in (("div", "section", "nav"), ("p",), ("ol", "ul")):
        for node in root.elements(*names):
            if not node.within(root):
                continue
            links = [a.attrs["href"] for a in node.elements("a") if "href" in a.attrs]
            entries = bool(links) and all(map(_TOC_LINK.match, links))
            kind = node.attrs.get("class", "")
            if (names[0] == "div" and _TOC_CLASS.search(kind)) or (names[0] == "p" and (_TOC_PARAGRAPH.search(kind) or entries)) or (names[0] == "ol" and entries):
                node.leave()
                cut.append(node)
    for node in root.elements("h1", "h2", "h3", "h4", "h5", "h6", "p"):
        if spaced("".join(node.strings())).lower() in _TOC_TITLES:
            cut.append(node)
            break
    out, at = [], 0
    for node in sorted(cut, key=lambda n: n.begin):
        out.append(page[at : max(at, node.begin)])
        at = max(at, node.end)
    return "".join([*out, page[at:]])


def _each(pages: pa.Array, change) -> pa.Array:
    return by_slice(pages, lambda some: pa.array([None if x is None else change(x) for x in some], pa.string()))


def html_to_markdown(html: Column | str) -> Column:
    """Markdown of each page, over Arrow batches; null for null, a line's end for an empty page."""
    return F.arrow_udf(lambda pages: _each(pages, markdown), "string")(html)


def strip_contents(html: Column | str) -> Column:
    """Each page without its table of contents; null for null."""
    return F.arrow_udf(lambda pages: _each(pages, without_contents), "string")(html)


def decoded(content: Column | str) -> Column:
    """UTF-8 text of bytes, invalid ones dropped; null for null."""

    def text(pages: pa.Array) -> pa.Array:
        return by_slice(pages, lambda some: pa.array([None if x is None else x.decode("utf-8", "ignore") for x in some], pa.string()))

    return F.arrow_udf(text, "string")(content)
