"""Legal HTML to provision rows: a small DOM, a reading of its elements as blocks, and a builder that nests blocks.

Both layouts of the official journal, original and consolidated, are read by the same walk: an element's classes give its
role (body, heading, continuation, marker of an amendment, ...), and point lists come as tables or as grids. A block is a
text, a heading, an item (marker and blocks), a data table or a numbered paragraph; acts are then built from blocks alone.

Defined results: a null, empty or foreign page gives one document node; a repeated id gets a suffix ~2, ~3; tables without
markers inside articles give no node (in annexes they are rows). A very long page takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ids of an act's parts.
TITLE_ID, PREAMBLE_ID, ENACTING_ID, FINAL_ID = "tit_1", "pbl_1", "enc_1", "fnp_1"
#: The annex that only has the signatures of the entry into force.
SIGNATURES_ID = "anx_ES"
# Classes of the two layouts, by role.
ROLES = {
    "body": ("oj-normal", "normal", "norm"),
    "continuation": ("list",),
    "heading": ("oj-ti-grseq-1", "title-gr-seq-level-1", "title-gr-seq-level-2", "title-gr-seq-level-3", "title-gr-seq-level-4", "title-gr-seq-level-5", "title-division-1", "title-division-2"),
    "annex_title": ("oj-doc-ti", "title-doc-first", "title-doc-last", "title-annex-1"),
    "enumeration": ("oj-enumeration-spacing",),
    "grid": ("grid-list",),
    "dropped": ("modref", "arrow", "hd-modifiers", "disclaimer", "hd-toc-1", "hd-toc-2", "hd-toc-3", "toc-1", "toc-2", "toc-item", "anchorarrow"),
    "own_title": ("oj-ti-art", "oj-sti-art", "title-article-norm", "stitle-article-norm", "eli-title"),
}
ROLE_OF = {name: role for role, names in ROLES.items() for name in names}
# What tells a consolidated page.
CONSOLIDATED_MARKS = ('class="norm"', 'class="modref"', 'class="grid-container')
# Marks that open quoted new text, and marks of unnumbered items.
QUOTE_OPENERS, DASHES = "‘“«'\"", "—–•"
AMENDMENT_ARROWS = re.compile("[►◄]")
CELL_MARK = "\x1f"

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "div": {"p"}, "table": set()}
_CHAPTER, _SECTION, _ARTICLE = re.compile(r"cpt_([IVXLCDM]+)"), re.compile(r"cpt_[IVXLCDM]+\.sct_([0-9]+)"), re.compile(r"art_([0-9]+)([a-z]?)")
_PARAGRAPH, _ANNEX = re.compile(r"([0-9]{3}[a-z]?)\.([0-9]{3}[a-z]?)"), re.compile(r"anx_([A-Za-z0-9]+)")
_LABEL, _LETTER, _NUMBER = re.compile(r"\(([^)]+)\)\s*"), re.compile(r"\(([A-Za-z]{1,2})\)"), re.compile(r"([0-9]+(?:\.[0-9]+)*)\.?")
_DOTTED = re.compile(r"([0-9]+(?:\.[0-9]+)*)\.(?:\s+|(?=[^0-9\s]))")


@lru_cache(maxsize=4096)
def _class_of(value: str) -> tuple[frozenset[str], str | None]:
    """The classes of a class attribute, and the role that they give."""
    classes = frozenset(value.split())
    return classes, next((ROLE_OF[c] for c in sorted(classes) if c in ROLE_OF), None)


class Element:
    __slots__ = ("tag", "id", "classes", "role", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.parent = tag, parent
        self.id = attrs.get("id") or ""
        self.classes, self.role = _class_of(attrs.get("class") or "")
        self.children: list[Element | str] = []

    def elements(self) -> list[Element]:
        return [c for c in self.children if c.__class__ is Element]

    def all(self):
        """The elements below, in document order, without recursion."""
        stack = self.elements()[::-1]
        while stack:
            e = stack.pop()
            yield e
            stack += e.elements()[::-1]

    def text(self, skip=None) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if x.__class__ is str:
                out.append(x)
            elif x is self or not (x.role == "dropped" or (skip is not None and skip(x)) or amendment_mark(x)):
                stack += x.children[::-1]
        return squeezed(" ".join(out))


def squeezed(text: str) -> str:
    return " ".join(text.split())


def amendment_mark(e: Element) -> bool:
    """An inline arrow that says which act a passage comes from."""
    return e.tag == "span" and "boldface" in e.classes and bool(AMENDMENT_ARROWS.search("".join(c for c in e.children if isinstance(c, str))))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("root", {}, None)

    def handle_starttag(self, tag, attrs):
        # An open paragraph, cell or row ends where another begins, within the nearest table or block.
        while self.now.tag in CLOSES.get(tag, ()) and self.now.parent is not None:
            self.now = self.now.parent
        e = Element(tag, dict(attrs), self.now)
        self.now.children.append(e)
        if tag not in VOID:
            self.now = e

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Element(tag, dict(attrs), self.now))

    def handle_endtag(self, tag):
        at = self.now
        while at is not None and at.tag != tag:
            if at.tag in ("table", "div", "root") and tag in ("p", "span", "td", "tr", "li"):
                return
            at = at.parent
        if at is not None and at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.children.append(data)


# A start tag with quoted attributes, an end tag or a text, where all parsers agree on what it is.
_PLAIN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][-a-z]*="[^"<>&]*")*)>|</([a-z][a-z0-9]*)>|([^<]+)')
_PLAIN_PAGE = re.compile(r'(?:<[a-z][a-z0-9]*(?: [a-z][-a-z]*="[^"<>&]*")*>|</[a-z][a-z0-9]*>|[^<]+)*+')
_ATTRIBUTE = re.compile(r' ([a-z][-a-z]*)="([^"]*)"')
#: What these hold is not read as tags and texts.
_RAW = re.compile("<(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)[ >]")


def _attributes(text: str) -> tuple[str, frozenset[str], str | None]:
    found = dict(_ATTRIBUTE.findall(text))
    return found.get("id", ""), *_class_of(found.get("class", ""))


_repeated = lru_cache(maxsize=4096)(_attributes)


def _plain(html: str) -> Element | None:
    """The DOM of a page of plain tags and texts by one expression, in a fraction of a parser's time; None if something else is on it."""
    if not _PLAIN_PAGE.fullmatch(html) or _RAW.search(html):
        return None
    made = _Builder.__new__(_Builder)
    made.root = now = Element("root", {}, None)
    for tag, attrs, end, data in _PLAIN.findall(html):
        if data:
            now.children.append(unescape(data) if "&" in data else data)
        elif end:
            if now.tag == end and now.parent is not None:
                now = now.parent
            else:
                made.now = now
                made.handle_endtag(end)
                now = made.now
        else:
            closes = CLOSES.get(tag)
            if closes:
                while now.tag in closes and now.parent is not None:
                    now = now.parent
            e = Element.__new__(Element)
            e.tag, e.parent, e.children = tag, now, []
            e.id, e.classes, e.role = (_attributes if 'id="' in attrs else _repeated)(attrs)
            now.children.append(e)
            if tag not in VOID:
                now = e
    return made.root


def build(html: str) -> Element:
    """The DOM of a page. A paragraph that the layout nests in another is its neighbour here."""
    plain = _plain(html or "")
    if plain is not None:
        return plain
    made = _Builder()
    made.feed(html or "")
    made.close()
    return made.root


def is_consolidated(html) -> bool:
    return any(mark in (html or "") for mark in CONSOLIDATED_MARKS)


# --- blocks ------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """kind: text, continuation, heading, annex_title, item, data, quoted or paragraph (with its number and id)."""

    kind: str
    text: str = ""
    marker: str = ""
    inner: list[Block] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    local: str = ""


def _rows(table: Element) -> list[list[Element]]:
    """The cells of a table's own rows."""
    out = []
    for part in table.elements():
        for row in part.elements() if part.tag in ("tbody", "thead", "tfoot") else [part]:
            if row.tag == "tr":
                out.append([c for c in row.elements() if c.tag in ("td", "th")])
    return out


def _marked(cells: list[Element]) -> tuple[str, Element] | None:
    """Marker and content of a row: the first two cells, or of three and more the second and third."""
    if len(cells) < 2:
        return None
    head, content = (cells[1], cells[2]) if len(cells) > 2 else (cells[0], cells[1])
    return head.text(), content


def is_marker(text: str) -> bool:
    return bool(_LABEL.fullmatch(text) or _NUMBER.fullmatch(text) or (text and text in DASHES + "-"))


def _structural(e: Element) -> bool:
    return e.tag == "table" or e.role == "grid"


def _cell_blocks(cell: Element) -> tuple[str, list[Block]]:
    """The own text of an item's content, with quoted new text folded in, and the blocks of its sub-items."""
    below = [b for e in _tops(cell) for b in blocks_of(e)]
    text = cell.text(_structural)
    for b in below:
        if b.kind == "quoted":
            text = f"{text} {b.text}".strip()
    return text, [b for b in below if b.kind in ("item", "data")]


def _tops(e: Element) -> list[Element]:
    """The uppermost tables and grids below an element."""
    out, stack = [], e.elements()[::-1]
    while stack:
        x = stack.pop()
        if _structural(x):
            out.append(x)
        else:
            stack.extend(x.elements()[::-1])
    return out


def _of_table(table: Element) -> list[Block]:
    whole = table.text()
    if whole[:1] and whole[0] in QUOTE_OPENERS:
        return [Block("quoted", whole)]
    rows = _rows(table)
    if not any((m := _marked(r)) and is_marker(m[0]) for r in rows):
        cells = [[t for c in r if (t := c.text())] for r in rows]
        return [Block("data", whole, rows=[c for c in cells if c])]
    out: list[Block] = []
    for r in rows:
        found = _marked(r)
        if found and is_marker(found[0]):
            text, inner = _cell_blocks(found[1])
            out.append(Block("item", text, found[0], inner))
        elif r:
            text = squeezed(" ".join(c.text() for c in r))
            if out:
                out[-1].text = f"{out[-1].text} {text}".strip()
            elif text:
                out.append(Block("continuation", text))
    return out


def _of_grid(grid: Element) -> list[Block]:
    columns = {name: next((e for e in grid.all() if name in e.classes), None) for name in ("grid-list-column-1", "grid-list-column-2")}
    marker, content = columns.values()
    if marker is None or content is None:
        return []
    text, inner = _cell_blocks(content)
    if text[:1] and text[0] in QUOTE_OPENERS and not marker.text():
        return [Block("quoted", text)]
    return [Block("item", text, marker.text(), inner)]


def _paragraph_number(e: Element) -> str | None:
    """Of a body block of the consolidated layout that carries its number in a span of its own."""
    for s in e.all():
        if "no-parag" in s.classes:
            m = re.fullmatch(r"([0-9]+[a-z]?)\.\s*", s.text())
            return m.group(1) if m else None
    return None


def blocks_of(e: Element) -> list[Block]:
    """The blocks that an element stands for."""
    role = e.role
    if role == "dropped" or role == "own_title" or amendment_mark(e):
        return []
    if e.tag == "table":
        return _of_table(e)
    if role == "grid":
        return _of_grid(e)
    if role in ("heading", "annex_title"):
        return [Block(role, e.text())]
    if role == "enumeration":
        parts = [p.text() for p in e.elements() if p.tag == "p"]
        return [Block("item", squeezed(" ".join(parts[1:])), parts[0])] if len(parts) > 1 else []
    below = [b for top in _tops(e) for b in blocks_of(top)]
    text = e.text(_structural)
    if role == "body":
        return [Block("text", text), *below] if text or below else []
    if role == "continuation" or (e.tag == "div" and not e.id and not e.classes):
        return ([Block("continuation", text)] if text else []) + below
    if e.tag == "p" and text:
        return [Block("loose", text), *below]
    return below


# --- the tree ----------------------------------------------------------------------------------------------------


class Tree:
    """Rows in document order. A node's id is the act's and its local id; its path are its ancestors' ids."""

    def __init__(self, celex: str):
        self.celex, self.rows, self.seen = celex, [], {}

    def add(self, kind: str, local: str, text: str, parent: dict | None, number: str | None = None, title: str | None = None) -> dict:
        name = f"{self.celex}_{local}"
        self.seen[name] = self.seen.get(name, 0) + 1
        if self.seen[name] > 1:
            name = f"{name}~{self.seen[name]}"
        row = {"id": name, "kind": kind, "text": text, "title": title, "number": number, "parent_id": parent["id"] if parent else None, "path": [*parent["path"], name] if parent else [name], "ord": 0, "children": 0}
        if parent:
            parent["children"] += 1
            row["ord"] = parent["children"]
        self.rows.append(row)
        return row

    def local(self, row: dict) -> str:
        return row["id"][len(self.celex) + 1 :]


def add_items(tree: Tree, parent: dict, blocks: list[Block]) -> None:
    """Points (roman items below points) and indents below a node; quoted new text becomes part of the node's own."""
    kind, mark = ("point", "pt") if parent["kind"] in ("article", "paragraph", "subparagraph") else ("roman_item", "rm")
    dashes, base = 0, tree.local(parent)
    for b in blocks:
        if b.kind == "quoted":
            parent["text"] = f"{parent['text']} {b.text}".strip()
        if b.kind != "item":
            continue
        label = _LABEL.fullmatch(b.marker)
        if label:
            node = tree.add(kind, f"{base}_{mark}_{label.group(1)}", b.text, parent, label.group(1))
        elif b.marker and b.marker in DASHES:
            dashes += 1
            node = tree.add("indent", f"{base}_ind_{dashes}", b.text, parent, str(dashes))
        else:
            continue
        add_items(tree, node, b.inner)


def grouped(blocks: list[Block]) -> list[tuple[str, list[Block]]]:
    """Subparagraphs: a text opens one, items and tables belong to the open one, continuations go on with its text."""
    out: list[list] = []
    for b in blocks:
        if b.kind == "text":
            out.append([b.text, []])
        elif b.kind in ("item", "quoted", "data"):
            if not out:
                out.append(["", []])
            out[-1][1].append(b)
        elif b.kind == "continuation":
            if out:
                out[-1][0] = f"{out[-1][0]} {b.text}".strip()
            else:
                out.append([b.text, []])
    return [(text, items) for text, items in out]


def _number_id(number: str) -> str:
    """3 -> 003, 10a -> 010a"""
    digits, letter = re.fullmatch(r"([0-9]+)([a-z]?)", number).groups()
    return f"{int(digits):03d}{letter}"


class Act:
    def __init__(self, html: str | None, celex: str, title: str | None = None):
        self.dom, self.tree = build(html or ""), Tree(celex)
        self.every = list(self.dom.all())
        self.by_id: dict[str, Element] = {}
        for e in self.every:
            if e.id:
                self.by_id.setdefault(e.id, e)
        head = self.by_id.get(TITLE_ID)
        self.root = self.tree.add("document", "document", (head.text() if head is not None and "eli-main-title" in head.classes else "") or title or celex, None)

    def title(self, local: str) -> str | None:
        found = self.by_id.get(f"{local}.tit_1")
        return found.text() if found is not None else None

    def rows(self) -> list[dict]:
        self.preamble()
        self.enacting()
        if FINAL_ID in self.by_id:
            self.tree.add("final_provisions", FINAL_ID, self.by_id[FINAL_ID].text(), self.root)
        self.annexes()
        return self.tree.rows

    # --- preamble ---

    def preamble(self) -> None:
        part = self.by_id.get(PREAMBLE_ID)
        if part is None:
            return
        node = self.tree.add("preamble", "preamble", "", self.root)
        of = lambda prefix: [e for e in part.all() if e.tag == "div" and re.match(prefix + "[0-9]", e.id)]
        for e in of("cit_"):
            self.tree.add("citation", e.id, e.text(), node, e.id.rsplit("_", 1)[-1])
        recitals = of("rct_")
        for e in recitals:
            self.tree.add("recital", e.id, e.text(), node, e.id.rsplit("_", 1)[-1])
        if not recitals:  # the older layout: rows of a number and a text
            for row in (e for e in part.all() if e.tag == "tr"):
                cells = [c.text() for c in row.elements() if c.tag in ("td", "th")]
                if len(cells) > 1 and cells[0][:1].isdigit():
                    self.tree.add("recital", f"rct_{cells[0]}", cells[1], node, cells[0])

    # --- enacting terms ---

    def enacting(self) -> None:
        part = self.by_id.get(ENACTING_ID)
        if part is None:
            return
        node = self.tree.add("enacting_terms", ENACTING_ID, "", self.root)
        chapters = [(e, m) for e in part.elements() if (m := _CHAPTER.fullmatch(e.id))]
        for e, m in chapters:
            title = self.title(e.id)
            self.sections(self.tree.add("chapter", e.id, title or "", node, m.group(1), title), e)
        if not chapters:
            self.sections(node, part)

    def sections(self, parent: dict, element: Element) -> None:
        found = [(e, m) for e in element.elements() if (m := _SECTION.fullmatch(e.id))]
        for e, m in found:
            title = self.title(e.id)
            self.articles(self.tree.add("section", e.id, title or "", parent, m.group(1), title), e)
        if not found:
            self.articles(parent, element)

    def articles(self, parent: dict, element: Element) -> None:
        found = [(e, m) for e in element.elements() if (m := _ARTICLE.fullmatch(e.id))]
        for e, m in found:
            title = self.title(e.id)
            self.article(self.tree.add("article", e.id, title or "", parent, m.group(1) + m.group(2), title), e)
        if found:
            return
        # Paragraphs without an article around them: by the first half of their ids.
        of: dict[str, list[Element]] = {}
        for e in element.elements():
            m = _PARAGRAPH.fullmatch(e.id)
            if m:
                of.setdefault(m.group(1), []).append(e)
        for number, some in of.items():
            plain = number.lstrip("0")
            article = self.tree.add("article", f"art_{plain}", self.title(f"art_{plain}") or "", parent, plain)
            for e in some:
                self.paragraph(article, e.id, self.content(e), [])

    def content(self, e: Element) -> list[Block]:
        """The blocks of an element's children; loose text counts as body where there is no other."""
        out = [b for c in e.elements() for b in blocks_of(c)]
        if not any(b.kind == "text" for b in out):
            out = [Block("text", b.text) if b.kind == "loose" else b for b in out]
        out = [b for b in out if b.kind != "loose"]
        own = squeezed(" ".join(c for c in e.children if isinstance(c, str)))
        return [Block("text", own), *out] if own and not any(b.kind == "text" for b in out) else out

    def article(self, article: dict, element: Element) -> None:
        """Numbered paragraphs with what trails them; without any the article's own text or subparagraphs."""
        number = article["number"]
        paragraphs: list[tuple[str, str, list[Block], list[Block]]] = []
        loose: list[Block] = []
        for e in element.elements():
            m = _PARAGRAPH.fullmatch(e.id) if e.tag == "div" else None
            own_number = _paragraph_number(e) if not m and e.role == "body" else None
            detached = re.match(r"([0-9]+)\s+(?=\S)", e.text()) if not m and own_number is None and e.tag == "div" and not e.id and e.role == "body" else None
            if m:
                paragraphs.append((e.id, m.group(2).lstrip("0") or "0", self.content(e), []))
            elif own_number is not None:
                inner = [Block(b.kind, re.sub(r"^[0-9]+[a-z]?\.\s*", "", b.text) if b.kind == "text" else b.text, b.marker, b.inner, b.rows) for b in blocks_of(e)]
                paragraphs.append((f"{_number_id(number)}.{_number_id(own_number)}", own_number, inner, []))
            elif detached and number.isdigit():
                inner = blocks_of(e)
                inner[0].text = inner[0].text[detached.end() :]
                paragraphs.append((f"{int(number):03d}.{int(detached.group(1)):03d}", detached.group(1), inner, []))
            elif e.id == f"{element.id}.tit_1":
                continue
            else:
                (paragraphs[-1][3] if paragraphs else loose).extend(blocks_of(e))
        for local, n, own, trailing in paragraphs:
            self.paragraph(article, local, own, [b for b in trailing if b.kind != "loose"], n)
        if not paragraphs:
            parts = grouped([b for b in loose if b.kind != "loose"])
            if not parts:
                body = element.text(_structural)
                if body:
                    article["text"] = body
            elif len(parts) == 1:
                article["text"] = parts[0][0]
                add_items(self.tree, article, parts[0][1])
            else:
                self.subparagraphs(article, element.id, parts)

    def paragraph(self, article: dict, local: str, own: list[Block], trailing: list[Block], number: str | None = None) -> None:
        number = number or _PARAGRAPH.fullmatch(local).group(2).lstrip("0") or "0"
        parts = grouped(own) or [("", [])]
        # Continuations behind a paragraph go on with it; a text begins its next subparagraph.
        parts += grouped(trailing)
        if len(parts) == 1:
            node = self.tree.add("paragraph", local, parts[0][0], article, number)
            add_items(self.tree, node, parts[0][1])
        else:
            self.subparagraphs(self.tree.add("paragraph", local, "", article, number), local, parts)

    def subparagraphs(self, parent: dict, local: str, parts: list[tuple[str, list[Block]]]) -> None:
        for n, (text, items) in enumerate(parts, 1):
            node = self.tree.add("subparagraph", f"{local}_sp_{n}", text, parent, str(n))
            add_items(self.tree, node, items)

    # --- annexes ---

    def annexes(self) -> None:
        consolidated = any("grid-list" in e.classes or "norm" in e.classes for e in self.every)
        found = [(e, m) for e in self.every if e.tag == "div" and (m := _ANNEX.fullmatch(e.id)) and e.id != SIGNATURES_ID and (consolidated or "eli-container" in e.classes)]
        if not found:
            return
        root = self.tree.add("annexes", "annexes", "", self.root)
        for e, m in found:
            titles = [t for c in e.elements() if c.role == "annex_title" and (t := c.text())]
            title = (titles[1] if len(titles) > 1 else titles[0] if titles else self.title(e.id)) or e.id
            Annex(self.tree, self.tree.add("annex", e.id, title, root, m.group(1), title)).read(self.flat(e))

    def flat(self, e: Element) -> list[Block]:
        """The blocks of an annex; wrappers without a role are looked through."""
        out: list[Block] = []
        for c in e.elements():
            if c.role in (None, "continuation") and c.tag == "div" and not c.id.endswith(".tit_1"):
                out += self.flat(c)
            else:
                out += [b for b in blocks_of(c) if b.kind != "annex_title"]
        return out


def dotted(text: str) -> tuple[str, str, int] | None:
    """Number, the rest and depth of a text that starts with a dotted number: '1.1.  Sub' -> ('1.1', 'Sub', 2)."""
    m = _DOTTED.match(text)
    return (m.group(1), text[m.end() :].strip(), m.group(1).count(".") + 1) if m else None


class Annex:
    """Nests an annex's blocks: chapters, parts and named sections at depth 0, dotted numbers at the number of their parts."""

    def __init__(self, tree: Tree, node: dict):
        self.tree, self.node, self.open, self.bullets = tree, node, [(-1, node)], {}

    @property
    def top(self) -> dict:
        return self.open[-1][1]

    def under(self, depth: int) -> dict:
        while len(self.open) > 1 and self.open[-1][0] >= depth:
            self.open.pop()
        return self.top

    def opened(self, depth: int, kind: str, local: str, text: str, number: str, title: str | None = None) -> None:
        self.open.append((depth, self.tree.add(kind, local, text, self.under(depth), number, title)))

    def append(self, text: str) -> None:
        self.top["text"] = f"{self.top['text']} {text}".strip()

    def read(self, blocks: list[Block]) -> None:
        k = 0
        while k < len(blocks):
            b = blocks[k]
            k += 1
            if b.kind == "heading":
                k += self.heading(b.text, blocks[k] if k < len(blocks) else None)
            elif b.kind in ("text", "loose", "continuation", "quoted"):
                numbered = dotted(b.text) if b.kind == "text" else None
                if numbered:
                    self.opened(numbered[2], "annex_point", f"{self.tree.local(self.under(numbered[2]))}_{numbered[0]}", numbered[1], numbered[0])
                elif b.text:
                    self.append(b.text)
            elif b.kind == "data":
                for n, row in enumerate(b.rows, 1):
                    self.tree.add("annex_row", f"{self.tree.local(self.top)}_r{n}", CELL_MARK.join(row), self.top, "")
            elif b.kind == "item":
                self.item(b)

    def heading(self, text: str, following: Block | None) -> int:
        """Opens what the heading names; gives 1 if the following heading was taken as its title."""
        if not text:
            return 0
        for pattern, kind, mark in ((r"chapter\s+([IVXLCDM]+)", "annex_chapter", "chp"), (r"part\s+([A-Z])\b", "annex_part", "part")):
            m = re.match(pattern, text, re.IGNORECASE)
            if m:
                number = m.group(1) if mark == "chp" else m.group(1).upper()
                title = following.text if following is not None and following.kind == "heading" and following.text and not self.named(following.text) else None
                self.opened(0, kind, f"{self.tree.local(self.node)}_{mark}_{number}", title or text, number, title or text)
                return int(title is not None)
        m = re.match(r"section\s+([A-Z0-9]+)\.?\s*(.*)", text, re.IGNORECASE)
        if m:
            title = m.group(2).strip() or text
            self.opened(0, "annex_section", f"{self.tree.local(self.node)}_sec_{m.group(1)}", title, m.group(1), title)
            return 0
        numbered = dotted(text)
        if numbered:
            number, title, depth = numbered
            self.opened(depth, "annex_section" if depth == 1 else "annex_subsection", f"{self.tree.local(self.under(depth))}_{number}", title, number, title)
        elif len(self.open) == 1:
            self.node["text"] = self.node["title"] = text
        elif self.top["kind"] in ("annex_chapter", "annex_part") and not self.top["children"]:
            self.top["text"] = self.top["title"] = text
        else:
            self.append(text)
        return 0

    @staticmethod
    def named(text: str) -> bool:
        return bool(dotted(text) or re.match(r"chapter\s+[IVXLCDM]+|part\s+[A-Z]\b|section\s+[A-Z0-9]+", text, re.IGNORECASE))

    def item(self, b: Block) -> None:
        number, letter = _NUMBER.fullmatch(b.marker), _LETTER.fullmatch(b.marker)
        if number:
            depth = number.group(1).count(".") + 1
            self.opened(depth, "annex_point", f"{self.tree.local(self.under(depth))}_{number.group(1)}", b.text, number.group(1))
        elif letter:
            self.tree.add("annex_subpoint", f"{self.tree.local(self.top)}_{letter.group(1).lower()}", b.text, self.top, letter.group(1).lower())
        elif b.marker and b.marker in DASHES + "-":
            self.bullets[self.top["id"]] = self.bullets.get(self.top["id"], 0) + 1
            self.tree.add("annex_bullet", f"{self.tree.local(self.top)}_blt_{self.bullets[self.top['id']]}", b.text, self.top)
        else:
            self.append(f"{b.marker} {b.text}".strip())
        self.read(b.inner)


def parse_act(html: str | None, celex: str, title: str | None = None) -> list[dict]:
    """The provision rows of a page in document order."""
    rows = Act(html, celex, title).rows()
    for seq, row in enumerate(rows):
        row["seq"] = seq
    return rows


# --- on tables ---------------------------------------------------------------------------------------------------

PROVISION = T.StructType(
    [T.StructField("celex", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("number", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType()))]
)
_ARROW = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]


#: Rows of a batch that goes back to Spark, but for a longer page.
ROWS = 4_096


def parse(pages: DataFrame, columns: tuple[str, ...] = tuple(PROVISION.names)) -> DataFrame:
    """The provisions of pages (celex, html): one Arrow pass, a page at a time. columns: those that are wanted."""
    schema = T.StructType([PROVISION[c] for c in columns])
    kinds = [_ARROW[PROVISION.names.index(c)] for c in columns]
    value = {"depth": lambda celex, r: len(r["path"]) - 1, "celex": lambda celex, r: celex}
    of = [value.get(c) or (lambda celex, r, c=c: r[c]) for c in columns]

    def run(batches):
        lists: list[list] = [[] for _ in columns]

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(lists, kinds)], names=list(columns))
            for x in lists:
                x.clear()
            return batch

        for b in batches:
            for celex, html in zip(b.column("celex").to_pylist(), b.column("html").to_pylist()):
                rows = parse_act(html, celex or "")
                for x, f in zip(lists, of):
                    x += [f(celex, r) for r in rows]
                if len(lists[0]) >= ROWS:
                    yield taken()
        if lists[0]:
            yield taken()

    return pages.select("celex", "html").mapInArrow(run, schema)


def graft_preamble(provisions: DataFrame, original: DataFrame) -> DataFrame:
    """provisions with the preamble of the original act for those acts that have none, as the document's first part.

    Nodes whose id the act already has are left out; an act whose original has no recital stays as it is.
    """
    kinds = F.col("kind").isin("preamble", "citation", "recital")
    lacking = provisions.select("celex").distinct().join(provisions.filter("kind = 'preamble'").select("celex").distinct(), "celex", "left_anti")
    useful = original.filter("kind = 'recital'").select("celex").distinct()
    taken = original.filter(kinds).join(lacking, "celex", "left_semi").join(useful, "celex", "left_semi").join(provisions.select("celex", "id"), ["celex", "id"], "left_anti")
    grafted = taken.select("celex").distinct().withColumn("__grafted", F.lit(True))
    moved = provisions.join(grafted, "celex", "left").withColumn("__first", F.coalesce(F.col("__grafted"), F.lit(False)) & (F.size("path") == 2))
    moved = moved.withColumn("ord", F.when(F.col("__first"), F.col("ord") + 1).otherwise(F.col("ord")))
    # Document order: the root, the preamble, then the rest.
    shifted = F.when(F.col("kind") == "document", F.struct(F.lit(0).alias("part"), "seq")).otherwise(F.struct(F.lit(2).alias("part"), "seq"))
    rows = moved.withColumn("place", shifted).select(*provisions.columns, "place").unionByName(taken.withColumn("place", F.struct(F.lit(1).alias("part"), "seq")).withColumn("ord", F.when(F.col("kind") == "preamble", F.lit(1).cast("long")).otherwise(F.col("ord"))).select(*provisions.columns, "place"))
    from pyspark.sql import Window

    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("celex").orderBy("place", "id")) - 1).cast("long")).drop("place")


def stamped(provisions: DataFrame) -> DataFrame:
    """Adds binding_force (interpretive for preamble, citations, recitals) and source_type."""
    return provisions.withColumn("binding_force", F.when(F.col("kind").isin("preamble", "citation", "recital"), "interpretive").otherwise("binding")).withColumn("source_type", F.lit("regulation"))


def diagnosis(pages: DataFrame) -> DataFrame:
    """celex, what, n: counts of tags, classes and structural ids of each page, to compare two layouts by a full join."""

    names = ["celex", "what", "n"]
    kinds = (pa.string(), pa.string(), pa.int64())

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for celex, html in zip(b.column("celex").to_pylist(), b.column("html").to_pylist()):
                counts: Counter = Counter()
                for e in build(html or "").all():
                    counts[f"tag:{e.tag}"] += 1
                    for c in e.classes:
                        counts[f"class:{c}"] += 1
                    if e.id:
                        for name, pattern in (("article", _ARTICLE), ("paragraph", _PARAGRAPH), ("chapter", _CHAPTER), ("section", _SECTION), ("annex", _ANNEX)):
                            if pattern.fullmatch(e.id):
                                counts[f"id:{name}"] += 1
                rows += [(celex, what, n) for what, n in counts.items()]
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return pages.select("celex", "html").mapInArrow(run, "celex string, what string, n long")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """celex, what, n_left, n_right where two diagnoses differ."""
    both = left.withColumnRenamed("n", "n_left").join(right.withColumnRenamed("n", "n_right"), ["celex", "what"], "full")
    return both.filter(~F.col("n_left").eqNullSafe(F.col("n_right")))
