"""References in legal prose: a tokenizer of their parts and a small grammar over the tokens.

Five families are read: explicit (Article 5(1), point (g); Annex III, Section A; point 4.2 of Annex VII; Section 2 of
Chapter III), range (Articles 102 to 109; paragraphs 6, 7 and 9), relative (this Article; the first subparagraph;
paragraph 3, point (b); referred to in paragraph 2), external (Regulation (EU) 2016/679) and amended (an act "as amended
by" another). Each reading is a set of named parts; resolve.py turns them into nodes.

Defined results: a null or empty text has no references; equal texts have equal references; positions count code points of
the text without footnote marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

# The words that references are made of.
ORDINALS = ("first", "second", "third", "fourth", "fifth")
ACT_TYPES = ("regulation", "directive", "decision")
SERIES = ("eu", "ec", "eec", "euratom")
SUFFIXES = ("ec", "eu", "eea", "eec", "euratom")
INSTITUTIONS = ("council", "commission")
LOCATORS = (("referred", "to", "in"), ("pursuant", "to"), ("in", "accordance", "with"))
#: Anaphoric targets: of "this ...", and of "of this ...".
THIS, OF_THIS = ("paragraph", "subparagraph", "article"), ("article", "paragraph")

#: A span of more numbers than this is not listed: a list has its two ends, and resolve.resolve() looks up what the act has between them.
MOST_RANGE = 10_000

FOOTNOTE = re.compile(r"\s*\(\s+[0-9]+\s+\)")
_TOKEN = re.compile(r"(?P<act>[0-9]+/[0-9]+)|(?P<decimal>[0-9]+\.[0-9]+)|(?P<number>[0-9]+)|(?P<bracket>\([A-Za-z0-9]+\))|(?P<word>[^\W\d_]+)|(?P<mark>\S)")
_ROMAN = re.compile(r"[IVX]+", re.IGNORECASE)
#: The words that a reading of each family begins with.
OPENERS = {
    "relative": frozenset({"section", "sections", "this", "of", "the", "point", "paragraph", *(words[0] for words in LOCATORS)}),
    "explicit": frozenset({"article", "articles", "annex", "point", "points", "section", "sections", "the", *ORDINALS}),
    "range": frozenset({"article", "articles", "paragraph", "paragraphs", "point", "points"}),
    "external": frozenset({*ACT_TYPES, *INSTITUTIONS}),
    "amended": frozenset(ACT_TYPES),
}
_OPENERS = frozenset().union(*OPENERS.values())


class Token(NamedTuple):
    kind: str
    low: str
    raw: str
    start: int
    end: int


Parts = dict[str, str]
Reading = tuple[int, Parts]  # the token behind the reference, and its parts


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup or "mark", (raw := m.group()).lower(), raw, *m.span()) for m in _TOKEN.finditer(text)]


class Reader:
    """Reads one family's phrases at a place of the tokens. Each method gives the place behind what it read, or None."""

    def __init__(self, text: str):
        self.text, self.t = text, tokens(text)

    # --- parts -------------------------------------------------------------------------------------------------

    def word(self, i: int, *options: str) -> bool:
        return i < len(self.t) and self.t[i].kind == "word" and self.t[i].low in options

    def words(self, i: int, phrase: tuple[str, ...]) -> int | None:
        return i + len(phrase) if all(self.word(i + k, w) for k, w in enumerate(phrase)) else None

    def is_(self, i: int, kind: str) -> bool:
        return i < len(self.t) and self.t[i].kind == kind

    def comma(self, i: int) -> int:
        return i + 1 if self.is_(i, "mark") and self.t[i].raw == "," else i

    def glued(self, i: int) -> bool:
        """Nothing stands between this token and the one before."""
        return 0 < i < len(self.t) and self.t[i - 1].end == self.t[i].start

    def bracket(self, i: int, glued: bool, letters: bool = True, digits: bool = True) -> str | None:
        if not self.is_(i, "bracket") or (glued and not self.glued(i)):
            return None
        inner = self.t[i].low[1:-1]
        return inner if (digits and inner.isdigit()) or (letters and not inner.isdigit()) else None

    def annex_number(self, i: int) -> str | None:
        if self.is_(i, "number") or (self.is_(i, "word") and _ROMAN.fullmatch(self.t[i].raw)):
            return self.t[i].raw.upper()
        return None

    def dotted(self, i: int) -> tuple[int, str] | None:
        """A number, perhaps with a second level, perhaps with a letter in brackets behind it."""
        if not (self.is_(i, "number") or self.is_(i, "decimal")):
            return None
        at, value = i + 1, self.t[i].raw
        letter = self.bracket(at, True, digits=False)
        if letter and len(letter) == 1:
            at, value = at + 1, f"{value}({letter})"
        return at, value

    def full_stop(self, i: int) -> int:
        return i + 1 if self.is_(i, "mark") and self.t[i].raw == "." and self.glued(i) else i

    def ordinal_part(self, i: int) -> tuple[int, str] | None:
        """[,] Nth subparagraph"""
        at = self.comma(i)
        if self.word(at, *ORDINALS) and self.word(at + 1, "subparagraph"):
            return at + 2, self.t[at].low
        return None

    def point_part(self, i: int) -> tuple[int, str, str | None] | None:
        """[,] point (x)[(y)]"""
        at = self.comma(i)
        if self.word(at, "point"):
            label = self.bracket(at + 1, False)
            if label:
                under = self.bracket(at + 2, True)
                return (at + 3, label, under) if under else (at + 2, label, None)
        return None

    def tail(self, i: int, parts: Parts) -> int:
        """What may follow an article or a paragraph: an ordinal subparagraph, then a point."""
        found = self.ordinal_part(i)
        if found:
            i, parts["ordinal"] = found
        point = self.point_part(i)
        if point:
            i, parts["point"] = point[0], point[1]
            if point[2]:
                parts["subpoint"] = point[2]
        return i

    def of_annex(self, i: int) -> tuple[int, str] | None:
        if self.word(i, "of") and self.word(i + 1, "annex"):
            number = self.annex_number(i + 2)
            if number:
                return i + 3, number
        return None

    # --- families ----------------------------------------------------------------------------------------------

    def explicit(self, i: int) -> Reading | None:
        return self.decimals_of_annex(i) or self.section_of(i) or self.point_of_annex(i) or self.annex(i) or self.article(i)

    def decimals_of_annex(self, i: int) -> Reading | None:
        """Points 4.3., 4.4 and the fifth paragraph of point 4.6 of Annex VII"""
        if not (self.word(i, "point", "points") and self.is_(i + 1, "decimal")):
            return None
        numbers, at = [self.t[i + 1].raw], self.full_stop(i + 2)
        while self.comma(at) > at and self.is_(at + 1, "decimal"):
            numbers.append(self.t[at + 1].raw)
            at = self.full_stop(at + 2)
        if self.word(at, "and"):
            then = at + 1
            then += self.word(then, "the")
            if self.word(then, *ORDINALS) and self.words(then + 1, ("paragraph", "of")):
                then += 3
            then += self.word(then, "point")
            if self.is_(then, "decimal"):
                numbers.append(self.t[then].raw)
                at = self.full_stop(then + 1)
        annex = self.of_annex(at)
        return (annex[0], {"annex": annex[1], "points": " ".join(numbers)}) if annex else None

    def section_of(self, i: int) -> Reading | None:
        """Section A[, point 2] of Annex I; Section 2 of Chapter III"""
        if not self.word(i, "section", "sections"):
            return None
        single = self.is_(i + 1, "number") or (self.is_(i + 1, "word") and len(self.t[i + 1].raw) == 1)
        if not single:
            return None
        section, at = self.t[i + 1].raw.upper(), i + 2
        if self.is_(i + 1, "number") and self.word(at, "of") and self.word(at + 1, "chapter"):
            chapter = self.annex_number(at + 2)
            return (at + 3, {"chapter": chapter, "section": section}) if chapter else None
        parts = {"section": section}
        then = self.comma(at)
        if self.word(then, "point", "points"):
            number = self.dotted(then + 1)
            if number:
                at, parts["point"] = number
        annex = self.of_annex(at) if self.word(i, "section") else None
        return (annex[0], {"annex": annex[1], **parts, "reversed": "yes"}) if annex else None

    def point_of_annex(self, i: int) -> Reading | None:
        """[[the] Nth paragraph of] point 2(a) of Annex IV"""
        at = i + self.word(i, "the")
        if self.word(at, *ORDINALS) and self.words(at + 1, ("paragraph", "of")):
            at += 3
        elif at > i:
            return None
        if self.word(at, "point"):
            number = self.dotted(at + 1)
            annex = self.of_annex(self.full_stop(number[0])) if number else None
            if annex:
                return annex[0], {"annex": annex[1], "point": number[1]}
        return None

    def annex(self, i: int) -> Reading | None:
        number = self.annex_number(i + 1) if self.word(i, "annex") else None
        if not number:
            return None
        parts, at = {"annex": number}, i + 2
        then = self.comma(at)
        if self.word(then, "section") and (self.is_(then + 1, "number") or (self.is_(then + 1, "word") and len(self.t[then + 1].raw) == 1)):
            at, parts["section"] = then + 2, self.t[then + 1].raw.upper()
            then = self.comma(at)
        if self.word(then, "point", "points"):
            point = self.dotted(then + 1)
            if point:
                at, parts["point"] = point
        return at, parts

    def article(self, i: int) -> Reading | None:
        if not (self.word(i, "article", "articles") and self.is_(i + 1, "number")):
            return None
        parts, at = {"article": self.t[i + 1].raw}, i + 2
        paragraph = self.bracket(at, True, letters=False)
        if paragraph:
            at, parts["paragraph"] = at + 1, paragraph
        return self.tail(at, parts), parts

    def range_(self, i: int) -> Reading | None:
        if not (self.word(i, "article", "articles", "paragraph", "paragraphs", "point", "points") and self.is_(i + 1, "number")):
            return None
        unit = self.t[i].low.rstrip("s")

        def number(at: int) -> tuple[int, str] | None:
            if not self.is_(at, "number"):
                return None
            inner = self.bracket(at + 1, True, letters=False)
            return (at + 2, f"{self.t[at].raw}({inner})") if inner else (at + 1, self.t[at].raw)

        at, first = number(i + 1)
        if self.word(at, "to"):
            last = number(at + 1)
            bare = self.bracket(at + 1, False, letters=False)
            if last:
                return last[0], {"unit": unit, "first": first, "last": last[1]}
            return (at + 2, {"unit": unit, "first": first, "last": f"({bare})"}) if bare else None
        listed = [first]
        while self.comma(at) > at:
            more = number(at + 1)
            if not more:
                break
            at = more[0]
            listed.append(more[1])
        more = number(at + 1) if self.word(at, "and") else None
        return (more[0], {"unit": unit, "listed": " ".join([*listed, more[1]])}) if more else None

    def relative(self, i: int) -> Reading | None:
        return self.section_of_this(i) or self.this(i) or self.ordinal_subparagraph(i) or self.point_of(i) or self.paragraph(i) or self.located(i)

    def section_of_this(self, i: int) -> Reading | None:
        if self.word(i, "section", "sections") and self.is_(i + 1, "number") and self.words(i + 2, ("of", "this")) and self.word(i + 4, "chapter", "regulation"):
            return i + 5, {"section": self.t[i + 1].raw, "scope": self.t[i + 4].low}
        return None

    def this(self, i: int) -> Reading | None:
        of = self.word(i, "of") and self.word(i + 1, "this")
        at = i + 1 if of else i
        if self.word(at, "this") and self.word(at + 1, *(OF_THIS if of else THIS)) and not (self.is_(at + 2, "number") or self.is_(at + 2, "decimal") or self.is_(at + 2, "act")):
            return at + 2, {"this": self.t[at + 1].low}
        return None

    def ordinal_subparagraph(self, i: int) -> Reading | None:
        if not (self.word(i, "the") and self.word(i + 1, *ORDINALS) and self.word(i + 2, "subparagraph")):
            return None
        parts, at = {"ordinal": self.t[i + 1].low, "the": "yes"}, i + 3
        if self.word(at, "of"):
            then = at + 1 + self.word(at + 1, "this")
            if self.word(then, "paragraph") and self.is_(then + 1, "number"):
                return then + 2, {**parts, "paragraph": self.t[then + 1].raw}
            if self.word(then, "article"):
                return then + 1, parts
        return at, parts

    def point_of(self, i: int) -> Reading | None:
        """point (x)[(y)] of the Nth subparagraph, of [this] paragraph or Article, thereof"""
        label = self.bracket(i + 1, False, digits=False) if self.word(i, "point") else None
        if not label or len(label) != 1:
            return None
        parts, at = {"point": label}, i + 2
        under = self.bracket(at, True)
        if under:
            at, parts["subpoint"] = at + 1, under
        if self.word(at, "thereof"):
            return at + 1, {**parts, "of": "thereof"}
        if not self.word(at, "of"):
            return None
        then = at + 1 + self.word(at + 1, "the")
        if self.word(then, *ORDINALS) and self.word(then + 1, "subparagraph"):
            return then + 2, {**parts, "of": f"{self.t[then].low} subparagraph"}
        then = at + 1 + self.word(at + 1, "this")
        return (then + 1, {**parts, "of": self.t[then].low}) if self.word(then, "paragraph", "article") else None

    def paragraph(self, i: int) -> Reading | None:
        if not (self.word(i, "paragraph") and self.is_(i + 1, "number")):
            return None
        parts, at = {"paragraph": self.t[i + 1].raw}, i + 2
        ordinal = self.ordinal_part(at) if self.comma(at) > at else None
        if ordinal:
            at, parts["ordinal"] = ordinal
        point = self.point_part(at) if self.comma(at) > at else None
        if point and len(point[1]) == 1 and point[1].isalpha():
            parts["point"] = point[1]
            at = point[0] - (1 if point[2] else 0)
        return at, parts

    def located(self, i: int) -> Reading | None:
        """referred to in, pursuant to or in accordance with [this] paragraph or Article N"""
        for phrase in LOCATORS:
            at = self.words(i, phrase)
            if at is None:
                continue
            at += self.word(at, "this")
            if self.word(at, "paragraph", "article") and self.is_(at + 1, "number"):
                parts, then = {"via": " ".join(phrase), self.t[at].low: self.t[at + 1].raw}, at + 2
                if self.comma(then) > then:
                    ordinal = self.ordinal_part(then)
                    if ordinal:
                        then, parts["ordinal"] = ordinal
                point = self.point_part(then) if self.comma(then) > then else None
                if point:
                    then, parts["point"] = point[0], point[1]
                    if point[2]:
                        parts["subpoint"] = point[2]
                return then, parts
        return None

    def act(self, i: int, plural: bool = False) -> Reading | None:
        """Regulation (EU) No 2016/679[/EC]"""
        if not self.word(i, *ACT_TYPES):
            return None
        parts, at = {"type": self.t[i].low}, i + 1
        if self.is_(at, "bracket") and self.t[at].low[1:-1] in SERIES:
            at, parts["series"] = at + 1, self.t[at].low[1:-1]
        at += self.word(at, "no")
        if not self.is_(at, "act"):
            return None
        at, parts["number"] = at + 1, self.t[at].raw
        if self.is_(at, "mark") and self.t[at].raw == "/" and self.glued(at) and self.word(at + 1, *SUFFIXES) and self.glued(at + 1):
            at, parts["suffix"] = at + 2, self.t[at + 1].low
        return at, parts

    def external(self, i: int) -> Reading | None:
        if self.word(i, *INSTITUTIONS):
            found = self.act(i + 1)
            return (found[0], {"institution": self.t[i].low, **found[1]}) if found else None
        return self.act(i)

    def amended(self, i: int) -> Reading | None:
        base = self.act(i)
        by = self.words(base[0], ("as", "amended", "by")) if base else None
        other = self.act(by) if by is not None else None
        return (other[0], {**{f"base_{k}": v for k, v in base[1].items()}, **{f"by_{k}": v for k, v in other[1].items()}}) if other else None

    def all_of(self, read: Callable[[int], Reading | None], places: list[int] | None = None) -> Iterator[tuple[int, int, Parts]]:
        """The leftmost readings of a family that share no token. places: the tokens where one may begin, if they are known."""
        free = 0
        for i in self.openers(_OPENERS) if places is None else places:
            found = read(i) if i >= free else None
            if found:
                yield self.t[i].start, self.t[found[0] - 1].end, found[1]
                free = found[0]

    def openers(self, words: frozenset[str]) -> list[int]:
        return [i for i, t in enumerate(self.t) if t[1] in words]


def contained(spans: list[dict]) -> list[dict]:
    """Without the spans that lie strictly in one that is kept; by start, longest first. Partial overlaps and equal spans stay."""
    out: list[dict] = []
    reach = opened = -1  # the furthest end of the kept, and the first start with that end
    for s in sorted(spans, key=lambda s: (s["start"], -(s["end"] - s["start"]))):
        if s["end"] < reach or (s["end"] == reach and opened < s["start"]):
            continue
        out.append(s)
        if s["end"] > reach:
            reach, opened = s["end"], s["start"]
    return out


def references_in(text: str | None) -> list[dict]:
    """kind, start, end, match, groups (the parts) of each reference, without those strictly inside a longer one."""
    return references_of(Reader(FOOTNOTE.sub("", text or "")))


def references_of(reader: Reader) -> list[dict]:
    families = {"relative": reader.relative, "explicit": reader.explicit, "range": reader.range_, "external": reader.external, "amended": reader.amended}
    some, found = reader.openers(_OPENERS), []
    for kind, read in families.items():
        places = [i for i in some if reader.t[i][1] in OPENERS[kind]]
        found += [{"kind": kind, "start": a, "end": b, "match": reader.text[a:b], "groups": list(parts.items())} for a, b, parts in reader.all_of(read, places)] if places else []
    return contained(found) if len(found) > 1 else found


#: Tokens that a qualifier in front of an act may have.
MOST_QUALIFIER = 16


def qualifier_before(reader: Reader, place: int) -> str | None:
    """The article or annex that "of" or "to" ties to the act whose first token is at place: 'Article 5(1), point (a) of' in front of it."""
    head = Reader("")
    head.t = reader.t[max(0, place - MOST_QUALIFIER - 1) : place]  # with the token before, which glued() looks at
    if not head.t or not head.word(len(head.t) - 1, "of", "to"):
        return None
    for i in range(max(0, len(head.t) - MOST_QUALIFIER), len(head.t)):
        found = head.article(i) or head.annex(i)
        if found and found[0] == len(head.t) - 1 and head.t[i].kind == "word":
            return reader.text[head.t[i].start : head.t[-1].end]
    return None


def located_references(text: str | None) -> list[dict]:
    """references_in, with the part "qualified" on external acts that an article or annex of theirs is named before.

    No reading depends on what a number is: short texts that differ in their numbers alone are read once, and the numbers put in.
    """
    text = FOOTNOTE.sub("", text or "")
    if len(text) > MOST_SHAPE:
        return _located(text)
    parts = _NUMBER.split(text)
    numbers = parts[1::2]
    moved = [0]
    for k, number in enumerate(numbers):
        moved.append(moved[-1] + len(number) - len(str(k)))
    fill = lambda said: _NUMBER.sub(lambda m: numbers[int(m.group())], said)
    return [
        {"kind": kind, "start": start + moved[before], "end": end + moved[within], "match": fill(match), "groups": [(k, fill(v)) for k, v in groups]}
        for kind, start, before, end, within, match, groups in _shaped(tuple(parts[::2]))
    ]


_NUMBER = re.compile("([0-9]+)")
#: Code points of a text that is read by its shape, and how many shapes are kept.
MOST_SHAPE, MOST_SHAPES = 400, 4096


@lru_cache(MOST_SHAPES)
def _shaped(between: tuple[str, ...]) -> list[tuple]:
    """The references of a text whose numbers are their places, 0, 1, ...; with start and end, how many numbers stand before them."""
    text = between[0] + "".join(f"{k}{said}" for k, said in enumerate(between[1:]))
    count = lambda end: len(_NUMBER.findall(text[:end]))
    return [(x["kind"], x["start"], count(x["start"]), x["end"], count(x["end"]), x["match"], x["groups"]) for x in _located(text)]


def _located(text: str) -> list[dict]:
    reader = Reader(text)
    out = references_of(reader)
    places = {t.start: k for k, t in enumerate(reader.t)} if any(found["kind"] == "external" for found in out) else {}
    for found in out:
        if found["kind"] == "external":
            before = qualifier_before(reader, places[found["start"]])
            if before:
                found["groups"] = [*found["groups"], ("qualified", before)]
    return out


def parse_reference(text: str | None) -> Parts:
    """The parts of the first article or annex that a reference text names, in normal or reversed order; empty if none."""
    reader = Reader(text or "")
    for _, _, parts in reader.all_of(reader.explicit):
        return parts
    return {}


def between(first: int, last: int) -> list[str]:
    """The numbers of a span; its ends if there are too many to list, nothing if it runs backwards."""
    return [str(first), str(last)] if last - first > MOST_RANGE else [str(n) for n in range(first, last + 1)]


def expanded(parts: Parts) -> list[str]:
    """The numbers of a range or an enumeration, with paragraphs in brackets kept in enumerations: 102 to 104; 8, 9 and 11(2)."""
    if "listed" in parts:
        return parts["listed"].split()
    first, last = (int(re.match(r"\(?([0-9]+)", parts[k]).group(1)) for k in ("first", "last"))
    return between(first, last)


# --- guidance: references to acts by their short names ----------------------------------------------------------


def guidance_references(text: str | None, names: dict[str, str]) -> list[dict]:
    """number, ref_text, how: the acts' provisions that a guidance text refers to. names: short name to number.

    An article or annex belongs to the act named behind it (how: named; a pair of short names joined by / means both); one
    behind which "of" another abbreviation stands to none; any other to the act mentioned nearest to it (near). An act
    without a provision is referred to as a whole (whole). Each number and text once, in that order.
    """
    reader = Reader(text or "")
    known = {k.lower(): v for k, v in names.items()}
    t, mentions, provisions, named = reader.t, [], [], []

    def short(at: int) -> tuple[int, list[str]] | None:
        if not (reader.is_(at, "word") and t[at].low in known):
            return None
        numbers, end = [known[t[at].low]], at + 1
        while reader.is_(end, "mark") and t[end].raw == "/" and reader.is_(end + 1, "word") and t[end + 1].low in known:
            numbers.append(known[t[end + 1].low])
            end += 2
        return end, numbers

    i = 0
    while i < len(t):
        act = reader.external(i)
        name = short(i)
        abbreviated = reader.word(i, "art") and reader.is_(i + 1, "mark") and t[i + 1].raw == "."
        if act:
            mentions.append((t[i].start, t[act[0] - 1].end, act[1]["number"]))
            i = act[0]
        elif name:
            mentions += [(t[i].start, t[name[0] - 1].end, n) for n in name[1]]
            i = name[0]
        elif reader.word(i, "article", "articles", "annex", "art"):
            at = i + 1 + abbreviated
            if reader.word(i, "annex"):
                number = reader.annex_number(at) if reader.is_(at, "word") else None
                ref, at = f"Annex {number}", at + 1
            else:
                number = t[at].raw if reader.is_(at, "number") else None
                at += 1
                inner = reader.bracket(at, False, letters=False) if number else None
                at += inner is not None
                while number and (reader.bracket(at, False) or "") and reader.glued(at):
                    at += 1
                point = reader.point_part(at) if number else None
                at, label, under = point or (at, None, None)
                ref = f"Article {number}" + (f"({inner})" if inner else "") + (f", point ({label})" if label else "") + (f"({under})" if under else "")
            if not number:
                i += 1
                continue
            after = at + reader.word(at, "of")
            after += after > at and reader.word(after, "the")
            owner = short(after)
            if owner:
                named += [(n, ref) for n in owner[1]]
                mentions += [(t[after].start, t[owner[0] - 1].end, n) for n in owner[1]]
                at = owner[0]
            elif not (after > at and reader.is_(after, "word") and len(t[after].raw) > 1 and t[after].raw.isupper()):
                provisions.append((t[i].start, ref))
            i = at
        else:
            i += 1
    near = []
    for place, ref in provisions:
        if mentions:
            nearest = min(mentions, key=lambda m: min(abs(place - m[0]), abs(place - m[1])))
            near.append((nearest[2], ref))
    of_known = set(known.values())
    out = [{"number": n, "ref_text": r, "how": "named"} for n, r in named] + [{"number": n, "ref_text": r, "how": "near"} for n, r in near if n in of_known]
    with_provision = {n for n, _ in named} | {n for n, _ in near}
    out += [{"number": n, "ref_text": f"Regulation (EU) {n}", "how": "whole"} for _, _, n in mentions if n in of_known and n not in with_provision]
    seen: dict[tuple[str, str], dict] = {}
    for x in out:
        seen.setdefault((x["number"], x["ref_text"]), x)
    return list(seen.values())


# --- mentions of articles and annexes, with lists and ranges ---------------------------------------------------


def families_in(text: str | None) -> list[tuple[str, int, int]]:
    """Base families that a text names (Article 5, Annex III, Recital 44) with the place of the mention.

    Lists, slashes and ranges are read ('Articles 111/113', 'Annexes I and III', 'Arts. 4a-4c'); of a range the ends count,
    as what lies between lettered ends is not defined. Paragraphs and points in brackets do not matter.
    """
    reader = Reader(text or "")
    out, i, t = [], 0, reader.t
    units = {"article": "Article", "articles": "Article", "art": "Article", "arts": "Article", "annex": "Annex", "annexes": "Annex", "recital": "Recital", "recitals": "Recital"}
    while i < len(t):
        unit = units.get(t[i].low) if t[i].kind == "word" else None
        at = i + 1 + (unit is not None and t[i].low in ("art", "arts") and reader.is_(i + 1, "mark") and t[i + 1].raw == ".")

        def read(at: int, unit: str | None = unit) -> tuple[int, list[str]] | None:
            """One number, or two around a slash, with a letter and brackets behind."""
            if unit == "Annex":
                fits = reader.is_(at, "word") and re.fullmatch(r"[IVXLCivxlc]+", t[at].raw)
                return (at + 1, [t[at].raw.upper()]) if fits else None
            if reader.is_(at, "act"):
                return at + 1, t[at].raw.split("/")
            if not reader.is_(at, "number"):
                return None
            number, at = t[at].raw, at + 1
            if unit == "Article" and reader.glued(at) and reader.is_(at, "word") and len(t[at].raw) == 1:
                number, at = number + t[at].low, at + 1
            return at, [number]

        found = read(at) if unit else None
        numbers: list[str] = []
        while found:
            at, more = found
            numbers += more
            while reader.is_(at, "bracket"):
                at += 1
            joint = at
            while joint < len(t) and joint < at + 2 and (t[joint].raw in ",/–—-−" or reader.word(joint, "and", "or", "to", "through")):
                joint += 1
            found = read(joint) if joint > at else None
        if numbers:
            out += [(f"{unit} {n}", t[i].start, t[at - 1].end) for n in dict.fromkeys(numbers)]
        i = max(at, i + 1) if numbers else i + 1
    return out


def base_family(ref: str) -> str:
    """Article 5(1)(f) -> Article 5; Annex IX, Chapter I -> Annex IX; Recital 44 as it is; what is none of these stays."""
    m = re.match(r"(article|annex|recital)\s+([0-9]+[a-z]?|[ivxlc]+)", " ".join(ref.split()), re.IGNORECASE)
    if not m:
        return " ".join(ref.split())
    return f"{m.group(1).capitalize()} {m.group(2).upper() if m.group(1).lower() == 'annex' else m.group(2).lower()}"


def parent_chain(ref: str) -> list[str]:
    """Article 5(1)(a) -> [Article 5(1), Article 5]; empty for what is no article below another."""
    m = re.match(r"(article\s+[0-9]+[a-z]?)((?:\([^()]+\))*)", " ".join(ref.split()), re.IGNORECASE)
    if not m:
        return []
    brackets = re.findall(r"\([^()]+\)", m.group(2))
    return [base_family(m.group(1)) + "".join(brackets[:n]) for n in range(len(brackets) - 1, -1, -1)]
