"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 2).

The patterns give the base spans. What they leave (numbers, at-signs and spelt-out addresses that no base span
covers) is cut into windows of tokens, and a semi-Markov CRF scores every candidate segment of at most
MOST_TOKENS tokens as a whole: its shape, digits, check sum, parts and left neighbour. Dynamic programming over
segments chooses boundaries and kinds together. Its spans are added to the base spans, which always stay; added
spans never overlap them. The CRF is trained here, by gradient ascent on its likelihood, on generated sentences
(forms the patterns miss, and look-alikes that are not personal data).

Defined results: a null or empty text has no span; positions count code points, the end is exclusive; other
columns stay; repeated rows are all kept. All work on a text is linear in its length.
"""

from __future__ import annotations

import json
import os
import random
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docweave.llm._frames import append_columns, read

KINDS = ("email", "ip", "card", "phone")
#: A bracketed at or dot counts as one token.
MOST_TOKENS = 20
#: Tokens around what the patterns left that a window takes in: all that a candidate can reach.
AROUND = MOST_TOKENS - 1
#: A span is added if its score beats leaving its tokens outside by so much (log odds).
MARGIN = 0.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# Without the look-behind the same matches, but a long run of digits would be tried from each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"[\[({<]\s?(?:at|arroba|dot|punkt|point|punto|\.)\s?[\])}>]|[^\W\d_]+|[0-9]+|[^\s]", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9](?:[ ().\[\]/,:-]{0,3}[0-9])+")
_SPELT = re.compile(r"(?<![^\W_])(?:dot|punkt|point|punto)(?![^\W_])", re.IGNORECASE)
_FOUR = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[({<]?\s?(?:\.|dot|punkt|point|punto)\s?[\])}>]?\s?[0-9]{1,3}(?![0-9])){3,}", re.IGNORECASE)
_AT = re.compile(r"[\[({<]\s?(?:at|arroba)\s?[\])}>]|\s(?:at|arroba)\s|@", re.IGNORECASE)

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap others of it, ordered by start and kind."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            a = at
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < at:
                found.append((a, m.end(), 0))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    first = _DIGIT.search(text)
    if first:
        at = first.start()
        for m in _IP.finditer(text, at):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text, at):
            if m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((m.start(), m.end(), 3))
    found.sort()
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def span_features(text: str, a: int, b: int, tokens: int, left: str) -> list[str]:
    """Of the whole segment text[a:b]."""
    s = text[a:b]
    digits = re.sub("[^0-9]", "", s)
    letters = sum(c.isalpha() for c in s)
    out = ["bias", f"tokens{_bucket(tokens, (2, 4, 6, 8, 10, 12, 16))}", f"digits{_bucket(len(digits), (1, 4, 7, 9, 10, 11, 13, 14, 16, 17, 20))}", f"letters{_bucket(letters, (1, 4, 10))}"]
    low = s.lower()
    at = len(re.findall(r"@|[\[({<]\s?(?:at|arroba)\s?[\])}>]|\s(?:at|arroba)\s", low))
    dots = len(re.findall(r"[\[({<]\s?(?:dot|punkt|point|punto)\s?[\])}>]|\s(?:dot|punkt|point|punto)\s|[\[({<]\s?\.\s?[\])}>]|\s?\.\s?", low))
    out.append(f"at{min(at, 2)}")
    if at:
        tail = re.split(r"@|[\[({<]\s?(?:at|arroba)\s?[\])}>]|\s(?:at|arroba)\s", low)[-1]
        has = re.search(r"(?:\.|dot|punkt|point|punto|\))[\])}>\s]*([a-z]{2,7})$", tail)
        mark = "@" if "@" in low else "[" if re.search(r"[\[({<]\s?(?:at|arroba)", low) else "word"
        point = "[" if re.search(r"[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]", tail) else "word" if re.search(r"\s(?:dot|punkt|point|punto)\s", tail) else "tight" if re.search(r"\S\.\S", tail) else "loose"
        out.append("suffix" if has and has.group(1) in _SUFFIXES else "nosuffix")
        local = re.split(r"\s?@|\s?[\[({<]\s?(?:at|arroba)|\s(?:at|arroba)\s", low)[0]
        out.append("spacedlocal" if re.search(r"[^\s\])}]\s+(?!(?:dot|punkt|point|punto)\b)[^\s\[({]|[.,;:]\s", re.sub(r"\s(?:dot|punkt|point|punto)\s", "", local)) else "local")
        out.append("sentence" if re.search(r"[^\s.]\.\s", s) and point != "loose" else "nosentence")
        out.append(f"address{mark}{point}" if has and at == 1 and low[0].isalnum() else "noaddress")
    parts = re.split(r"[\[({<\s]*(?:\.|dot|punkt|point|punto)[\])}>\s]*", low)
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("fourparts")
    elif dots:
        out.append(f"dots{min(dots, 4)}")
    if 14 <= len(digits) <= 19 and not letters:
        out.append("luhn" if luhn(digits) else "noluhn")
        groups = [len(x) for x in re.findall("[0-9]+", s)]
        out.append("even" if len(set(groups[:-1] or groups)) == 1 else "uneven")
    if not letters and digits:
        groups = [len(x) for x in re.findall("[0-9]+", s)]
        out.append("groups" + "-".join(map(str, groups[:5])) if len(groups) <= 5 and max(groups) <= 5 else f"manygroups{min(len(groups), 6)}")
        out.append("open" + (s[0] if s[0] in "+(" else "d") + (s[-1] if not s[-1].isdigit() else "d"))
        out.append("marks" + "".join(sorted({c for c in s if not c.isdigit()}))[:6])
    elif digits:
        out.append("mixed")
    out.append("first" + _kind(s[0]))
    out.append("last" + _kind(s[-1]))
    out.append("left=" + left if left in _CUES else "left")
    after = text[b] if b < len(text) else " "
    before = text[a - 1] if a else " "
    out.append(f"edge{'x' if before.isalnum() or before in '=#@_' else '-'}{'x' if after.isalnum() or after in '=#@_' else '-'}")
    return out


_SUFFIXES = frozenset("com net org de fr es uk io edu gov info example".split())
_CUES = frozenset("tel phone call fax mobile mail email contact ip host server address card visa account password key id no nr ref order version isbn page".split())


def _kind(c: str) -> str:
    return "a" if c.isalpha() else "d" if c.isdigit() else c if c in "+()[]@." else "o"


def _segments(text: str, tokens: list[tuple[int, int]], live: list[bool]) -> list[tuple[int, int]]:
    """Candidates: at most MOST_TOKENS tokens, with something the patterns left, sensible at both ends."""
    out, n = [], len(tokens)
    heads = [text[a].isalnum() or text[a:b] in ("+", "(") for a, b in tokens]
    tails = [text[b - 1].isalnum() for _, b in tokens]
    counted = np.concatenate(([0], np.cumsum(live)))
    for i in range(n):
        if heads[i]:
            out += [(i, j) for j in range(i + 1, min(n, i + MOST_TOKENS) + 1) if tails[j - 1] and counted[j] > counted[i]]
    return out


class SemiCrf:
    """Weights by feature and kind; a token outside all segments scores 0."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights
        self.hopeless = self._hopeless()

    def _hopeless(self) -> frozenset[str]:
        """Kinds of a first character with which no segment can beat MARGIN that has no digit, a letter at its end and no suffix of a host before it.

        An exact bound: the sum of the largest weights that each group of span_features can add to such a segment.
        """
        def top(*names: str) -> np.ndarray:
            return np.max([self.weights[self.names[n]] if n in self.names else np.zeros(len(KINDS)) for n in names], axis=0)

        with_at = top("at1", "at2") + top("nosuffix") + top("noaddress") + top("local", "spacedlocal") + top("sentence", "nosentence")
        most = top("bias") + top("digits0") + top(*(f"tokens{n}" for n in range(8))) + top(*(f"letters{n}" for n in range(1, 4))) + top("lasta")
        most = most + np.maximum(top("at0"), with_at) + top("", *(f"dots{n}" for n in range(1, 5))) + top("left", *(f"left={c}" for c in _CUES)) + top("edgexx", "edgex-", "edge-x", "edge--")
        return frozenset(c for c in "ado+()[]@." if (most + top("first" + c)).max() <= MARGIN - 1e-9)

    def hopeful(self, text: str, tokens: list[tuple[int, int]], segments: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """segments without those that cannot beat MARGIN."""
        heads = [_kind(text[a]) in self.hopeless for a, _ in tokens]
        digits = np.concatenate(([0], np.cumsum([bool(_DIGIT.search(text, a, b)) for a, b in tokens]))).tolist()
        plain, pointed = [], False
        for a, b in tokens:
            token = text[a:b].lower()
            spelt = any(w in token for w in ("dot", "punkt", "point", "punto"))
            plain.append(text[b - 1].isalpha() and not pointed and not spelt)
            pointed = spelt or "." in token or ")" in token or pointed and token in ("]", "}", ">")
        return [(i, j) for i, j in segments if not (heads[i] and plain[j - 1] and digits[i] == digits[j])]

    def rows(self, text: str, tokens: list[tuple[int, int]], segments: list[tuple[int, int]]) -> list[list[int]]:
        get, out = self.names.get, []
        for i, j in segments:
            left = text[slice(*tokens[i - 1])].lower() if i else ""
            if left in (":", "=", ".") and i > 1:
                left = text[slice(*tokens[i - 2])].lower()
            found = (get(f) for f in span_features(text, tokens[i][0], tokens[j - 1][1], j - i, left))
            out.append([f for f in found if f is not None])
        return out

    def best(self, text: str, tokens: list[tuple[int, int]], live: list[bool]) -> list[Span]:
        segments = self.hopeful(text, tokens, _segments(text, tokens, live))
        if not segments:
            return []
        scores = [self.weights[r].sum(axis=0) for r in self.rows(text, tokens, segments)]
        ending: dict[int, list[tuple[int, float, int]]] = {}
        for (i, j), s in zip(segments, scores):
            k = int(s.argmax())
            if s[k] > MARGIN:
                ending.setdefault(j, []).append((i, float(s[k]) - MARGIN, k))
        value, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            value[j] = value[j - 1]
            for i, s, k in ending.get(j, ()):
                if value[i] + s > value[j]:
                    value[j], back[j] = value[i] + s, (i, k)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((tokens[i][0], tokens[j - 1][1], k))
                j = i
        return out[::-1]

    @staticmethod
    def train(examples: list[tuple[str, list[Span]]], passes: int = 6, rate: float = 0.15, decay: float = 1e-3) -> SemiCrf:
        names: dict[str, int] = {}
        prepared = []
        for text, gold in examples:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            segments = _segments(text, tokens, [True] * len(tokens))
            rows = []
            for i, j in segments:
                left = text[slice(*tokens[i - 1])].lower() if i else ""
                if left in (":", "=", ".") and i > 1:
                    left = text[slice(*tokens[i - 2])].lower()
                rows.append([names.setdefault(f, len(names)) for f in span_features(text, tokens[i][0], tokens[j - 1][1], j - i, left)])
            known = {(a, b): k for a, b, k in gold}
            lost = known.keys() - {(tokens[i][0], tokens[j - 1][1]) for i, j in segments}
            if lost:
                raise ValueError(f"no candidate segment for {[text[a:b] for a, b in sorted(lost)]} in {text!r}")
            labels = [known.get((tokens[i][0], tokens[j - 1][1])) for i, j in segments]
            prepared.append((len(tokens), segments, rows, labels))
        weights = np.zeros((len(names), len(KINDS)))
        order = random.Random(5)
        for step in range(passes):
            order.shuffle(prepared)
            for n, segments, rows, labels in prepared:
                if not segments:
                    continue
                scores = np.array([weights[r].sum(axis=0) for r in rows])
                both = np.logaddexp.reduce(scores, axis=1)
                ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                ahead[0] = behind[n] = 0.0
                ends, heads = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
                for x, (i, j) in enumerate(segments):
                    ends[j].append((i, x))
                    heads[i].append((j, x))
                for j in range(1, n + 1):
                    ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[i] + both[x] for i, x in ends[j]]])
                for i in range(n - 1, -1, -1):
                    behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[j] + both[x] for j, x in heads[i]]])
                for x, (i, j) in enumerate(segments):
                    slope = -np.exp(ahead[i] + scores[x] + behind[j] - ahead[n])
                    if labels[x] is not None:
                        slope[labels[x]] += 1
                    if np.abs(slope).max() > 1e-4:
                        weights[rows[x]] += rate / (1 + step) * slope
            weights *= 1 - decay
        return SemiCrf(names, weights)


def examples(n: int = 960, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Sentences with forms that the patterns miss, and with look-alikes."""
    r = random.Random(seed)
    syllables = "an be ca do er fi go ha in ka le mo na or pe ra si ta un ve".split()
    word = lambda lo=1, hi=4: "".join(r.choice(syllables) for _ in range(r.randint(lo, hi)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def email() -> str:
        at = r.choice([" [at] ", "[at]", " (at) ", "(at)", " at ", " AT ", " @ ", "{at}"])
        dot = r.choice([" [dot] ", "[dot]", " (dot) ", "(dot)", " dot ", " DOT ", "."]) if at != " @ " else r.choice([".", " . ", " dot "])
        name = word() + (r.choice([".", "_", dot]) + word() if r.random() < 0.4 else "") + (number(2) if r.random() < 0.3 else "")
        return name + at + word() + "".join(dot + r.choice([word(), word(), word(), "example"]) for _ in range(r.choice([0, 0, 1, 1, 2]))) + dot + r.choice(["com", "net", "org", "de", "example"])

    def ip() -> str:
        return r.choice(["[.]", " . ", "(.)", "[dot]", " dot "]).join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = r.choice("3456") + number(r.choice([14, 14, 14, 13, 15]))
        full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        mark = r.choice([".", "/", " . ", "  "])
        return mark.join(full[k : k + 4] for k in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = r.randint(200, 989), r.randint(200, 989), number(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"({a}){b}-{c}"])

    def other() -> str:
        return r.choice([
            lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: number(r.randint(3, 12)), lambda: f"{number(3)},{number(3)},{number(3)}",
            lambda: f"password={number(3)}ab{number(4)}c{number(3)}", lambda: f"{number(1)}.{number(2)}.{number(1)}", lambda: f"{number(16)}", lambda: f"{r.randint(1, 99)} at {word()} {r.randint(1, 99)}", lambda: f"{word()} at {word()} {word()}", lambda: f"{word()} at {word()}. {word(1, 2)}", lambda: f"{word()}, at {word()}. {word(1, 1)} {word()}", lambda: f"{word()} dot {word()}",
            *[lambda: f"{word()} at {' '.join(word() for _ in range(r.choice([1, 1, 2, 4, 7])))}. {r.choice(['', '', word() + ' ' + word() + '. '])}{r.choice(['Es', 'De', 'Us', 'Info'])} {word()}"] * 2,
            lambda: f"id {number(4)} {number(4)} {number(4)}", lambda: f"{number(4)}-{number(4)}", lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{number(3)}.{number(3)}", lambda: f"{number(2)}:{number(2)}:{number(2)} {number(4)}", lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"{word()}@{word()}", lambda: " ".join(number(2) for _ in range(8)), lambda: f"{number(8)}-{number(4)}-{number(4)}",
        ])()

    makers = (email, ip, card, phone)
    out = []
    for x in range(n):
        text, gold = " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(r.choice([0, 1, 2, 3, 4, 5, 14]))), []
        for _ in range(r.randint(1, 2)):
            if text:
                text += r.choice([" ", " ", ": ", ", "])
            k = x % 8
            made = makers[k]() if k < 4 else other()
            if k < 4:
                gold.append((len(text), len(text) + len(made), k))
            text += made + r.choice(["", "", ".", ","]) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
            x += 1
        out.append((text.strip() if not text.startswith(" ") else text.rstrip(), gold))
    return out


#: Features and weights of SemiCrf.train(examples()), written by write_weights(); tests/llm/test_pii_weights.py trains anew and compares.
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.json")


@lru_cache(maxsize=1)
def trained() -> SemiCrf:
    """The model of the shipped weights: a driver reads a file instead of training in each session."""
    with open(WEIGHTS, encoding="utf-8") as f:
        held = json.load(f)
    return SemiCrf({name: k for k, name in enumerate(held)}, np.array(list(held.values())).reshape(len(held), len(KINDS)))


def write_weights(path: str = WEIGHTS) -> None:
    model = SemiCrf.train(examples())
    with open(path, "w", encoding="utf-8") as f:
        json.dump({name: [round(float(w), 9) for w in model.weights[k]] for name, k in model.names.items()}, f, ensure_ascii=False, indent=0)


def _marks(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Places in text[lo:hi] that open a window: numbers, at-signs and at-forms, four groups of digits, and spelt-out dots near numbers."""
    marks = [m.span() for m in _AT.finditer(text, lo, hi)]
    if _DIGIT.search(text, lo, hi):
        marks += [m.span() for m in _NUMBER.finditer(text, lo, hi) if sum(map(str.isdigit, m.group())) >= 7]
        marks += [m.span() for m in _FOUR.finditer(text, lo, hi)]
        marks += [m.span() for m in _SPELT.finditer(text, lo, hi)]
    return sorted(marks)


def _gaps(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """What the base spans leave of the text."""
    out, at = [], 0
    for a, b, _ in sorted(base):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out + [(at, len(text))] if at < len(text) else out


#: Characters that are read before a mark at first, and tokens at their begin that may be torn.
READ_BEFORE, TORN = 160, 4
#: Characters between marks whose windows are not worth telling apart.
CLOSE = 228


def _reach(text: str, first: int, last: int, a: int, b: int) -> tuple[int, int]:
    """Where the AROUND tokens before a mark at a to b begin, and where those behind it end, in text[first:last], however long they are."""
    size = READ_BEFORE
    while True:
        lo = max(first, a - size)
        before = [m.start() for m in _TOKEN.finditer(text, lo, a)][TORN if lo > first else 0 :]
        if lo == first or len(before) >= AROUND:
            break
        size *= 2
    behind = [m.end() for m in islice(_TOKEN.finditer(text, b, last), AROUND)]
    return before[-AROUND] if len(before) >= AROUND else first, behind[-1] if len(behind) == AROUND else last


def added_spans(text: str, base: list[Span], model: SemiCrf) -> list[Span]:
    """Spans of the CRF in what the patterns left: marks and windows are cut at base spans."""
    out: list[Span] = []
    for first, last in _gaps(text, base):
        near_by: list[list[tuple[int, int]]] = []  # marks close to each other share a window
        end = first
        for a, b in _marks(text, first, last):
            if near_by and a - end <= CLOSE:
                near_by[-1].append((a, b))
            else:
                near_by.append([(a, b)])
                end = b
            end = max(end, b)
        groups: list[tuple[int, int, list[tuple[int, int]]]] = []
        for marks in near_by:
            lo, hi = _reach(text, first, last, marks[0][0], max(b for _, b in marks))
            if groups and lo <= groups[-1][1]:
                begin, end, before = groups.pop()
                groups.append((begin, max(end, hi), before + marks))
            else:
                groups.append((lo, hi, marks))
        ready = first
        for lo, hi, group in groups:
            tokens = [m.span() for m in _TOKEN.finditer(text, max(lo, ready), hi)]
            live, x, reach = [], 0, 0
            for a, b in tokens:
                while x < len(group) and group[x][0] < b:
                    reach = max(reach, group[x][1])
                    x += 1
                live.append(reach > a)
            near = [any(live[max(0, t - AROUND) : t + AROUND + 1]) for t in range(len(tokens))]
            tokens, live = [t for t, y in zip(tokens, near) if y], [v for v, y in zip(live, near) if y]
            found = model.best(text, tokens, live)
            ready = max(ready, *[b for _, b, _ in found]) if found else ready
            out += found
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("kind", T.StringType(), False), T.StructField("base", T.BooleanType(), False)])


def find(docs: DataFrame, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """docs with the personal data of a text column: array of (start, end, kind, base), by start, then kind as listed."""
    kind = pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False), pa.field("kind", pa.string(), False), pa.field("base", pa.bool_(), False)]))

    model = trained()  # some hundred weights, that go with the function

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        found = []
        for value in batch.column(text):
            body = value.as_py() or ""
            base = base_spans(body)
            spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(body, base, model)]
            spans.sort(key=lambda s: (s[0], s[2], s[1]))
            found.append([{"start": a, "end": b, "kind": KINDS[k], "base": known} for a, b, k, known in spans])
        return [pa.array(found, kind)]

    return append_columns(docs, T.StructType([T.StructField(out, T.ArrayType(SPAN, False))]), work, keep)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans become one of the first's kind. A null text stays null."""
    work_name, model = "__dw_masked", trained()

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for value in batch.column(text):
            body = value.as_py()
            if body is None:
                out.append(None)
                continue
            base = base_spans(body)
            spans = sorted(base + added_spans(body, base, model), key=lambda s: (s[0], s[2]))
            pieces, at = [], 0
            for a, b, k in spans:
                if a >= at:
                    pieces += [body[at:a], f"<{KINDS[k].upper()}>"]
                at = max(at, b)
            out.append("".join([*pieces, body[at:]]))
        return [pa.array(out, pa.string())]

    others = [c for c in docs.columns if c != text]
    masked = append_columns(docs, T.StructType([T.StructField(work_name, T.StringType())]), work, others)
    return masked.withColumnRenamed(work_name, text).select(docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: lambda s: s["kind"] == kind
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
