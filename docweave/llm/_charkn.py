"""Class-conditional Kneser-Ney models over the bytes of words, with lower orders shared by the classes if wanted.

Word w is scored as the bytes of w and an end, after a start mark. Counts of the highest order, and of n-grams at
a word's start, are tokens; those of lower orders are numbers of different left extensions. Up to order ``shared``
the classes are counted together, so a rare word falls back on the same distribution in each class.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

from docweave.llm._words import Index, Words, mix

U = np.uint64
BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15)
START, END = 1, 2
DISCOUNT = 0.75


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with marks, each byte's place in its word, and where words begin."""
    sizes = ends - starts
    begins = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 2, out=begins[1:])
    place = np.arange(begins[-1], dtype=np.int64) - np.repeat(begins[:-1], sizes + 2)
    text = np.empty(begins[-1], np.uint8)
    body = np.ones(len(text), bool)
    body[begins[:-1]] = body[begins[1:] - 1] = False
    text[begins[:-1]], text[begins[1:] - 1] = START, END
    text[body] = data[np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)]
    return text, place, begins


def _roll(text: np.ndarray, shorter: np.ndarray | None) -> np.ndarray:
    """Hashes of the n bytes that end at each place, from those of n - 1."""
    out = BYTE[text]
    if shorter is not None:
        out[1:] += shorter[:-1] * STEP
    return out


def _gram(hashes: np.ndarray, order: int) -> np.ndarray:
    return mix(hashes + U(order * 0xD6E8FEB86659FD93 % 2**64))


def _context(hashes: np.ndarray, order: int) -> np.ndarray:
    return mix(hashes + U((order * 0xA0761D6478BD642F + 1) % 2**64))


def _unique_by_parts(values: np.ndarray, bits: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with first places and inverse, a range of values at a time, for less memory."""
    top = (values >> U(64 - bits)).astype(np.int8)
    keys, first, back, n = [], [], np.empty(len(values), np.int32), 0
    for part in range(1 << bits):
        at = np.flatnonzero(top == part)
        k, f, b = np.unique(values[at], return_index=True, return_inverse=True)
        back[at] = b + n
        keys.append(k)
        first.append(at[f])
        n += len(k)
    return np.concatenate(keys), np.concatenate(first), back


@dataclass
class CharKN:
    order: int
    classes: int
    grams: list[tuple[Index, np.ndarray]]  # by order: share of each class
    contexts: list[tuple[Index, np.ndarray]]  # by order: weight of the shorter context

    @staticmethod
    def fit(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, order: int = 5, shared: int = 2) -> CharKN:
        """counts: of each word in each class, a row for a word."""
        text, place, _ = padded(data, starts, ends)
        place = np.minimum(place, order).astype(np.int8)
        word = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts + 2)
        classes = counts.shape[1]

        def found(n: int, rolled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Different n-grams: keys, a place of each, tokens by class; all their places, and which they are."""
            at = np.flatnonzero((place >= n - 1) & (place > 0)).astype(np.int32)
            keys, first, back = _unique_by_parts(_gram(rolled[at], n))
            tokens = np.stack([np.bincount(back, weights=counts[word[at], c], minlength=len(keys)) for c in range(classes)], axis=1)
            return keys, at[first], tokens, at, back

        # Only two orders are held at a time.
        grams, contexts = [], []
        shorter, rolled = None, _roll(text, None)
        now = found(1, rolled)
        for n in range(1, order + 1):
            keys, first, tokens, at, back = now
            if n < order:
                after = _roll(text, rolled)
                now = found(n + 1, after)
            if n < order and len(keys):
                _, longer_first, longer, _, _ = now
                of = np.full(len(text), -1, np.int32)
                of[at] = back
                suffix = of[longer_first]
                inner = suffix >= 0
                kinds = (longer > 0).astype(np.float64)
                if n <= shared:
                    kinds[:] = kinds.any(axis=1, keepdims=True)
                counted = np.stack([np.bincount(suffix[inner], weights=kinds[inner, c], minlength=len(keys)) for c in range(classes)], axis=1)
                anchored = place[first] == n - 1
                counted[anchored] = tokens[anchored] if n > shared else tokens[anchored].sum(axis=1, keepdims=True)
                del of, suffix, inner, kinds
            else:
                counted = tokens if n > shared else np.repeat(tokens.sum(axis=1, keepdims=True), classes, axis=1)
            at = back = None
            before = shorter[first - 1] if n > 1 else np.zeros(len(first), np.uint64)
            outer, back = np.unique(_context(before, n), return_inverse=True)
            total = np.stack([np.bincount(back, weights=counted[:, c], minlength=len(outer)) for c in range(classes)], axis=1)
            kinds = np.stack([np.bincount(back, weights=counted[:, c] > 0, minlength=len(outer)) for c in range(classes)], axis=1)
            some = np.maximum(total, 1e-300)
            share = np.maximum(counted - DISCOUNT, 0) / some[back] if len(keys) else counted
            weight = np.where(total > 0, DISCOUNT * kinds / some, 1.0)
            grams.append((Index(keys), np.vstack([share, np.zeros((1, classes))]).astype(np.float32)))
            contexts.append((Index(outer), np.vstack([weight, np.ones((1, classes))]).astype(np.float32)))
            shorter, rolled = rolled, after if n < order else None
        return CharKN(order, classes, grams, contexts)

    def log_likelihoods(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> np.ndarray:
        """Natural logarithm of each word's probability in each class."""
        out, a = np.empty((len(starts), self.classes), np.float32), 0
        sizes = np.concatenate(([0], np.cumsum(ends - starts + 2)))
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + most, side="right")) - 1)
            out[a:b] = self._some(data, starts[a:b], ends[a:b])
            a = b
        return out

    def _some(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        text, place, begins = padded(data, starts, ends)
        chance = np.full((len(text), self.classes), 1 / 256, np.float32)
        live, rolled = np.flatnonzero(place > 0), None
        for n in range(1, self.order + 1):
            shorter, rolled = rolled, _roll(text, rolled)
            live = live[place[live] >= n - 1]
            outer = self.contexts[n - 1][0].find(_context(shorter[live - 1] if n > 1 else np.zeros(len(live), np.uint64), n))
            seen = outer < len(self.contexts[n - 1][0].keys)
            live, outer = live[seen], outer[seen]
            inner = self.grams[n - 1][0].find(_gram(rolled[live], n))
            chance[live] = self.grams[n - 1][1][inner] + self.contexts[n - 1][1][outer] * chance[live]
        logs = np.log(chance)
        logs[begins[:-1]] = 0
        return np.add.reduceat(logs, begins[:-1], axis=0) if len(starts) else np.empty((0, self.classes), np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{kind}{n}{part}": x for kind, rows in (("g", self.grams), ("c", self.contexts)) for n, (index, values) in enumerate(rows) for part, x in (("k", index.keys), ("v", values))}
        np.savez(out, shape=np.array([self.order, self.classes]), **arrays)
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> CharKN:
        z = np.load(io.BytesIO(blob))
        order, classes = map(int, z["shape"])
        return CharKN(order, classes, *[[(Index(z[f"{kind}{n}k"]), z[f"{kind}{n}v"]) for n in range(order)] for kind in "gc"])


def score_words(model: CharKN, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of the different words of a batch, and each word's place among them."""
    hashes = words.hashes()
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    return model.log_likelihoods(words.data, words.starts[first], words.ends[first]), back
