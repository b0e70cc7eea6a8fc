"""Words of many texts at once, in NumPy: boundaries, 64-bit hashes and an index of sorted hashes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z in lower case. Its hash is a random
polynomial modulo 2**64, mixed; two different words of a corpus of a thousand million agree with a chance of
some percent, and of a corpus of a million with one in forty million.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20_240_229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_RNG.integers(2**40, 2**62)) | 1
INVERSE = pow(BASE, -1, 2**64)
#: Bytes hashed at once; a longer word gets as much as it needs.
WINDOW = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, WINDOW + 1)
        have = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            take = min(filled, size - filled)
            have[filled : filled + take] = have[:take] * U(pow(base, filled, 2**64))
            filled += take
        if size <= 4 * WINDOW:
            _powers[base] = have
    return have


@dataclass
class Words:
    """Of the texts of one batch: bytes in lower case, where words start and end, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than there are texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + WINDOW, side="right")))
            part = self.data[base : self.ends[j - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE[part] * powers(BASE, len(part))[: len(part)], out=sums[1:])
            a, b = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * powers(INVERSE, len(part))[a] + (b - a).astype(np.uint64) * U(0x9E3779B97F4A7C15)
            i = j
        return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array) -> Words:
    data, offsets = text_buffers(column)
    data = LOWER[data]
    solid = ~BLANK[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True  # a text starts here
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        starts = np.flatnonzero(solid & (~before | opens[:-1]))
        ends = np.flatnonzero(solid & (~after | opens[1:])) + 1
    else:
        starts = ends = np.empty(0, np.int64)
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def slices(column: pa.Array, most_bytes: int) -> list[tuple[int, int]]:
    """Row ranges of about most_bytes of text each; a longer text is a range of its own."""
    n = len(column)
    if not n:
        return []
    _, offsets = text_buffers(column)
    out, a = [], 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


class Index:
    """Finds 64-bit hashes in a sorted array of different ones: a directory by leading bits, then a short scan."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        tops = (keys >> U(64 - self.bits)).astype(np.int64)
        self.directory = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(tops, minlength=1 << self.bits), out=self.directory[1:])
        self.longest = int(np.diff(self.directory).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, or the number of keys."""
        n = len(self.keys)
        top = (wanted >> U(64 - self.bits)).astype(np.int64)
        at, end = self.directory[top], self.directory[top + 1]
        out = np.full(len(wanted), n, np.int32)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        wanted = wanted[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out
