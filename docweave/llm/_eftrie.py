"""A shard of an Elias-Fano n-gram trie: bigrams as contexts, and the words that follow them.

A level is a monotone sequence in Elias-Fano form: of each value the low 24 bits in 3 bytes, the rest in unary in
a bit vector. The first level holds 40-bit fingerprints of bigrams. In the second, a value is the bigram's rank and
24 bits of the following word's fingerprint, so that the unary part is the monotone pointers from a bigram to its
words, and a word is found by a successor search relative to its context only: a directory of the zeros before each 32
bytes leads to the place in the mapped bits where the context's words begin. Beside the levels lie one-byte codes
of a codebook: the bigram's count, its backoff weight, and the word's discounted probability. All parts are in one
file, which is mapped into memory and has no name any more.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

LOW = 24
MASK = (1 << LOW) - 1
U = np.uint64


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low bytes and packed unary part of a sorted array of numbers."""
    low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : LOW // 8].copy()
    high = (values >> U(LOW)).astype(np.int64)
    bits = np.zeros((int(high[-1]) if len(high) else 0) + len(high) + 1, np.uint8)
    bits[high + np.arange(len(high))] = 1
    return low, np.packbits(bits)


def low_values(low: np.ndarray) -> np.ndarray:
    return low[:, 0].astype(np.uint32) | low[:, 1].astype(np.uint32) << np.uint32(8) | low[:, 2].astype(np.uint32) << np.uint32(16)


def decode(low: np.ndarray, bits: np.ndarray) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(bits))[: len(low)]
    return (ones - np.arange(len(ones))).astype(np.uint64) << U(LOW) | low_values(low).astype(np.uint64)


def codebook(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and what they stand for: each value if there are at most 256, else means of bins of equal use."""
    kinds, back, uses = np.unique(values, return_inverse=True, return_counts=True)
    if len(kinds) > 256:
        part = np.minimum(((np.cumsum(uses) - uses / 2) * 256 / uses.sum()).astype(np.int64), 255)
        total, weight = np.bincount(part, weights=kinds * uses, minlength=256), np.bincount(part, weights=uses, minlength=256)
        kinds, back = total / np.maximum(weight, 1), part[back]
    return back.astype(np.uint8), kinds.astype(np.float32)


#: Bytes of a unary part whose zeros the directory counts together.
BLOCK = 32
_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.uint8)
#: The place of each zero of a byte, the first bit leading.
_PLACE = np.array([([k for k in range(8) if not b >> (7 - k) & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def padded(bits: np.ndarray) -> np.ndarray:
    """A unary part in whole blocks."""
    return np.concatenate([bits, np.zeros(-len(bits) % BLOCK, np.uint8)]) if len(bits) % BLOCK else bits


class Level:
    """An encoded sequence, searched in its own bits: a directory of zeros before each block finds a bucket of equal high part."""

    def __init__(self, low: np.ndarray, bits: np.ndarray, buckets: int | None = None):
        """buckets: how many high parts there can be; by default as many as the bits have."""
        self.low, self.bits, self.buckets = low, padded(bits).reshape(-1, BLOCK), buckets
        zeros = np.concatenate([_ZEROS[self.bits[a : a + 4096]].sum(axis=1, dtype=np.int64) for a in range(0, len(self.bits), 4096)]) if len(bits) else np.empty(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(zeros)))

    def begin(self, high: np.ndarray) -> np.ndarray:
        """The place of the first value whose high part is not less: behind as many zeros as that, the ones count the values."""
        out = np.full(len(high), len(self.low), np.int64)
        out[high == 0] = 0
        if self.buckets is not None and len(high) and high.max() > self.buckets:
            raise ValueError("there is no such bucket")
        for a in range(0, len(high), 1 << 15):
            ask = a + np.flatnonzero((high[a : a + (1 << 15)] > 0) & (high[a : a + (1 << 15)] <= self.before[-1]))
            zero = high[ask] - 1
            block = np.searchsorted(self.before, zero, side="right") - 1
            rest, rows = zero - self.before[block], self.bits[block]
            upto = np.cumsum(_ZEROS[rows], axis=1, dtype=np.int64)
            byte = (upto <= rest[:, None]).sum(axis=1)
            at = np.arange(len(ask))
            rest = rest - np.where(byte > 0, upto[at, np.maximum(byte - 1, 0)], 0)
            out[ask] = np.minimum((block * BLOCK + byte) * 8 + _PLACE[rows[at, byte], rest] - zero, len(self.low))
        return out

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: successor search among those of its bucket."""
        edges, back = np.unique(np.concatenate([high, high + 1]), return_inverse=True)
        begins = self.begin(edges)[back]
        a, end = begins[: len(high)], begins[len(high) :]
        b, low = end.copy(), low.astype(np.uint32)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            below = low_values(self.low[middle]) < low[open_]
            a[open_[below]] = middle[below] + 1
            b[open_[~below]] = middle[~below]
            open_ = open_[a[open_] < b[open_]]
        out = np.full(len(high), -1, np.int64)
        some = np.flatnonzero(a < end)
        hit = some[low_values(self.low[a[some]]) == low[some]]
        out[hit] = a[hit]
        return out


class Trie:
    def __init__(self, bigrams: np.ndarray, counts: np.ndarray, parents: np.ndarray, words: np.ndarray, word_counts: np.ndarray, discount: float):
        """Sorted fingerprints and counts of bigrams; of each follower, sorted, its bigram's rank, fingerprint and count."""
        total = np.bincount(parents, weights=word_counts, minlength=len(bigrams))
        kinds = np.bincount(parents, minlength=len(bigrams))
        backoff = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        count_codes, self.count_book = codebook(counts)
        backoff_codes, self.backoff_book = codebook(backoff)
        share_codes, self.share_book = codebook((word_counts - discount) / total[parents] if len(parents) else np.empty(0))
        (low, bits), (low_, bits_) = encode(bigrams), encode(parents.astype(np.uint64) << U(LOW) | words.astype(np.uint64))
        parts = [low, padded(bits), low_, padded(bits_), count_codes, backoff_codes, share_codes]
        low, bits, low_, bits_, self.counts, self.backoffs, self.shares = _mapped(parts)
        self.contexts, self.followers = Level(low, bits), Level(low_, bits_)

    def ask(self, bigrams: np.ndarray, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes plus 1 (0: unknown) of bigrams' counts and backoffs, and of followers (rank among bigrams asked for, word)."""
        at = self.contexts.find((bigrams >> U(LOW)).astype(np.int64), bigrams & U(MASK))
        known = at >= 0
        counts, backoffs = np.zeros(len(at), np.uint16), np.zeros(len(at), np.uint16)
        counts[known], backoffs[known] = self.counts[at[known]].astype(np.uint16) + 1, self.backoffs[at[known]].astype(np.uint16) + 1
        shares = np.zeros(len(parents), np.uint16)
        of = at[parents]
        asked = np.flatnonzero(of >= 0)
        found = self.followers.find(of[asked], words[asked])
        hit = found >= 0
        shares[asked[hit]] = self.shares[found[hit]].astype(np.uint16) + 1
        return counts, backoffs, shares


def _mapped(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a file of the task's own that is mapped and then unlinked; the space goes when the task ends."""
    handle, path = tempfile.mkstemp(prefix="docweave-trie-")
    try:
        os.unlink(path)
        with os.fdopen(handle, "wb+") as out:
            for p in parts:
                out.write(p.tobytes())
            out.flush()
            size = sum(p.nbytes for p in parts)
            whole = np.frombuffer(mmap.mmap(out.fileno(), size, access=mmap.ACCESS_READ), np.uint8) if size else np.empty(0, np.uint8)
    except BaseException:
        if os.path.exists(path):
            os.unlink(path)
        raise
    found, at = [], 0
    for p in parts:
        found.append(whole[at : at + p.nbytes].view(p.dtype).reshape(p.shape))
        at += p.nbytes
    return found
