"""Language-model scores from an Elias-Fano n-gram trie (operator 1).

The model is a word trigram. p1 is a discounted unigram in which all unknown words share the discounted mass; p2
adds p1 to the bigram counts as PRIOR pseudo-tokens; p3 = share(u v w) + backoff(u v) p2(w | v) by absolute discounting.

Nothing of the model is gathered in one place. Documents are read in blocks of about BLOCK_TOKENS tokens; a block
sends, to each of the shards of the trie, its different words and n-grams once, with their counts in training
documents, as Elias-Fano lists. A shard (of words by their hash, of bigrams and what follows them by the bigram's
hash) adds up the counts of all blocks, builds its part of the trie, maps it into memory and answers each block with
the exact counts of its words and with codes of smoothed probabilities. The block, whose words wait in compressed
form, puts the answers together. A frequent context loads its shard with its different followers only.

Words are 64-bit hashes (exact but for about one chance in 10**5 that any two of 10 million words agree); bigrams are
40 bits besides the shard's, followers 24 bits within their context, so an unseen follower of a context of T words is
taken for a seen one with a chance of T / 16 million.

Defined results: a null or empty text is one token, its end; equal rows are scored alike and all count in training;
a null doc_id hashes as no characters; without training rows each token has the base chance of 1 and score 0; other
columns are left out.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._eftrie import LOW, MASK, Trie, decode, encode
from docweave.llm._frames import held_out, read
from docweave.llm._words import U, mix, slices, words

BLOCK_TOKENS = 1_500_000
SLICE_BYTES = 4 << 20
#: Bytes of text for each shard of the trie.
SHARD_BYTES = 16 << 20
DISCOUNT_WORD, DISCOUNT, PRIOR = 0.75, 0.75, 300.0
BEGIN, END = U(0x1F3D5B79ACE02468), U(0x2468ACE013579BDF)
FINGERPRINT = 40

_BLOB = T.StructType([T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("payload", T.BinaryType())])
_SKELETON = T.StructType([T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType())])
_SCORED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens", "train_words")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
)


def _pack(compress: bool = False, **arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return pa.compress(out.getvalue(), "zstd", asbytes=True) + out.tell().to_bytes(8, "little") if compress else out.getvalue()


def _unpack(blob: bytes, compressed: bool = False) -> dict[str, np.ndarray]:
    data = pa.decompress(blob[:-8], int.from_bytes(blob[-8:], "little"), "zstd", asbytes=True) if compressed else blob
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


class Grams:
    """The different words, bigrams and followers of a block's tokens, each in order, and each token's place among them."""

    def __init__(self, kinds: np.ndarray, of: np.ndarray, first: np.ndarray, bits: int):
        """kinds: sorted word hashes. of: each token's. first: where documents begin, one more at the end. bits: of the shard's number."""
        self.words, self.of_word = kinds, of
        token = kinds[of]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first[:-1]] = BEGIN
        pairs = mix(before * U(0x9E3779B97F4A7C15) + mix(token)) >> U(64 - FINGERPRINT - bits)
        self.bigrams, self.of_bigram = np.unique(pairs, return_inverse=True)
        self.later = np.ones(len(token), bool)
        self.later[first[:-1]] = False  # a document's first token follows no bigram
        at = np.flatnonzero(self.later)
        follow = self.of_bigram[at - 1].astype(np.uint64) << U(LOW) | mix(token[at] ^ U(0x5DEECE66D)) >> U(64 - LOW)
        self.followers, self.of_follower = np.unique(follow, return_inverse=True)

    def cuts(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each shard's words, bigrams and followers begin."""
        bits = shards.bit_length() - 1
        edges = np.arange(shards + 1, dtype=np.uint64)
        low = lambda values, shift: np.searchsorted(values >> U(shift), edges) if shift < 64 else np.array([0, len(values)])
        bigrams = low(self.bigrams, FINGERPRINT)
        return low(self.words, 64 - bits), bigrams, np.searchsorted(self.followers >> U(LOW), bigrams.astype(np.uint64))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, ids (with validity), held-out flags, different words, tokens and first tokens of each block of documents."""
    number = TaskContext.get().partitionId() << 24 if TaskContext.get() else 0
    hashes, counts, ids, known, held, size = [], [], [], [], [], 0

    def done():
        n = np.concatenate(counts)
        first = np.concatenate(([0], np.cumsum(n)))
        kinds, of = np.unique(np.concatenate(hashes), return_inverse=True)
        return np.concatenate(ids), np.concatenate(known), np.concatenate(held), kinds, of.astype(np.int32), first

    for batch in batches:
        column = batch.column("text")
        for a, b in slices(column, SLICE_BYTES):
            w = words(column.slice(a, b - a))
            n = w.counts + 1
            first = np.concatenate(([0], np.cumsum(n)))
            token = np.full(first[-1], END, np.uint64)
            inner = np.ones(len(token), bool)
            inner[first[1:] - 1] = False
            token[inner] = w.hashes()
            hashes.append(token)
            counts.append(n)
            doc = batch.column("doc_id").slice(a, b - a)
            ids.append(doc.fill_null(0).to_numpy())
            known.append(doc.is_valid().to_numpy(zero_copy_only=False))
            held.append(batch.column("held_out").slice(a, b - a).to_numpy(zero_copy_only=False))
            size += len(token)
            if size >= most:
                yield number, *done()
                number, size = number + 1, 0
                hashes, counts, ids, known, held = [], [], [], [], []
    if size:
        yield number, *done()


def _questions(batches: Iterator[pa.RecordBatch], shards: int, most: int) -> Iterator[pa.RecordBatch]:
    bits = shards.bit_length() - 1
    for number, _, _, held, kinds, of, first in _blocks(batches, most):
        g = Grams(kinds, of, first, bits)
        learnt = np.repeat(~held, np.diff(first))
        count = lambda place, size, mask: np.bincount(place[mask], minlength=size).astype(np.uint32)
        n1, n2, n3 = count(g.of_word, len(g.words), learnt), count(g.of_bigram, len(g.bigrams), learnt), count(g.of_follower, len(g.followers), learnt[g.later])
        w, b, f = g.cuts(shards)
        rows = []
        for s in range(shards):
            bigrams = g.bigrams[b[s] : b[s + 1]] & U((1 << FINGERPRINT) - 1)
            followers = g.followers[f[s] : f[s + 1]] - (U(int(b[s])) << U(LOW))
            low, high = encode(bigrams)
            low_, high_ = encode(followers)
            rows.append(_pack(words=g.words[w[s] : w[s + 1]], n1=_small(n1[w[s] : w[s + 1]]), low=low, high=high, n2=_small(n2[b[s] : b[s + 1]]), low_=low_, high_=high_, n3=_small(n3[f[s] : f[s + 1]])))
        yield pa.RecordBatch.from_arrays([pa.array([number] * shards, pa.int64()), pa.array(range(shards), pa.int32()), pa.array(rows, pa.binary())], names=_BLOB.names)


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8) if counts.max(initial=0) < 256 else counts


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys with their counts added, without those of no count."""
    key, count = np.concatenate(keys), np.concatenate([c.astype(np.int64) for c in counts])
    some = count > 0
    key, count = key[some], count[some]
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[new], np.add.reduceat(count, new) if len(new) else count


def _answers(table: pa.Table) -> pa.Table:
    """One shard: adds up all blocks, builds its trie, answers each block."""
    asked = [_unpack(p.as_py()) for p in table.column("payload")]
    kinds, totals = _summed([q["words"] for q in asked], [q["n1"] for q in asked])
    pairs = [decode(q["low"], q["high"]) for q in asked]
    bigrams, counts = _summed(pairs, [q["n2"] for q in asked])
    follows = [decode(q["low_"], q["high_"]) for q in asked]
    ranked = []
    for q, pair, follow in zip(asked, pairs, follows):
        at = np.searchsorted(bigrams, pair[(follow >> U(LOW)).astype(np.int64)]) if len(follow) else np.empty(0, np.int64)
        ranked.append(at.astype(np.uint64) << U(LOW) | follow & U(MASK))
    followers, follower_counts = _summed(ranked, [q["n3"] for q in asked])
    trie = Trie(bigrams, counts, (followers >> U(LOW)).astype(np.int64), followers & U(MASK), follower_counts, DISCOUNT)
    totals_of = np.array([totals.sum(), len(kinds)], np.int64)
    out = []
    for q, pair, follow in zip(asked, pairs, follows):
        at = np.searchsorted(kinds, q["words"])
        at_ = np.minimum(at, max(0, len(kinds) - 1))
        found = np.where(kinds[at_] == q["words"], totals[at_], 0) if len(kinds) else np.zeros(len(at), np.int64)
        c, b, s = trie.ask(pair, (follow >> U(LOW)).astype(np.int64), follow & U(MASK))
        narrow = lambda x: x.astype(np.uint8) if x.max(initial=0) < 256 else x
        found = found.astype(np.uint32) if found.max(initial=0) < 2**32 else found
        out.append(_pack(True, totals=totals_of, words=found, counts=narrow(c), backoffs=narrow(b), shares=narrow(s), count_book=trie.count_book, backoff_book=trie.backoff_book, share_book=trie.share_book))
    return pa.table([table.column("block"), table.column("shard"), pa.array(out, pa.binary())], names=_BLOB.names)


def _skeletons(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for number, ids, known, held, kinds, of, first in _blocks(batches, most):
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_pack(True, ids=ids, known=known, held=held, kinds=kinds, of=of, first=first)], pa.binary())], names=_SKELETON.names)


def _scored(shards: int, skeleton: pa.Table, answers: pa.Table) -> pa.Table:
    """One block: its tokens' chances from the shards' answers."""
    s = _unpack(skeleton.column("payload")[0].as_py(), True)
    g = Grams(s["kinds"], s["of"], s["first"], shards.bit_length() - 1)
    order = np.argsort(answers.column("shard").to_numpy())
    given = [_unpack(answers.column("payload")[int(i)].as_py(), True) for i in order]
    tokens, kinds = sum(a["totals"] for a in given)
    word = np.concatenate([a["words"].astype(np.int64) for a in given])
    looked = lambda book, code, missing: np.concatenate(([missing], book.astype(np.float64)))[code]
    counts = np.concatenate([looked(a["count_book"], a["counts"], 0.0) for a in given])
    backoffs = np.concatenate([looked(a["backoff_book"], a["backoffs"], 1.0) for a in given])
    shares = np.concatenate([looked(a["share_book"], a["shares"], 0.0) for a in given])
    first = s["first"]
    c = word[g.of_word]
    base = np.add.reduceat(np.log10((c + 1) / float(tokens + kinds + 1)), first[:-1])
    if tokens:
        p = np.where(c > 0, (c - DISCOUNT_WORD) / tokens, DISCOUNT_WORD * kinds / tokens)
        before = np.empty(len(c), np.float64)
        before[1:] = c[:-1]
        before[first[:-1]] = word[np.searchsorted(g.words, END)]  # as many documents begin as end
        p = (counts[g.of_bigram] + PRIOR * p) / (before + PRIOR)
        at = np.flatnonzero(g.later)
        p[at] = shares[g.of_follower] + backoffs[g.of_bigram[at - 1]] * p[at]
        score = np.add.reduceat(np.log10(p), first[:-1])
    else:
        score = np.zeros(len(first) - 1)
    n = len(first) - 1
    return pa.table([pa.array(s["ids"], mask=~s["known"]), pa.array(s["held"]), pa.array(np.diff(first)), pa.array(np.add.reduceat((c > 0).astype(np.int64), first[:-1])), pa.array(np.full(n, tokens)), pa.array(np.full(n, kinds)), pa.array(base), pa.array(score)], names=_SCORED.names)


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores of docs (doc_id, text, held_out), learning from those that are not held out. The input is scanned twice and has to have a stable order, as files have."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, (int(size) // shard_bytes).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "held_out")
    answers = rows.mapInArrow(lambda batches: _questions(batches, shards, block_tokens), _BLOB).groupBy("shard").applyInArrow(_answers, _BLOB)
    skeletons = rows.mapInArrow(lambda batches: _skeletons(batches, block_tokens), _SKELETON)
    return skeletons.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _scored(shards, a, b), _SCORED)


def op1_ef_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out")))
