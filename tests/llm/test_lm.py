import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import lm
from docweave.llm._eftrie import LOW, Level, Trie, codebook, decode, encode
from docweave.llm._frames import held_out

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)) + [None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows):
    """Scores by dictionaries: doc_id and text of each row."""
    one, two, three, follow = Counter(), Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            one.update(w)
            two.update(zip(["<s>", *w], w))
            for tri in zip(["<s>", *w], w, w[1:]):
                three[tri] += 1
                follow[tri[:2]].add(tri[2])
    n, v = sum(one.values()), len(one)
    ends = one[None]
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score, before = 0.0, ["<s>", *w]
        for k, x in enumerate(w):
            p = (one[x] - lm.DISCOUNT_WORD) / n if one[x] else lm.DISCOUNT_WORD * v / n
            c = ends if k == 0 else one[w[k - 1]]
            p = (two[before[k], x] + lm.PRIOR * p) / (c + lm.PRIOR)
            if k:
                ctx = (before[k - 1], w[k - 1])
                total = two[ctx]
                if total:
                    p = max(three[(*ctx, x)] - lm.DISCOUNT, 0) / total + lm.DISCOUNT * len(follow[ctx]) / total * p
            score += math.log10(p)
        out.append((i if i is not None else -1, held(i), len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def sample(n=150):
    r = random.Random(6)
    vocabulary = [f"w{int(r.paretovariate(0.9))}" for _ in range(400)] + ["The", "THE", "é", "É"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(n)]
    return rows + [(None, "the w1 w2"), (7, None), (8, ""), (9, " \t\x0b"), (11, rows[3][1]), (11, rows[3][1]), (12, "the " * 3000)]


@pytest.mark.parametrize("block,shard", [(10**6, 16 << 20), (300, 512)])
def test_scores(spark, block, shard):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", held_out(F.col("doc_id"), 7))
    key = lambda r: (r[0], r[2], r[5])
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs, block, shard).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-9)
    # With few different values the codebooks are exact up to single precision.
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-4, atol=1e-4)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    (r,) = lm.score(docs).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(docs.limit(0)).count() == 0


def test_elias_fano_round_trip_and_search():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    low, bits = encode(values)
    assert np.array_equal(decode(low, bits), values)
    level = Level(low, bits, 1 << 16)
    asked = np.concatenate([values[::3], rng.integers(0, 1 << 40, 2000, dtype=np.uint64)])
    found = level.find((asked >> np.uint64(LOW)).astype(np.int64), asked & np.uint64((1 << LOW) - 1))
    places = {int(v): k for k, v in enumerate(values)}
    assert found.tolist() == [places.get(int(a), -1) for a in asked]
    assert decode(*encode(values[:0])).size == 0


def test_trie_has_no_file_left(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    two = np.array([5, 1 << 30], np.uint64)
    trie = Trie(two, np.array([3, 1]), np.array([0, 0, 1]), np.array([1, 9, 4], np.uint64), np.array([2, 1, 1]), 0.75)
    assert list(tmp_path.iterdir()) == []
    counts, backoffs, shares = trie.ask(np.array([5, 6], np.uint64), np.array([0, 0, 1]), np.array([9, 8, 9], np.uint64))
    assert trie.count_book[counts[0] - 1] == 3 and counts[1] == 0
    assert abs(trie.backoff_book[backoffs[0] - 1] - 0.75 * 2 / 3) < 1e-6
    assert abs(trie.share_book[shares[0] - 1] - 0.25 / 3) < 1e-6 and shares[1:].tolist() == [0, 0]


def test_codebook_of_many_values():
    values = np.random.default_rng(1).lognormal(size=20_000)
    codes, book = codebook(values)
    assert len(book) == 256
    assert np.median(np.abs(book[codes] / values - 1)) < 0.02


def test_better_than_base_on_held_out(spark, sf_dir):
    rows = lm.op1_ef_trie_lm(spark, sf_dir).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
