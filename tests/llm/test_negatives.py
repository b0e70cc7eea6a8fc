"""Hard negatives: brute force on random and clustered vectors, ties, repeated rows, other lengths and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, is_anchor, scale=256):
    held = [(i, l, np.floor(np.array(e, np.float32).astype(np.float64) * scale)) for i, l, e in rows if i is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, l, e in held:
        if not is_anchor(i):
            continue
        scores = [(int(e @ x), j, m) for j, m, x in held if j != i and len(x) == len(e)]
        best = lambda some, k: sorted(some, key=lambda s: (-s[0], s[1]))[:k]
        for p, j, _ in best([s for s in scores if s[2] == l], 5):
            for rank, (n, m, _) in enumerate(best([s for s in scores if s[2] != l and 50 * p <= 100 * s[0] <= 95 * p], 3), 1):
                out.append((i, j, rank, m, p, n))
    return sorted(out)


def mined(spark, rows, **how):
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, **how)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("kind", ["random", "clustered", "one vector"])
def test_against_brute_force(spark, kind):
    chance = np.random.default_rng(1)
    points = chance.normal(size=(240, 6))
    if kind == "clustered":
        points = chance.normal(size=(6, 6))[chance.integers(6, size=240)] + 0.05 * points
    if kind == "one vector":
        points[80:200] = points[0]
    rows = [(k, int(chance.integers(4)), points[k].tolist()) for k in range(240)]
    assert mined(spark, rows, shelf=40) == brute(rows, lambda i: i % 5 == 0) != []


def test_broken_and_repeated_rows(spark):
    chance = np.random.default_rng(2)
    rows = [(k, k % 3, chance.normal(size=4).tolist()) for k in range(40)]
    rows += [rows[5], rows[5], rows[6], rows[6], (5, 1, rows[0][2])]  # an anchor three times over, and once more with another vector
    rows += [(100, None, [1.0] * 4), (None, 1, [1.0] * 4), (105, 1, None), (110, 1, [1.0, None, 0.0, 0.0]), (115, 1, [float("inf"), 0.0, 0.0, 0.0]), (120, 1, [float("nan"), 0.0, 0.0, 0.0]), (125, 1, [])]
    rows += [(200 + k, k % 2, chance.normal(size=7).tolist()) for k in range(12)]
    assert mined(spark, rows, shelf=20) == brute(rows, lambda i: i % 5 == 0)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(5, 1, [1.0])]) == []


def test_bounds_hold_and_stop_is_strict():
    """No row of a list scores beyond its bounds; a tie with the k-th score is met by the smaller id."""
    chance = np.random.default_rng(3)
    points = np.floor(chance.normal(size=(500, 8)) * 50)
    lists = negatives.Lists(np.arange(500), chance.integers(3, size=500), chance.integers(9, size=500), points)
    q = points[0]
    top, low = negatives._bounds(lists.centers @ q, np.sqrt(q @ q) * lists.radius)
    for k in range(len(lists.labels)):
        scores = lists.points[lists.begin[k] : lists.begin[k + 1]] @ q
        assert low[k] <= scores.min() and scores.max() <= top[k]
    same = negatives.Lists(np.arange(10)[::-1].copy(), np.zeros(10, int), np.arange(10), np.ones((10, 2)))
    (_, ids, scores), *_ = same.search(99, 0, np.ones(2), np.array([(-negatives.ANY, negatives.ANY, 2)]), 3, True)
    assert ids.tolist() == [0, 1, 2] and scores.tolist() == [2, 2, 2]


def test_lists_outside_the_window_are_skipped(monkeypatch):
    points = np.concatenate([np.full((300, 2), 100.0), np.full((300, 2), 10.0), np.full((300, 2), 1.0)])
    lists = negatives.Lists(np.arange(900), np.zeros(900, int), np.repeat([0, 1, 2], 300), points)
    looked = []
    monkeypatch.setattr(negatives.np, "rint", lambda x: looked.append(len(x)) or np.round(x))
    (_, ids, scores), *_ = lists.search(-1, 1, np.ones(2), np.array([(1_500, 2_500, -negatives.ANY)]), 3, False)
    assert looked == [300] and scores.tolist() == [20, 20, 20] and ids.tolist() == [300, 301, 302]


def test_columns_of_clashing_names(spark):
    rows = spark.createDataFrame([(5, 1, [1.0, 2.0]), (6, 1, [1.0, 2.0]), (7, 2, [1.0, 1.0])], SCHEMA).withColumns({c: F.lit("x") for c in ("key", "dim", "place", "rank", "score", "shelf", "slice", "times", "cluster")})
    assert negatives.mine(rows, F.col("vec_id") == 5).count() == 1
