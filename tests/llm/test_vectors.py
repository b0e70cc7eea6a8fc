import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import covertree, hnsw

rng = np.random.default_rng(5)


def vectors(n=700, d=12):
    x = rng.normal(size=(n, d)) * rng.uniform(0.2, 2, size=(n, 1))
    x[20:60] = x[20]  # copies
    x[60:90] = x[60] + 0.01 * rng.normal(size=(30, d))
    return x


ODD = [(5000, None), (5010, [1.0, None] + [0.0] * 10), (5020, [float("nan")] * 12), (5030, [math.inf] + [0.0] * 11), (None, [1.0] * 12), (5040, [0.0] * 12), (5050, [1.0, 2.0]), (5100, [1.0, 3.0])]


def frame(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows + ODD + rows[:3], "vec_id long, embedding array<double>")


def brute(x, step, k, score):
    """Every row is a candidate; the first three rows are there twice."""
    ids = list(range(len(x))) + [0, 1, 2]
    out = {}
    for q in range(0, len(x), step):
        s = sorted(((-score(x[q], x[i]), i) for i in ids if i != q))[:k]
        out[q] = [(r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return out


@pytest.mark.parametrize("block", [8192, 130])
def test_exact_top_k(spark, block):
    x = vectors()
    whole = np.floor(256 * x).astype(int)
    want = brute(whole, 50, 5, lambda a, b: int(a @ b))
    zero = sorted(((0, i) for i in range(len(x))))[:5]
    got = {}
    for r in covertree.top_k(frame(spark, x), F.col("vec_id") % 50 == 0, data_block=block, query_block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    with_zero = {q: v for q, v in got.items() if q < 5000}
    for q, rows in with_zero.items():
        best = sorted([(-int(whole[q] @ whole[i]), i) for i in [*range(len(x)), 0, 1, 2] if i != q] + [(0, 5040)])[:5]
        times = 2 if q < 3 else 1  # a row that is there twice asks twice
        assert [(r[1], r[2]) for r in rows[::times]] == [(i, -s) for s, i in best] == [(r[1], r[2]) for r in rows[times - 1 :: times]]
    assert set(with_zero) == set(want)
    assert got[5050] == [(1, 5100, 256 * 256 + 512 * 768)] and got[5100] == [(1, 5050, 256 * 256 + 512 * 768)]
    assert zero


def test_tree_keeps_cover_and_separation():
    tree = covertree.CoverTree(np.floor(256 * vectors(400)))
    assert sorted(tree.order.tolist()) == list(range(400))
    for node in range(len(tree.center)):
        below = tree.order[tree.low[node] : tree.high[node]]
        gaps = np.linalg.norm(tree.points[below] - tree.points[tree.center[node]], axis=1)
        assert abs(gaps.max() - tree.radius[node]) < 1e-6
        centers = tree.points[[tree.center[c] for c in tree.children[node]]]
        for a in range(len(centers)):
            assert all(np.linalg.norm(centers[a] - centers[b]) > tree.radius[node] / 2 - 1e-6 for b in range(a))


def test_graph_recall_and_scores(spark):
    x = vectors(3000, 16)
    got = {}
    for r in hnsw.nearest(frame(spark, x).filter(F.size("embedding") == 16), F.col("vec_id") % 20 == 0, shard=1000).collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(x, 20, 20, lambda a, b: float(a @ b))
    hit = 0
    for q, rows in want.items():
        order = sorted(got[q], key=lambda r: r["rank"])[:: 2 if q < 3 else 1]
        found = {r.vec_id: r.score for r in order}
        assert len(order) == 20 and q not in found
        for i, s in found.items():
            assert abs(s - float(x[q] @ x[i])) < 1e-9
        hit += sum(found.get(i) is not None for _, i, _ in rows)
        assert [(-r.score, r.vec_id) for r in order] == sorted((-r.score, r.vec_id) for r in order)
    assert hit / (20 * len(want)) >= 0.9


def test_graph_reaches_all_vertices():
    x = np.vstack([rng.normal(size=(400, 8)) + 40 * k for k in range(3)])
    graph = hnsw.Graph(np.arange(len(x)), x, 21)
    links = graph.layers[0][1]
    seen, front = {0}, [0]
    while front:
        front = [int(v) for u in front for v in links[u] if v >= 0 and int(v) not in seen and not seen.add(int(v))]
    assert len(seen) == len(graph.vectors)
    assert pickle.loads(pickle.dumps(graph)).layers


def test_few_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 0.0]), (5, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 2.0), (0, 2, 20, 1.0), (20, 1, 5, 2.0), (20, 2, 0, 1.0)]
    assert hnsw.nearest(rows.limit(0), F.lit(True)).count() == 0
    assert covertree.top_k(rows.limit(0), F.lit(True)).count() == 0


def test_repeated_ids(spark):
    """Rows of one id count one by one: as candidates, and as queries with their own rankings."""
    r = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in r.normal(size=6)]) for i in r.integers(0, 60, 300)]
    rows += [rows[0]] * 9 + [(50, rows[5][1]), (50, rows[6][1]), (100, rows[5][1])] + [(7, rows[5][1])] * 30
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = sorted((q, tuple(sorted(((-int(a @ b), i) for i, b in whole if i != q))[:5])) for q, a in whole if q % 50 == 0)
    got = {}
    for x in covertree.top_k(frame_, F.col("vec_id") % 50 == 0, data_block=90, query_block=4).collect():
        got.setdefault((x.query_id, x["rank"]), []).append((-x.score, x.vec_id))
    for place in range(5):
        for q in (0, 50, 100):
            assert sorted(got.get((q, place + 1), [])) == sorted(w[place] for i, w in want if i == q)
    exact = {}
    for q, a in rows:
        if q % 20 == 0:
            exact.setdefault(q, []).append(sorted(((-float(np.dot(a, b)), i) for i, b in rows if i != q))[:20])
    found = {}
    for x in hnsw.nearest(frame_, F.col("vec_id") % 20 == 0, shard=150).collect():
        found.setdefault(x.query_id, []).append((round(-x.score, 9), x.vec_id))
    assert {q: len(v) for q, v in found.items()} == {q: 20 * len(v) for q, v in exact.items()}
    near = sum(len(set(found[q]) & {(round(s, 9), i) for one in v for s, i in one}) for q, v in exact.items())
    assert near >= 0.9 * sum(len({(round(s, 9), i) for one in v for s, i in one}) for v in exact.values())


def test_small_shards_have_graphs():
    x = rng.normal(size=(40, 5))
    graph = hnsw.Graph(np.arange(40), x, 3)
    assert graph.layers and len(graph.layers[0][0]) == 40
    places, found, scores = hnsw.search(graph, np.array([100]), x[:1], 3, 16)
    best = np.argsort(-(x @ x[0]), kind="stable")[:3]
    assert found.tolist() == best.tolist() and places.tolist() == [0, 0, 0] and np.allclose(scores, (x @ x[0])[best])


def test_sql_agrees_on_repeated_rows(spark, tmp_path):
    import duckdb

    rows = [(50, [0.5, 1.0]), (50, [0.5, 1.0]), (50, [1.0, 0.25]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (100, [0.1, -2.0]), (5, [1.0]), (150, [2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = covertree.op5_exact_top_k(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.execute(f"SELECT query_id, rank, vec_id, score FROM ({covertree.OP5_SQL}) ORDER BY ALL").fetchall()
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want
