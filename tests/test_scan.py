"""Scans over ranges: carries, sums, intervals, texts and contexts against loops, with one act over all ranges."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import graph, resolve, scan, tree
from docweave.sources import corpus


@pytest.fixture
def ranges(spark):
    """More ranges than rows of most keys, none joined together."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_carries_and_sums(spark, ranges):
    chance = random.Random(1)
    rows = [(chance.choice([None, "a", "b"]) if k < 60 else "c", k, chance.choice([None, None, None, k]), chance.randrange(5)) for k in range(400)]
    ranged = scan.ranged(spark.createDataFrame(rows, "act string, seq long, mark long, n long").repartition(5), ["act"], ["seq"])
    assert ranged.select(scan.PART).distinct().count() > 3
    last, total, want = {}, {}, {}
    for act, seq, mark, n in rows:
        last[act] = mark if mark is not None else last.get(act)
        total[act] = total.get(act, 0) + n
        want[seq] = (last[act], total[act])
    carried = scan.carried(ranged, ["seq"], {"x": F.col("mark")})
    summed = scan.running(ranged, ["seq"], {"y": F.col("n")})
    assert {r.seq: r.x for r in carried.collect()} == {k: v[0] for k, v in want.items()}
    assert {r.seq: r.y for r in summed.collect()} == {k: v[1] for k, v in want.items()}
    assert scan.finished(scan.carried(scan.ranged(spark.createDataFrame([], "act string, seq long, mark long"), ["act"], ["seq"]), ["seq"], {"x": F.col("mark")})).count() == 0


def forest(seed, n=300):
    chance = random.Random(seed)
    rows, depth = [], {}
    for k in range(n):
        parent = chance.choice([None, *range(max(0, k - 12), k)]) if k else None
        depth[k] = 0 if parent is None else depth[parent] + 1
        if depth[k] > 5:
            parent, depth[k] = None, 0
        body = chance.choice([None, "", "Body.", "words of text", "title"])
        rows.append((str(k), chance.choice(["article", "point"]), None if parent is None else str(parent), k, depth[k], "title", body))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tree(spark, ranges, seed):
    rows = forest(seed)
    node = spark.createDataFrame(rows, "id string, kind string, parent_id string, ord long, depth int, title string, text string")
    pathed = corpus.with_paths(node)
    by = {r[0]: r for r in rows}
    below = {}
    for r in rows:
        below.setdefault(r[2], []).append(r[0])
    order = []

    def walk(i):
        begin = len(order)
        order.append(i)
        for c in below.get(i, []):
            walk(c)
        spans[i] = (begin, len(order) - 1)

    spans = {}
    for root in below[None]:
        walk(root)
    got = {r.id: (r.begin, r.end) for r in tree.numbered(tree.in_order(pathed)).collect()}
    assert got == spans
    body = lambda i: by[i][6].strip() if by[i][6] and by[i][6].strip() and by[i][6] != by[i][5] else None
    for most in (None, 30):
        flat = {r.id: r for r in tree.flatten(pathed, "article", most).collect()}
        assert set(flat) == {r[0] for r in rows if r[1] == "article"}
        for i, r in flat.items():
            a, b = spans[i]
            whole = " ".join(t for j in order[a : b + 1] if (t := body(j))) or None
            assert r.full_length == (len(whole) if whole else None)
            assert r.text == whole if most is None else (r.text or "")[: most + 1] == (whole or "")[: most + 1]


def test_citing_equals_the_closure(spark, ranges):
    rows = forest(3)
    chance = random.Random(4)
    node = spark.createDataFrame(rows, "id string, kind string, parent_id string, ord long, depth int, title string, text string")
    edge = spark.createDataFrame([(str(chance.randrange(300)), "CITES", str(chance.randrange(300))) for _ in range(900)], "src string, type string, dst string")
    pathed = corpus.with_paths(node)
    want = graph.citing_provisions(node.filter("ord % 7 = 0"), node, edge, tree.closure(pathed), ("article",))
    got = graph.citing_in_order(tree.in_order(pathed.select("id", "kind", "depth", "key", "ord")), edge, F.col("ord") % 7 == 0, ("article",))
    plain = lambda df: sorted((r.target, r.id, r.n) for r in df.collect())
    assert plain(got) == plain(want) != []


def test_contexts_of_one_long_act(spark, ranges):
    chance = random.Random(5)
    kinds = ["chapter", "article", "paragraph", "subparagraph", "point"]
    rows = [("A" if k < 500 else "B", k, str(k), chance.choice(kinds), str(chance.randrange(9))) for k in range(520)]
    got = {r.seq: (r.ctx_chapter, r.ctx_article, r.ctx_paragraph, r.ctx_subparagraph) for r in resolve.with_context(spark.createDataFrame(rows, "celex string, seq long, id string, kind string, number string")).collect()}
    now, act = {}, None
    for celex, seq, _, kind, number in rows:
        if celex != act:
            now, act = {}, celex
        if kind == "article":
            now = {"chapter": now.get("chapter"), "article": number}
        elif kind == "paragraph":
            now = {**now, "paragraph": number, "subparagraph": None}
        elif kind != "point":
            now = {**now, kind: number}
        assert got[seq] == tuple(now.get(k) for k in kinds[:4]), seq


def test_no_act_is_one_window(spark):
    rows = spark.createDataFrame([("A", 1, "1", "article", "1")], "celex string, seq long, id string, kind string, number string")
    plan = resolve.with_context(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("__part" in line for line in plan.split("\n") if line.strip().startswith(("+- Window", "Window")))
