"""Consolidation in parts of acts against acts as one task."""

import random

import pytest

from docweave.operators import consolidate

NODES = "act string, id string, parent_id string, ord long, title string, text string"
OPS = "act string, seq long, op string, target string, id string, title string, text string"


def case(seed, linked):
    chance = random.Random(seed)
    nodes, ops = [], []
    for act in ("A", "B", None):
        ids = []
        for k in range(120):
            parent = chance.choice(ids) if ids and chance.random() < 0.7 else ("gone" if chance.random() < 0.1 else None)
            ids.append(f"{act}{k}")
            nodes.append((act, ids[-1], parent, chance.randrange(40), f"t{k}", f"x{k}"))
        for seq in range(60):
            kind = chance.choice(["insert_after", "insert_after", "add", "replace", "heading", "delete", "what"])
            target = chance.choice(ids) if chance.random() < 0.9 else "nowhere"
            new = f"new{seq // 2 if linked and act == 'A' else seq}"
            ops.append((act, seq, kind, f"new{seq // 3}" if linked and act == "A" and chance.random() < 0.4 else target, new, "head", "words"))
    return nodes, ops


@pytest.mark.parametrize("seed,linked", [(1, False), (2, True)])
def test_parts_give_what_whole_acts_give(spark, seed, linked):
    nodes, ops = case(seed, linked)
    names, fields = NODES.replace(" string", "").replace(" long", "").split(", "), OPS.replace(" string", "").replace(" long", "").split(", ")
    trees, reports = set(), set()
    for act in ("A", "B", None):
        rows, report = consolidate.apply_operations([dict(zip(names, r)) for r in nodes if r[0] == act], [dict(zip(fields, r)) for r in ops if r[0] == act])
        trees |= {(act, r["id"], r["parent_id"], r["pos"], r["title"], r["text"]) for r in rows}
        reports |= {(act, *r.values()) for r in report}
    made, report = consolidate.consolidate(spark.createDataFrame(nodes, NODES), spark.createDataFrame(ops, OPS), group=10)
    got = consolidate.numbered(made).collect()
    assert len(got) == len(trees) and {tuple(r) for r in got} == trees
    assert {tuple(r) for r in report.collect()} == reports


def test_a_large_act_is_many_tasks(spark):
    nodes = [("A", f"n{k}", None, k, "t", "x") for k in range(200)]
    made, _ = consolidate.consolidate(spark.createDataFrame(nodes, NODES), spark.createDataFrame([], OPS), group=20)
    assert made.agg({"pos": "max"}).first()[0] < 60  # before, an act was one group and its places ran to 200
    assert sorted(r.pos for r in consolidate.numbered(made).collect()) == list(range(1, 201))


def test_circles(spark):
    nodes = [("A", "a", "b", 1, "t", "x"), ("A", "b", "a", 2, "t", "x"), ("A", "c", None, 3, "t", "x")]
    made, report = consolidate.consolidate(spark.createDataFrame(nodes, NODES), spark.createDataFrame([("A", 1, "heading", "b", None, "u", None)], OPS), group=1)
    assert {(r.id, r.pos, r.title) for r in consolidate.numbered(made).collect()} == {("a", 1, "t"), ("b", 1, "u"), ("c", 1, "t")}
    assert report.first().status == "applied"
