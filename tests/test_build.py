"""Operators that SQL cannot state: invariants and small cases."""

import random

from docweave.operators import communities, consolidate, spans, verify
from docweave.plans import graph_build_queries as q
from docweave.sources import parse


def test_html_blocks_skip_navigation():
    html = "<html><head><title>T &amp; U</title><script>x</script></head><body><nav><p>no</p></nav><div class='ad'><p>no</p></div><h1>One</h1><p>a<br>b</p><h2>Two</h2><ul><li>c<li>d</ul><h1>Three</h1><p>e</p></body>"
    assert parse.html_blocks(html) == [("title", 0, "T & U", -1), ("heading", 1, "One", -1), ("paragraph", 0, "a b", 1), ("heading", 2, "Two", 1), ("item", 0, "c", 3), ("item", 0, "d", 3), ("heading", 1, "Three", -1), ("paragraph", 0, "e", 6)]


def test_pages(spark, sf_dir):
    rows = q.html_nodes(spark, sf_dir).collect()
    pages = {r.page_id for r in rows}
    assert len(pages) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.text and r.parent_seq < r.seq for r in rows)


def nodes():
    return [{"id": i, "parent_id": p, "ord": k, "title": i, "text": i} for k, (i, p) in enumerate([("a", None), ("a1", "a"), ("a2", "a"), ("a11", "a1"), ("b", None)])]


def op(seq, kind, target, new=None):
    return {"seq": seq, "op": kind, "target": target, "id": new, "title": "t", "text": "x"}


def test_consolidation_rules():
    same, _ = consolidate.apply_operations(nodes(), [])
    assert {(r["id"], r["parent_id"]) for r in same} == {(r["id"], r["parent_id"]) for r in nodes()}
    got, report = consolidate.apply_operations(nodes(), [op(1, "insert_after", "a1", "new"), op(2, "delete", "new"), op(3, "replace", "a1"), op(4, "heading", "b"), op(5, "add", "b", "b1"), op(6, "delete", "a11"), op(7, "add", "b", "b1")])
    by = {r["id"]: r for r in got}
    assert set(by) == {"a", "a1", "a2", "b", "b1"}
    assert by["a1"]["text"] == "x" and by["b"]["title"] == "t" and by["a2"]["pos"] == 2
    assert [r["status"] for r in report] == ["applied"] * 5 + ["unresolved", "duplicate"]


def test_louvain_finds_cliques():
    links = {}
    for g in "ab":
        for i in range(5):
            links[f"{g}{i}"] = {f"{g}{j}": 1.0 for j in range(5) if j != i}
    links["a0"]["b0"] = links["b0"]["a0"] = 0.5
    got = communities.louvain(links)
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"] and set(got) == set(links)


def test_communities_on_tables(spark, sf_dir):
    rows = q.louvain_communities(spark, sf_dir).collect()
    assert len({r.id for r in rows}) == len(rows)
    pairs = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(4) for j in range(i)], "a string, b string, weight double")
    labels = communities.label_propagation(pairs, 4)
    assert labels.select("label").distinct().count() == 2
    assert abs(communities.modularity(pairs, labels).first()[0] - 0.5) < 1e-9


def test_overlapping_spans():
    s = lambda a, b: {"start": a, "end": b}
    kept = spans.contained([s(0, 10), s(2, 5), s(8, 12), s(0, 10)])
    assert [(x["start"], x["end"]) for x in kept] == [(0, 10), (0, 10), (8, 12)]
    r = random.Random(1)
    for _ in range(50):
        once = spans.contained([s(a := r.randrange(20), a + r.randrange(1, 8)) for _ in range(6)])
        assert spans.contained(once) == once
    found = spans.references_in("See Article 5(2), point (a) and Annex II, Section A; paragraph 3; Regulation (EU) 2017/745; Articles 2 to 4")
    assert [f["kind"] for f in found] == ["explicit", "explicit", "relative", "external", "range"]
    assert dict(found[0]["groups"]) == {"article": "5", "paragraph": "2", "point": "a"}
    assert spans.quotes_in('He said "' + "x" * 50 + '" and "short"')[0]["start"] == 9


def test_near_quotes():
    quote = "the manufacturer shall keep the technical documentation at the disposal of the authorities"
    assert verify.nearness(quote, "so: " + quote.replace("keep", "kept") + " always")[0] > 0.9
    assert verify.nearness(quote, "nothing of that kind is written here")[0] < 0.6
