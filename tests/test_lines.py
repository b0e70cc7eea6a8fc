"""Paths with lines: what a node's ancestors say, without joins of nodes."""

import random

from docweave.operators import graph, references, tree
from docweave.plans import tree_queries
from docweave.sources import corpus


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_paths_from_the_tables_are_those_of_the_nodes(spark, sf_dir):
    got, want = corpus.pathed(spark, sf_dir), corpus.with_paths(corpus.nodes(spark, sf_dir), corpus.LEVELS)
    plain = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert plain(got) == plain(want) != []
    lined = tree._lined(want).select("id", "line")
    assert sorted(map(repr, got.select("id", "line").collect())) == sorted(map(repr, lined.collect()))


def test_headings_and_references_need_no_closure(spark, sf_dir):
    assert exchanges(tree_queries.tree_display(spark, sf_dir)) <= 5  # tables alone; before, nodes and pairs of nodes besides
    assert exchanges(tree_queries.tree_context(spark, sf_dir)) <= 5


def test_citing_by_lines_equals_the_closure(spark):
    chance, rows, depth = random.Random(7), [], {}
    for k in range(300):
        parent = chance.choice([None, *range(max(0, k - 12), k)]) if k else None
        depth[k] = 0 if parent is None else depth[parent] + 1
        rows.append((str(k), chance.choice(["article", "chapter", "point"]), None if parent is None else str(parent), k, depth[k], "t", "x"))
    node = spark.createDataFrame(rows, "id string, kind string, parent_id string, ord long, depth int, title string, text string")
    edge = spark.createDataFrame([(str(chance.randrange(300)), "CITES", str(chance.randrange(300))) for _ in range(900)], "src string, type string, dst string")
    pathed = tree._lined(corpus.with_paths(node))
    want = graph.citing_provisions(node.filter("kind = 'chapter'"), node, edge, tree.closure(pathed), ("article",), 2)
    got = graph.citing_by_lines(pathed, edge, "chapter", ("article",), 2)
    plain = lambda df: sorted((r.target, r.id, r.n) for r in df.collect())
    assert plain(got) == plain(want) != []
    kinds = {r[0]: r[1] for r in rows}
    pairs = {(r.anc, r.desc_id, r.dist) for r in tree.closure(pathed).collect() if "article" in (kinds[r.anc], kinds[r.desc_id])}
    assert {tuple(r) for r in tree.closure(pathed, kind="article").select("anc", "desc_id", "dist").collect()} == pairs


def test_families_are_read_only_where_they_can_begin():
    reader, asked = references.Reader("flag R under Article 5(1) of the Annex III, point 2, and Regulation (EU) 2016/679"), []
    read = lambda i: asked.append(i) or reader.external(i)
    places = reader.openers(references.OPENERS["external"])
    assert list(reader.all_of(read, places)) == list(reader.all_of(reader.external)) != []
    assert len(asked) == 1
