import math
import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import linking, retrieve, search, tree
from docweave.operators.retrieve import Corpus

#: id, kind, celex, parent, ord, text, display_ref
NODES = [
    ("A", "document", "A", None, 1, "act A", "A"),
    ("A1", "article", "A", "A", 1, "providers keep records of the notified thing", "Article 1"),
    ("A1p1", "paragraph", "A", "A1", 1, "first of the records", "Article 1(1)"),
    ("A1p2", "paragraph", "A", "A1", 2, "second of them", "Article 1(2)"),
    ("A2", "article", "A", "A", 2, "importers tell authorities", "Article 2"),
    ("A2p1", "paragraph", "A", "A2", 1, "telling of risks", "Article 2(1)"),
    ("Ar", "recital", "A", "A", 3, "whereas records matter", "Recital 1"),
    ("B", "document", "B", None, 1, "act B", "B"),
    ("B1", "article", "B", "B", 1, "records of the other act", "Article 1"),
    ("B1p1", "paragraph", "B", "B1", 1, "see the first act", "Article 1(1)"),
    ("B2", "article", "B", "B", 2, "amending text", "Article 2"),
    ("Gh", "guidance_section", "G", None, 1, "guide", "1"),
    ("G1", "guidance_subsection", "G", "Gh", 1, "on article one", "1.1"),
    ("G2", "guidance_subsection", "G", "Gh", 2, "more", "1.2"),
]
EDGES = [("B1p1", "CITES", "A1", "Article 1"), ("A2p1", "CITES", "A1p1", "x"), ("A1p2", "CITES", "B1", "y"), ("B2", "AMENDS", "A1", "Article 1"), ("G1", "INTERPRETS", "A1", "z"), ("A1", "OBLIGATION_OF", "r:provider", "s"), ("A2p1", "OBLIGATION_OF", "r:provider", "s"), ("B1", "OBLIGATION_OF", "r:maker", "s"), ("A1", "TRIGGERS", "A2", None), ("A2", "TRIGGERS", "B1", None)]
TERMS = [("notified thing", "A", "formal", "other", "A1p1"), ("notified thing", "B", "inline", "other", "B1"), ("records", "A", "formal", "actor", "A2p1"), ("thing", "B", "formal", "actor", "B1p1")]


@pytest.fixture(scope="module")
def corpus(spark):
    from docweave.operators.resolve import with_paths

    depth = {i: 0 for i, *_ in NODES}
    for i, _, _, parent, *_ in NODES:
        depth[i] = depth[parent] + 1 if parent else 0
    node = spark.createDataFrame([(i, k, c, p, o, t, r, depth[i]) for i, k, c, p, o, t, r in NODES], "id string, kind string, celex string, parent_id string, ord long, text string, display_ref string, depth int").cache()
    edge = spark.createDataFrame(EDGES, "src string, type string, dst string, ref_text string").cache()
    closed = tree.closure(with_paths(node)).cache()
    r = random.Random(1)
    vectors = spark.createDataFrame([(i, [r.uniform(0.1, 1) for _ in range(4)]) for i, *_ in NODES], "id string, embedding array<double>").cache()
    terms = spark.createDataFrame(TERMS, "term string, celex string, definition_type string, category string, source_id string")
    anchors = closed.join(node.filter("kind in ('article', 'recital', 'document', 'guidance_section', 'guidance_subsection')").select(F.col("id").alias("anc")), "anc").groupBy(F.col("desc_id").alias("id")).agg(F.min_by("anc", "dist").alias("anchor"))
    return Corpus(node, edge, closed, vectors, terms, anchors)


def ids(frame, case=1):
    return [r.id for r in sorted(frame.filter(F.col("case_id") == case).collect(), key=lambda r: r["rank"])]


def test_by_ids_and_refs(spark, corpus):
    wanted = spark.createDataFrame([(1, 0, "B1"), (1, 1, "A1"), (1, 2, "B1"), (1, 3, None), (1, 4, "nothing"), (2, 0, "A2")], "case_id long, at int, id string")
    assert ids(retrieve.by_ids(wanted, corpus)) == ["B1", "A1"]
    refs = spark.createDataFrame([(1, 0, "article 1", ["A"], None), (1, 1, "Article 2(68)", ["A"], None), (2, 0, "Article 1", None, None), (3, 0, "Annex V", None, None)], "case_id long, at int, ref string, acts array<string>, paragraph string")
    found = retrieve.by_refs(refs, corpus)
    assert ids(found) == ["A1", "A2"] and ids(found, 2) == ["A1", "B1"] and ids(found, 3) == []
    widened = spark.createDataFrame([(1, 0, "Article 2", ["A"], "1"), (2, 0, "Article 2", ["A"], "7")], "case_id long, at int, ref string, acts array<string>, paragraph string")
    got = retrieve.direct_provisions(widened, corpus)
    assert ids(got) == ["A2"] and ids(got, 2) == ["A2", "B2"]


def test_merged(spark, corpus):
    frame = lambda rows, channel: spark.createDataFrame([(1, i, n, 0.0, channel) for n, i in enumerate(rows, 1)], "case_id long, id string, rank int, score double, channel string")
    a, b = frame(["x", "y", "z"], "a"), frame(["z", "w"], "b")
    assert ids(retrieve.merged([a, b])) == ["x", "y", "z", "w"]
    assert ids(retrieve.merged([a, b], prepend=True)) == ["z", "w", "x", "y"]


def test_amendments_and_citers(spark, corpus):
    bag = spark.createDataFrame([(1, "A1p1", 1, 0.0, "s"), (1, "A2", 2, 0.0, "s")], "case_id long, id string, rank int, score double, channel string")
    assert ids(retrieve.surface_amendments(bag, corpus)) == ["B2", "A1p1", "A2"]
    leaf = spark.createDataFrame([(1, "B1", "A1p2", 1, 0.0, "s")], "case_id long, id string, leaf string, rank int, score double, channel string")
    assert ids(retrieve.surface_amendments(leaf, corpus)) == ["B2", "B1"]
    targets = spark.createDataFrame([(1, "A1")], "case_id long, id string")
    assert ids(retrieve.citing(targets, corpus, ("article",))) == ["A2", "B1"]


def test_roles_chain_terms(spark, corpus):
    roles = spark.createDataFrame([(1, "r:provider", None, [1.0, 0.0, 0.0, 0.0]), (2, "r:provider", ["B"], None)], "case_id long, role string, acts array<string>, vector array<double>")
    related = spark.createDataFrame([("r:provider", "r:maker")], "src string, dst string")
    found = ids(retrieve.by_roles(roles, related, corpus))
    assert set(found[:2]) == {"A1", "B1"} and found[2] == "A2p1"
    assert ids(retrieve.by_roles(roles, related, corpus), 2) == ["B1"]
    seeds = spark.createDataFrame([(1, "Article 1", ["A"]), (2, "Article 2", ["B"])], "case_id long, ref string, acts array<string>")
    chained = retrieve.by_chain(seeds, corpus, ("TRIGGERS",))
    assert ids(chained) == ["A1", "A2", "B1"] and ids(chained, 2) == ["B2"]
    assert ids(retrieve.by_chain(seeds, corpus, ("TRIGGERS",), seed_only=True)) == ["A1"]
    got = retrieve.by_term(spark.createDataFrame([(1, " Notified  Thing ")], "case_id long, term string"), corpus).collect()
    assert sorted((r.celex, r.source_id, r.parent_ref) for r in got) == [("A", "A1p1", "Article 1"), ("B", "B1", "B")]
    assert [(r.celex, r.term) for r in retrieve.by_category("actor", corpus).collect()] == [("A", "records"), ("B", "thing")]
    assert [r.celex for r in retrieve.by_category("actor", corpus, ["B"]).collect()] == ["B"]


def test_obligation_walk(spark):
    links = spark.createDataFrame([("Article 6", "A", "Article 8", None), ("Article 8", "A", "Article 5", "B"), ("Article 5", "B", "Article 6", "A")], "ref string, celex string, target_ref string, target_celex string")
    start = spark.createDataFrame([("Article 6", "A")], "ref string, celex string")
    assert sorted((r.ref, r.celex, r.hop) for r in retrieve.obligation_walk(start, links).collect()) == [("Article 5", "B", 2), ("Article 6", "A", 0), ("Article 8", "A", 1)]


def test_communities(spark, corpus):
    summaries = spark.createDataFrame([("c1", [1.0, 0.0], ["A"], 0, None, 3, "s1"), ("c2", [0.0, 1.0], ["B"], 0, None, 2, "s2"), ("c3", [0.9, 0.1], [], 1, "Top", 9, "s3")], "id string, embedding array<double>, regulations array<string>, level int, label string, member_count int, summary_text string")
    found = retrieve.communities(summaries, [(1, [1.0, 0.0])], 2, ["B"])
    assert ids(found) == ["c3", "c2"]
    members = spark.createDataFrame([("c3", "A1p1"), ("c3", "A1"), ("c2", "B1"), ("c2", "A")], "community string, id string")
    assert ids(retrieve.community_members(found, members, corpus.node, 2, ("article", "paragraph"))) == ["A1", "B1"]
    assert sorted(tuple(r) for r in retrieve.community_summaries(summaries, 0).collect()) == [("c1", "c1", 3, "s1"), ("c2", "c2", 2, "s2")]
    assert retrieve.community_summaries(summaries, 1).first().label == "Top"


def test_targets_definitions_gaps(spark, corpus):
    targets = spark.createDataFrame([(1, 0, "Article 2", ["B"]), (1, 1, "Article 1", ["A"]), (1, 2, "Annex I", None)], "case_id long, at int, ref string, acts array<string>")
    found = retrieve.lookup_targets(targets, corpus)
    assert ids(found) == ["B2", "A1"]
    assert [r.covered for r in retrieve.covered(targets, found, corpus.node).orderBy("at").collect()] == [True, True, False]
    known = spark.createDataFrame([(1, "records")], "case_id long, term string")
    acts = spark.createDataFrame([(1, ["B"])], "case_id long, acts array<string>")
    defined = retrieve.related_definitions(found, corpus, known, acts).orderBy("rank").collect()
    assert [(r.term, r.celex) for r in defined] == [("notified thing", "B"), ("thing", "B")]
    wants = spark.createDataFrame([(1, 0, 'the definition of "notified thing" in Article 9', ["A"]), (1, 1, "Article 2", ["A"]), (1, 2, "definition of nothing at all", None), (1, 3, "Article 1", ["A"])], "case_id long, at int, want string, acts array<string>")
    have = spark.createDataFrame([(1, "A1")], "case_id long, id string")
    assert ids(retrieve.gap_provisions(wants, corpus, have, 5)) == ["A1p1", "A2"]
    assert ids(retrieve.gap_provisions(wants, corpus, have, 1)) == ["A1p1"]


def test_whole_retrieve(spark, corpus):
    rows = {r.id: list(r.embedding) for r in corpus.vectors.collect()}
    anchor = {r.id: r.anchor for r in corpus.anchors.collect()}
    asked = [(1, [1.0, 0.2, 0.1, 0.0]), (2, [0.0, 0.3, 1.0, 0.5])]
    questions = spark.createDataFrame([(1, "records of the act", None), (2, "records", ["A", "B"])], "case_id long, text string, acts array<string>")
    documents = corpus.node.select("id", "text")
    got = retrieve.retrieve(questions, asked, corpus, documents, k=4)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    celex = {i: c for i, _, c, *_ in NODES}
    lexical = search.bm25(documents, questions.select(F.col("case_id").alias("question"), "text")).collect()
    for case, vector in asked:
        near = sorted((i for i in rows if case == 1 or celex[i] in "AB"), key=lambda i: (-round(cos(rows[i], vector), 6), i))
        words = sorted(((-round(r.score, 6), r.id) for r in lexical if r.question == case and (case == 1 or celex[r.id] in "AB")))
        place = {i: n for n, (_, i) in enumerate(words)}
        fused = {i: round(1 / (60 + n) + (0.5 / (60 + place[i]) if i in place else 0), 8) for n, i in enumerate(near)}
        best = {}
        for i in sorted(fused, key=lambda i: (-fused[i], i)):
            best.setdefault(anchor[i], (i, fused[i]))
        order = sorted(best, key=lambda a: (-best[a][1], a))
        kept, count = [], {}
        for a in order:
            if case == 1 or count.get(celex[a], 0) < 3:
                kept.append(a)
                count[celex[a]] = count.get(celex[a], 0) + 1
        want = [(a, best[a][0]) for a in kept[:4]]
        found = sorted((r for r in got.filter(F.col("case_id") == case).collect() if r.channel == "search"), key=lambda r: r["rank"])
        assert [(r.id, r.leaf) for r in found] == want
    assert {r.case_id for r in got.filter("channel = 'reverse'").collect()} <= {1}
    strong = spark.createDataFrame([(1, a, float(s)) for s, a in enumerate(sorted(set(anchor.values())))], "case_id long, id string, strong double")
    again = retrieve.retrieve(questions, asked, corpus, documents, k=2, rerank=strong)
    assert again.filter("case_id = 1 and channel = 'search'").count() == 2
    bags = {r.id: r for r in retrieve.with_bags(got.select("id").distinct(), corpus).collect()}
    if "A1" in bags:
        assert bags["A1"].children == ["A", "A1p1", "A1p2"] and bags["A1"].cited == ["B1"] and bags["A1"].interpreted == ["G1"]
    one = retrieve.with_bags(spark.createDataFrame([("G1",)], "id string"), corpus).first()
    assert one.children == ["Gh", "G2"] and one.interpreted == ["A1"]
    bare = retrieve.with_bags(spark.createDataFrame([("A1",)], "id string"), corpus, expanded=False).first()
    assert bare.children and not bare.cited and not bare.interpreted


def test_recitals_and_ranks(spark, corpus):
    assert ids(retrieve.recitals(corpus.vectors, corpus.node, [(1, [1.0, 0, 0, 0])], 3)) == ["Ar"]
    r = random.Random(2)
    rows = [(q, i, r.randrange(40) / 10) for q in range(3) for i in range(400)]
    scored = spark.createDataFrame(rows, "question long, id long, s double").repartition(5)
    want = {(q, i): n for q in range(3) for n, (_, i) in enumerate(sorted((-s, i) for p, i, s in rows if p == q))}
    assert {(x.question, x.id): x["rank"] for x in search.ranks(scored, "s").collect()} == want
    assert {(x.question, x.id): x["rank"] for x in search.ranks(scored, "s", 7).collect()} == {k: n for k, n in want.items() if n < 7}


def brute_links(text, terms):
    import re

    words, out, k = re.findall("[a-z0-9]+", (text or "").lower()), {}, 0
    tables = sorted({tuple(re.findall("[a-z0-9]+", t.lower())) for t in terms} - {()}, key=len, reverse=True)
    while k < len(words):
        hit = next((t for t in tables if tuple(words[k : k + len(t)]) == t), None)
        if hit:
            out[" ".join(hit)] = out.get(" ".join(hit), 0) + 1
        k += len(hit) if hit else 1
    return out


def test_dictionary_links(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    terms = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 1, 2, 2, 3, 5, 7, 9)] + ["", "w1-w2"]
    rows = [(k, " ".join(r.choice(words) for _ in range(60)) + " " + r.choice(terms)) for k in range(40)] + [(100, None), (101, ""), (102, terms[7]), (102, terms[7])]
    documents, known = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    want = {}
    for i, text in rows:
        for t, n in brute_links(text, terms).items():
            want[i, t] = want.get((i, t), 0) + n
    for links in (linking.dictionary_links, linking.token_links):
        assert {(x.id, x.term): x.n for x in links(documents, known).collect()} == want
        assert links(documents, known.limit(0)).count() == 0 == links(documents.limit(0), known).count()


def test_term_links(spark):
    provisions = spark.createDataFrame([("p1", "the notified body and the risk"), ("p2", "Notified-body means a body"), ("p3", None)], "id string, text string")
    terms = spark.createDataFrame([("t1", "notified body", "p2"), ("t2", "notified body", "q9"), ("t3", "risk", "p9")], "term_id string, term string, source_id string")
    assert sorted((r.id, r.term_id) for r in linking.term_links(provisions, terms).collect()) == [("p1", "t1"), ("p1", "t2"), ("p2", "t2")]
