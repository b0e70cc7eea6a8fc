import json

from pyspark.sql import functions as F

from docweave.sources import files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_pages_and_parsed(spark, tmp_path):
    put(tmp_path / "legislation" / "A" / "EN" / "raw" / "raw.html", "<p>a\nb</p>")
    put(tmp_path / "legislation" / "A" / "EN" / "raw" / "raw_preamble.html", "<p>pre</p>")
    put(tmp_path / "legislation" / "B" / "DE" / "raw" / "raw.html", "<p>c</p>")
    assert sorted((r.family, r.doc_id, r.lang, r.html) for r in files.raw_pages(spark, str(tmp_path)).collect()) == [("legislation", "A", "EN", "<p>a\nb</p>"), ("legislation", "B", "DE", "<p>c</p>")]
    assert files.raw_pages(spark, str(tmp_path), "EN").count() == 1 == files.raw_preambles(spark, str(tmp_path)).count()
    envelope = lambda text: json.dumps({"celex_id": "A", "provisions": [{"id": "A_document", "kind": "document", "text": text, "path": []}], "relations": [{"source": "a", "type": "CITES", "target": "b", "properties": {"ref_text": "x"}}], "defined_terms": [{"id": "t", "term": "thing", "celex": "A"}]}, indent=1)
    put(tmp_path / "legislation" / "A" / "EN" / "parsed.json", envelope("first"))
    put(tmp_path / "legislation" / "A" / "EN" / "parsed.consolidated.json", envelope("second"))
    for consolidated, text in ((False, "first"), (True, "second")):
        parsed = files.parsed_documents(spark, str(tmp_path), consolidated)
        assert [r.text for r in files.provisions_of(parsed).collect()] == [text]
    assert files.relations_of(parsed).first().properties == {"ref_text": "x"} and files.terms_of(parsed).first().term == "thing"
    files.write_parsed(parsed.select("celex_id", "provisions", "family", "doc_id", "lang"), str(tmp_path / "out"))
    files.write_parsed(parsed.select("celex_id", "provisions", F.lit("x").alias("family"), "doc_id", "lang"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_catalogue_cases_log(spark, tmp_path):
    put(tmp_path / "cat.json", '{"id": "a", "tier": 1}\n{"id": "b"}\n{"id": "c", "tier": 3}\n')
    ids = lambda n: sorted(r.id for r in files.catalogue(spark, str(tmp_path / "cat.json"), n).collect())
    assert ids(99) == ["a", "b", "c"] and ids(2) == ["a"]
    put(tmp_path / "golden.json", '[{"id": "HQ", "expected_celexes": ["A"]}, {"id": "H2"}]')
    assert files.json_cases(spark, str(tmp_path / "golden.json"), "id string, expected_celexes array<string>").count() == 2
    lines = ['{"type": "interaction", "ts": "2026-01-01T00:00:00Z", "interaction_id": "1", "question": "q"}', "{broken", '{"type": "feedback", "ts": "2026-01-01T00:00:01Z", "interaction_id": "1", "rating": "up"}', '{"type": "feedback", "ts": "2026-01-01T00:00:02Z", "interaction_id": "1", "rating": "down"}', '{"type": "interaction", "ts": "2026-01-01T00:00:00Z", "interaction_id": "2"}', '{"type": "other"}']
    put(tmp_path / "log" / "a.jsonl", "\n".join(lines) + "\n")
    rows = files.log(spark, str(tmp_path / "log"))
    assert rows.count() == 4
    assert {r.interaction_id: r.rating for r in files.with_feedback(rows).collect()} == {"1": "down", "2": None}
    assert files.append_log(rows, str(tmp_path / "again")) and not files.append_log(rows, "nowhere://x/y")


def test_owned_partitions_and_vectors(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    root = str(tmp_path / "edges")
    files.write_owned(rows("a", "b"), root, "one")
    files.write_owned(rows("x"), root, "two")
    files.write_owned(rows("c"), root, "one")
    assert sorted((r.producer, r.id) for r in spark.read.parquet(root).collect()) == [("one", "c"), ("two", "x")]
    vectors = lambda **v: spark.createDataFrame([(k, [float(x)]) for k, x in v.items()], "id string, embedding array<double>")
    root = str(tmp_path / "vectors")
    files.write_vectors(vectors(a=1, b=2, c=3), root, 2)
    files.write_vectors(vectors(b=9, d=4), root, 2)
    assert {r.id: r.embedding[0] for r in spark.read.parquet(root).collect()} == {"a": 1.0, "b": 9.0, "c": 3.0, "d": 4.0}


def test_exports(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "Hello "), (1, 0, "user", "Hi"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.markdown for r in files.conversation_markdown(turns).collect()}
    assert got == {1: "# Conversation\n\n### User\n\nHi\n\n### Assistant\n\nHello\n", 2: "# Conversation\n\n### Unknown\n\n\n"}
    cases = spark.createDataFrame([(1, "q"), (2, "r")], "case_id long, question string")
    hits = spark.createDataFrame([(1, "search", 1, "a", 0.5)], "case_id long, channel string, rank int, id string, score double")
    checks = spark.createDataFrame([(1, "role_coverage", True, None)], "case_id long, check string, passed boolean, detail string")
    rows = {r.case_id: r for r in files.trace(cases, hits, checks).collect()}
    assert rows[1].hits[0].id == "a" and rows[1].checks[0].passed and rows[2].hits is None
    found = files.uniqueness({"t": (hits, ["id"]), "u": (hits.union(hits), ["case_id", "id"])}).collect()
    assert [tuple(r) for r in found] == [("u", "1|a", 2)]


def test_upserts(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "B"), ("d", None)], "id string, celex string")
    parts = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, ord int")
    got = files.upsert_parts(parts(("a", "b", 1)), parts(("a", "b", 7), ("a", "c", 2), ("a", "c", 3), ("a", "z", 1)), nodes)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", 1), ("a", "c", 2)]
    relations = spark.createDataFrame([("a", "CITES", "b"), ("a", "CITES_EXTERNAL", "ext"), ("a", "LIKES", "c"), ("a", None, "c")], "source string, type string, target string")
    inside, outside, unknown = files.routed_relations(relations, ("CITES",), ("CITES_EXTERNAL",))
    assert (inside.count(), outside.count(), unknown.count()) == (1, 1, 2)
    terms, edges = files.upsert_terms(spark.createDataFrame([("t1", "old", "a"), ("t2", "old", "z")], "id string, term string, source_id string"), spark.createDataFrame([("t1", "new", "b"), ("t3", "new", None)], "id string, term string, source_id string"), nodes)
    assert {r.id: r.term for r in terms.collect()} == {"t1": "new", "t2": "old", "t3": "new"} and [tuple(r) for r in edges.collect()] == [("t1", "b")]
    left, kept = files.wiped(nodes, parts(("a", "c", 1), ("c", "d", 1)), ["A"])
    assert sorted(r.id for r in left.collect()) == ["c", "d"] and [(r.src, r.dst) for r in kept.collect()] == [("c", "d")]
    acts = spark.createDataFrame([("ext_regulation_eu_2017_745",), ("ext_directive_1",)], "id string")
    assert [r.id for r in files.without_stale_acts(acts, spark.createDataFrame([("2017_745",)], "fragment string")).collect()] == ["ext_directive_1"]


def test_embedding(spark):
    node = spark.createDataFrame([("a", "A / 1", "the thing"), ("b", None, "the thing"), ("c", "x", None), ("d", "x", "")], "id string, display_path string, text string")
    made = {r.id: r.text for r in files.passages(node).collect()}
    assert made == {"a": "passage: A / 1: the thing", "b": "passage: : the thing", "d": "passage: x: "}
    got = {r.id: r.embedding for r in files.embed(spark.createDataFrame([("a", "one two"), ("b", "two one"), ("c", None)], "id string, text string"), 16).collect()}
    assert got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and set(got["c"]) == {0.0}
    custom = files.embed(node.select("id", "text").filter("text is not null"), encode=lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert all(len(r.embedding) == 2 for r in custom)
    assert node.select(files.query_text(F.lit(" q "))).first()[0] == "query: q"
