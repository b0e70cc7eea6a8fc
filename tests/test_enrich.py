import datetime

from pyspark.sql import functions as F

from docweave.operators import communities, enrich
from docweave.streaming import events

D = datetime.date


def test_applicability(spark):
    acts = spark.createDataFrame([("A", "AI Act", D(2024, 8, 1), D(2026, 8, 2)), ("M", "MDR", D(2017, 5, 25), D(2021, 5, 26)), ("X", "None", None, None)], "act string, name string, entry_into_force date, general_application date")
    milestones = spark.createDataFrame([("A", D(2025, 2, 2), "bans", "Article 113(a)"), ("A", D(2026, 8, 2), "rest", "Article 113"), ("M", D(2021, 5, 26), "all", "Article 123")], "act string, date date, scope string, citation string")
    day = F.lit("2026-01-01").cast("date")
    got = {r.act: (r.in_force, r.generally_applicable, [x.scope for x in r.applied], [x.scope for x in r.pending]) for r in enrich.applicability_status(acts, milestones, day).collect()}
    assert got == {"A": (True, False, ["bans"], ["rest"]), "M": (True, True, ["all"], []), "X": (False, False, [], [])}
    notes = {r.act: r.note for r in enrich.applicability_notes(acts, milestones, day).collect()}
    assert notes == {"A": "AI Act (A) — in force since 2024-08-01; general application 2026-08-02:\n    - 2025-02-02 [applies] bans (Article 113(a))\n    - 2026-08-02 [NOT YET applicable] rest (Article 113)"}


def test_captions_pointers_summaries(spark):
    c = spark.createDataFrame([("c1", " ", None, ["B", "A"], 3), ("c2", "Title", "L", [], 1), ("c3", None, "L", None, None), ("c4", None, None, [], None)], "id string, title string, label string, regulations array<string>, member_count int")
    assert {r.id: r.caption for r in enrich.community_captions(c).collect()} == {"c1": "Community of 3 provisions in A, B", "c2": "Title", "c3": "L", "c4": "Community of 0 provisions"}
    bag = spark.createDataFrame([(1, "a", 0, "A", "see Article 2 and Article 1"), (1, "b", 1, "B", "Article 2, Article 9"), (1, "n", 2, "A", None)], "case_id long, id string, pos int, celex string, text string")
    node = spark.createDataFrame([("a", "A", "Article 1"), ("a2", "A", "Article 2"), ("b2", "B", "article 2")], "id string, celex string, display_ref string")
    assert [(r["rank"], r.id) for r in enrich.inline_pointers(bag, node, 5).orderBy("rank").collect()] == [(1, "a2"), (2, "b2")]
    parts = spark.createDataFrame([("u", "c1", 2, "small"), ("u", "c2", 9, "large"), ("u", "c3", 5, None)], "community string, part string, member_count int, summary string")
    assert [tuple(r) for r in enrich.summaries_of(parts, 5).collect()] == [("u", "[c2] large\n[c1] small")]
    dominant = spark.createDataFrame([("c1", "A_cpt_I"), ("c2", "A_cpt_I"), ("c3", None)], "community string, chapter string")
    members = spark.createDataFrame([("c1", "x", "A"), ("c1", "y", "A"), ("c2", "z", "B"), ("c3", "w", "A")], "community string, id string, celex string")
    upper, parent = communities.upper_communities(dominant, members)
    assert [tuple(r) for r in upper.collect()] == [("community::L1::A_cpt_I", 1, 3, ["A", "B"], ["c1", "c2"])]
    assert sorted(r.id for r in parent.collect()) == ["c1", "c2"]
    one = spark.range(1)
    score = lambda *x: round(one.select(enrich.completeness(*map(F.lit, x))).first()[0], 6)
    assert (score(True, False, False, False, False), score(False, True, False, True, False), score(True, False, True, True, True)) == (1.0, 0.1, 1.0)
    assert [r[0] for r in spark.createDataFrame([("guidance_section", None), ("article", None), ("article", "x")], "k string, s string").select(enrich.source_type(F.col("k"), F.col("s"))).collect()] == ["guidance", "regulation", "x"]


def test_state_survives_a_new_run(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, event_type string, value double"
    rows = lambda *r: spark.createDataFrame([(u, datetime.datetime(2026, 1, 1, h), e, "x", 1.0) for u, h, e in r], schema)
    source, folder = str(tmp_path / "in"), str(tmp_path / "kept")
    rows((1, 1, 1), (2, 1, 2)).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    assert {r.user_id: r.event_id for r in events.keep_latest(stream(), folder, "user_id").collect()} == {1: 1, 2: 2}
    rows((1, 2, 3), (3, 1, 4)).write.mode("append").parquet(source)
    # A new run knows nothing of the first but what is in the folder.
    assert {r.user_id: r.event_id for r in events.keep_latest(stream(), folder, "user_id").collect()} == {1: 3, 2: 2, 3: 4}
    assert {r.user_id: r.event_id for r in events.keep_latest(stream(), folder, "user_id").collect()} == {1: 3, 2: 2, 3: 4}
