from pyspark.sql import functions as F

from docweave.operators import audits, routing

ACTS = [("A", "ai act"), ("M", "mdr"), ("M", "2017 745"), ("G", "gdpr"), ("MDCG_1", "mdcg 2025 6")]


def detected(spark, *questions, k=8):
    asked = spark.createDataFrame(list(enumerate(questions, 1)), "case_id long, question string")
    acts = spark.createDataFrame(ACTS, "act string, alias string")
    definitions = spark.createDataFrame([("conformity assessment", "M"), ("medical device", "M")], "term string, act string")
    roles = spark.createDataFrame([("provider", "A"), ("importer", "A"), ("importer", "M"), ("controller", "G")], "term string, act string")
    return routing.detect(asked, acts, definitions, roles, k).cache()


def test_detection(spark):
    got = {r.case_id: r for r in detected(spark, "What must the importer do under the AI Act?", "How do the MDR and the AI Act interact?", "Is my medical device fine?", None, "mdcg 2025-6 and the GDPR for a controller", "Article 6 of the MDR").collect()}
    assert got[1].acts == ["A"] and [(r.term, r.act) for r in got[1].roles] == [("importer", "A")] and got[1].route == "role_obligations" and got[1].k == 8
    assert got[2].acts == ["A", "M"] and got[2].route == "cross_regulation"
    assert got[3].named_acts == [] and got[3].acts == ["M"]
    assert got[4].acts == [] and got[4].route == "general_compliance" and got[4].refs == []
    assert got[5].acts == ["G", "MDCG_1"] and got[5].k == 8
    assert got[6].refs == ["Article 6"] and got[6].route == "provision_lookup"
    assert detected(spark, "mdcg 2025-6, the GDPR, the MDR", k=5).first().k == 12 and detected(spark, "the MDR and the GDPR", k=5).first().k == 6


def test_gates(spark):
    d = detected(spark, "What must we do under the AI Act?", "Which duties has a company that imports, and what must we do under the AI Act and in comparison?", "What must the provider do under the AI Act?", "Show me Article 5 of the AI Act", "How does Article 5 of the AI Act apply?", "What are my obligations?")
    recognised = spark.createDataFrame([("provider", "A", 1), ("importer", "A", 2), ("controller", "G", 3)], "term string, act string, priority int")
    asks = {r.case_id: (r.ask, r.options) for r in routing.needs_role(d, recognised).collect()}
    assert asks == {1: (True, ["provider", "importer"]), 2: (False, []), 3: (False, []), 4: (False, []), 5: (False, []), 6: (False, [])}
    assert [(r.case_id, r.ref, r.act) for r in routing.shows_text(d).collect()] == [(4, "Article 5", "A")]


def test_targets(spark):
    cases = spark.createDataFrame([(1, "is the hospital exempt?", ["A", "M"]), (2, "plain", ["A"]), (3, None, [])], "case_id long, question string, acts array<string>")
    seeds = spark.createDataFrame([(0, "M", "Article 5", ["hospital"], None, None), (1, "A", "Article 6", None, None, None), (2, "A", "Article 43", None, ["M"], None), (3, "A", "Article 25", None, None, ["exempt"])], "at int, act string, ref string, words array<string>, needs array<string>, without array<string>")
    got = [(r.case_id, r.ref, r.acts) for r in routing.curated_targets(cases, seeds).orderBy("case_id", "at").collect()]
    assert got == [(1, "Article 5", ["M"]), (1, "Article 6", ["A"]), (1, "Article 43", ["A"]), (2, "Article 6", ["A"]), (2, "Article 25", ["A"])]


def test_sufficiency(spark):
    role = "array<struct<term:string,act:string>>"
    cases = spark.createDataFrame([(1, "provision_lookup", ["Article 2(65)", "Article 9"], ["A"], []), (2, "cross_regulation", [], ["A", "M"], [("provider", "A")]), (3, "legal_qualification", [], ["A"], []), (4, "general_compliance", [], [], []), (5, "definition_lookup", [], [], [])], f"case_id long, route string, refs array<string>, acts array<string>, roles {role}")
    found = spark.createDataFrame([(1, "x", "article2(65)", "A", None, False, None), (2, "y", "article1", "A", "OBLIGATION", True, "c1"), (2, "z", "article2", "A", None, False, "c1"), (3, "w", "article5", "M", "EXEMPTS", False, None)], "case_id long, id string, ref_key string, celex string, role string, by_role boolean, community string")
    targets = spark.createDataFrame([(3, "Article 6", False), (3, "Annex I", True)], "case_id long, ref string, covered boolean")
    anchors = spark.createDataFrame([("A", "Article 3"), ("M", "Article 2")], "celex string, ref string")
    checks = routing.sufficiency(cases, found, targets, anchors).cache()
    got = {(r.case_id, r.check): (r.passed, r.detail) for r in checks.collect()}
    assert got == {
        (1, "explicit_refs"): (False, "Article 9"), (2, "role_coverage"): (True, None), (2, "cross_reg_coverage"): (False, "M"), (2, "community_diversity"): (False, ""), (2, "status_anchor"): (False, "A"),
        (3, "qualification_backbone"): (False, "Article 6"), (3, "status_anchor"): (False, "M"), (5, "definition_coverage"): (False, ""),
    }
    assert [(r.read, r.detail) for r in routing.recoveries(checks).filter("case_id = 3").orderBy("step").collect()] == [("curated targets", "Article 6"), ("status anchors", "M")]
    assert {r.case_id: r.coverage for r in routing.fraction_passed(checks, cases).collect()} == {1: 0.0, 2: 0.25, 3: 0.0, 4: 0.5, 5: 0.0}


def test_scores_and_verdicts(spark):
    rows = spark.createDataFrame([("the MDCG guidance", ["M"], 1, 3, 4), ("x", ["M"], 3, 1, 4), ("x", ["M"], 2, 2, 4), ("x", ["M"], 1, 3, 4), ("x", [], 0, 0, 4), ("x", ["M"], 0, 0, 0)], "q string, acts array<string>, b int, n int, t int")
    assert [round(r[0], 6) for r in rows.select(routing.force_alignment(F.col("q"), F.col("acts"), F.col("b"), F.col("n"), F.col("t"))).collect()] == [0.825, 1.0, 0.65, 0.3, 0.7, 0.0]
    graded = spark.createDataFrame([(1, 8.0, "good", 1, 0, 0, True, []), (2, None, "good", 0, 0, 0, True, None), (3, 5.0, "bad", 0, 0, 2, False, ["Article 5"]), (4, 9.0, "good", 0, 0, 0, None, None), (5, 7.0, "good", 0, 0, 0, False, [])], "case_id long, score double, reliance string, fabricated int, misattributed int, phantom int, key_passed boolean, missed array<string>")
    got = {r.case_id: (r.critical_defects, r.reliance_final, r.reliance_gated) for r in routing.critical_defects(graded, ("bad",), "bad").collect()}
    assert got == {1: (["fabricated_quotes=1"], "bad", True), 2: (["ungraded"], "good", False), 3: (["phantom_citations=2", "answer_key_failed(Article 5)", "judge_verdict_unreliable"], "bad", False), 4: ([], "good", False), 5: (["answer_key_failed(state_recall_below_threshold)"], "bad", True)}
    deltas = spark.createDataFrame([(0.0, 0.0, 1), (0.1, 0.0, 1), (-0.1, 0.2, 0), (0.1, 0.0, 0), (0.0, 0.0, -1), (0.0, 0.0, 0)], "c double, s double, f int")
    assert [r[0] for r in deltas.select(routing.revision_verdict(F.col("c"), F.col("s"), F.col("f"))).collect()] == ["hurt", "hurt", "hurt", "helped", "helped", "neutral"]
    grades = spark.createDataFrame([(1, 8.0, "good"), (1, 6.0, "bad"), (1, 7.0, "none"), (2, None, "none"), (3, 4.0, "bad"), (3, 5.0, "bad"), (3, 9.0, "good")], "case_id long, score double, verdict string")
    assert {r.case_id: (r.median, r.mean, r.verdict) for r in routing.judge_summary(grades, ("good", "bad")).collect()} == {1: (7.0, 7.0, "bad"), 2: (None, None, "(unparsed)"), 3: (5.0, 6.0, "bad")}
    texts = spark.createDataFrame([("7/10 first, Final score: **8.5 / 10**. Strong draft",), ("3/10",), ("none",)], "t string")
    assert [tuple(r[0]) for r in texts.select(routing.parsed_grade(F.col("t"), ("Strong draft", "Unsafe"))).collect()] == [(8.5, "Strong draft"), (3.0, "(unparsed)"), (None, "(unparsed)")]
    bag = spark.createDataFrame([(1, "a", "g", 2), (1, "b", "d", 3), (1, "c", "x", 1)], "case_id long, id string, kind string, rank int")
    assert [(r.id, r.bucket, r.place) for r in routing.in_buckets(bag, [("definitions", F.col("kind") == "d"), ("guidance", F.col("kind") == "g")], "rank").orderBy("place").collect()] == [("b", "definitions", 1), ("a", "guidance", 2), ("c", "other", 3)]
    assert [(r.k, r.vs) for r in routing.distinct_sorted(spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b")], "k string, v string"), "k", "v").collect()] == [("x", ["a", "b"])]


def test_audits(spark):
    p = spark.createDataFrame([
        ("A", "A_document", "document", None, "x", None, None), ("A", "A_art_1", "article", "A_document", "One", "One", "Article 1"), ("A", "A_art_2", "article", "A_document", "", None, ""), ("A", "A_p", "point", "A_art_1", "point (c) is replaced by the following: ;", None, None),
        ("A", "A_q", "point", "A_art_1", "the following point is inserted:", None, None), ("A", "A_q1", "point", "A_q", "‘(x) a long enough new text of the point’", None, None), ("A", "A_sp", "subparagraph", "A_art_1", "sole", None, None), ("G", "G1", "guidance_section", None, "t", "Scope", None),
    ], "celex string, id string, kind string, parent_id string, text string, title string, display_ref string")
    diagnosis = spark.createDataFrame([("A", "id:article", 3), ("A", "id:chapter", 1), ("A", "tag:p", 9)], "celex string, what string, n long")
    assert sorted((r.kind, r.expected, r.actual) for r in audits.source_parity(diagnosis, p).collect()) == [("article", 3, 2), ("chapter", 1, 0)]
    assert [r.id for r in audits.uncovered_ids(spark.createDataFrame([("A", "A_art_1"), ("A", "A_art_9")], "celex string, id string"), p).collect()] == ["A_art_9"]
    assert [r.id for r in audits.husks(p).collect()] == ["A_p"]
    assert [r.id for r in audits.sampled_empty(p).collect()] == ["A_art_2"] and audits.sampled_empty(p.limit(0)).count() == 0
    assert [(r.title, r.in_source, r.parsed) for r in audits.heading_parity(spark.createDataFrame([("G", "SCOPE "), ("G", "Lost")], "celex string, title string"), p).collect()] == [("lost", 1, 0)]
    vectors = spark.createDataFrame([("A_art_1", [0.0] * 768), ("A_p", [0.0] * 5)], "id string, embedding array<double>")
    ready = {r.celex: (r.no_vector, r.odd_dimension, r.no_ref) for r in audits.readiness(p, vectors).collect()}
    assert ready == {"A": (4, 1, 1), "G": (1, 0, 0)}
    shown = spark.createDataFrame([("A", "x One point (c) is  replaced by the following: ; sole")], "celex string, shown string")
    assert sorted(r.id for r in audits.rendered(p, shown).collect()) == ["A_q", "A_q1", "G1"]
    assert [(r.id, r.why) for r in audits.lone_subparagraphs(p).collect()] == [("A_sp", "single")]
    runs = lambda *rows: spark.createDataFrame(list(rows), "case_id long, ref string")
    deltas = audits.ablation(runs((1, "a"), (1, "b"), (2, "c")), runs((1, "a"), (2, "c"), (2, "d")), runs((1, "a"), (1, "b"), (2, "c"), (2, "d")))
    assert sorted((r.case_id, r.delta, r.recovered, r.lost) for r in deltas.collect()) == [(1, 0.5, 1, 0), (2, -0.5, 0, 1)]
    assert tuple(audits.ablation_summary(deltas).first()) == (0.75, 0.75, 0.0, 1, 1, 1, 0, 1)
    cover = audits.authority_coverage(spark.createDataFrame([("A", "binding", None), ("A", None, "regulation"), ("A", "binding", "regulation")], "celex string, binding_force string, source_type string")).first()
    assert tuple(cover) == ("A", 3, 1, 1, ["binding"], ["regulation"])
    roles = spark.createDataFrame([("A", "provider", "r1"), ("A", "importer", "r2")], "celex string, term_key string, role_id string")
    edges = spark.createDataFrame([("p", "OBLIGATION_OF", "r1"), ("q", "OBLIGATION_OF", "r1"), ("r1", "INCLUDES_ROLE", "r2")], "src string, type string, dst string")
    assert sorted(tuple(r) for r in audits.role_audit(roles, edges).collect()) == [("r1", 2, 1, 0, 0), ("r2", 0, 0, 0, 0)]
    expected = spark.createDataFrame([("A", "provider"), ("A", "importer"), ("M", "user")], "celex string, term_key string")
    assert sorted((r.term_key, r.why) for r in audits.uncovered_roles(expected, roles, edges).collect()) == [("importer", "no obligation"), ("user", "no role")]
    wants = spark.createDataFrame([(1, "article 1"), (1, "Article 99")], "case_id long, ref string")
    assert tuple(audits.grounded_wants(wants, p).first()) == (1, 2, 1, 0.5)
    answer = spark.createDataFrame([("> **FAITHFULNESS FLAG** — 2 of 7 quotes\n**ATTRIBUTION FLAG** - 1 of 9; **Wording check** — 3 quotes; **PHANTOM CITATION FLAG** — 4 statements",), ("",)], "a string")
    assert [tuple(r[0]) for r in answer.select(audits.flag_counts(F.col("a"))).collect()] == [(2, 1, 3, 4, 9), (0, 0, 0, 0, 0)]
    results = spark.createDataFrame([(8.0, 1, 0, 0, 0, False, ["x"]), (6.0, 0, 0, 1, 0, None, []), (None, 0, 0, 0, 0, True, ["ungraded"])], "score double, fabricated int, misattributed int, near int, phantom int, timed_out boolean, critical_defects array<string>")
    assert tuple(audits.run_summary(results).first()) == (3, 2, 7.0, 7.0, 1, 0, 1, 0, 1, 0.333333)
