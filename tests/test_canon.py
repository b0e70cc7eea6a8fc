from pyspark.sql import functions as F

from docweave.operators import canon, text

TERMS = [
    ("t1", "provider", "provider", "A", "actor", "p1", "'provider' means a natural or legal person"),
    ("t2", "deployer", "deployer", "A", "actor", "p2", "'deployer' means a person"),
    ("t3", "operator", "operator", "A", "other", "p3", "'operator' means a provider, deployer or other operator2; and more"),
    ("t4", "operators of all kinds", "operators_of_all_kinds", "A", "other", "p4", "'operators of all kinds' means the operator or the provider"),
    ("t5", "device", "device", "A", "other", "p5", "'device' means a provider of things"),
    ("t6", "operator2", "operator2", "A", "other", "p6", "'operator2' means the provider and any deployer"),
    ("t7", "sponsor", "sponsor", "B", "other", "q1", "'sponsor' means whoever pays"),
    ("t8", "economic operator", "economic_operator", "B", "other", "q2", "curated"),
    ("t9", "maker", "maker", "B", "actor", "q3", "'maker' means a person"),
]


def frames(spark):
    terms = spark.createDataFrame(TERMS, "term_id string, term string, term_key string, celex string, category string, source_id string, definition string")
    terms = terms.withColumn("definition", text.definition_body(F.col("definition")))
    components = spark.createDataFrame([("B", "economic_operator", "maker"), ("B", "economic_operator", "importer")], "celex string, term_key string, part string")
    derived = spark.createDataFrame([("B", "importer", "importer"), ("C", "importer", "importer"), ("B", "seller", "seller")], "celex string, term_key string, term string")
    standalone = spark.createDataFrame([("D", "manufacturer", "manufacturer"), ("A", "provider", "provider")], "celex string, term_key string, term string")
    return terms, components, derived, standalone


def test_roles(spark):
    terms, components, derived, standalone = frames(spark)
    roles = canon.actor_roles(terms, components, derived, standalone).cache()
    assert {r.role_id: r.source_type for r in roles.collect()} == {
        **{f"A::role::{k}": "defined_term" for k in ("provider", "deployer", "operator", "operator2", "operators_of_all_kinds")},
        "B::role::economic_operator": "defined_term", "B::role::maker": "defined_term", "B::role::importer": "derived_role", "D::role::manufacturer": "standalone_curated",
    }
    pairs = {(r.role.split("::")[-1], r.part.split("::")[-1]) for r in canon.includes(roles, components).collect()}
    assert pairs == {("economic_operator", "maker"), ("economic_operator", "importer"), ("operator", "provider"), ("operator", "deployer"), ("operator", "operator2"), ("operator2", "provider"), ("operator2", "deployer"), ("operators_of_all_kinds", "operator"), ("operators_of_all_kinds", "provider")}
    assert canon.actor_roles(terms.limit(0), components, derived, standalone).count() == 2
    both = canon.equivalences(spark.createDataFrame([("Maker", "B", "provider", "A", "x")], "left_term string, left_celex string, right_term string, right_celex string, basis string"))
    assert sorted((r.src, r.dst, r.basis) for r in both.collect()) == [("A::role::provider", "B::role::maker", "x"), ("B::role::maker", "A::role::provider", "x")]


def test_obligations(spark):
    roles = spark.createDataFrame([("A", "A::role::provider", "provider"), ("A", "A::role::body", "notified body"), ("B", "B::role::provider", "provider")], "celex string, role_id string, term string")
    provisions = spark.createDataFrame([
        ("a1", "A", None, "1. Providers shall keep records. The notified body may look."), ("a2", "A", "Notified bodies", "Where it is so, nothing follows."), ("a3", "A", "Obligations of providers", "They are many."),
        ("a4", "A", "On providers and others", "They shall act."), ("a5", "A", None, "The provider shall not act."), ("a6", "A", None, None), ("a7", "C", None, "The provider shall act."), ("a8", "A", None, "The provider may act."),
    ], "id string, celex string, title string, text string")
    got = {(r.provision, r.role.split("::")[-1], r.modality, r.cue) for r in canon.obligations(provisions, roles).collect()}
    assert got == {("a1", "provider", "obligation", "text"), ("a2", "body", "obligation", "title"), ("a3", "provider", "obligation", "title"), ("a5", "provider", "prohibition", "text")}


def test_plurals():
    assert [canon.plural(x) for x in ("provider", "notified body", "key", "process", "box", "")] == ["providers", "notified bodies", "keys", "processes", "boxes", ""]


def test_delegations_and_amendments(spark):
    node = spark.createDataFrame([
        ("A_art_1", "article", "A", "as set out in Annex I"), ("A_art_2", "article", "A", "see Annex I"), ("A_anx_I", "annex", "A", "listed in Annex II"), ("A_anx_II", "annex", "A", "x"),
        ("M_art_9", "article", "M", "Regulation (EU) 2024/1689 is amended as follows:"), ("M_p1", "point", "M", "in Article 1, paragraph 2 is replaced by"), ("M_p2", "point", "M", "Annex II is deleted"), ("M_p3", "point", "M", "Article 77 is deleted"), ("M_p4", "point", "M", "Article 1 is cited"),
    ], "id string, kind string, celex string, text string")
    edge = spark.createDataFrame([("A_art_1", "CITES", "A_anx_I", "Annex I"), ("A_art_2", "CITES", "A_anx_I", None), ("A_anx_I", "CITES", "A_anx_II", None), ("A_art_1", "CITES", "A_art_2", None)], "src string, type string, dst string, ref_text string")
    assert [(r.src, r.dst, r.phrase) for r in canon.delegations(edge, node).collect()] == [("A_art_1", "A_anx_I", "set out in")]
    closed = spark.createDataFrame([("M_art_9", f"M_p{k}", 1) for k in range(1, 5)], "anc string, desc_id string, dist int")
    catalogue = spark.createDataFrame([("2024/1689", "A"), ("2026/1", "M")], "number string, celex string")
    got = sorted((r.src, r.dst, r.operation, r.target_ref) for r in canon.amendment_edges(node, closed, catalogue).collect())
    assert got == [("M_p1", "A_art_1", "replaced", "Article 1"), ("M_p2", "A_anx_II", "deleted", "Annex II")]


def test_bound_parts_and_narrowing(spark):
    names = {"32017R0745": ("2017/745", ["MDR"]), "32024R1689": ("2024/1689", ["AI Act", "AIA"])}
    parts = lambda text: canon.bound_parts(text, ["MDR"], "2017/745")
    assert parts("Article 6(1) of the MDR and MDR, Annex III; Annex IV") == [{"article": "6", "paragraph": "1"}, {"annex": "III"}]
    assert parts("Annex VIII of Regulation (EU) 2017/745; Article 3 of the IVDR") == [{"annex": "VIII"}]
    assert parts("per 2017/745 Article 9") == [{"article": "9"}] and parts(None) == [] == parts("Annex VIII")
    assert canon.target_ids("X", {"article": "2", "paragraph": "14"}) == ["X_002.014", "X_art_2_pt_14", "X_art_2"]
    assert canon.target_ids("X", {"article": "2", "paragraph": "1", "point": "a"}) == ["X_002.001_pt_a", "X_art_2_pt_1", "X_art_2"]
    edges = spark.createDataFrame([
        ("g1", "32017R0745_document", "32017R0745", "as Article 2(14) of the MDR says"), ("g2", "32017R0745_document", "32017R0745", "“Intended purpose” means the use"), ("g3", "32017R0745_document", "32017R0745", "Article 6 somewhere"), ("g4", "32024R1689_document", "32024R1689", None),
    ], "src string, dst string, celex string, text string")
    ids = spark.createDataFrame([("32017R0745_art_2_pt_14",), ("32017R0745_art_2",)], "id string")
    sources = spark.createDataFrame([("32017R0745", "intended purpose ", "32017R0745_art_2_pt_12")], "celex string, term string, source_id string")
    got = {r.src: (r.dst, r.fallback, r.how) for r in canon.narrowed(edges, ids, sources, names).collect()}
    document = "32017R0745_document"
    assert got == {"g1": ("32017R0745_art_2_pt_14", document, "reference"), "g2": ("32017R0745_art_2_pt_12", document, "definition"), "g3": (document, None, "document"), "g4": ("32024R1689_document", None, "document")}


def test_patches(spark):
    node = spark.createDataFrame([("A_art_1", "A", 2, "Article 1")], "id string, celex string, depth int, display_ref string")
    roles = spark.createDataFrame([("A", "provider", "A::role::provider")], "celex string, term_key string, role_id string")
    patches = spark.createDataFrame([("article 1", "A", "Provider", "r"), ("Article 2", "A", "provider", "r"), ("A_art_1", "A", "nobody", "r")], "ref string, celex string, term string, rationale string")
    edges, open_ = canon.curated_patches(patches, node, roles)
    assert [tuple(r) for r in edges.collect()] == [("A_art_1", "A::role::provider", "r")]
    assert sorted((r.ref, r.why) for r in open_.collect()) == [("A_art_1", "role"), ("Article 2", "provision")]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(text.first_sentence(lit("(1) First one; second."))) == "First one;" and get(text.first_sentence(lit("1. Article two. More"))) == "Article two."
    assert get(text.definition_body(lit("‘x’ Means a thing"))) == "a thing" and get(text.definition_body(lit("plain "))) == "plain"
    assert get(text.authority(lit(" Implementing_Act "))) == "binding" and get(text.authority(lit(None).cast("string"))) == "persuasive" and get(text.authority(lit("blog"))) == "persuasive"
    assert get(text.chapter_key(lit("a/b/X_cpt_III/d"))) == "X_cpt_III" and get(text.chapter_key(lit("a/b/c"))) is None and get(text.chapter_key(lit("a"))) is None
    assert get(text.community_label(lit("community::L1::32024R1689_cpt_III"))) == "Chapter III (32024R1689)" and get(text.community_label(lit("community::L1::X_anx_IV"))) == "Annex IV (X)"
    assert get(text.query_text(lit('Article 6(3)? "a/b" ~x'))) == "Article 6 3 a b x"
    assert get(text.repaired_id(lit("32024R1689_art_5_2"))) == "32024R1689_005.002" and get(text.repaired_id(lit("32024R1689_art_5"))) == "32024R1689_art_5"
    assert get(text.capped_quote(lit("One is long enough. Two is not so"), 22)) == "One is long enough. […]" and get(text.capped_quote(lit("short"), 10)) == "short"
    assert get(text.capped_quote(lit("abcdefghij klmnop"), 12)) == "abcdefghij k […]"
    assert get(text.bold_references(lit("See Article 5(1)(a) and Annex IV\n# Article 6\n> Article 7\n**Article 8**"))) == "See **Article 5(1)**(a) and **Annex IV**\n# Article 6\n> Article 7\n**Article 8**"
    assert get(text.parent_references(lit("Article 5(1)(a)"))) == ["Article 5(1)", "Article 5"] and get(text.parent_references(lit("Annex I"))) == []
