import json

from pyspark.sql import functions as F

from docweave import __main__ as cli
from docweave.operators import ingest
from tests.test_grounding import FAMILIES, LAW, NAMES
from tests.test_legal_html import CONSOLIDATED, OJ


def test_legislation_and_canonical(spark):
    page = OJ.replace("(1)</td><td>‘thing’ means a thing;", "(1)</td><td>‘provider’ means a natural or legal person;").replace("First paragraph, nothing behind.", "The provider shall act as set out in Annex I and Article 2.")
    page = page.replace("<tr><td>(1)</td><td>‘provider’", "<tr><td>(1)</td><td>‘provider’")
    tables = ingest.legislation(spark.createDataFrame([("A", page), ("B", CONSOLIDATED)], "celex string, html string"), spark.createDataFrame([("B", OJ)], "celex string, html string"), {"A": "2"})
    assert {r.source_type for r in tables["provisions"].collect()} == {"regulation"} and tables["provisions"].filter("celex = 'B' and kind = 'recital'").count() == 1
    edges = {(r.source, r.target) for r in tables["relations"].collect()}
    assert ("A_001.001", "A_anx_I") in edges and ("A_001.001", "A_art_2") in edges
    assert [(r.term, r.category, r.definition_type, r.source_id) for r in tables["terms"].collect()] == [("provider", "actor", "formal", "A_art_2_pt_1")]
    none = spark.createDataFrame([], "celex string, term_key string, part string")
    extra = spark.createDataFrame([], "celex string, term_key string, term string")
    made = ingest.canonical(tables, spark.createDataFrame([], "number string, celex string"), none, extra, extra)
    assert [r.role_id for r in made["roles"].collect()] == ["A::role::provider"]
    assert ("A_001.001", "obligation") in {(r.provision, r.modality) for r in made["obligations"].collect()}
    assert [(r.src, r.dst, r.phrase) for r in made["delegations"].collect()] == [("A_001.001", "A_anx_I", "set out in")] and made["amendments"].count() == 0


def test_guidance(spark):
    tables = ingest.guidance_documents(spark.createDataFrame([("G", "Guide", "## 1 Scope\nsee Article 6 of the MDR")], "celex string, name string, text string"), {"MDR": "2017/745"})
    assert [(r.source, r.target, r.ref_text) for r in tables["relations"].collect()] == [("G_sec_1", "ext_regulation_eu_2017_745", "Article 6")]
    assert {r.binding_force for r in tables["provisions"].collect()} == {"non_binding"}


def test_routes_and_verification(spark):
    cases = spark.createDataFrame([(1, "role_obligations"), (2, "general_compliance")], "case_id long, route string")
    frame = lambda name, *rows: spark.createDataFrame([(c, i, n, 0.0, name) for c, i, n in rows], "case_id long, id string, rank int, score double, channel string")
    channels = {"search": frame("search", (1, "a", 1), (1, "b", 2), (2, "a", 1)), "roles": frame("roles", (1, "b", 1), (1, "c", 2), (2, "z", 1))}
    got = [(r.case_id, r.id, r["rank"], r.channel) for r in ingest.by_route(cases, channels, {"role_obligations": ("roles", "search")}).orderBy("case_id", "rank").collect()]
    assert got == [(1, "b", 1, "roles"), (1, "c", 2, "roles"), (1, "a", 3, "search"), (2, "a", 1, "search")]
    answers = spark.createDataFrame([(1, f'Article 5 says "{LAW}"\nArticle 77 is no law.\nAlso "an invented passage that is in no source of any kind at all, truly"', None), (2, "nothing", None)], "case_id long, answer string, question string")
    sources = spark.createDataFrame([(1, "Article 5", LAW)], "case_id long, ref string, text string")
    families = spark.createDataFrame([(a, f) for a, some in FAMILIES.items() for f in some], "act string, family string")
    rows = {r.case_id: r for r in ingest.verified(answers, sources, families, NAMES).collect()}
    assert (rows[1].phantoms, rows[1].verified, rows[1].unverified, rows[1].removed) == (["Article 77"], 1, 1, 1) and LAW in rows[1].answer and "invented" not in rows[1].answer
    assert (rows[2].answer, rows[2].verified) == ("nothing", 0)
    one = spark.createDataFrame([(None, "c", "r"), ("f", None, "r"), (None, None, " ")], "f string, c string, r string")
    assert [tuple(r) for r in one.select(ingest.classifier_text(F.col("f"), F.col("c"), F.col("r")), ingest.linker_text(F.col("c"), F.col("r"))).collect()] == [("c", "c"), ("f", "r"), (" ", None)]


def test_command_line(tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "tree_closure" in capsys.readouterr().out
    (tmp_path / "page.html").write_text(OJ)
    assert cli.main(["parse", str(tmp_path / "page.html"), "A"]) == 0
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert rows[0]["id"] == "A_document" and len(rows) > 20
    assert cli.main(["run", "nothing", str(tmp_path)]) == 2
