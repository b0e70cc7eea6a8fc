import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import references, resolve, rules, spans

CASES = [
    ("Article 5(1), first subparagraph, point (g)", "explicit", {"article": "5", "paragraph": "1", "ordinal": "first", "point": "g"}),
    ("Article 4, point (14)(c)", "explicit", {"article": "4", "point": "14", "subpoint": "c"}),
    ("Annex III, Section A, point 2.1", "explicit", {"annex": "III", "section": "A", "point": "2.1"}),
    ("Section 1, point 3 of Annex VIII", "explicit", {"annex": "VIII", "section": "1", "point": "3", "reversed": "yes"}),
    ("the second paragraph of point 4.6(b) of Annex VII", "explicit", {"annex": "VII", "point": "4.6(b)"}),
    ("Points 4.3., 4.4. and point 4.6 of Annex VII", "explicit", {"annex": "VII", "points": "4.3 4.4 4.6"}),
    ("Section 2 of Chapter III", "explicit", {"chapter": "III", "section": "2"}),
    ("Articles 102 to 109", "range", {"unit": "article", "first": "102", "last": "109"}),
    ("paragraphs 2, 3 and 5", "range", {"unit": "paragraph", "listed": "2 3 5"}),
    ("this Article", "relative", {"this": "article"}),
    ("of this paragraph", "relative", {"this": "paragraph"}),
    ("the third subparagraph of paragraph 4", "relative", {"ordinal": "third", "the": "yes", "paragraph": "4"}),
    ("point (b)(ii) of the first subparagraph", "relative", {"point": "b", "subpoint": "ii", "of": "first subparagraph"}),
    ("paragraph 3, second subparagraph, point (a)", "relative", {"paragraph": "3", "ordinal": "second", "point": "a"}),
    ("referred to in paragraph 1, point (h)", "relative", {"via": "referred to in", "paragraph": "1", "point": "h"}),
    ("Section 4 of this Chapter", "relative", {"section": "4", "scope": "chapter"}),
    ("Council Directive 85/374/EEC", "external", {"institution": "council", "type": "directive", "number": "85/374", "suffix": "eec"}),
    ("Regulation (EC) No 765/2008", "external", {"type": "regulation", "series": "ec", "number": "765/2008"}),
    ("Directive 2001/83/EC as amended by Regulation (EU) 2017/745", "amended", {"base_type": "directive", "base_number": "2001/83", "base_suffix": "ec", "by_type": "regulation", "by_series": "eu", "by_number": "2017/745"}),
]


@pytest.mark.parametrize(("text", "kind", "parts"), CASES)
def test_each_family(text, kind, parts):
    found = references.references_in(f"It follows, {text} being meant.")
    assert [(f["kind"], f["match"], dict(f["groups"])) for f in found] == [(kind, text, parts)]


def test_no_references():
    for text in (None, "", "this paragraph 3 is other", "articles of clothing", "Article five", "a regulation of trade", "point (a)", "Annex it"):
        assert [f for f in references.references_in(text) if f["kind"] != "relative" or "this" in dict(f["groups"])] == []


def test_footnotes_and_qualifiers():
    found = references.located_references("see Article 5(1), point (a) of Regulation (EU) 2016/679 ( 9 ) and Directive 2002/58/EC")
    external = [dict(f["groups"]) for f in found if f["kind"] == "external"]
    assert external[0]["qualified"] == "Article 5(1), point (a) of" and "qualified" not in external[1]


def test_spans_inside_spans_go():
    r = random.Random(4)
    for _ in range(300):
        some = [{"start": a, "end": a + r.randrange(1, 9)} for a in (r.randrange(30) for _ in range(25))]
        kept: list[dict] = []
        for s in sorted(some, key=lambda s: (s["start"], -(s["end"] - s["start"]))):
            if not any(k["start"] <= s["start"] and s["end"] <= k["end"] and (k["start"], k["end"]) != (s["start"], s["end"]) for k in kept):
                kept.append(s)
        assert references.contained(some) == kept


def test_ranges_and_parse():
    assert references.expanded({"first": "5(2)", "last": "(6)"}) == ["5", "6"]
    assert references.expanded({"first": "7", "last": "5"}) == []
    assert references.expanded({"first": "1", "last": "99999999"}) == ["1", "99999999"]
    assert references.expanded({"listed": "8 9 11(2)"}) == ["8", "9", "11(2)"]
    assert references.parse_reference("point 2 of Annex IV") == {"annex": "IV", "point": "2"}
    assert references.parse_reference("nothing") == {} == references.parse_reference(None)


def test_families_of_lists():
    found = [f for f, _, _ in references.families_in("Articles 111/113, Annexes I and III, Arts. 4a-4c, Articles 5 to 7 and Article 6(1)(f), Recitals 44 to 46")]
    assert found == ["Article 111", "Article 113", "Annex I", "Annex III", "Article 4a", "Article 4c", "Article 5", "Article 7", "Article 6", "Recital 44", "Recital 46"]
    assert references.families_in("articles of faith, annexed") == [] == references.families_in(None)
    assert references.parent_chain("Article 5(1)(a)") == ["Article 5(1)", "Article 5"] and references.parent_chain("Annex I") == []
    assert [references.base_family(x) for x in ("article 5A(1)", "ANNEX ix, point 3", "Recital 4", "Section 2")] == ["Article 5a", "Annex IX", "Recital 4", "Section 2"]


NAMES = {"MDR": "2017/745", "IVDR": "2017/746", "AIA": "2024/1689"}


def test_guidance_references():
    got = lambda text: [(x["number"], x["ref_text"], x["how"]) for x in references.guidance_references(text, NAMES)]
    assert got("Article 6(1) of the MDR applies.") == [("2017/745", "Article 6(1)", "named")]
    assert got("Annex VI MDR/IVDR") == [("2017/745", "Annex VI", "named"), ("2017/746", "Annex VI", "named")]
    assert got("The AIA says so in Article 3, point (4); see also Article 9.") == [("2024/1689", "Article 3, point (4)", "near"), ("2024/1689", "Article 9", "near")]
    assert got("Article 2(2) of the EHDS, unlike the MDR") == [("2017/745", "Regulation (EU) 2017/745", "whole")]
    assert got("Regulation (EU) 2017/746 alone") == [("2017/746", "Regulation (EU) 2017/746", "whole")]
    assert got("Art. 5 MDR and Art. 5 MDR") == [("2017/745", "Article 5", "named")]
    assert got(None) == [] == got("Article 5 of something")


def act():
    """An act of two chapters; texts refer to its parts."""
    rows = [
        ("d", "document", None, None, "The act"),
        ("c1", "chapter", "I", "d", "General"),
        ("s1", "section", "1", "c1", "Section text, see Section 2 of Chapter I and Article 2(1), point (b)"),
        ("s2", "section", "2", "c1", "x"),
        ("a1", "article", "1", "s1", "this Article and Articles 2 to 4"),
        ("a1p1", "paragraph", "1", "a1", "see paragraph 2 and the first subparagraph of paragraph 2; this paragraph"),
        ("a1p2", "paragraph", "2", "a1", "Article 9, Annex I, point 2 and Annex I, point 7"),
        ("a1p2s1", "subparagraph", "1", "a1p2", "this subparagraph; referred to in paragraph 1"),
        ("a2", "article", "2", "s1", "Article 2, point (b)"),
        ("a2p1", "paragraph", "1", "a2", "point (b) of this paragraph, Article 3, point (4), paragraph 1, point (a)"),
        ("a2p1a", "point", "a", "a2p1", "Article 2(1), point (b)(ii) and the second subparagraph"),
        ("a2p1b", "point", "b", "a2p1", "Section 2 of this Chapter"),
        ("a2p1b2", "roman_item", "ii", "a2p1b", "Regulation (EU) 2016/679 and Article 1(1) of Directive 2002/58/EC"),
        ("a3", "article", "3", "c1", ""),
        ("a3pt4", "point", "4", "a3", "Directive 2001/83/EC as amended by Regulation (EU) 2017/745"),
        ("x1", "annex", "I", "d", "Section A of Annex I, points 2, 3"),
        ("x1A", "annex_section", "A", "x1", "point 2 of Annex I"),
        ("x1p2", "annex_point", "2", "x1A", None),
    ]
    return [("A", n, i, kind, number, parent, text) for n, (i, kind, number, parent, text) in enumerate(rows)]


WANTED = {
    ("s1", "s2"), ("s1", "a2p1b"), ("a1", "a2"), ("a1", "a3"), ("a1p1", "a1p2"), ("a1p1", "a1p2s1"), ("a1p2", "x1p2"), ("a1p2", "x1"), ("a1p2s1", "a1p1"),
    ("a2", "a2p1b"), ("a2p1", "a2p1b"), ("a2p1", "a3pt4"), ("a2p1", "a2p1a"), ("a2p1a", "a2p1b2"), ("a2p1b", "s2"), ("x1", "x1A"), ("x1A", "x1p2"),
    ("a2p1b2", "ext_regulation_eu_2016_679"), ("a2p1b2", "ext_directive_2002_58_ec"), ("ext_regulation_eu_2017_745", "ext_directive_2001_83_ec"),
    ("a2p1b2", "a1p1"),  # an article of another act is also read as one of this act
}


def test_resolution(spark):
    rows = spark.createDataFrame(act(), "celex string, seq long, id string, kind string, number string, parent_id string, text string").repartition(3)
    got = resolve.resolve(resolve.with_paths(rows)).collect()
    pairs = {(r.source, r.target) for r in got}
    # The longer span "X as amended by Y" swallows the mentions of X and Y in it.
    assert pairs == WANTED
    assert len(got) == len(pairs)
    text = {(r.source, r.target): (r.type, r.ref_text) for r in got}
    assert text["a2p1b2", "ext_directive_2002_58_ec"] == ("CITES_EXTERNAL", "Article 1(1) of Directive 2002/58/EC")
    assert text["ext_regulation_eu_2017_745", "ext_directive_2001_83_ec"][0] == "AMENDS"
    empty = rows.limit(0)
    assert resolve.resolve(empty.withColumn("path", F.array("id"))).count() == 0


def test_paths_of_deep_trees(spark):
    rows = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(40)], "id string, parent_id string")
    paths = {r.id: r.path for r in resolve.with_paths(rows).collect()}
    assert all(paths[f"n{k}"] == [f"n{j}" for j in range(k + 1)] for k in range(40))


def test_nearest_ancestor(spark):
    rows = resolve.with_paths(spark.createDataFrame(act(), "celex string, seq long, id string, kind string, number string, parent_id string, text string"))
    got = {r.id: r.number for r in resolve.nearest_ancestor(rows, "article").collect()}
    assert got["a2p1b2"] == "2" and got["a3pt4"] == "3" and got["x1p2"] is None and got["a1"] is None


def test_guidance_edges(spark):
    rows = spark.createDataFrame([("g1", "Article 6 MDR"), ("g2", None)], "id string, text string")
    got = resolve.guidance_edges(rows, NAMES).collect()
    assert [(r.source, r.target, r.ref_text) for r in got] == [("g1", "ext_regulation_eu_2017_745", "Article 6")]


def test_spans_replace_a_column(spark):
    rows = spark.createDataFrame([(1, "Article 2", "old"), (2, None, "old"), (2, "", "old")], "id long, text string, found string")
    got = sorted((r.id, len(r.found)) for r in spans.spans(rows, "text", "found").collect())
    assert got == [(1, 1), (2, 0), (2, 0)]


def test_delegation_and_definitions(spark):
    rows = spark.createDataFrame([("The conditions laid down in Annex I",), ("goods Listed in Annex II",), ("requirement of Annex",), ("he may go",), (None,)], "t string")
    got = [r[0] for r in rows.select(rules.delegation_phrase(F.col("t"))).collect()]
    assert got == ["The conditions laid down in", "Listed in", "requirement of", None, None]
    ids = spark.createDataFrame([("X_art_2",), ("X_002.001_pt_a",), ("X_art_22",), ("Y_art_2",), ("X_020.001",)], "id string")
    inside = [r[0] for r in ids.select(rules.in_definitions_article(F.col("id"), F.lit("X"), {"X": "2", "Z": "4"})).collect()]
    assert inside == [True, True, False, False, False]
    assert rows.select(rules.rule_confidence(F.lit("PENALTY.keyword"))).first()[0] == 0.95
