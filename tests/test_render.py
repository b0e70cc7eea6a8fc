from docweave.operators import render
from docweave.sources import guidance


def test_block_caps_and_order():
    kids = [{"id": f"A_{k}", "ref": f"p{k}", "text": "t" * 20} for k in range(20, 0, -1)]
    hit = {"ref": "Article 5", "regulation": "AI Act", "celex": "32024R1689", "binding_force": "binding", "role": "OBLIGATION", "id": "A", "path": "x / y", "text": "b" * 5000, "leaf": "A_17", "children": kids, "cross": [{"id": "c", "ref": "Annex I", "text": "first. " * 200}], "cited": [{"id": str(k), "ref": f"r{k}", "text": "x"} for k in range(9)], "interpreted": [{"id": "g", "ref": "G", "text": "y"}] * 5}
    text = render.block(3, hit)
    assert text.startswith("[3] Article 5 — AI Act (CELEX: 32024R1689) [LEGISLATION] [BINDING] [role: OBLIGATION]\n    id: A\n    Path: x / y\n" + "b" * 4000 + " […see")
    lines = text.split("Paragraphs/Points:\n")[1].split("\n\n")[0].split("\n")
    assert len(lines) == 12 and lines[0].startswith("  [★ MATCHED] p17 (id: A_17)") and lines[1].startswith("  p1 ") and lines[2].startswith("  p2 ")
    cites = text.split("Cross-references:\n")[1].split("\n\n")[0].split("\n")
    assert len(cites) == 6 and cites[0].startswith("  Annex I: first.") and cites[0].endswith(".") and len(cites[0]) <= 720
    assert text.count("  G: y") == 3
    whole = render.block(1, {**hit, "subject": True})
    assert whole.split("Paragraphs/Points:\n")[1].split("\n\n")[0].count("\n") == 19
    assert render.block(1, {"ref": None, "text": None}) == "[1] Unknown —  [LEGISLATION]\n"
    long = render.block(1, {"ref": "x", "regulation": "r", "text": "c" * 3900, "children": [{"id": f"k{k}", "ref": "q", "text": "z" * 699} for k in range(12)]})
    assert long.endswith(render.TRUNCATED) and len(long) <= 9000 + len(render.TRUNCATED)
    amending = render.block(1, {"ref": "Article 1", "regulation": "O", "text": "t", "amends": ("Article 113", "Regulation (EU) 2026/1")})
    assert amending.startswith("⚠ AMENDING PROVISION — CONTROLLING (supersedes the original wording of Article 113; source: Regulation (EU) 2026/1):\n[1]")


def test_context_buckets_and_budget():
    hits = [{"ref": f"a{k}", "regulation": "", "role": role, "text": "x" * 100} for k, role in enumerate(["OBLIGATION", "DEFINES", None, "OBLIGATION"])]
    text = render.context(hits, [("DEFINES", "DEFINITIONS"), ("OBLIGATION", "OBLIGATIONS")])
    assert [text.index(s) for s in ("### DEFINITIONS ###", "[2] a1", "### OBLIGATIONS ###", "[1] a0", "[4] a3", "### OTHER PROVISIONS ###", "[3] a2")] == sorted(text.index(s) for s in ("### DEFINITIONS ###", "[2] a1", "### OBLIGATIONS ###", "[1] a0", "[4] a3", "### OTHER PROVISIONS ###", "[3] a2"))
    assert render.context(hits, [], budget=10).count("[LEGISLATION]") == 1 and "###" not in render.context(hits[:1], [])


NODES = [
    {"depth": 0, "kind": "article", "number": "5", "text": "Article"}, {"depth": 1, "kind": "paragraph", "number": "1", "text": "1. Own number"}, {"depth": 1, "kind": "paragraph", "number": "2", "text": "No number"},
    {"depth": 1, "kind": "paragraph", "number": "3", "text": ""}, {"depth": 2, "kind": "subparagraph", "number": "1", "text": "First:"}, {"depth": 3, "kind": "point", "number": "a", "text": "point a"}, {"depth": 4, "kind": "roman_item", "number": "i", "text": "deep"}, {"depth": 4, "kind": "indent", "number": "1", "text": "dash"},
    {"depth": 2, "kind": "subparagraph", "number": "2", "text": "Second."}, {"depth": 1, "kind": "annex_row", "number": "", "text": "Old\x1fNew"}, {"depth": 1, "kind": "annex_row", "number": "", "text": "a|b\x1fc"},
]


def test_subtrees():
    assert render.subtree(NODES[:3] + NODES[5:8]) == "Article\n  (1) 1. Own number\n  (2) No number\n      (a) point a\n        (i) deep\n        — dash"
    lines = render.verbatim(NODES).split("\n>\n")
    assert lines[:2] == ["> **1.** Own number", "> **2.** No number"] and lines[2] == "> **3.** First:" and lines[3] == "> **(a)** point a"
    assert lines[4].endswith("**(i)** deep") and lines[4].startswith(">  ") and lines[6] == "> Second."
    assert lines[7] == "> | Old | New |\n> | --- | --- |\n> | a\\|b | c |"


KNOWN = {"X_art_10": ("Article 10", "MDR", "The law says. More of it."), "X_005.002": ("2", "MDR", "para")}
OTHERS = {"X_art_25": ("Article 25", "MDR")}


def test_pointers():
    text, log = render.resolve_pointers("It holds [quote:X_art_10] and [quote:X_art_10], see [cite:X_art_5_2], as required by [cite:X_art_77].", KNOWN, OTHERS)
    assert "> The law says. More of it.\n>\n> — Article 10, MDR" in text and "**Article 10** (MDR)" in text and "**Article 5(2)** (MDR)" in text
    assert "X_art" not in text and "as required by" not in text and log["unresolved"] == ["X_art_77"] and log["repeated"] == ["X_art_10"]
    text, log = render.resolve_pointers("As Article 25 [cite:X_art_25] says; and then a good deal of other text goes on before [label](cite:X_art_25) (id: 32024R1689_art_2)", KNOWN, OTHERS)
    assert text == "As Article 25 says; and then a good deal of other text goes on before **Article 25** (MDR)" and log["suppressed"] == ["X_art_25"]
    assert render.resolve_pointers("plain", {}, {})[0] == "plain"
    body, log = render.structured_answer("See [[c1]] and [[q1]] and [[zz]].", [("c1", "X_art_25", "cite"), ("q1", "X_art_10", "quote")], KNOWN, OTHERS)
    assert "**Article 25** (MDR)" in body and "> The law says." in body and log["unresolved"] == [""]
    assert render.tidy("- \n### HeadGlued\n> \nx ( ) , . [Article 5]") == "### Head\n\nGlued\nx. Article 5"


def test_around_an_answer():
    assert render.warning_block({}, 3) is None and "2 of 5" in render.warning_block({"unverified": 2}, 5)
    text = render.postprocessed("It must always hold.", "LOW", ["> w"], [("Article 1", "Act", "replaced"), ("Article 1", "Act", "replaced")])
    assert text.startswith("> w\n\n> ⚠ **LOW CONFIDENCE**") and "generally have to" in text and text.count("- Article 1: replaced by Act") == 1
    assert render.postprocessed("a", "HIGH", [], []) == "a"
    assert render.redacted("abcdefgh", [(1, 3), (5, 6), (2, 3)], "_") == "a_de_gh"
    assert render.definition_block([("T", "Article 2", "MDR", "a  b"), ("t", "Article 2", "MDR", "c")]) == "- **T** (Article 2, MDR): a b"
    assert render.community_header([("c1", "", "s"), ("c1", "x", "y"), ("c2", "L", None)]) == "[c1] s\n\n[L] "
    assert render.corpus_text([{"text": "A-b", "children": [{"text": "C"}], "cited": []}, {"text": None}]) == "a b c"


def test_markdown_normaliser():
    text = render.normalised_markdown("### Head\nIntro: 1. one (a) first (b) second (i) deep (ii) deeper (c) third\nplain (a) only\n> 1. x (a) y")
    assert text.split("\n") == ["### Head", "", "Intro:", "- 1. one", "  - (a) first", "  - (b) second", "    - (i) deep", "    - (ii) deeper", "  - (c) third", "plain (a) only", "> 1. x (a) y"]
    assert render.normalised_markdown("") == "" == render.normalised_markdown(None)


def test_rendered_on_cases(spark):
    cases = spark.createDataFrame([(1, [("a", 1)]), (2, None)], "case_id long, hits array<struct<ref:string,n:int>>")
    assert {r.case_id: r.rendered for r in render.rendered(cases, lambda r: ",".join(h["ref"] for h in r["hits"] or [])).collect()} == {1: "a", 2: ""}
    provisions = spark.createDataFrame([("r", "article", "1", "R", 0, ["r"]), ("b", "point", "b", "B", 2, ["r", "b"]), ("a", "point", "a", "A", 1, ["r", "a"]), ("x", "article", "2", "X", 3, ["x"])], "id string, kind string, number string, text string, seq long, path array<string>")
    row = render.subtree_rows(provisions, spark.createDataFrame([(7, "r")], "case_id long, id string")).first()
    assert [(n.depth, n.text) for n in row.nodes] == [(0, "R"), (1, "A"), (1, "B")]


MARKDOWN = """# MDCG 2020-3 Guidance
Medical Devices
## Contents
## 1 Scope 3
preamble
## 1 Scope
Text one.
---
Medical Devices
### 1.1. Detail <sup>2</sup>
more
#### Note
deep
## Footnotes
1. A note here
2 A note  HERE
## Chart A - Design
**A1** Is it new?
- Yes → significant
- No: go on
**A2**: Other question
- **No** – none
# Annex
tail
## Footnotes
3. Another note
"""


def test_guidance():
    text, counts = guidance.cleaned(MARKDOWN)
    assert counts == {"separators": 1, "headers": 1, "footnote_sections": 2, "footnotes": 2}
    assert text.endswith("## Footnotes\n\n1. A note here\n\n3. Another note\n") and text.count("Medical Devices") == 1 and "\n### 1.1. Detail" in text
    found = guidance.sections(text)
    assert [(s["level"], s["number"], s["title"], s["chart"]) for s in found] == [(2, "1", "Scope", None), (3, "1.1", "Detail", None), (4, None, "Note", None), (2, None, "Chart A - Design", "A"), (2, None, "Annex", None)]
    rows = guidance.tree(text, "G", "Guide")
    assert [(r["id"], r["kind"], r["path"][-2] if len(r["path"]) > 1 else None) for r in rows] == [("G_document", "guidance_document", None), ("G_sec_1", "guidance_section", "G_document"), ("G_sec_1_1", "guidance_subsection", "G_sec_1"), ("G_note", "guidance_paragraph", "G_sec_1_1"), ("G_chart_A", "guidance_chart", "G_document"), ("G_annex", "guidance_section", "G_document")]
    chart = guidance.charts(text)
    assert chart == [{"chart": "A", "title": "Design", "section": "", "steps": [{"id": "A1", "question": "Is it new?", "yes": "significant", "no": "go on"}, {"id": "A2", "question": "Other question?", "no": "none"}]}]
    loose = guidance.charts("## Main Chart\n**Is this a change of design?**\n- Yes\n- No – Section 4.2 applies\n## Main Chart\nnothing")
    assert loose == [{"chart": "Main", "title": "Main Chart", "section": "4.2", "steps": [{"id": "Main1", "question": "Is this a change of design?", "yes": "significant", "no": "Section 4.2 applies"}]}]
    assert guidance.tree(None, "G", "g") == [] and len(guidance.tree("", "G", "g")) == 1
    twice = guidance.tree("## 1 A\n## 1 B\n## 1 C", "G", "g")
    assert [r["id"] for r in twice] == ["G_document", "G_sec_1", "G_sec_1_2", "G_sec_1_3"]


def test_guidance_table(spark):
    documents = spark.createDataFrame([("G", "Guide", MARKDOWN), ("H", None, None)], "celex string, name string, text string")
    got = guidance.parse(documents).orderBy("seq").collect()
    assert [r.id for r in got][:2] == ["G_document", "G_sec_1"] and got[1].parent_id == "G_document" and {r.celex for r in got} == {"G"}
