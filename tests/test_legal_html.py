from docweave.sources import legal_html
from docweave.sources.legal_html import dotted, parse_act

OJ = """<html><body><div class="eli-main-title" id="tit_1"><p>REGULATION X</p></div>
<div id="pbl_1"><div id="cit_1"><p class="oj-normal">Having regard,</p></div><div id="rct_1"><table><tr><td>(1)</td><td>Whereas one.</td></tr></table></div></div>
<div id="enc_1"><div id="cpt_I"><p>CHAPTER I</p><div id="cpt_I.tit_1"><p>General</p></div>
<div id="cpt_I.sct_1"><div id="cpt_I.sct_1.tit_1"><p>First</p></div>
<div id="art_1"><p class="oj-ti-art">Article 1</p><div class="eli-title" id="art_1.tit_1"><p class="oj-sti-art">Scope</p></div>
<div id="001.001"><p class="oj-normal">First paragraph, nothing behind.</p></div>
<div id="001.002"><p class="oj-normal"><p class="oj-normal inline-element">Intro, namely:</p>
<table width="100%"><tr><td><p class="oj-normal">(a)</p></td><td><p class="oj-normal">first point:</p><table width="100%"><tr><td>(i)</td><td>deep</td></tr></table><table width="100%"><tr><td>—</td><td>dash</td></tr></table></td></tr></table>
<table width="100%"><tr><td><p class="oj-normal">(b)</p></td><td><p class="oj-normal">is replaced by the following:</p><table width="100%"><tr><td>‘(b)</td><td>new text’;</td></tr></table></td></tr></table></p></div>
<p class="oj-normal">Second subparagraph.</p><p class="list">and on it goes.</p>
<div class="oj-normal">3 Detached paragraph.</div></div></div></div>
<div id="cpt_II"><div id="art_2"><div id="art_2.tit_1"><p>Definitions</p></div><p class="oj-normal">In this act:</p><table width="100%"><tr><td>(1)</td><td>‘thing’ means a thing;</td></tr></table></div>
<div id="art_2a"><p class="oj-normal">One.</p><p class="oj-normal">Two.</p></div><div id="art_3"><p>only loose text</p></div></div>
<div id="cpt_III"><div id="007.001"><p class="oj-normal">Bare paragraph.</p></div></div></div>
<div id="fnp_1"><p>Done at Brussels</p></div>
<div id="anx_I" class="eli-container"><p class="oj-doc-ti">ANNEX I</p><p class="oj-doc-ti">LISTS</p>
<p class="oj-ti-grseq-1">Chapter I</p><p class="oj-ti-grseq-1">Requirements</p><p class="oj-ti-grseq-1">1.   GENERAL</p><div><p class="oj-normal">1.1.Sub one</p></div><p class="oj-normal">goes on.</p>
<table><tr><td>(a)</td><td>letter</td></tr><tr><td>—</td><td>bullet</td></tr></table><p class="oj-normal">2.   Two</p>
<p class="oj-ti-grseq-1">Section A. Special</p><table><tr><td>Old</td><td>New</td></tr><tr><td>Article 5</td><td>6 and more</td></tr></table>
<div class="oj-enumeration-spacing"><p>3.</p><p>by enumeration</p></div></div>
<div id="anx_ES" class="eli-container"><p>signatures</p></div></body></html>"""


def tree(html, celex="A"):
    return {r["id"][len(celex) + 1 :]: r for r in parse_act(html, celex)}


def test_original_layout():
    t = tree(OJ)
    kinds = {k: r["kind"] for k, r in t.items()}
    assert t["document"]["text"] == "REGULATION X"
    assert (t["cit_1"]["number"], t["rct_1"]["text"]) == ("1", "(1) Whereas one.")
    assert (t["cpt_I"]["title"], t["cpt_I.sct_1"]["number"], t["art_1"]["title"]) == ("General", "1", "Scope")
    assert t["001.001"]["text"] == "First paragraph, nothing behind." and t["001.001"]["children"] == 0
    assert t["001.002"]["text"] == "" and t["001.002"]["children"] == 2
    assert t["001.002_sp_1"]["text"] == "Intro, namely:" and t["001.002_sp_2"]["text"] == "Second subparagraph. and on it goes."
    assert (kinds["001.002_sp_1_pt_a"], t["001.002_sp_1_pt_a"]["text"]) == ("point", "first point:")
    assert (kinds["001.002_sp_1_pt_a_rm_i"], kinds["001.002_sp_1_pt_a_ind_1"]) == ("roman_item", "indent")
    assert t["001.002_sp_1_pt_b"]["text"] == "is replaced by the following: ‘(b) new text’;"
    assert t["001.003"]["text"] == "Detached paragraph." and t["001.003"]["number"] == "3"
    assert t["art_2"]["text"] == "In this act:" and t["art_2_pt_1"]["text"] == "‘thing’ means a thing;"
    assert [t[f"art_2a_sp_{k}"]["text"] for k in (1, 2)] == ["One.", "Two."] and t["art_2a"]["number"] == "2a"
    assert t["art_3"]["text"] == "only loose text"
    assert t["art_7"]["kind"] == "article" and t["007.001"]["text"] == "Bare paragraph." and t["007.001"]["parent_id"] == "A_art_7"
    assert t["fnp_1"]["text"] == "Done at Brussels"


def test_annexes():
    t = tree(OJ)
    assert t["anx_I"]["title"] == "LISTS" and "anx_ES" not in t
    assert t["anx_I_chp_I"]["title"] == "Requirements"
    assert t["anx_I_chp_I_1"]["kind"] == "annex_section"
    assert t["anx_I_chp_I_1_1.1"]["text"] == "Sub one goes on." and t["anx_I_chp_I_1_1.1"]["kind"] == "annex_point"
    assert t["anx_I_chp_I_1_1.1_a"]["kind"] == "annex_subpoint" and t["anx_I_chp_I_1_1.1_blt_1"]["text"] == "bullet"
    assert t["anx_I_chp_I_2"]["text"] == "Two" and t["anx_I_chp_I_2"]["parent_id"] == "A_anx_I_chp_I"
    assert t["anx_I_sec_A"]["title"] == "Special"
    assert t["anx_I_sec_A_r2"]["text"] == "Article 5\x1f6 and more" and t["anx_I_sec_A_r1"]["kind"] == "annex_row"
    assert t["anx_I_sec_A_3"]["text"] == "by enumeration"
    assert dotted("1.Contact") == ("1", "Contact", 1) and dotted("1.1.1.Sub") == ("1.1.1", "Sub", 3) and dotted("1.5 million") is None


CONSOLIDATED = """<div class="eli-main-title" id="tit_1"><p>REGULATION X</p></div><p class="modref">▼B</p><div id="enc_1"><div id="art_10a"><p class="title-article-norm">Article 10a</p>
<div id="art_10a.tit_1"><p class="stitle-article-norm">Title</p></div>
<div class="norm"><span class="no-parag">1. </span><div class="inline-element">From <span class="boldface">►M1</span>26 May 2021<span class="boldface">◄</span>, it applies.</div></div>
<div class="norm"><span class="no-parag">3a. </span><div class="inline-element">Namely:<div class="grid-container grid-list"><div class="grid-list-column-1"><span>(a)</span></div><div class="grid-list-column-2"><p class="norm">one:</p>
<div class="grid-container grid-list"><div class="grid-list-column-1">(i)</div><div class="grid-list-column-2"><p class="norm">two</p></div></div></div></div></div></div></div></div>
<div id="anx_II"><p class="title-annex-1">ANNEX II</p><p class="title-gr-seq-level-1">1. HEAD</p><p class="norm">2. Body</p></div>"""


def test_consolidated_layout():
    assert legal_html.is_consolidated(CONSOLIDATED) and not legal_html.is_consolidated(OJ) and not legal_html.is_consolidated(None)
    t = tree(CONSOLIDATED)
    assert t["010a.001"]["text"] == "From 26 May 2021 , it applies." and t["010a.001"]["number"] == "1"
    assert t["010a.003a"]["text"] == "Namely:" and t["010a.003a"]["number"] == "3a"
    assert t["010a.003a_pt_a"]["text"] == "one:" and t["010a.003a_pt_a_rm_i"]["text"] == "two"
    assert t["anx_II_1"]["title"] == "HEAD" and t["anx_II_2"]["text"] == "Body"
    assert not any("▼" in r["text"] or "►" in r["text"] for r in t.values())


def test_invariants_and_odd_pages():
    for html in (OJ, CONSOLIDATED, "", None, "<p>x", "<div id='enc_1'><div id='art_1'><div id='001.001'>a</div><div id='001.001'>b</div></div></div>", "<table><tr><td>(a)<td>b</table>" * 50):
        rows = parse_act(html, "A")
        ids = [r["id"] for r in rows]
        assert len(set(ids)) == len(ids)
        by = {r["id"]: r for r in rows}
        for seq, r in enumerate(rows):
            assert r["seq"] == seq and r["path"][-1] == r["id"]
            if r["parent_id"]:
                assert by[r["parent_id"]]["path"] == r["path"][:-1] and by[r["parent_id"]]["seq"] < seq
    assert [r["id"] for r in parse_act("<div id='enc_1'><div id='art_1'><div id='001.001'>a</div><div id='001.001'>b</div></div></div>", "A")][-1] == "A_001.001~2"


def test_older_recitals():
    t = tree("<div id='pbl_1'><table><tr><td>1</td><td>Whereas</td></tr><tr><td>x</td><td>no</td></tr></table></div>")
    assert t["rct_1"]["text"] == "Whereas" and len([r for r in t.values() if r["kind"] == "recital"]) == 1


def test_tables_and_graft(spark):
    pages = spark.createDataFrame([("A", CONSOLIDATED), ("B", OJ), ("C", None)], "celex string, html string")
    original = legal_html.parse(spark.createDataFrame([("A", OJ), ("B", OJ)], "celex string, html string"))
    got = legal_html.parse(pages)
    assert got.filter("celex = 'C'").count() == 1
    whole = legal_html.graft_preamble(got, original)
    a = [r.id for r in whole.filter("celex = 'A'").orderBy("seq").collect()]
    assert a[:4] == ["A_document", "A_preamble", "A_cit_1", "A_rct_1"] and a[4] == "A_enc_1"
    assert [r.seq for r in whole.filter("celex = 'A'").orderBy("seq").collect()] == list(range(len(a)))
    assert whole.filter("celex = 'B'").count() == got.filter("celex = 'B'").count()
    force = {r.kind: r.binding_force for r in legal_html.stamped(whole).collect()}
    assert force["recital"] == "interpretive" and force["article"] == "binding"
    difference = legal_html.compared(legal_html.diagnosis(pages), legal_html.diagnosis(spark.createDataFrame([("A", OJ), ("B", OJ), ("C", "")], "celex string, html string")))
    assert {r.celex for r in difference.collect()} == {"A"}
