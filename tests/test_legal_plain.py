"""Pages of plain tags are read without a parser, as the parser reads them, and rows go back in batches of many pages."""

from docweave.sources import legal_html

ACT = '<html><div class="eli-main-title" id="tit_1">Act 1 &amp; 2</div><div id="enc_1"><div id="art_1"><div id="art_1.tit_1"><p>Scope</div><div id="001.001"><p class="oj-normal">It holds:<table width="100%"><tr><td>(a)<td>one</td></tr></table></div><p class="oj-normal list">On.</span><br>x</p></div></div></html>'


def dump(e):
    return e.tag, e.id, e.classes, e.role, [c if isinstance(c, str) else dump(c) for c in e.children]


def test_plain_pages_need_no_parser_and_have_its_tree():
    assert legal_html._plain(ACT) is not None
    for odd in ("<!-- a comment -->", "<P>", "<p class=x>", "<br/>", "</ p>", "<script>if (a<b) c</script>", "a < b"):
        assert legal_html._plain(ACT + odd) is None
        assert dump(legal_html.build(ACT + odd)).__class__ is tuple
    parser = legal_html._Builder()
    parser.feed(ACT)
    parser.close()
    assert dump(legal_html.build(ACT)) == dump(parser.root)


def test_rows_of_many_pages_share_a_batch(spark):
    pages = spark.createDataFrame([(f"K{k}", ACT) for k in range(50)] + [("none", None)], "celex string, html string").coalesce(1)
    rows = legal_html.parse(pages, ("id", "depth"))
    assert rows.columns == ["id", "depth"]
    whole = legal_html.parse(pages)
    assert sorted(map(tuple, rows.collect())) == sorted((r.id, r.depth) for r in whole.collect())
    assert whole.filter("celex = 'K7'").count() == len(legal_html.parse_act(ACT, "K7"))
