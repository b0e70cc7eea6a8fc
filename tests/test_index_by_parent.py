"""The index of provisions: ancestors' numbers are found once a parent, keys by one aggregate."""

from docweave.operators import resolve

ROWS = [
    ("c", "1", "a", "article", "5", None, ["a"]), ("c", "2", "p", "paragraph", "1", "a", ["a", "p"]), ("c", "3", "x", "point", "a", "p", ["a", "p", "x"]), ("c", "4", "y", "point", "b", "p", ["a", "p", "y"]),
    ("c", "5", "q", "paragraph", "2", "a", ["a", "q"]), ("c", "6", "z", "point", "a", "q", ["a", "q", "z"]), ("c", "7", "w", "point", "a", "q", ["a", "q", "w"]), ("c", "8", "u", "point", "d", "a", ["a", "u"]),
]


def test_index_by_parent(spark):
    rows = spark.createDataFrame(ROWS, "celex string, seq string, id string, kind string, number string, parent_id string, path array<string>")
    assert {(r.parent, r.in_article, r.in_paragraph) for r in resolve._ancestor_numbers(rows).collect()} == {("a", "5", None), ("p", "5", "1"), ("q", "5", "2")}
    assert {(r.id, r.in_article, r.in_paragraph) for r in resolve.ancestor_numbers(rows).collect()} == {("p", "5", None), ("q", "5", None), ("u", "5", None), ("x", "5", "1"), ("y", "5", "1"), ("z", "5", "2"), ("w", "5", "2")}
    got = {(r.key_kind, r.key): r.target for r in resolve.index(rows).collect()}
    assert got == {("article", "5"): "a", ("paragraph", "5.1"): "p", ("paragraph", "5.2"): "q", ("point", "5.1.a"): "x", ("point", "5.1.b"): "y", ("point", "5.2.a"): "w", ("point", "5.d"): "u", ("some_point", "5.a"): "x", ("some_point", "5.b"): "y"}
