"""The index of provisions with their ancestors' numbers, against the one from paths, and what it joins."""

from docweave.operators import resolve
from tests.test_index_by_parent import ROWS


def test_index_by_given_numbers(spark):
    of = {r[2]: (r[3], r[4]) for r in ROWS}
    number = lambda r, kind: next((of[i][1] for i in r[6][:-1] if of[i][0] == kind), None)
    rows = [(*r[:5], number(r, "article"), number(r, "paragraph")) for r in ROWS]
    held = spark.createDataFrame(rows, "celex string, seq string, id string, kind string, number string, in_article string, in_paragraph string")
    paths = spark.createDataFrame(ROWS, "celex string, seq string, id string, kind string, number string, parent_id string, path array<string>")
    assert sorted(map(tuple, resolve.index(held).collect())) == sorted(map(tuple, resolve.index(paths).collect()))
    assert "Join" not in resolve.index(held)._jdf.queryExecution().executedPlan().toString()


def test_provision_index_stores_no_nodes(spark, sf_dir, monkeypatch):
    """Before, the tree was stored with the points' texts, and joined with itself."""
    from docweave.plans import reference_queries

    monkeypatch.setattr(reference_queries, "cut", None)
    assert reference_queries.provision_index(spark, sf_dir).count() > 0
