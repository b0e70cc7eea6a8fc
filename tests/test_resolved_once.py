"""Resolution reads and stores the provisions once: what it leaves in storage, and contexts and wide spans over many ranges."""

import os

import pytest
from pyspark.sql import functions as F

from docweave.functions.storage import shared_dir
from docweave.operators import resolve
from docweave.plans import reference_queries as q
from tests.test_references import WANTED, act

SCHEMA = "celex string, seq long, id string, kind string, number string, parent_id string, text string"


@pytest.fixture
def ranges(spark):
    """Many ranges: as many as there are rows, nearly."""
    keys = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def bytes_in(spark):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(shared_dir(spark).removeprefix("file://")) for f in files)


def test_what_is_stored(spark, sf_dir):
    """Before, the tree, its ranges, the references and the index were each stored, with paths and texts: over 300 bytes a provision."""
    n, before = q._provisions(spark, sf_dir).count(), bytes_in(spark)
    assert q.resolved_references(spark, sf_dir).count() > 0
    assert bytes_in(spark) - before < 100 * n


def test_contexts_go_on_over_ranges(spark, ranges):
    rows = spark.createDataFrame([*act(), *[("B", *r[1:]) for r in act()]], SCHEMA).repartition(3)
    paths = resolve.with_paths(rows.filter("celex = 'A'"))
    rows = paths.unionByName(paths.withColumn("celex", F.lit("B")))
    got = resolve.resolve(rows).collect()
    assert {(r.source, r.target) for r in got if r.celex == "A"} == WANTED == {(r.source, r.target) for r in got if r.celex == "B"}
    plain = resolve.resolve(rows, texts=False).collect()
    assert sorted(tuple(r[:4]) for r in plain) == sorted(tuple(r[:4]) for r in got) and not any(r.ref_text for r in plain)


def test_numbers_of_ancestors_in_place_of_paths(spark, ranges):
    rows = resolve.with_paths(spark.createDataFrame(act(), SCHEMA))
    held = rows.join(resolve.ancestor_numbers(rows), "id", "left").drop("path")
    assert {(r.source, r.target) for r in resolve.resolve(held).collect()} == WANTED


def test_wide_span_beside_others(spark, ranges):
    rows = [("A", k, f"a{k}", "article", str(k * 1000), None, "Articles 3000 to 90000, Article 2000" if k == 5 else None) for k in range(1, 12)]
    got = resolve.resolve(spark.createDataFrame(rows, SCHEMA).withColumn("path", F.array("id"))).collect()
    assert {(r.source, r.target) for r in got} == {("a5", f"a{k}") for k in (2, 3, 4, 6, 7, 8, 9, 10, 11)}
