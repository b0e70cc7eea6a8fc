"""The inverted index against the ranking that reads the texts, and what it skips."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import inverted, search
from docweave.sources.corpus import first_by


def texts(seed, n=900):
    chance = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    pick = lambda: words[min(59, int(chance.paretovariate(0.7)) - 1)]
    rows = [(k, " ".join(pick() for _ in range(chance.randrange(1, 40)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "w1 w1 w1 rare"), (n + 4, "w1 w1 w1 rare")]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equals_the_scan(spark, tmp_path, k):
    rows = texts(k)
    documents = spark.createDataFrame(rows, "id long, text string").repartition(6)
    questions = spark.createDataFrame([(1, "w1 w2 w3"), (2, "rare"), (3, "w40 w41 w1 w1 nothing"), (4, "nothing at all"), (5, None)], "question long, text string")
    folder = f"file://{tmp_path}/index"
    inverted.build(documents, folder, shard=200, block=8)
    want = first_by(search.bm25(documents, questions).withColumn("score", F.round("score", 6)), ["question"], [F.desc("score"), "id"], k)
    got = inverted.search(spark, folder, questions, k, cut, block=8)
    plain = lambda df: sorted((r.question, r["rank"], r.id, r.score) for r in df.collect())
    assert plain(got) == plain(want)


def test_blocks_are_skipped(spark, tmp_path):
    """A rare, telling term lies in few blocks; those with common terms only cannot reach its score."""
    rows = [(k, "w1 " + ("gem " * 3 if k % 500 == 0 else "") + "w2 " * (k % 7)) for k in range(4000)]
    folder = f"file://{tmp_path}/index"
    inverted.build(spark.createDataFrame(rows, "id long, text string"), folder, shard=1000, block=16)
    asked = inverted.weights(spark, folder, spark.createDataFrame([(1, "gem w1")], "question long, text string"))
    postings = spark.read.parquet(f"{folder}/postings")
    bounds = inverted.bounds(postings, asked).collect()
    best = inverted.scored(postings, asked, inverted.bounds(postings, asked)).agg(F.max("score")).first()[0]
    assert len(bounds) == 252 or len(bounds) > 240
    assert sum(b.bound >= best - 1e-6 for b in bounds) <= 8
    assert "locals" not in inverted.bounds(postings, asked)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    inverted.build(spark.createDataFrame([], "id long, text string"), folder)
    assert inverted.search(spark, folder, spark.createDataFrame([(1, "w1")], "question long, text string"), 3, cut).count() == 0
