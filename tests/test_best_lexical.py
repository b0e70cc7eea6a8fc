"""The head of lexical rankings and whole dense rankings, made where documents and vectors are."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import lexical, search
from docweave.operators.vectors import ranking
from docweave.sources.corpus import first_by


def plain(df):
    return sorted(((r.question, r["rank"], r.id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("again", [[], [(3, "w1 w9"), (3, "w1 w9"), (4, None), (None, "w2"), (None, "w1 w1")]])
def test_best_are_the_head_of_all_scores(spark, again, monkeypatch):
    """Also where ids are repeated or null, and where questions take several scans and scores several sums."""
    chance = random.Random(len(again))
    rows = [(k, " ".join(f"w{min(20, int(chance.paretovariate(0.8)))}" for _ in range(chance.randrange(1, 25)))) for k in range(300)]
    documents = spark.createDataFrame(rows + [(400, None), (401, "!")] + again, "id long, text string").repartition(5)
    questions = spark.createDataFrame([(1, "w1 w2 W3"), (2, "w19"), (3, "nothing"), (4, None), (5, "w4 w5 w6 w20")], "question long, text string")
    monkeypatch.setattr(lexical, "QUESTION_BYTES", 64)
    monkeypatch.setattr(lexical, "CELLS", 50)
    for k in (1, 12, 1000):
        want = first_by(search.bm25(documents, questions).withColumn("score", F.round("score", 6)), ["question"], [F.desc("score"), "id"], k)
        assert plain(lexical.bm25_best(documents, questions, k)) == plain(want)
    assert lexical.bm25_best(documents, questions.limit(0), 3).count() == lexical.bm25_best(documents.limit(0), questions, 3).count() == 0


def test_rows_of_questions_and_documents_are_not_shuffled(spark):
    """With a common word every task hands over k rows for each question; before, one for each document."""
    documents = spark.range(400, numPartitions=4).select("id", F.lit("w1 w2").alias("text"))
    questions = spark.createDataFrame([(q, "w1") for q in range(10)], "question long, text string")
    found = lexical.bm25_best(documents, questions, 2)
    assert "mapInArrow" in found._jdf.queryExecution().executedPlan().toString() or "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.question, r.id) for r in found.orderBy("question", "rank").collect()] == [(q, i) for q in range(10) for i in (0, 1)]


def test_ranking(spark):
    chance = random.Random(2)
    rows = [(k, [chance.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for k in range(200)] + [(900, None), (901, [0.0] * 3), (902, [1.0]), (903, [float("nan")] * 3)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    questions = [(7, [1.0, 0.2, 0.1]), (8, [-1.0, -1.0, 1.0])]
    found = ranking(vectors, questions)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1  # before, a range exchange, a stored table and a join of all rows
    near = search.dense(vectors.filter("id < 900"), questions).withColumn("cosine", F.round("cosine", 6))
    assert sorted(map(tuple, found.select("question", "id", "rank").collect())) == sorted(map(tuple, search.ranks(near, "cosine").collect()))
    assert ranking(vectors, []).count() == 0


def test_hybrid_needs_the_head_alone(spark, sf_dir, monkeypatch):
    """Before, the scores of all questions and documents were made and sorted by question."""
    from docweave.plans import search_queries

    monkeypatch.setattr(search, "bm25", None)
    assert search_queries.hybrid_retrieve(spark, sf_dir).count() > 0
