"""What lexical ranking shuffles."""

from docweave.operators import search


def test_documents_are_shuffled_once_by_id(spark):
    documents = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} w1 w1") for k in range(200)] + [(3, "w1 w9"), (900, None)], "id long, text string")
    questions = spark.createDataFrame([(1, "w1 w2"), (2, "w4 nothing"), (3, None)], "question long, text string")
    plan = search.bm25(documents, questions)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(question" not in plan  # before, rows of questions and documents were shuffled
    assert search.bm25(documents, questions.limit(0)).count() == 0
