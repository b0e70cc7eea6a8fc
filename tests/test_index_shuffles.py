"""What building and reading the inverted index shuffles, and blocks over the bounds of batches."""

import random

from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import inverted, search
from docweave.sources.corpus import first_by


def shuffled(spark):
    """Records that stages have shuffled so far."""
    context, some = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(some(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), some())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_texts_are_indexed_where_they_are_read(spark, tmp_path):
    folder, documents = f"file://{tmp_path}/index", spark.createDataFrame([(k, f"w{k % 7} w{k % 5} w1 w1") for k in range(200)], "id long, text string")
    before = shuffled(spark)
    inverted.build(documents, folder)
    assert shuffled(spark) - before <= 16  # the number of documents and their mean alone; before, texts and postings were shuffled
    asked = inverted.weights(spark, folder, spark.createDataFrame([(1, "w1")], "question long, text string"))
    assert "ids" not in inverted.bounds(spark.read.parquet(f"{folder}/postings"), asked)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_small_batches_and_text_ids(spark, tmp_path):
    chance = random.Random(4)
    rows = [(f"d{k}", " ".join(f"w{min(30, int(chance.paretovariate(0.8)))}" for _ in range(chance.randrange(30)))) for k in range(500)]
    documents = spark.createDataFrame(rows, "id string, text string").repartition(3)
    questions = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w30 w7"), (2, "w9")], "question long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        inverted.build(documents, f"file://{tmp_path}/index", shard=20, block=4)
        got = inverted.search(spark, f"file://{tmp_path}/index", questions, 9, cut, block=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = first_by(search.bm25(documents, questions).withColumn("score", F.round("score", 6)), ["question"], [F.desc("score"), "id"], 9).collect()
    assert sorted((r.question, r["rank"], r.id, r.score) for r in got) == sorted((r.question, r["rank"], r.id, r.score) for r in want)
