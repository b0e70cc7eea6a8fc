"""Toxicity with few labels of a class: scores differ between texts, and clean documents stay in the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from docweave.llm import toxicity


def tables(spark, toxic, seed):
    chance = np.random.default_rng(seed)
    plain, bad = ["table", "green", "river", "stone", "walks", "singing", "house", "little"], ["vilenames", "scumbags", "idiots"]
    rows = [(k, " ".join([*chance.choice(plain, 30), *(chance.choice(bad, 6) if k < 6 else [])])) for k in range(60)]
    labels = [(k, int(k < toxic)) for k in range(toxic)] + [(k, 0) for k in range(6, 60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("toxic", [1, 2, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_scores(spark, toxic, seed):
    docs, labels = tables(spark, toxic, seed)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert len(set(got.values())) > 10
    clean = [got[k] for k in range(6, 60)]
    assert max(clean) < toxicity.THRESHOLD
    assert min(got[k] for k in range(6)) > max(clean) or toxic < 5


def test_clean_documents_stay(spark, tmp_path):
    docs, labels = tables(spark, 1, 3)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path)).collect()}
    assert kept >= set(range(6, 60))


def test_labelled_texts_of_one_class_only(spark):
    """The only toxic label is of a document that is not there: its share of the labels is the score."""
    docs, labels = tables(spark, 1, 4)
    got = {r.score for r in toxicity.score(docs.filter("doc_id > 0"), labels).collect()}
    assert got == {1 / 55}


def test_one_row_of_each_class(spark):
    docs, _ = tables(spark, 1, 5)
    got = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame([(0, 1), (10, 0)], "doc_id long, toxic int")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[0] >= got[10]
