"""A training corpus from the table documents: toxicity, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents; the last returns token ids in place of the text. run() writes each stage's rows as Parquet into the
cluster's shared folder and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, minhash, mixing, pii, toxicity
from docweave.functions.storage import remove, shared_dir
from docweave.llm._frames import held_out, read


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. Learns from the rows of labels that op6_toxicity learns from.

    A null or empty text is scored as one without words; rows without an id and repeated rows are judged like any other.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs, labels, ~held_out(F.col("doc_id"), 4), out="__dw_score")
    return scored.filter(F.col("__dw_score") < toxicity.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more), that of the smallest doc_id; of equal rows one.

    Rows without an id, and null or wordless texts of different ids, stay; rows that repeat an id with an unlike text stay too.
    """
    return minhash.drop_duplicates(docs, minhash.CORPUS_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars counts the new text. A null text stays null."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else masked


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated to the tempered source weights, shuffled. A null source is a source; rows of one id get one count."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with a digest of the bytes that they decode to. A null or empty text has no ids.

    Every row stays; columns of the names that are added (ids, n_tokens, decoded_sha256) are replaced.
    """
    encoded = bpe.encode(docs, digest="decoded_sha256")
    return encoded.select(*[c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded_sha256")], F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixed_sources),
    ("bpe", tokens),
]

#: Models and hashing are not expressible in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
