"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Two models over the bytes of words, of toxic and of ordinary labelled texts, share the counts of short contexts,
so that a rare expression is smoothed alike in both. A text is compared by its length-normalised
log-likelihoods, over all of it and over each window of a few words, and a logistic function fitted on labelled
rows that the models have not seen turns these into a score.

At most ROWS_PER_CLASS labelled rows of each class, and SAMPLE_BYTES of their texts, are learnt from (documented
bounds); everything else covers all rows. A FOLDS-th of each class calibrates, and the models learn from the rest. Where a class has too few
rows for that (under FEW), the models that calibrate are fitted anew for each fold, so that every row is measured by models that have not
seen it, and those that score learn from all rows. With one row of a class nothing can be calibrated: a score is then the odds of the class times a likelihood ratio.

Defined results: a null or empty text is scored as no words; a null label, a null id in the labels and labels of
unknown documents teach nothing; an id with several labels counts as toxic if one of them is 1; where only one
class is labelled all scores are its share (0 or 1), and without any labels, or labelled texts of one class only, its share of the labels;
one labelled row of a class is enough to score. Repeated rows are all kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.llm._charkn import CharKN, score_words
from docweave.llm._classes import SLICE_BYTES, bounded_ids, bounded_sample, fit
from docweave.llm._frames import PREFIX, append_columns, held_out, materialise, read
from docweave.llm._words import slices, words

ROWS_PER_CLASS = 1_500
ORDER, SHARED = 5, 2
WINDOW_WORDS = 16
THRESHOLD = 0.3
FEATURES = 4
FOLDS, FEW = 4, 8


def features(model: CharKN, column: pa.Array) -> np.ndarray:
    """Of each text: log-likelihood ratio a byte, of the worst window a word, of words clearly toxic, of the worst word."""
    out = np.zeros((len(column), FEATURES))
    for a, b in slices(column, SLICE_BYTES):
        w = words(column.slice(a, b - a))
        if not len(w.starts):
            continue
        logs, back = score_words(model, w)
        ratio = np.clip((logs[:, 1] - logs[:, 0]).astype(np.float64), -20, 20)[back]
        sums = np.concatenate(([0.0], np.cumsum(ratio)))
        some = np.flatnonzero(w.counts)
        first, last = w.first[some], w.first[some + 1]
        size = np.add.reduceat(w.ends - w.starts + 1, first)
        end = np.minimum(np.arange(len(ratio)) + WINDOW_WORDS, np.repeat(w.first[1:], w.counts))
        part = out[a:b]
        part[some, 0] = (sums[last] - sums[first]) / size
        part[some, 1] = np.maximum.reduceat((sums[end] - sums[:-1]) / WINDOW_WORDS, first)
        part[some, 2] = np.log1p(np.add.reduceat(np.maximum(ratio - 3, 0), first))
        part[some, 3] = np.maximum.reduceat(ratio, first)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton steps: intercept, coefficients, for raw x."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - middle) / spread])
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-4] + [0.1] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + penalty @ w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        w = w - np.clip(np.linalg.solve(curve + 1e-9 * np.eye(len(w)), slope), -3, 3)
    return np.concatenate(([w[0] - (w[1:] * middle / spread).sum()], w[1:] / spread))


def score(docs: DataFrame, labels: DataFrame, eligible=None, rows_per_class: int = ROWS_PER_CLASS, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """docs (doc_id, text, ...) with a score from 0 to 1. labels: doc_id, toxic. eligible: a condition on doc_id, which labelled rows to learn from."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if eligible is not None:
        known = known.filter(eligible)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).filter(F.col("label").isin(0, 1))
    shares = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    field = T.StructType([T.StructField(out, T.DoubleType(), False)])
    same = lambda batch: [pa.array(np.full(batch.num_rows, share))]
    if len(shares) < 2:
        return append_columns(docs, field, same, keep)
    # About four times rows_per_class ids are expected, so they are broadcast; their rows are bounded again, as an id may have many.
    chosen = docs.select("doc_id", "text").join(F.broadcast(bounded_ids(known, "label", rows_per_class)), "doc_id")
    drawn = bounded_sample(materialise(chosen.filter("text is not null").distinct()), "label", rows_per_class)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit("fold"), "doc_id", "text"), "doc_id"))
    sample = materialise(drawn.withColumn("fold", (place + F.col("label")) % FOLDS))  # one row of each class lies in two folds
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return append_columns(docs, field, same, keep)
    names = [f"{PREFIX}f{k}" for k in range(FEATURES)]

    def learnt(rows: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(fit(rows.select("text", "label"), 2, ORDER, SHARED))

    def measured(rows: DataFrame, model: Broadcast) -> pd.DataFrame:
        work = lambda batch, kn: list(map(pa.array, features(kn, batch.column("text")).T.copy()))
        return append_columns(rows, T.StructType([T.StructField(n, T.DoubleType()) for n in names]), work, ["label"], lambda: CharKN.load(model.value)).toPandas()

    if min(sizes.values()) < FEW:
        inside = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
        whole = [k for k in range(FOLDS) if any(f == k for f, _ in inside) and all(inside.get((k, c), 0) < n for c, n in sizes.items())]  # both classes are left to learn from
        parts = [measured(sample.filter(F.col("fold") == k), learnt(sample.filter(F.col("fold") != k))) for k in whole]
        seen = pd.concat(parts) if parts else pd.DataFrame(columns=[*names, "label"])
        model = learnt(sample)
    else:
        model = learnt(sample.filter(F.col("fold") != 0))
        seen = measured(sample.filter(F.col("fold") == 0), model)
    x, y = seen[names].to_numpy(dtype=float), seen["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        # One row of a class cannot be learnt from and calibrate: the odds of the class, times the likelihood ratio of a word of the worst window.
        fitted = np.array([np.log(share / (1 - share)), 0.0, 1.0, 0.0, 0.0])
    else:
        weight = np.array([shares[int(v)] / max(1, (y == v).sum()) for v in y])
        fitted = logistic(x, y, weight * len(y) / weight.sum())

    def judge(batch: pa.RecordBatch, kn: CharKN) -> list[pa.Array]:
        z = features(kn, batch.column("text")) @ fitted[1:] + fitted[0]
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]

    return append_columns(docs, field, judge, keep, lambda: CharKN.load(model.value))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out(F.col("doc_id"), 4), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
