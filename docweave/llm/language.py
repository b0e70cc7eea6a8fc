"""Language identification by multilingual mixture inference (operator 10).

Kneser-Ney models over the bytes of words give each run of a few words a likelihood in each language. In each
document expectation-maximisation estimates the proportions of the languages, and the set of languages is the
one of best penalised likelihood (BIC) among the nested sets of the largest proportions, grown while that gets
better. The prediction is the largest proportion in that set, its score that proportion.

At most ROWS_PER_LANGUAGE rows of each language, and SAMPLE_BYTES of their texts, are learnt from (documented
bounds); all else covers all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null lang teaches nothing; if
no row can be learnt from, all texts are ``und``; a row without an id teaches like any other, and equal rows once; equal proportions go to the language first in order. Repeated
rows are all kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._charkn import CharKN, score_words
from docweave.llm._classes import SLICE_BYTES, bounded_sample, fit
from docweave.llm._frames import append_columns, held_out, materialise, read
from docweave.llm._words import slices, words

ROWS_PER_LANGUAGE = 1_000
ORDER = 4
#: Words that are taken to be in one language together.
RUN_WORDS = 6
#: Expectation-maximisation of a document ends when no proportion moves by more than this, or after so many steps.
TOLERANCE, MOST_STEPS = 1e-6, 500
#: Part of a run's likelihood that each language gets whatever the run says, so that one odd word decides nothing.
FLOOR = 1e-4
#: The column of a document's languages and their proportions.
SET = "languages"


def _proportions(like: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions among the allowed languages, and the log-likelihood."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    live, part, size = np.arange(len(sizes)), like, sizes
    for _ in range(MOST_STEPS):
        joint = part * np.repeat(share[live], size, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        now = np.add.reduceat(joint, np.cumsum(size) - size, axis=0) / size[:, None]
        moved = np.abs(now - share[live]).max(axis=1) > TOLERANCE
        share[live] = now
        if not moved.any():
            break
        if not moved.all():
            part, live, size = part[np.repeat(moved, size)], live[moved], size[moved]
    total = np.log((like * np.repeat(share, sizes, axis=0)).sum(axis=1))
    return share, np.add.reduceat(total, np.cumsum(sizes) - sizes)


def mixtures(model: CharKN, column: pa.Array) -> np.ndarray:
    """Proportions of each text's chosen set of languages; zeros where it has no word."""
    out = np.zeros((len(column), model.classes))
    for a, b in slices(column, SLICE_BYTES):
        w = words(column.slice(a, b - a))
        some = np.flatnonzero(w.counts)
        if not len(some):
            continue
        logs, back = score_words(model, w)
        counts = w.counts[some]
        runs = -(-counts // RUN_WORDS)
        start = np.concatenate(([0], np.cumsum(runs)))
        inside = np.arange(start[-1]) - np.repeat(start[:-1], runs)
        heads = np.repeat(w.first[some], runs) + inside * RUN_WORDS
        run = np.add.reduceat(logs[back], heads, axis=0).astype(np.float64)
        like = np.exp(run - run.max(axis=1, keepdims=True)) + FLOOR
        n = len(some)
        share, _ = _proportions(like, runs, np.ones((n, model.classes)))
        order = np.argsort(-share, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        best, chosen = np.full(n, np.inf), np.zeros((n, model.classes))
        # Sets grow by the next largest language until the penalised likelihood gets no better.
        live = np.arange(n)
        for size in range(1, model.classes + 1):
            mine = np.zeros(n, bool)
            mine[live] = True
            fitted, likelihood = _proportions(like[np.repeat(mine, runs)], runs[live], (rank[live] < size).astype(np.float64))
            cost = -2 * likelihood + (size - 1) * np.log(runs[live])
            better = cost < best[live]
            live, fitted = live[better], fitted[better]
            best[live], chosen[live] = cost[better], fitted
            if not len(live):
                break
        out[a + some] = chosen
    return out


def identify(docs: DataFrame, labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, keep: list[str] | None = None, lang: str = "lang_pred", out: str = "score") -> DataFrame:
    """docs with the language of the column text, its proportion, and the set of languages with theirs, largest first.

    labelled: doc_id, text, lang, the rows to learn from.
    """
    spark = docs.sparkSession
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").alias("label"))
    sample = materialise(bounded_sample(known, "label", rows_per_language))
    languages = sorted(r[0] for r in sample.select("label").distinct().collect())
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (lang, out, SET)]
    share_type = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    added = T.StructType([T.StructField(lang, T.StringType()), T.StructField(out, T.DoubleType()), T.StructField(SET, share_type)])
    number = F.create_map(*[x for k, v in enumerate(languages) for x in (F.lit(v), F.lit(k))]) if languages else None
    blob = None
    if languages:
        blob = fit(sample.select("text", number[F.col("label")].alias("label")), len(languages), ORDER, 0)
    set_of = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    if blob is None:
        return append_columns(docs, added, lambda batch: [pa.array(["und"] * batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows)), pa.array([[]] * batch.num_rows, set_of)], keep)
    model = spark.sparkContext.broadcast(blob)

    def judge(batch: pa.RecordBatch, kn: CharKN) -> list[pa.Array]:
        found = mixtures(kn, batch.column("text"))
        row, column = np.nonzero(found)
        order = np.lexsort((column, -found[row, column], row))
        row, column = row[order], column[order]
        names = pa.array(np.asarray(languages, dtype=object)[column], pa.string())
        begins = pa.array(np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32))
        sets = pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays([names, pa.array(found[row, column])], names=["lang", "share"]))
        return [pa.array(np.asarray(languages, dtype=object)[found.argmax(axis=1)], pa.string()), pa.array(np.clip(found.max(axis=1), 0, 1)), sets]

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    flag = "__dw_letters"
    judged = append_columns(docs.withColumn(flag, letters), added, judge, [*keep, flag], lambda: CharKN.load(model.value))
    some = lambda c, otherwise: F.when(F.col(flag), F.col(c)).otherwise(otherwise).alias(c)
    return judged.select(*keep, some(lang, F.lit("und")), some(out, F.lit(0.0)), some(SET, F.array().cast(share_type)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out(F.col("doc_id"), 4)), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", SET)
