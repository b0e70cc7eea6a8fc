"""Lexical scores as products of Arrow batches: of each task no more rows than its best.

Documents' terms are weighed where they are read. A task keeps, for each question, the k best documents that it has met, so that no row of a question
and a document is shuffled, however many documents hold a question's words.

Defined results: scores are rounded to DIGITS, and equal ones go by the smaller id, null first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.storage import cut
from docweave.functions.workers import prepare
from docweave.operators.vectors import DIGITS, QUESTION_BYTES, rounded
from docweave.sources.corpus import first_by

K1, B = 1.2, 0.75
#: Scores that are summed at once, for all questions.
CELLS = 1 << 21


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def share(tf, dl, mean):
    """A term's share of a document's score, but for the term's weight: of columns, numbers or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def idf(n, df, log=F.log):
    return log(1 + (n - df + 0.5) / (df + 0.5))


def matrices(asked: Iterable[tuple[int, str, float]]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Questions, terms, and the terms' weights (a row for each term, a column for each question), QUESTION_BYTES of them at most unless one question has more; from (question, term, weight)."""
    of: dict[int, dict[str, float]] = {}
    for question, term, weight in asked:
        of.setdefault(question, {})[term] = weight

    def one(some: list[int]) -> tuple[np.ndarray, list[str], np.ndarray]:
        known = sorted({t for q in some for t in of[q]})
        place = {t: k for k, t in enumerate(known)}
        out = np.zeros((len(known), len(some)))
        for k, q in enumerate(some):
            out[[place[t] for t in of[q]], k] = list(of[q].values())
        return np.array(some, np.int64), known, out

    some, seen = [], set()
    for q in sorted(of):
        if some and len(seen | set(of[q])) * (len(some) + 1) * 8 > QUESTION_BYTES:
            yield one(some)
            some, seen = [], set()
        some.append(q)
        seen |= set(of[q])
    if some:
        yield one(some)


def counted(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among known, and count, of the known terms in each row's list; by row."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    key = (np.repeat(np.arange(len(lists)), sizes) * max(1, len(known)) + found)[found >= 0]
    key, tf = np.unique(key, return_counts=True)
    return *np.divmod(key, max(1, len(known))), tf


class Best:
    """For each question the k best documents that were offered."""

    def __init__(self, questions: np.ndarray, weights: np.ndarray, k: int):
        self.questions, self.weights, self.k = questions, weights, k
        self.worst = np.full(len(questions), -np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(questions)

    def offer(self, doc: np.ndarray, term: np.ndarray, shares: np.ndarray, ids: np.ndarray) -> None:
        """doc: places in ids, ascending; a document may have a term more than once."""
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        step = max(1, CELLS // max(1, len(self.questions)))
        a = 0
        while a < len(starts):  # whole documents
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + step, "right")) - 1)
            rows = slice(starts[a], starts[b] if b < len(starts) else len(doc))
            scores = np.add.reduceat(self.weights[term[rows]] * shares[rows, None], starts[a:b] - starts[a], axis=0)
            self._keep(scores, ids[doc[starts[a:b]]])
            a = b

    def _keep(self, raw: np.ndarray, ids: np.ndarray) -> None:
        scores = rounded(raw)
        fits = (raw > 0) & (scores >= self.worst)
        for q in np.flatnonzero(fits.any(axis=0)):
            at = np.flatnonzero(fits[:, q])
            s, i = scores[at, q], ids[at]
            if self.rows[q] is not None:
                s, i = np.concatenate([self.rows[q][0], s]), np.concatenate([self.rows[q][1], i])
            order = np.lexsort((i, -s))[: self.k]
            self.rows[q] = s[order], i[order]
            if len(order) == self.k:
                self.worst[q] = s[order[-1]]

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """question, id, score."""
        for q, rows in zip(self.questions.tolist(), self.rows):
            if rows is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), q)), pa.array(rows[1].tolist(), schema.field("id").type), pa.array(rows[0])], names=schema.names)


def best_schema(id_field: T.StructField) -> tuple[T.StructType, pa.Schema]:
    """question, id, score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("question", T.LongType()), T.StructField("id", id_field.dataType), T.StructField("score", T.DoubleType())])
    return schema, to_arrow_schema(schema)


def values(ids: pa.Array) -> np.ndarray:
    """Ids without nulls, in an array that sorts like SQL."""
    x = ids.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def bm25_best(documents: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """question, id, score, rank from 1: the k best of search.bm25(), which makes all scores, for each question. documents: id, text. questions: question, text.

    Texts are read twice, once for the terms' weights. Rows whose id is repeated, or null, are one document: their terms are counted by id, with a shuffle of those rows alone.
    """
    spark = documents.sparkSession
    prepare(spark)
    wanted = questions.select("question", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct().collect()
    known = sorted({r.term for r in wanted})
    again = cut(documents.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("__id")))
    repeated = not again.isEmpty()
    same = F.col("id").eqNullSafe(F.col("__id"))
    single = (documents.join(again, same, "left_anti") if repeated else documents).select("id", terms(F.col("text")).alias("words")).withColumn("dl", F.size("words"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, words, sized, these = np.zeros(len(known), np.int64), 0, 0, 0, pa.array(known, pa.string())
        for b in batches:
            df += np.bincount(counted(b.column("words"), these)[1], minlength=len(known))
            dl = b.column("dl")
            rows, words, sized = rows + len(dl), words + (pc.sum(dl).as_py() or 0), sized + len(dl) - dl.null_count
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None, *(known[t] for t in some)], pa.string()), *(pa.array([x, *y], pa.int64()) for x, y in ((rows, df[some]), (words, [0] * len(some)), (sized, [0] * len(some))))], names=["term", "n", "words", "sized"])

    read = single.select("words", "dl").mapInArrow(sums, "term string, n long, words long, sized long")
    tf = None
    if repeated:
        more = documents.join(again, same, "left_semi").select("id", terms(F.col("text")).alias("words")).withColumn("dl", F.size("words"))
        asked = spark.createDataFrame([(t,) for t in known], "term string")
        tf = cut(more.select("id", "dl", F.explode("words").alias("term")).join(F.broadcast(asked), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
        lengths = more.select(F.lit(None).cast("string").alias("term"), F.lit(1).alias("n"), F.coalesce("dl", F.lit(0)).alias("words"), F.when(F.col("dl").isNull(), 0).otherwise(1).alias("sized"))
        read = read.unionByName(lengths).unionByName(tf.select("term", F.lit(1).alias("n"), F.lit(0).alias("words"), F.lit(0).alias("sized")))
    found = {r.term: r for r in read.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "words", "sized")]).collect()}
    n, mean = (found[None].n, found[None].words / (found[None].sized or 1)) if None in found else (0, 0.0)
    weight = {t: float(idf(n, r.n, np.log)) for t, r in found.items() if t is not None}
    asked = [(r.question, r.term, weight[r.term]) for r in wanted if r.term in weight]
    schema, arrow = best_schema(documents.schema["id"])

    def one(numbers: np.ndarray, some: list[str], weights: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, these = Best(numbers, weights, k), pa.array(some, pa.string())
            for b in batches:
                doc, term, count = counted(b.column("words"), these)
                dl = pc.fill_null(b.column("dl"), 0).to_numpy(zero_copy_only=False)
                best.offer(doc, term, share(count, dl[doc], mean), values(b.column("id")))
            yield from best.batches(arrow)

        return single.select("id", "words", "dl").mapInArrow(run, schema)

    parts = [one(*m) for m in matrices(asked)]
    if repeated and asked:
        weights = spark.createDataFrame(asked, "question long, term string, weight double")
        parts.append(tf.join(F.broadcast(weights), "term").groupBy("question", "id").agg(F.round(F.sum(F.col("weight") * share(F.col("tf"), F.col("dl"), mean)), DIGITS).alias("score")))
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return first_by(out, ["question"], [F.desc("score"), "id"], k)
