"""Exact dense search by scans: vectors as matrix blocks, and of each task no more rows than its best.

A scan multiplies Arrow batches of vectors with the matrix of the questions. nearest() keeps, in each task, the k best for each
question (or for each question and group), so a task hands over k rows for them however many vectors it reads. ranks_of()
counts, for rows whose place in a question's whole ranking is asked, how many vectors are better, without making that ranking. ranking() makes it: a first scan counts
how many cosines lie in each of BINS ranges, so the second knows how many rows come before a row's range, and rows are shuffled once.

Questions come from the caller as (number, vector); those whose vectors take more than QUESTION_BYTES together are asked in several
scans, so what a task gets is bounded.

Defined results: cosines are rounded to DIGITS, and equal ones go by the smaller id; a vector that is null, of another length than
the question's, all zero or not finite is in no result; of rows that repeat an id each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.workers import prepare
from docweave.sources.corpus import first_by

DIGITS = 6
QUESTION_BYTES = 16 << 20
#: Ranges of cosines that a question's whole ranking is made in.
BINS = 2_000

Questions = list[tuple[int, list[float]]]
#: The groups that a question's rows may have; None for all.
Scopes = dict[int, tuple | None]


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """To digits, halves away from zero, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits


def blocks(questions: Questions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and unit vectors of questions of one length, at most QUESTION_BYTES of them."""
    for dim in sorted({len(v) for _, v in questions}):
        some = [(q, v) for q, v in questions if len(v) == dim]
        most = max(1, QUESTION_BYTES // (8 * max(1, dim)))
        for a in range(0, len(some), most):
            matrix = np.array([v for _, v in some[a : a + most]], np.float64).reshape(-1, dim)
            norms = np.sqrt((matrix**2).sum(axis=1))
            whole = np.isfinite(norms) & (norms > 0)
            if whole.any():
                yield np.array([q for q, _ in some[a : a + most]], np.int64)[whole], matrix[whole] / norms[whole, None]


def _scores(batch: pa.RecordBatch, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count, and their cosines: a row for each question."""
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, matrix.shape[1])
    norms = np.sqrt((x**2).sum(axis=1))
    at = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    return at, matrix @ (x[at] / norms[at, None]).T


def _of_length(vectors: DataFrame, dim: int, *columns: str) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).select("embedding", *columns)


def _values(batch: pa.RecordBatch, name: str, at: np.ndarray) -> np.ndarray:
    """A column's values in an array that sorts like SQL: numbers, or texts."""
    x = batch.column(name).take(pa.array(at)).to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def _empty(vectors: DataFrame, columns: list[str]) -> DataFrame:
    return vectors.select(F.lit(0).cast("long").alias("question"), *columns, F.lit(0.0).alias("cosine")).limit(0)


def cosines(vectors: DataFrame, questions: Questions, extra: tuple = (), asked: dict[int, list[str]] | None = None) -> DataFrame:
    """question, id, extra columns, cosine (not rounded) of all vectors (id, embedding) for each question.

    asked: the different terms of each question; adds overlap, the share of them that a row has in its column terms (different ones), so that no
    text is read again for each question; questions without terms have no rows.
    """
    prepare(vectors.sparkSession)
    fields = [T.StructField("question", T.LongType()), vectors.schema["id"], *[vectors.schema[c] for c in extra], T.StructField("cosine", T.DoubleType())]
    schema = T.StructType(fields + ([] if asked is None else [T.StructField("overlap", T.DoubleType())]))

    def one(numbers: np.ndarray, matrix: np.ndarray) -> DataFrame:
        if asked is not None:
            some = np.array([bool(asked.get(n)) for n in numbers.tolist()], bool)
            numbers, matrix = numbers[some], matrix[some]
            known = sorted({t for n in numbers.tolist() for t in asked[n]})
            place = {t: k for k, t in enumerate(known)}
            has = np.zeros((len(known), len(numbers)), np.uint8)
            for q, n in enumerate(numbers.tolist()):
                has[[place[t] for t in asked[n]], q] = 1
            sizes = has.sum(axis=0, dtype=np.int64)

        def shares(column: pa.Array, at: np.ndarray) -> np.ndarray:
            """Of each row at these places the share of each question's terms that it has: a row for each question."""
            lists = column.take(pa.array(at))
            found = pc.index_in(lists.flatten(), value_set=pa.array(known, pa.string()))
            found = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            counts = np.zeros((len(at), len(numbers)), np.int64)
            for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                row = found[a:b]
                counts[k] = has[row[row >= 0]].sum(axis=0, dtype=np.int64)
            return (counts / sizes).T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, scores = _scores(batch, matrix)
                kept = [batch.column(c).take(pa.array(at)) for c in ("id", *extra)]
                more = None if asked is None else shares(batch.column("terms"), at)
                for q, number in enumerate(numbers):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), *kept, pa.array(scores[q]), *([] if more is None else [pa.array(more[q])])], names=schema.names)

        return _of_length(vectors, matrix.shape[1], "id", *extra, *(["terms"] if asked is not None else [])).mapInArrow(run, schema)

    parts = [one(*b) for b in blocks(questions)]
    if parts:
        return reduce(DataFrame.unionByName, parts)
    none = _empty(vectors, ["id", *extra])
    return none if asked is None else none.withColumn("overlap", F.lit(0.0))


class _Best:
    """Of a slot the k best anchors, each with its best row: (-cosine, id, anchor, group)."""

    def __init__(self, k: int):
        self.k, self.rows, self.worst = k, [], -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray, anchors: np.ndarray, groups: np.ndarray) -> None:
        near = np.flatnonzero(scores >= self.worst)
        if not len(near):
            return
        order = near[np.lexsort((ids[near], -scores[near]))]
        new, seen = [], set()
        for i in order:  # ends with the k-th anchor
            if len(new) == self.k:
                break
            if anchors[i] not in seen:
                seen.add(anchors[i])
                new.append((-scores[i], ids[i], anchors[i], groups[i]))
        rows, seen = [], set()
        for row in sorted(self.rows + new, key=lambda r: r[:2]):
            if row[2] not in seen and len(rows) < self.k:
                seen.add(row[2])
                rows.append(row)
        self.rows = rows
        if len(rows) == self.k:
            self.worst = -rows[-1][0]


def nearest(vectors: DataFrame, questions: Questions, k: int, group: str | None = None, anchor: str | None = None, by_group: bool = True, scopes: Scopes | None = None) -> DataFrame:
    """question, id, cosine, rank (and group, anchor): the k nearest of each question, or of each question and group.

    anchor: of the rows of one anchor the best counts alone. scopes: the groups that a question may have; with by_group false
    only questions of two groups or more are ranked group by group.
    """
    prepare(vectors.sparkSession)
    extra = list(dict.fromkeys(c for c in (group, anchor) if c))
    names = ["question", "id", *extra, "cosine"]
    names = names + (["__slot"] if group else [])  # the group that a row is ranked in, if its question is ranked group by group
    kinds_of = {"question": T.LongType(), "cosine": T.DoubleType()} | ({"__slot": vectors.schema[group].dataType} if group else {})
    schema = T.StructType([T.StructField(c, kinds_of[c] if c in kinds_of else vectors.schema[c].dataType) for c in names])
    within = scopes or {}
    apart = lambda q: group is not None and (by_group or len(within.get(q) or ()) > 1)

    def one(numbers: np.ndarray, matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple, _Best] = {}
            for batch in batches:
                at, scores = _scores(batch, matrix)
                scores, ids = rounded(scores), _values(batch, "id", at)
                anchors = _values(batch, anchor, at) if anchor else ids
                groups = np.array(batch.column(group).take(pa.array(at)).to_pylist(), object) if group else None
                kinds = {g: np.flatnonzero(groups == g) for g in set(groups.tolist())} if group else {}
                for q, number in enumerate(numbers.tolist()):
                    scope = within.get(number)
                    if apart(number):
                        slots = [((number, g), rows) for g, rows in kinds.items() if scope is None or g in scope]
                    else:
                        slots = [((number, None), np.arange(len(at)) if scope is None else np.concatenate([kinds[g] for g in scope if g in kinds] or [np.empty(0, np.int64)]))]
                    for slot, rows in slots:
                        best.setdefault(slot, _Best(k)).offer(scores[q, rows], ids[rows], anchors[rows], groups[rows] if group else anchors[rows])
            rows = [(number, i, a, g, -s, slot) for (number, slot), x in best.items() for s, i, a, g in x.rows]
            if rows:
                number, i, a, g, s, slot = zip(*rows)
                have = {"question": number, "id": i, "cosine": s, "__slot": slot} | ({group: g} if group else {}) | ({anchor: a} if anchor else {})
                plain = lambda some: [x.item() if isinstance(x, np.generic) else x for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(plain(have[c])) for c in names], names=names).cast(out)

        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        return _of_length(vectors, matrix.shape[1], "id", *extra).mapInArrow(run, schema)

    parts = [one(*b) for b in blocks(questions)]
    if not parts:
        return _empty(vectors, ["id", *extra]).withColumn("rank", F.lit(0))
    found = reduce(DataFrame.unionByName, parts).select(names)
    keys = ["question", "__slot"] if group else ["question"]
    if anchor:
        found = first_by(found, [*keys, anchor], [F.desc("cosine"), "id"]).drop("rank")
    return first_by(found, keys, [F.desc("cosine"), "id"], k).drop("__slot")


def ranks_of(vectors: DataFrame, questions: Questions, wanted: DataFrame, group: str | None = None, scopes: Scopes | None = None) -> DataFrame:
    """wanted (question, id, cosine, rounded) with rank, from 0: how many vectors are nearer to the question, or as near with a smaller id.

    wanted is sent to the tasks: some rows for each question, as nearest() and a lexical search give.
    """
    prepare(vectors.sparkSession)
    within = scopes or {}
    asked: dict[int, list] = {}
    for r in wanted.select("question", "id", "cosine").toLocalIterator():
        asked.setdefault(r.question, []).append((r.id, r.cosine))
    schema = T.StructType([T.StructField("question", T.LongType()), wanted.schema["id"], T.StructField("better", T.LongType())])

    def one(numbers: np.ndarray, matrix: np.ndarray) -> DataFrame:
        of = {n: (np.array([i for i, _ in asked[n]]), np.array([c for _, c in asked[n]])) for n in numbers.tolist() if n in asked}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            better = {n: np.zeros(len(x[0]), np.int64) for n, x in of.items()}
            for batch in batches:
                at, scores = _scores(batch, matrix)
                scores, ids = rounded(scores), _values(batch, "id", at)
                groups = np.array(batch.column(group).take(pa.array(at)).to_pylist(), object) if group else None
                for q, number in enumerate(numbers.tolist()):
                    if number not in of:
                        continue
                    own, own_ids = scores[q], ids
                    if within.get(number) is not None:
                        inside = np.isin(groups, list(within[number]))
                        own, own_ids = own[inside], ids[inside]
                    order = np.lexsort((own_ids, -own))
                    down, names = -own[order], own_ids[order]
                    first, last = (np.searchsorted(down, -of[number][1], side) for side in ("left", "right"))
                    better[number] += first
                    for k in np.flatnonzero(last > first):
                        better[number][k] += np.searchsorted(names[first[k] : last[k]], of[number][0][k])
            for number, counts in better.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), number)), pa.array([i for i, _ in asked[number]], to_arrow), pa.array(counts)], names=schema.names)

        from pyspark.sql.pandas.types import to_arrow_type

        to_arrow = to_arrow_type(wanted.schema["id"].dataType)
        return _of_length(vectors, matrix.shape[1], "id", *([group] if group else [])).mapInArrow(run, schema)

    parts = [one(*b) for b in blocks(questions) if asked]
    if not parts:
        return wanted.withColumn("rank", F.lit(0)).limit(0)
    counted = reduce(DataFrame.unionByName, parts).groupBy("question", "id").agg(F.sum("better").alias("better"))
    return wanted.join(counted, ["question", "id"]).select(*wanted.columns, F.col("better").cast("int").alias("rank"))


def ranking(vectors: DataFrame, questions: Questions) -> DataFrame:
    """question, id, rank, from 0, of all vectors for each question, by cosine, then id.

    What is held of a question on the driver and in a task is BINS counts; rows of one range of a question, and so equal cosines, are ranked in one window.
    """
    prepare(vectors.sparkSession)
    schema = T.StructType([T.StructField("question", T.LongType()), vectors.schema["id"], T.StructField("cosine", T.DoubleType()), T.StructField("before", T.LongType())])

    def bins(scores: np.ndarray) -> np.ndarray:
        """The ranges of rounded cosines, the nearest first."""
        return np.clip(np.floor((1 - scores) * (BINS / 2)), 0, BINS - 1).astype(np.int64)

    def one(numbers: np.ndarray, matrix: np.ndarray) -> DataFrame:
        some = _of_length(vectors, matrix.shape[1], "id")

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(numbers) * BINS, np.int64)
            for batch in batches:
                at = bins(rounded(_scores(batch, matrix)[1])) + np.arange(len(numbers))[:, None] * BINS
                counts += np.bincount(at.ravel(), minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

        counts = np.zeros((len(numbers), BINS), np.int64)
        for r in some.select("embedding").mapInArrow(sizes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[divmod(r.at, BINS)] = r.n
        before = np.cumsum(counts, axis=1) - counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, scores = _scores(batch, matrix)
                scores, ids = rounded(scores), batch.column("id").take(pa.array(at))
                for q, number in enumerate(numbers):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), ids, pa.array(scores[q]), pa.array(before[q][bins(scores[q])])], names=schema.names)

        return some.mapInArrow(run, schema)

    parts = [one(*b) for b in blocks(questions)]
    if not parts:
        return _empty(vectors, ["id"]).select("question", "id", F.lit(0).alias("rank"))
    place = F.row_number().over(Window.partitionBy("question", "before").orderBy(F.desc("cosine"), "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).select("question", "id", (F.col("before") + F.col("place") - 1).cast("int").alias("rank"))
