"""Vectors in blocks of bounded size, each met by a stream of queries, for the two searches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.llm._frames import release

def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id, embedding, dim of the rows that take part: an id, and a vector of finite components (and not all zero unless zero)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    out = out.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    if not zero:
        out = out.filter(F.exists("embedding", lambda x: x != 0))
    return out.withColumn("dim", F.size("embedding"))


def copies_at_most(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors by id; of equal rows k, as no query has room for more."""
    order = np.lexsort((*vectors.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    if len(ids) > 1:
        new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1))))
        place = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids))))
        ids, vectors = ids[place < k], vectors[place < k]
    return ids, vectors


def asked_of(rows: DataFrame) -> DataFrame:
    """The different queries among rows: vec_id, embedding, dim, key (of the vector) and times (how many rows ask it)."""
    return rows.groupBy("vec_id", "dim", "embedding").agg(F.count("*").cast("int").alias("times")).withColumn("key", F.xxhash64("embedding"))


def searched(
    data: DataFrame, queries: DataFrame, size: int, query_block: int, k: int, build: Callable[[np.ndarray, np.ndarray], object], search: Callable[[object, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], score: T.DataType
) -> DataFrame:
    """query_id, key, times, vec_id, score: the best of each block of all rows for each query.

    Rows are dealt into blocks of about size rows, by a hash of the id and of where the row was read, so that a
    repeated id doesn't meet in one block. Each block goes to one task once, before the queries, which are sent to every
    block: the task builds its index and then answers a stream of query_block queries at a time.
    search(index, query ids, query vectors) gives the place of the query, row id and score of each result.
    """
    blocks = max(1, -(-data.count() // size))
    placed = data.withColumn("block", F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(blocks)).cast("int"))
    one = placed.select("dim", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("times"), "vec_id", "embedding")
    two = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "key", "times", "vec_id", "embedding")
    rows = one.unionByName(two).repartition(2 * blocks, "dim", "block").sortWithinPartitions("dim", "block", "kind")
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("times", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score)])
    number = pa.int64() if isinstance(score, T.LongType) else pa.float64()

    def answer(index: object, asked: list) -> pa.RecordBatch:
        ids, vectors, keys, times = (np.concatenate(x) for x in zip(*asked))
        at, found, scores = search(index, ids, vectors)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(keys[at]), pa.array(times[at]), pa.array(found, pa.int64()), pa.array(scores, number)], names=out.names)

    def work(batches):
        now, held, index, asked = None, [], None, []
        for batch in batches:
            dim, block, kind, times = (batch.column(c).to_numpy() for c in ("dim", "block", "kind", "times"))
            ids, keys = batch.column("vec_id").to_numpy(), batch.column("key").to_numpy()
            flat, begins = batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dim)))
            turns = np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)]):
                if a == b:
                    continue
                if (dim[a], block[a]) != now:
                    if asked:
                        yield answer(index, asked)
                    now, held, index, asked = (dim[a], block[a]), [], None, []
                vectors = flat[begins[a] : begins[b]].reshape(b - a, dim[a])
                if kind[a] == 0:
                    held.append((ids[a:b], vectors))
                    if sum(len(x) for x, _ in held) > 4 * size:
                        held = [copies_at_most(*map(np.concatenate, zip(*held)), k)]
                    continue
                if not held and index is None:
                    continue  # a block without rows
                if index is None:
                    index, held = build(*copies_at_most(*map(np.concatenate, zip(*held)), k)), []
                for c in range(a, b, query_block):
                    d = min(b, c + query_block)
                    asked.append((ids[c:d], vectors[c - a : d - a], keys[c:d], times[c:d]))
                    if sum(len(x[0]) for x in asked) >= query_block:
                        yield answer(index, asked)
                        asked = []
        if asked:
            yield answer(index, asked)
        now = held = index = asked = None
        release()

    return rows.mapInArrow(work, out)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, equal scores by smaller id, as often as it is asked. A query has at most k rows of each block."""
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.asc("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("query_id", "rank", "vec_id", "score")
