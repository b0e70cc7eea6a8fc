"""An inverted index for lexical ranking, kept as tables, and searches that read its blocks only where they can matter.

build() writes, below a folder:

* size: documents, their mean length, and a null of the ids' type;
* postings: bucket (of the term), shard, term, block, n, top, ids, tfs, dls - the n documents of a block (BLOCK documents that a task has read one after
  another; SHARD of them are a shard) that have the term, how often, and their lengths, with the largest share of the score that the term, but for its
  weight, has in one of them. Files are split by bucket and sorted by term, so a read of some terms opens their buckets only and skips row groups.

A task indexes what it reads, so neither texts nor postings are shuffled.

search() works in three steps, for all questions at once. Block maxima alone (postings' lists are not read) bound the score of
any document of a block for a question. The blocks of the highest bounds are scored, enough of them to hold k documents, which gives a score that k
documents reach. Then those blocks are scored whose bound reaches it for a question; the rest is skipped. Postings of the questions' terms are shuffled by block, and
a task hands over its k best for each question. The result is exact.

A term that all documents have is a block row for each BLOCK documents: no row, and no group, grows with the corpus. The numbers of the blocks that are
scored, at most one for BLOCK documents, are sent to all tasks.

Defined results: a null text has no terms but counts as a document, as it does for search.bm25; ids are unique and not null; equal scores (to DIGITS) go by
the smaller id; a question without a known term has no row; documents without a term of the question are in no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.workers import prepare
from docweave.operators import lexical
from docweave.operators.lexical import DIGITS, share, terms
from docweave.sources.corpus import first_by

SHARD, BLOCK, BUCKETS = 16_384, 128, 64
#: What rounding may change of a score.
MARGIN = 10.0**-DIGITS
#: Blocks for so many times k documents are scored before the others are held against their k-th score.
FIRST = 4


def _schema(kind: T.DataType) -> T.StructType:
    lists = {"ids": kind, "tfs": T.IntegerType(), "dls": T.IntegerType()}
    fields = {"shard": T.LongType(), "block": T.IntegerType(), "term": T.StringType(), "n": T.IntegerType(), "top": T.DoubleType()} | {c: T.ArrayType(k) for c, k in lists.items()}
    return T.StructType([T.StructField(c, k) for c, k in fields.items()])


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    """Without documents there are no files, but a schema."""
    kind = spark.read.parquet(f"{folder}/size").schema["id"].dataType
    return spark.read.schema(_schema(kind).add("bucket", T.IntegerType())).parquet(f"{folder}/postings")


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _lists(ids: pa.Array, words: pa.ListArray, first: int, block: int, mean: float) -> tuple[np.ndarray, list[pa.Array]]:
    """Postings of documents, of which the first is the first of block number first: the rows' blocks; term, n, top, ids, tfs, dls."""
    dl = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    names = max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(len(dl)), dl)
    key = ((doc // block) * names + coded.indices.to_numpy(zero_copy_only=False)) * block + doc % block
    key, tf = np.unique(key, return_counts=True)
    row, local = np.divmod(key, block)
    at = row // names * block + local
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    ends = pa.array(np.append(starts, len(row)), pa.int32())
    tops = np.maximum.reduceat(share(tf, dl[at], mean), starts) if len(starts) else np.empty(0)
    listed = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(at)), pa.array(tf, pa.int32()), pa.array(dl[at], pa.int32()))]
    return first + row[starts] // names, [coded.dictionary.take(pa.array(row[starts] % names)), pa.array(np.diff(np.append(starts, len(row))), pa.int32()), pa.array(tops), *listed]


def build(documents: DataFrame, folder: str, shard: int = SHARD, block: int = BLOCK) -> None:
    """Writes the index of documents (id, text) into a folder that all machines share."""
    spark = documents.sparkSession
    prepare(spark)
    words = documents.select("id", terms(F.col("text")).alias("words"))
    kind = documents.schema["id"].dataType
    words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.lit(None).cast(kind).alias("id")).write.parquet(f"{folder}/size")
    mean = spark.read.parquet(f"{folder}/size").first().mean or 1.0
    each = max(1, shard // block)  # blocks of a shard
    schema = _schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are cut at whole blocks; what is left goes to the next."""
        from pyspark.sql.pandas.types import to_arrow_schema

        out, done, left = to_arrow_schema(schema), 0, None

        def some(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            one = rows.combine_chunks().to_batches()[0]
            blocks, columns = _lists(one.column("id"), one.column("words"), done, block, mean)
            task = one.column("task")[0].as_py()
            numbers = [pa.array((np.int64(task) << 32) + blocks // each), pa.array(blocks % each, pa.int32())]
            yield pa.RecordBatch.from_arrays([x.cast(out.field(k).type) for k, x in enumerate([*numbers, *columns])], names=out.names)

        for b in batches:
            rows = pa.Table.from_batches([b])
            left = rows if left is None else pa.concat_tables([left, rows])
            whole = len(left) // block * block
            if whole:
                yield from some(left.slice(0, whole))
                done, left = done + whole // block, left.slice(whole)
        if left is not None and len(left):
            yield from some(left)

    rows = words.select("id", "words", F.spark_partition_id().alias("task")).mapInArrow(run, schema)
    rows.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "shard", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")


def weights(spark: SparkSession, folder: str, questions: DataFrame) -> DataFrame:
    """question, term, bucket, idf of the terms of questions (question, text) that the index has; mean, the mean length of its documents."""
    size = spark.read.parquet(f"{folder}/size").first()
    wanted = questions.select("question", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct().withColumn("bucket", _bucket(F.col("term")))
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
    held = _postings(spark, folder).filter(F.col("bucket").isin(buckets)).select("bucket", "term", "n")
    df = held.join(F.broadcast(wanted.select("bucket", "term").distinct()), ["bucket", "term"]).groupBy("term").agg(F.sum("n").alias("df"))
    return wanted.join(df, "term").select("question", "term", "bucket", lexical.idf(F.lit(size.n), F.col("df")).alias("idf"), F.lit(size.mean or 1.0).alias("mean"))


def bounds(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """question, shard, block, bound: no document of the block scores more. Reads no lists."""
    tops = postings.select("bucket", "term", "shard", "block", "top").join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    tops = tops.repartition("shard", "block").join(F.broadcast(asked.select("question", "term", "idf")), "term")
    return tops.groupBy("question", "shard", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))


def scored(postings: DataFrame, asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """question, id, score of the documents in the blocks chosen (question, shard, block): some blocks for each question."""
    wanted = chosen.select("question", "shard", "block").join(asked, "question")
    rows = postings.join(wanted, ["bucket", "term", "shard", "block"]).select("question", "idf", "mean", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("x"))
    return rows.groupBy("question", F.col("x.ids").alias("id")).agg(F.sum(F.col("idf") * share(F.col("x.tfs"), F.col("x.dls"), F.col("mean"))).alias("score"))


def best(postings: DataFrame, asked: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """question, id, score, rank: the k best documents of each question in the blocks chosen (shard, block)."""
    spark = postings.sparkSession
    prepare(spark)
    schema, arrow = lexical.best_schema(T.StructField("id", postings.schema["ids"].dataType.elementType))
    rows = asked.collect()  # the terms of the questions
    if not rows:
        return first_by(spark.createDataFrame([], schema), ["question"], [F.desc("score"), "id"], k)
    mean = rows[0].mean
    held = postings.join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").join(F.broadcast(chosen), ["shard", "block"], "left_semi")
    held = held.select("shard", "block", "term", "ids", "tfs", "dls").repartition("shard", "block").sortWithinPartitions("shard", "block")

    def one(numbers: np.ndarray, known: list[str], matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A block's rows lie one after another; those of a batch's last block wait for the next batch."""
            found, these, left = lexical.Best(numbers, matrix, k), pa.array(known, pa.string()), None

            def some(rows: pa.Table) -> None:
                b = rows.combine_chunks().to_batches()[0]
                sizes = pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False)
                term = np.repeat(pc.fill_null(pc.index_in(b.column("term"), value_set=these), -1).to_numpy(zero_copy_only=False), sizes)
                coded = b.column("ids").flatten().dictionary_encode()
                doc = coded.indices.to_numpy(zero_copy_only=False)
                tf, dl = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tfs", "dls"))
                order = np.argsort(doc, kind="stable")
                order = order[term[order] >= 0]
                found.offer(doc[order], term[order], share(tf[order], dl[order], mean), lexical.values(coded.dictionary))

            for b in batches:
                rows = pa.Table.from_batches([b])
                left = rows if left is None else pa.concat_tables([left, rows])
                shard, block = (left.column(c).to_numpy() for c in ("shard", "block"))
                ends = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0))
                if len(ends):
                    some(left.slice(0, ends[-1] + 1))
                    left = left.slice(ends[-1] + 1)
            if left is not None and len(left):
                some(left)
            yield from found.batches(arrow)

        return held.mapInArrow(run, schema)

    parts = [one(*m) for m in lexical.matrices((r.question, r.term, r.idf) for r in rows)]
    return first_by(reduce(DataFrame.unionByName, parts), ["question"], [F.desc("score"), "id"], k)


def search(spark: SparkSession, folder: str, questions: DataFrame, k: int, cut, block: int = BLOCK) -> DataFrame:
    """question, id, score, rank: the k best documents of questions (question, text). cut keeps a table that is read several times."""
    asked = cut(weights(spark, folder, questions))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    postings = _postings(spark, folder).filter(F.col("bucket").isin(buckets))
    bounded = cut(bounds(postings, asked))
    few = first_by(bounded, ["question"], [F.desc("bound"), "shard", "block"], max(2, -(-FIRST * k // block))).drop("rank")
    early = first_by(scored(postings, asked, few), ["question"], [F.desc("score"), "id"], k).groupBy("question").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    reached = cut(early.select("question", F.when(F.col("n") == k, F.col("least")).alias("least")))
    needed = bounded.join(F.broadcast(reached), "question", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - MARGIN))
    return best(postings, asked, needed.select("shard", "block").distinct(), k)
