"""Fitting class-conditional models on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.llm._charkn import CharKN
from docweave.llm._frames import release
from docweave.llm._words import slices, text_buffers, words

SLICE_BYTES = 1 << 20
#: Bytes of text of each class that are learnt from, at most.
SAMPLE_BYTES = 32 << 20


def _place() -> Column:
    """A row's place in [0, 2**63), from a hash of its id and text; the same at each run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text")), 1)


def bounded_ids(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """rows (doc_id, label) whose ids' hashes are small: about twice per_class of each label, or all if there are fewer."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 1)
    return rows.filter(place <= _limits(rows, label, per_class))


def _limits(rows: DataFrame, label: str, per_class: int) -> Column:
    """For each label the place below which twice per_class rows are expected. Labels are few: their counts come to the driver."""
    counts = rows.groupBy(label).count().collect()
    limits = [x for r in sorted(counts, key=lambda r: r[0]) for x in (F.lit(r[0]), F.lit(min(2**63 - 1, (2**63 - 1) // r[1] * 2 * per_class)))]
    return F.create_map(*limits)[F.col(label)] if limits else F.lit(-1)


def bounded_sample(rows: DataFrame, label: str, per_class: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Of rows (doc_id, text, label) those of the smallest hashes of id and text: at most per_class and most_bytes of text of each label, but one at least.

    Equal rows count once. Two scans, whatever the number of labels; a hot row is reduced before it is shuffled.
    """
    some = rows.select("doc_id", "text", label).withColumn("place", _place()).filter(F.col("place") <= _limits(rows, label, per_class))
    once = some.groupBy("doc_id", label, "place").agg(F.min("text").alias("text"))
    order = Window.partitionBy(label).orderBy("place", "doc_id")
    numbered = once.withColumn("number", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.filter((F.col("number") <= per_class) & ((F.col("number") == 1) | (F.col("bytes") <= most_bytes))).select("doc_id", "text", label)


def fit(sample: DataFrame, classes: int, order: int, shared: int) -> bytes | None:
    """The model of the sample's words; label is the number of a class. The sample's rows and bytes bound the one task that fits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                w = words(batch.column("text").slice(a, b - a))
                label = np.repeat(batch.column("label").to_numpy()[a:b], w.counts)
                _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                counts = np.stack([np.bincount(back, weights=label == c, minlength=len(first)) for c in range(classes)], axis=1).astype(np.float64)
                texts = [w.data[s:e].tobytes() for s, e in zip(w.starts[first], w.ends[first])]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *[pa.array(counts[:, c]) for c in range(classes)]], names=["word", *[f"n{c}" for c in range(classes)]])

        w = label = first = back = counts = texts = None  # noqa: F841
        release()

    counted = sample.select("text", "label").mapInArrow(count, "word binary, " + ", ".join(f"n{c} double" for c in range(classes)))
    summed = counted.groupBy("word").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(classes)])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        data, offsets = text_buffers(table.column("word").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        counts = np.stack([table.column(f"n{c}").to_numpy() for c in range(classes)], axis=1)
        blob = CharKN.fit(data, offsets[:-1], offsets[1:], counts, order, shared).dump()
        del table, data, offsets, counts
        release()
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    made = summed.repartition(1).mapInArrow(learn, T.StructType([T.StructField("blob", T.BinaryType())])).collect()
    return bytes(made[0].blob) if made else None
