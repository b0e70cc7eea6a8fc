"""Helpers shared by the operators: internal column names, shared storage and Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.storage import shared_dir
from docweave.functions.workers import prepare

PREFIX = "__dw_"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a reliable checkpoint in the shared folder, so a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id, modulus: int, remainder: int = 2):
    """crc32 of the id as text, by remainder. A null id counts as text of no characters."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


#: Batches are worked on, and handed back, in row ranges of about so many bytes.
PART_BYTES = 8 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def release() -> None:
    """Gives a Python worker's free memory back: workers live on for the next tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def append_columns(df: DataFrame, added: T.StructType, work: Callable[..., list[pa.Array]], keep: list[str] | None = None, state: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow that keeps the columns in keep (all by default) and adds those that work makes of a batch. A column of an added name is replaced.

    state makes what work gets besides the batch; it lives as long as one partition.
    """
    prepare(df.sparkSession)
    names = {f.name for f in added.fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [state()] if state else []
        try:
            for batch in batches:
                for part in parts(batch):
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + work(part, *have), names=[f.name for f in schema.fields])
        finally:
            have.clear()
            release()

    return df.mapInArrow(run, schema)
