"""The cluster's shared folder, for checkpoints and streaming state."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, in local mode (tests), a folder of our own.

    A cluster without it is refused: each machine would write to its own disk.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    conf = context.getConf().get("spark.checkpoint.dir", None)
    if conf is None and current.isDefined():
        return current.get()
    if conf is None and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
    folder = conf or f"file://{os.path.join(tempfile.gettempdir(), 'docweave-' + uuid.uuid4().hex)}"
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


#: Spark removes the shuffle files of a statement when it ends, if this is set: nothing reads those of a stored table again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows in reliable storage, without their lineage; the shuffle files that made them are removed."""
    shared_dir(df.sparkSession)
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: df itself may have shuffle files that others read


def stored(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """The rows written to path and read again; the shuffle files that made them are removed. codec: of the files. For loops: unlike a checkpoint, a table brings no constraints of the plans before it along, which grow with each round."""
    with _cleaned(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, wherever it is; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
