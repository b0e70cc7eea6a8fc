"""Streams: windowed counts of a log, and its latest state by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.storage import cut, remove, shared_dir

DELAY, WIDTH = "10 minutes", "1 hour"


def read_log(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream of files, with ts as an instant of the session's time zone."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(log: DataFrame) -> DataFrame:
    """Events, and the sum of their values, by hour and type; late ones count within the delay, and an event that comes twice counts once."""
    late = log.withWatermark("ts", DELAY)
    return late.dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", WIDTH), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of what is there now, in files: each batch writes all windows as its version, the last counts."""
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    query = windowed(read_log(spark, sf_dir)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    found = cut(spark.read.parquet(f"{folder}/rows/{versions(spark, f'{folder}/rows')[-1]}"))
    remove(spark, folder)  # a run of its own: nothing goes on from here
    return found


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches that folder has a finished version of, in order; it may not be there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [(s.getPath().getName(), s.getPath()) for s in files.listStatus(path)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(name) for name, at in found if name.isdigit() and files.exists(done(at, "_SUCCESS")))


def keep_latest(log: DataFrame, folder: str, key: str) -> DataFrame:
    """Each key's last event of a stream (key, ts, event_id, event_type, value), kept in folder: a batch is merged with the last version before it.

    Versions are found by their numbers, so a run that starts again after a failure goes on from the state that its log of
    batches says it has, and a batch that is done twice gives the same version.
    """
    spark = log.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = [n for n in versions(batch.sparkSession, f"{folder}/state") if n < number]
        rows = batch if not before else batch.unionByName(batch.sparkSession.read.parquet(f"{folder}/state/{before[-1]}"))
        last = rows.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x")).select(key, "x.*")
        last.write.mode("overwrite").parquet(f"{folder}/state/{number}")

    log.select(key, "ts", "event_id", "event_type", "value").writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/state/{versions(spark, f'{folder}/state')[-1]}")


def latest_state(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """Each key's last event of what is there now."""
    folder = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    found = cut(keep_latest(read_log(spark, sf_dir), folder, key))
    remove(spark, folder)
    return found
