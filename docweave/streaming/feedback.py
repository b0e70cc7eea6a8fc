"""A log of interactions and feedback as a stream: lines parsed, malformed ones set aside, both sides joined under watermarks, each batch written once.

Lines are JSON with type (interaction or feedback), id, of (the interaction that feedback is on), ts and rating. Feedback counts that comes
WITHIN its interaction; a line that comes later than DELAY after newer ones may be left out, as the state of both sides is
dropped behind the watermark, so it does not grow with the log.

Defined results: a line that is no such JSON, or lacks type, id or ts, is malformed; a line that comes twice counts once; feedback on an
interaction that is not there, before it, or after WITHIN, joins nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.streaming.events import versions

DELAY, WITHIN = "30 minutes", "2 hours"
LINE = "type string, id long, of long, ts string, rating double, broken string"


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of a table or stream of lines (line), and the malformed lines."""
    x = F.from_json("line", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.withColumn("x", x).withColumn("ts", F.try_to_timestamp(F.col("x.ts")))
    good = F.col("x.broken").isNull() & F.col("x.type").isin("interaction", "feedback") & F.col("x.id").isNotNull() & F.col("ts").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return rows.filter(good).select("x.type", "x.id", "x.of", "ts", "x.rating"), rows.filter(~good).select("line")


def joined(log: DataFrame, delay: str = DELAY, within: str = WITHIN) -> DataFrame:
    """id, asked, feedback_id, said, rating: each feedback with its interaction. log: a stream of records."""
    once = lambda kind: log.filter(F.col("type") == kind).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    asked = once("interaction").select("id", F.col("ts").alias("asked"))
    said = once("feedback").select(F.col("id").alias("feedback_id"), F.col("of"), F.col("ts").alias("said"), "rating")
    return asked.join(said, F.expr(f"of = id AND said >= asked AND said <= asked + INTERVAL {within}")).drop("of")


def run(lines: DataFrame, folder: str) -> None:
    """Takes in what is there now. A batch's rows replace what an earlier try wrote under its number; a run that starts again goes on behind the last batch."""
    records, malformed = parsed(lines)

    def into(name: str):
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/{name}/{number}")

        return keep

    queries = [
        rows.writeStream.outputMode("append").foreachBatch(into(name)).option("checkpointLocation", f"{folder}/log-{name}").trigger(availableNow=True).start()
        for name, rows in (("joined", joined(records)), ("malformed", malformed))
    ]
    for q in queries:
        q.awaitTermination()


def kept(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """All finished batches of a sink; None before the first."""
    found = versions(spark, f"{folder}/{name}")
    return spark.read.parquet(*[f"{folder}/{name}/{n}" for n in found]) if found else None


def latest(rows: DataFrame) -> DataFrame:
    """id, rating, n: the last feedback on each interaction, and how many there are."""
    return rows.groupBy("id").agg(F.max_by("rating", F.struct("said", "feedback_id")).alias("rating"), F.count("*").alias("n"))
