"""Published versions: one at a time for a reader, nothing of a writer that died, no shuffle of what is bucketed."""

import uuid

import pytest
from pyspark.sql import functions as F

from docweave.sources import versions


def tables(spark, n):
    node = spark.range(100).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(n).alias("v"))
    edge = spark.range(300).select(F.concat(F.lit("n"), F.col("id") % 100).alias("src"), F.concat(F.lit("n"), F.col("id") % 7).alias("dst"), F.lit(n).alias("v"))
    return {"node": (node, "id"), "edge": (edge, "src")}


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    with pytest.raises(FileNotFoundError):
        versions.current(spark, folder)
    assert versions.publish(tables(spark, 1), folder, 4) == 1
    one = versions.current(spark, folder)
    versions.write_version(tables(spark, 9), folder, 4)  # a writer that dies before it is shown
    assert {r.v for r in versions.current(spark, folder)["node"].collect()} == {1}
    assert versions.publish(tables(spark, 2), folder, 4) == 2
    assert {r.v for r in one["node"].collect()} == {r.v for r in one["edge"].collect()} == {1}
    two = versions.current(spark, folder)
    assert {r.v for r in two["node"].collect()} == {r.v for r in two["edge"].collect()} == {2}
    assert versions.prune(spark, folder) == 2 and {r.v for r in versions.current(spark, folder)["node"].collect()} == {2}


def test_another_session_and_no_shuffle(spark, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    versions.publish(tables(spark, 1), folder, 4)
    for t in versions.manifest(spark, folder)["tables"].values():
        spark.sql(f"DROP TABLE {t['table']}")  # the files stay, as for a session that has not written them
    held = versions.current(spark, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = held["edge"].join(held["node"].select(F.col("id").alias("src"), F.col("v").alias("w")), "src")
        assert joined.count() == 300
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
