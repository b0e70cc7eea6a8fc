"""Lets the Python workers import the package from where the driver has it, if they see that folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of one batch that goes to a Python worker, where the session has the default of 64 MB: a batch is held
#: several times over, in the JVM and in Python, for each core.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def prepare(spark: SparkSession) -> None:
    if spark.conf.get(BATCH[0], "67108864b") == "67108864b":
        spark.conf.set(*BATCH)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
