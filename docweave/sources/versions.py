"""Published versions of tables: written whole, then shown at once, and bucketed by their keys, so that joins on those do not shuffle them.

A version is a folder with all tables of a stage. The manifest names the current one; it is replaced by one rename when all
tables are there. A reader that has taken a version goes on reading it while the next is written; a writer that dies before the rename leaves
nothing that a reader sees. Sessions that have not written a version register its tables from the manifest.

Defined results: before the first publication there is no version; rows and columns are kept as they are, empty tables too; a null key is a row like any
other; of two writers at once the later rename counts, so a stage has one writer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docweave.functions.storage import remove

BUCKETS = 16


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """version, and for each table its name, path, key, buckets and schema; None before the first publication."""
    path, files = _files(spark, f"{folder}/manifest.json")
    if not files.exists(path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json", wholetext=True).collect()))


def _swap(spark: SparkSession, folder: str, held: dict) -> None:
    new, files = _files(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    to = hadoop.Path(f"{folder}/manifest.json")
    hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(new, to, overwrite)


def write_version(tables: dict[str, tuple[DataFrame, str]], folder: str, buckets: int = BUCKETS) -> dict:
    """Writes tables (by name, with the key of each) as a version that nothing shows yet; gives its manifest."""
    spark = next(iter(tables.values()))[0].sparkSession
    number = ((manifest(spark, folder) or {}).get("version") or 0) + 1
    mark, held = uuid.uuid4().hex, {"version": number, "tables": {}}
    for name, (df, key) in tables.items():
        path, table = f"{folder}/{number}-{mark}/{name}", f"{name}_{mark}"
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
        held["tables"][name] = {"table": table, "path": path, "key": key, "buckets": buckets, "schema": df.schema.json()}
    return held


def publish(tables: dict[str, tuple[DataFrame, str]], folder: str, buckets: int = BUCKETS) -> int:
    """Writes a version and shows it. Gives its number."""
    spark = next(iter(tables.values()))[0].sparkSession
    held = write_version(tables, folder, buckets)
    _swap(spark, folder, held)
    return held["version"]


def current(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the version that is shown."""
    held = manifest(spark, folder)
    if held is None:
        raise FileNotFoundError(f"no version is published in {folder}")
    out = {}
    for name, t in held["tables"].items():
        if not spark.catalog.tableExists(t["table"]):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(t["schema"])))
            spark.sql(f"CREATE TABLE {t['table']} ({columns}) USING parquet OPTIONS (path '{t['path']}') CLUSTERED BY (`{t['key']}`) SORTED BY (`{t['key']}`) INTO {t['buckets']} BUCKETS")
        out[name] = spark.table(t["table"])
    return out


def prune(spark: SparkSession, folder: str) -> int:
    """Removes versions that the manifest does not show, once no reader has them any more. Gives how many went."""
    held = manifest(spark, folder)
    keep = {t["path"].rsplit("/", 2)[1] for t in held["tables"].values()} if held else set()
    path, files = _files(spark, folder)
    old = [s.getPath() for s in files.listStatus(path) if s.isDirectory() and s.getPath().getName() not in keep] if files.exists(path) else []
    for p in old:
        for t in files.listStatus(p):
            spark.sql(f"DROP TABLE IF EXISTS {t.getPath().getName()}_{p.getName().split('-', 1)[1]}")
        remove(spark, p.toString())
    return len(old)
