"""Files in and out of the engine: pages, parsed documents, catalogues, logs, and the tables that stages own.

Paths are whatever Spark's readers open. Documents lie as {root}/{family}/{doc_id}/{lang}/..., and their place becomes
columns. Writers replace partitions as a whole, so a stage that runs again leaves what one run leaves.

Defined results: a folder without files is an empty table; malformed log lines are left out; a null in a partition column is
its own partition; two rows of one id are both written unless the writer says which counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.workers import prepare
from docweave.sources.corpus import first_by

PLACE = r"/([^/]+)/([^/]+)/([^/]+)/(?:raw/)?[^/]+$"
NODE_JSON = "id string, kind string, text string, title string, number string, parent_id string, hierarchy_depth int, path array<string>, children array<string>, lang string, binding_force string, source_type string"
RELATION_JSON = "source string, type string, target string, properties map<string,string>"
TERM_JSON = "id string, term string, term_normalized string, category string, definition_type string, celex string, regulation string, source_provision_id string"
INTERACTION = "type string, ts timestamp, interaction_id string, session_id string, question string, answer string, k int, history_len int, confidence_score double, confidence_level string, error string, rating string, comment string"
MOST_TIER = 99


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in fields.split(", "))) + ">"


PARSED_JSON = f"graph_version string, celex_id string, regulation_id string, source_name string, generated_at string, provisions array<{_struct(NODE_JSON)}>, relations array<{_struct(RELATION_JSON)}>, defined_terms array<{_struct(TERM_JSON)}>"


def placed(df: DataFrame, path: Column) -> DataFrame:
    """Adds family, doc_id and lang of a file's place."""
    return df.withColumn("family", F.regexp_extract(path, PLACE, 1)).withColumn("doc_id", F.regexp_extract(path, PLACE, 2)).withColumn("lang", F.regexp_extract(path, PLACE, 3))


def raw_pages(spark: SparkSession, root: str, lang: str = "*") -> DataFrame:
    """family, doc_id, lang, html of cached pages, a page a row; the preamble of an original act is another table (raw_preambles)."""
    return _pages(spark, root, lang).filter(~F.col("path").endswith("raw_preamble.html")).drop("path")


def raw_preambles(spark: SparkSession, root: str, lang: str = "*") -> DataFrame:
    return _pages(spark, root, lang).filter(F.col("path").endswith("raw_preamble.html")).drop("path")


def _pages(spark: SparkSession, root: str, lang: str) -> DataFrame:
    prepare(spark)
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.html", recursiveFileLookup=True).withColumn("path", F.input_file_name())
    rows = placed(files, F.col("path")).withColumnRenamed("value", "html")
    return (rows if lang == "*" else rows.filter(F.col("lang") == lang)).select("family", "doc_id", "lang", "html", "path")


def parsed_documents(spark: SparkSession, root: str, consolidated: bool = False, lang: str = "*") -> DataFrame:
    """Envelopes of parsed documents (family, doc_id, lang, celex_id, provisions, relations, defined_terms); consolidated: where there is such a version, it counts."""
    prepare(spark)
    files = spark.read.schema(PARSED_JSON).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "parsed*.json").json(root).withColumn("path", F.input_file_name())
    rows = placed(files, F.col("path")).withColumn("second", F.col("path").endswith("parsed.consolidated.json"))
    rows = rows if lang == "*" else rows.filter(F.col("lang") == lang)
    if not consolidated:
        return rows.filter("not second").drop("second", "path")
    return first_by(rows, ["family", "doc_id", "lang"], [F.desc("second")]).drop("rank", "second", "path")


def provisions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("celex_id").alias("celex"), F.posexplode("provisions").alias("seq", "p")).select("celex", F.col("seq").cast("long").alias("seq"), "p.*")


def relations_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("celex_id").alias("celex"), F.explode("relations").alias("r")).select("celex", "r.*")


def terms_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("defined_terms").alias("t")).select("t.*")


def catalogue(spark: SparkSession, path: str, tier: int = MOST_TIER) -> DataFrame:
    """A catalogue file (JSON lines) up to a tier; an entry without one is of the last."""
    rows = spark.read.json(path)
    return rows.filter(F.coalesce(F.col("tier").cast("int"), F.lit(MOST_TIER)) <= tier) if "tier" in rows.columns else rows


def json_cases(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Golden cases, answer keys or run artifacts: a JSON array, or lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    """Interactions and feedback of an append-only log; lines that are no JSON object of a known type are left out."""
    rows = spark.read.schema(INTERACTION + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken is null and type in ('interaction', 'feedback')").drop("_broken")


def with_feedback(rows: DataFrame) -> DataFrame:
    """Each interaction with the last feedback on it, or none."""
    last = first_by(rows.filter("type = 'feedback'"), ["interaction_id"], [F.desc("ts"), F.desc("rating")]).select("interaction_id", "rating", "comment")
    return rows.filter("type = 'interaction'").drop("rating", "comment").join(last, "interaction_id", "left")


# --- sinks -------------------------------------------------------------------------------------------------------


def write_parsed(documents: DataFrame, root: str) -> None:
    """Envelopes as JSON, by family, document and language; a document that is written again replaces its own."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family", "doc_id", "lang").json(root)


def write_owned(rows: DataFrame, root: str, producer: str) -> None:
    """The rows of a stage: its producer's partition is replaced, those of others stay, so a stage can run again."""
    rows.withColumn("producer", F.lit(producer)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("producer").parquet(root)


def write_vectors(vectors: DataFrame, root: str, parts: int = 64) -> None:
    """Embeddings by id, in a table of their own: the parts that hold given ids are replaced, ids they hold besides stay."""
    spark = vectors.sparkSession
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    new = vectors.select("id", "embedding", part).dropDuplicates(["id"])
    try:
        old = spark.read.parquet(root).join(new.select("id"), "id", "left_anti").join(new.select("part").distinct(), "part", "left_semi").select("id", "embedding", "part")
        from docweave.functions.storage import cut

        new = cut(new.unionByName(old))  # what is read is replaced below
    except Exception as e:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(root)


def append_log(rows: DataFrame, path: str) -> bool:
    """Appends log lines; a failure is reported and never raised, as a log must not stop its writer."""
    try:
        rows.write.mode("append").json(path)
        return True
    except Exception:  # the caller's work counts more than its log
        return False


def uniqueness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """name, key, n: keys of tables that stand more than once, which constraints would forbid."""
    parts = [df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("name"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n") for name, (df, keys) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def conversation_markdown(turns: DataFrame) -> DataFrame:
    """conv_id, markdown: turns (conv_id, turn, role, text) in order, a heading for each speaker; a conversation is one group."""
    said = F.struct("turn", F.concat(F.lit("### "), F.initcap(F.coalesce("role", F.lit("unknown"))), F.lit("\n\n"), F.coalesce(F.trim("text"), F.lit(""))).alias("said"))
    return turns.groupBy("conv_id").agg(F.concat(F.lit("# Conversation\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n\n"), F.lit("\n")).alias("markdown"))


def trace(cases: DataFrame, hits: DataFrame, checks: DataFrame) -> DataFrame:
    """One nested row a case: the question, what was found by channel, the checks."""
    found = hits.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("channel", "rank", "id", "score"))).alias("hits"))
    judged = checks.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("check", "passed", "detail"))).alias("checks"))
    return cases.join(found, "case_id", "left").join(judged, "case_id", "left")


def write_snapshot(rows: DataFrame, path: str) -> None:
    """case_id, route, celexes, retrieved_ids of a run, one JSON line a case."""
    rows.select("case_id", "route", "celexes", "retrieved_ids").write.mode("overwrite").json(path)


# --- upserts -----------------------------------------------------------------------------------------------------


def upsert_parts(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """HAS_PART edges (src, dst, ord): those whose ends exist, once each; an edge that is there keeps its place."""
    ids = nodes.select("id")
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    fresh = first_by(known, ["src", "dst"], ["ord"]).drop("rank").join(old.select("src", "dst"), ["src", "dst"], "left_anti")
    return old.select("src", "dst", "ord").unionByName(fresh.select("src", "dst", "ord"))


def routed_relations(relations: DataFrame, internal: tuple[str, ...], external: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations (source, type, target) inside the corpus, those to acts outside, and counts of types that nothing knows."""
    known = [*internal, *external]
    return relations.filter(F.col("type").isin(*internal)), relations.filter(F.col("type").isin(*external)), relations.filter(~F.col("type").isin(*known) | F.col("type").isNull()).groupBy("type").agg(F.count("*").alias("n"))


def upsert_terms(old: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defined terms (id, ..., source_id), the new ones counting, and DEFINED_BY edges (src, dst) to sources that exist."""
    terms = new.dropDuplicates(["id"])
    terms = terms.unionByName(old.join(terms.select("id"), "id", "left_anti"), allowMissingColumns=True)
    edges = terms.filter("source_id is not null").select(F.col("id").alias("src"), F.col("source_id").alias("dst"))
    return terms, edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def wiped(node: DataFrame, edge: DataFrame, celex: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the documents of these acts and all that touches them."""
    gone = node.filter(F.col("celex").isin(*celex)).select("id")
    left = edge.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return node.filter(~F.col("celex").isin(*celex) | F.col("celex").isNull()), left


def without_stale_acts(acts: DataFrame, fragments: DataFrame) -> DataFrame:
    """External acts (id) without those whose id holds one of the fragments (fragment), a curated, short list."""
    return acts.join(F.broadcast(fragments.select("fragment").distinct()), F.col("id").contains(F.col("fragment")), "left_anti")


# --- encoders ----------------------------------------------------------------------------------------------------


def passages(node: DataFrame) -> DataFrame:
    """id, text as an encoder of passages takes it: its prefix, the place of the provision, the text."""
    return node.filter("text is not null").select("id", F.concat(F.lit("passage: "), F.coalesce("display_path", F.lit("")), F.lit(": "), "text").alias("text"))


def query_text(question: Column) -> Column:
    return F.concat(F.lit("query: "), F.trim(question))


def embed(rows: DataFrame, dimension: int = 256, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """id, embedding of unit length of texts (id, text). encode makes rows of numbers of a batch of texts; by default words are hashed to signed places."""

    def hashed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for k, text in enumerate(texts):
            for word in re.findall(r"[^\W_]+", text.lower()):
                h = zlib.crc32(word.encode())
                out[k, h % dimension] += 1.0 if h >> 31 else -1.0
        return out

    def run(batches):
        for b in batches:
            made = np.asarray((encode or hashed)([t or "" for t in b.column("text").to_pylist()]), np.float32)
            size = np.linalg.norm(made, axis=1, keepdims=True)
            made = np.where(size > 0, made / np.maximum(size, 1e-12), 0).astype(np.float32)
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, pa.array(made.reshape(-1)))], names=["id", "embedding"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")
