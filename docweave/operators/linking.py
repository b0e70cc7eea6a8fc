"""Entity linking and reference resolution as joins."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms, or first words of terms, that are sent to every task; beyond, they are joined.
MOST_BROADCAST = 200_000
# Terms too general to link.
STOP_TERMS = ("risk", "system", "user", "label", "recall", "subject", "kit", "performance")


def words_of(text: Column) -> Column:
    """Words of a-z and 0-9, in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def _dictionary(terms: DataFrame) -> DataFrame:
    """term (its words joined by spaces), n, first: the different terms that have a word."""
    words = terms.select(words_of(F.col("term")).alias("w")).filter(F.size("w") > 0)
    return words.select(F.array_join("w", " ").alias("term"), F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first")).distinct()


def dictionary_links(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term, n: occurrences of terms in texts as whole words, the longest at each place, leftmost first.

    One Arrow pass with the terms by their first word, while there are at most MOST_BROADCAST terms; beyond, token_links.
    A null or empty text has no link; documents that repeat an id are counted together; a term without a word links nothing.
    """
    known = [r.term for r in _dictionary(terms).select("term").limit(MOST_BROADCAST + 1).collect()]
    if len(known) > MOST_BROADCAST:
        return token_links(documents, terms)
    tails: dict[str, list[tuple[str, ...]]] = {}
    for words in sorted((tuple(t.split(" ")) for t in known), key=lambda w: (-len(w), w)):
        tails.setdefault(words[0], []).append(words)
    sent = documents.sparkSession.sparkContext.broadcast(tails)

    def run(batches):
        for b in batches:
            at, found, counts = [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                words, here, k = re.findall("[a-z0-9]+", (text or "").lower()), {}, 0
                while k < len(words):
                    hit = next((t for t in sent.value.get(words[k], ()) if tuple(words[k : k + len(t)]) == t), None)
                    if hit:
                        here[hit] = here.get(hit, 0) + 1
                    k += len(hit) if hit else 1
                at += [row] * len(here)
                found += [" ".join(t) for t in here]
                counts += list(here.values())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["id", "term", "n"])

    schema = T.StructType([documents.schema["id"], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    return documents.select("id", "text").mapInArrow(run, schema).groupBy("id", "term").agg(F.sum("n").alias("n"))


def token_links(documents: DataFrame, terms: DataFrame, shadowed: bool = False) -> DataFrame:
    """The same as joins, for dictionaries of any size and terms of any length. shadowed: matches inside others count too.

    Only places where a term's first word stands are looked at further, with the lengths that terms of that word have; of
    overlapping matches the leftmost, then the longest is kept, in the document's own array of matches.
    """
    known = _dictionary(terms)
    longest = known.agg(F.max("n")).first()[0] or 0
    firsts = known.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    if firsts.count() <= MOST_BROADCAST:
        firsts = F.broadcast(firsts)
    rows = documents.select("id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("doc", F.xxhash64("id", "w"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("at"), F.slice("w", i + 1, F.lit(max(1, longest))).alias("next"))))
    placed = rows.select("id", "doc", at.alias("g")).select("id", "doc", "g.at", "g.next", F.get("g.next", F.lit(0)).alias("first")).join(firsts, "first")
    grams = placed.select("id", "doc", "at", "next", F.explode("lengths").alias("n")).filter(F.col("n") <= F.size("next")).select("id", "doc", "at", "n", F.array_join(F.slice("next", F.lit(1), F.col("n")), " ").alias("term"))
    hits = grams.join(known.select("term"), "term")
    if shadowed:
        return hits.groupBy("id", "term").agg(F.count("*").alias("n"))
    best = hits.groupBy("id", "doc", "at").agg(F.max_by(F.struct("n", "term"), F.col("n")).alias("m"), F.count("*").alias("all"), F.count_distinct("n").alias("lengths"))
    best = best.withColumn("times", (F.col("all") / F.col("lengths")).cast("int"))  # equal documents of one id
    ordered = best.groupBy("id", "doc", "times").agg(F.array_sort(F.collect_list(F.struct("at", F.col("m.n").alias("n"), F.col("m.term").alias("term")))).alias("found"))
    start = F.struct(F.lit(-1).cast("int").alias("end"), F.array().cast("array<string>").alias("kept"))
    kept = F.aggregate("found", start, lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] + x["n"]).alias("end"), F.array_append(s["kept"], x["term"]).alias("kept"))).otherwise(s))
    return ordered.select("id", "times", F.explode(kept["kept"]).alias("term")).groupBy("id", "term").agg(F.sum(F.col("times").cast("long")).alias("n"))


def term_links(provisions: DataFrame, terms: DataFrame, stop: tuple[str, ...] = STOP_TERMS) -> DataFrame:
    """id, term_id: defined terms (term_id, term, source_id) that provisions (id, text) use; not where they are defined, and no stop terms.

    A text that several acts define gives a link to each of their terms.
    """
    used = terms.filter(~F.lower(F.trim("term")).isin(*stop)).withColumn("key", F.array_join(words_of(F.col("term")), " "))
    found = dictionary_links(provisions, used.select("term")).select("id", F.col("term").alias("key"))
    return found.join(used.select("key", "term_id", "source_id"), "key").filter(~F.col("id").eqNullSafe(F.col("source_id"))).select("id", "term_id").distinct()


def catalogue_status(references: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds target and status (self, resolvable, skip) of references (celex, number). catalogue: number, target."""
    joined = references.join(catalogue, "number", "left")
    return joined.withColumn("status", F.when(F.col("target").isNull(), "skip").when(F.col("target") == F.col("celex"), "self").otherwise("resolvable"))


def curated_targets(wanted: DataFrame, node: DataFrame) -> DataFrame:
    """ref, celex, id, status of curated references: the node whose id it is wins, else the shallowest of that display reference in any case of letters."""
    nodes = node.select("id", "celex", "depth", F.lower("display_ref").alias("key"))
    exact = wanted.join(nodes.select(F.col("id").alias("ref"), "celex", "id", "depth"), ["ref", "celex"]).withColumn("exact", F.lit(0))
    named = wanted.withColumn("key", F.lower("ref")).join(nodes, ["key", "celex"]).select("ref", "celex", "id", "depth").withColumn("exact", F.lit(1))
    found = exact.unionByName(named).groupBy("ref", "celex").agg(F.min(F.struct("exact", "depth", "id")).alias("best"), F.count_if(F.col("exact") == 1).alias("named"), F.count_if(F.col("exact") == 0).alias("exactly"))
    status = F.when(F.col("best").isNull(), "unresolved").when((F.col("exactly") > 0) | (F.col("named") == 1), "unique").otherwise("ambiguous")
    return wanted.join(found, ["ref", "celex"], "left").select("ref", "celex", F.col("best.id").alias("id"), status.alias("status"))


def lookup_refs(wanted: DataFrame, node: DataFrame, most: int = 8) -> DataFrame:
    """ref, rank, id: nodes of a normalised reference, shallowest first; a reference without any is tried without its last bracket."""
    nodes = node.select("id", "depth", "key")
    direct = wanted.join(nodes, "key")
    missing = wanted.join(nodes.select("key"), "key", "left_anti").withColumn("key", F.regexp_replace("key", r"\([^()]*\)$", ""))
    found = direct.unionByName(missing.join(nodes, "key").select(direct.columns))
    w = Window.partitionBy("ref").orderBy("depth", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("ref", "rank", "id")


def first_definitions(rows: DataFrame) -> DataFrame:
    """Of texts (celex, seq, id, text) that define a quoted term, the first of each act and term."""
    term = F.regexp_extract("text", "^['‘’‚‛]([^'‘’‚‛]+)['‘’‚‛]\\s+means(?:\\s|$)", 1)
    found = rows.withColumn("term", term).filter("term <> ''").withColumn("term_key", F.regexp_replace(F.lower(F.trim("term")), r"\s+", "_"))
    return found.groupBy("celex", "term_key").agg(F.min_by(F.struct("id", "term"), F.struct("seq", "id")).alias("x")).select("celex", "term_key", "x.id", "x.term")
