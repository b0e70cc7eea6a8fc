"""Mixing sources to target weights by Poisson replication (operator 8).

A source's mean rate of repetition is its target weight times all rows, over its own rows. Each document's count
is the inverse Poisson distribution at a number in [0, 1) hashed from seed and doc_id, so runs agree whatever the
partitioning. Documents are exploded by their count and shuffled globally: dealt out and ordered by a hash of
seed, doc_id and copy.

A hot source never meets in one task: counts are summed before they are shuffled, and rates come to the rows by
broadcast while there are at most MOST_BROADCAST sources and their distributions take at most BROADCAST_BYTES, else by a
join on source and SALTS salts.

Defined results: a null source is a source; a null doc_id hashes as no id; rows that repeat a doc_id get the same
count; sources without a target weight, or of weight 0, are left out; other columns stay; without rows no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._frames import PREFIX, read

SEED = 20_240_601
#: Without given weights a source's weight is its number of rows to this power.
TEMPER = 0.5
MOST_BROADCAST, BROADCAST_BYTES = 10_000, 64 << 20
SALTS = 32


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ..., as far as doubles tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("found"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["total"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("total"), F.array_append(state["found"], total).alias("found"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["found"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temper: float = TEMPER, size: float = 1.0) -> DataFrame:
    """source and its mean repetition rate, for sources with a weight. size: expected rows out for each row in."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighed = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    total = weighed.agg(F.sum("weight").alias("all_weight"))
    rows = counts.agg(F.sum("n").alias("all_rows"))
    joined = weighed.filter("weight > 0").join(F.broadcast(total)).join(F.broadcast(rows))  # one row each
    return joined.select("source", (F.lit(size) * F.col("weight") / F.col("all_weight") * F.col("all_rows") / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temper: float = TEMPER, size: float = 1.0, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """docs (doc_id, source, ...) with each row as often as its count says, in an order that a hash decides. copy: a column for the copy's number."""
    source, cdf, salt, number = (PREFIX + x for x in ("source", "cdf", "salt", "copy"))
    known = rates(docs, weights, temper, size).select(F.col("source").alias(source), _distribution(F.col("rate")).alias(cdf))
    same = F.col("source").eqNullSafe(F.col(source))
    sources, numbers = known.agg(F.count("*"), F.coalesce(F.sum(F.size(cdf)), F.lit(0))).first()
    if sources <= MOST_BROADCAST and 8 * numbers <= BROADCAST_BYTES:
        placed = docs.join(F.broadcast(known), same)
    else:
        salted = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = docs.withColumn(salt + "_", F.pmod(F.xxhash64(_id_text(F.col("doc_id"))), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(salt + "_") == F.col(salt))).drop(salt, salt + "_")
    at = unit(F.lit(str(seed)), _id_text(F.col("doc_id")))
    count = F.size(F.filter(cdf, lambda c: c <= at))
    exploded = placed.withColumn(number, count).filter(F.col(number) > 0).drop(source, cdf).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(number))))
    order = PREFIX + "order"
    dealt = exploded.withColumn(order, F.xxhash64(F.lit(seed), _id_text(F.col("doc_id")), number)).repartition(F.col(order)).sortWithinPartitions(order)
    return dealt.select(*[c for c in docs.columns if c != copy], *([F.col(number).cast("int").alias(copy)] if copy else []))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), copy="copy")


OP8_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, power(CAST(n AS DOUBLE), {TEMPER}) AS weight FROM counts),
totals AS (SELECT sum(weight) AS all_weight, sum(n) AS all_rows FROM weighed),
rated AS (SELECT source, weight / all_weight * CAST(all_rows AS DOUBLE) / n AS rate FROM weighed, totals),
steps AS (SELECT CAST(range AS BIGINT) AS k FROM range(0, 400)),
chances AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(CAST(k + 1 AS DOUBLE))) AS p FROM rated, steps WHERE k <= rate + 12 * sqrt(rate) + 30),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM chances),
units AS (SELECT doc_id, source, text, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT u.doc_id, u.source, u.text, count(*) AS n_copies FROM units u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY u.doc_id, u.source, u.text)
SELECT doc_id, source, text, CAST(k AS INTEGER) AS copy FROM counted JOIN steps ON steps.k BETWEEN 1 AND n_copies
"""
