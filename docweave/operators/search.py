"""Similarity search, lexical ranking, fusion and quotas, for tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.storage import cut
from docweave.operators.lexical import B, K1, terms
from docweave.operators.vectors import cosines, ranks_of
from docweave.sources.corpus import first_by

RRF_K, LEXICAL_WEIGHT = 60, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(vectors: DataFrame, questions: list[tuple[int, list[float]]], extra: tuple = (), asked: dict[int, list[str]] | None = None) -> DataFrame:
    """question, id, extra, cosine (and overlap, as in vectors.cosines) of every vector (id, embedding) for each question: the whole ranking. vectors.nearest() gives its head alone."""
    return cosines(vectors, questions, extra, asked)


def bm25(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """question, id, score: of every document that has a term of the question; lexical.bm25_best() gives the head alone. documents: id, text. questions: question, text.

    Documents are shuffled once, by id, and only as terms of questions; those, with their weights, go to all tasks, so that a document's scores are
    summed where it is and no row of a question and a document is shuffled.
    """
    wanted = questions.select("question", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = documents.select("id", terms(F.col("text")).alias("words"))
    size = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    hits = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").repartition("id")
    tf = hits.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    joined = tf.join(F.broadcast(df), "term").join(F.broadcast(size))  # one row
    return joined.withColumn("part", part).join(F.broadcast(wanted), "term").groupBy("question", "id").agg(F.sum("part").alias("score"))


def reciprocal_rank_fusion(dense_ranked: DataFrame, lexical_ranked: DataFrame) -> DataFrame:
    """question, id, fused from two tables question, id, rank (from 0); missing in the second adds nothing."""
    joined = dense_ranked.withColumnRenamed("rank", "r1").join(lexical_ranked.withColumnRenamed("rank", "r2"), ["question", "id"], "left")
    return joined.select("question", "id", (1 / (RRF_K + F.col("r1")) + F.coalesce(LEXICAL_WEIGHT / (RRF_K + F.col("r2")), F.lit(0.0))).alias("fused"))


#: Cuts up to this are made before rows are shuffled; ranks beyond are counted over sorted ranges.
CUT = 1_000


def ranks(scored: DataFrame, score: str, most: int | None = None) -> DataFrame:
    """question, id, rank from 0, by score, then id.

    Without a cut, or with a large one, rows are sorted by ranges of (question, score, id) over all tasks, and a range's
    ranks begin after the rows that earlier ranges have of the question: no task holds a question's whole table.
    """
    if most is not None and most <= CUT:
        out = first_by(scored, ["question"], [F.desc(score), "id"], most)
        return out.select("question", "id", (F.col("rank") - 1).alias("rank"))
    order = ["question", F.desc("__score"), "id"]
    ranged = scored.select("question", "id", F.col(score).alias("__score")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)  # the ranges are drawn from a sample, so they are kept as drawn
    sizes = ranged.groupBy("question", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("question").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("question", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("question", "__part").orderBy(F.desc("__score"), "id"))
    out = ranged.withColumn("__in", inside).join(offsets, ["question", "__part"]).select("question", "id", (F.col("__before") + F.col("__in") - 1).cast("int").alias("rank"))
    return out if most is None else out.filter(F.col("rank") < most)


def fused_candidates(vectors: DataFrame, questions: list[tuple[int, list[float]]], near: DataFrame, words: DataFrame, group: str | None = None, scopes: dict | None = None) -> DataFrame:
    """question, id, cosine, fused of the rows near (question, id) and of those lexical hits (question, id, rank) that have a vector.

    Their dense ranks are those of the whole ranking, which is counted, not made: so the best of them by fused score are the best of all, as
    any other row has no lexical share and a worse dense rank than what near has of its group.
    """
    asked = vectors.sparkSession.createDataFrame([(int(q), [float(x) for x in v]) for q, v in questions], "question long, vector array<double>")
    hits = words.select("question", "id").unionByName(near.select("question", "id")).distinct().join(asked, "question").join(vectors, "id")
    if scopes and group:
        inside = vectors.sparkSession.createDataFrame([(q, g) for q, some in scopes.items() if some is not None for g in some], T.StructType([T.StructField("question", T.LongType()), T.StructField(group, vectors.schema[group].dataType)]))
        free = [q for q, _ in questions if scopes.get(q) is None]
        hits = hits.filter(F.col("question").isin(free)).unionByName(hits.join(inside, ["question", group], "left_semi").select(hits.columns))
    scored = hits.select("question", "id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("cosine")).filter("cosine is not null")
    ranked = ranks_of(vectors, questions, cut(scored), group, scopes)
    fused = reciprocal_rank_fusion(ranked.select("question", "id", "rank"), words)
    return fused.withColumn("fused", F.round("fused", 8)).join(ranked.select("question", "id", "cosine"), ["question", "id"])


def collapse(fused: DataFrame, anchors: DataFrame) -> DataFrame:
    """The best leaf of each anchor: question, anchor, id, fused. anchors: id, anchor."""
    return first_by(fused.join(anchors, "id"), ["question", "anchor"], [F.desc("fused"), "id"]).select("question", "anchor", "id", "fused")


def share_of(k: int, groups: int) -> int:
    """What a group may have of k."""
    return max(3, -(-k // max(1, groups)))


def quota(found: DataFrame, k: int, group: str, groups: int) -> DataFrame:
    """At most max(3, ceil(k / groups)) rows of each group, and k in all, by fused, then anchor."""
    per = share_of(k, groups)
    kept = first_by(found, ["question", group], [F.desc("fused"), "anchor"], per, "in_group").drop("in_group")
    return first_by(kept, ["question"], [F.desc("fused"), "anchor"], k)


def blend(scored: DataFrame, keys: list[str], strong: str, weak: str, share: float = 0.6) -> DataFrame:
    """Adds blended: both scores scaled to 0..1 within keys (1 where all are equal), share of the first."""
    bounds = scored.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in (strong, weak) for f, n in ((F.min, "least"), (F.max, "most"))])

    def scaled(c: str) -> Column:
        span = F.col(f"most_{c}") - F.col(f"least_{c}")
        return F.when(span < 1e-9, F.lit(1.0)).otherwise((F.col(c) - F.col(f"least_{c}")) / span)

    joined = scored.join(bounds, keys)
    return joined.withColumn("blended", share * scaled(strong) + (1 - share) * scaled(weak)).select(*scored.columns, "blended")


def overlap(question: Column, text: Column) -> Column:
    """Share of a question's different terms that a text has: the default scorer where no model is given."""
    asked = F.array_distinct(terms(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(text))) / F.size(asked)).otherwise(F.lit(0.0))
