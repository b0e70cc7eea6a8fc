"""Search, fusion, ranking and confidence queries, with their SQL. Question q, a multiple of 50, is vector q and the whole text of item q / 50."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.functions.storage import cut, remove, shared_dir
from docweave.operators import inverted, lexical, search
from docweave.operators.vectors import nearest, ranking
from docweave.sources.corpus import first_by, table

#: Questions are the vectors whose id is a multiple of this, of which there is an item.
EACH = 50
K = 20


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _texts(spark, sf_dir):
    """The whole texts of the questions."""
    item = table(spark, sf_dir, "benchmark").select((F.col("item_id") * EACH).alias("question"), "text")
    return item.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question")), "question", "left_semi")


def _asked(spark, sf_dir, vectors):
    """The questions' vectors: at most as many as there are items."""
    item = table(spark, sf_dir, "benchmark").select((F.col("item_id") * EACH).alias("id"))
    return sorted((r.id, list(r.embedding)) for r in vectors.join(item, "id", "left_semi").select("id", "embedding").collect())


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def dense_top_k(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return nearest(vectors, _asked(spark, sf_dir, vectors), K)


def bm25_top_k(spark, sf_dir):
    return lexical.bm25_best(_documents(spark, sf_dir), _texts(spark, sf_dir), 8 * K)


def _words(spark, sf_dir):
    """bm25_top_k, with ranks from 0."""
    return bm25_top_k(spark, sf_dir).select("question", "id", (F.col("rank") - 1).alias("rank"))


def bm25_indexed(spark, sf_dir):
    """bm25_top_k through an index that is built, read and removed."""
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    inverted.build(_documents(spark, sf_dir), folder)
    found = cut(inverted.search(spark, folder, _texts(spark, sf_dir), 8 * K, cut))
    remove(spark, folder)
    return found


def rank_fusion(spark, sf_dir):
    """All vectors for each question: the dense ranking is whole, the lexical one has 8 * K rows for a question, which are sent to all tasks."""
    vectors = _vectors(spark, sf_dir)
    fused = search.reciprocal_rank_fusion(ranking(vectors, _asked(spark, sf_dir, vectors)), F.broadcast(_words(spark, sf_dir)))
    return fused.select("question", "id", F.round("fused", 8).alias("fused"))


def hybrid_retrieve(spark, sf_dir):
    """Dense and lexical ranks, fused; leaves collapsed to anchors; a quota for each label; k anchors for each question."""
    vectors = _vectors(spark, sf_dir).withColumn("anchor", F.col("id") % 50)
    asked = _asked(spark, sf_dir, vectors)
    words = cut(_words(spark, sf_dir))
    near = nearest(vectors, asked, 1, "anchor")  # an anchor here has leaves of all labels, so its best leaf decides its label
    fused = search.fused_candidates(vectors, asked, near, words)
    found = search.collapse(fused, vectors.select("id", "anchor")).join(vectors.select("id", "label"), "id")
    return search.quota(found, K, "label", 10).select("question", "rank", "anchor", "id", "label", "fused")


def rerank_by_label(spark, sf_dir):
    """Blend of a scorer and the cosine, scaled within question and label. Documents are read as terms once, for all questions."""
    vectors = _vectors(spark, sf_dir)
    asked = _texts(spark, sf_dir).select("question", F.explode(search.terms(F.col("text"))).alias("term")).groupBy("question").agg(F.collect_set("term").alias("terms"))
    asked = {r.question: r.terms for r in asked.collect()}  # as many as there are items, like their vectors
    documents = _documents(spark, sf_dir).join(vectors.select("id"), "id", "left_semi")
    documents = documents.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.array_distinct(F.flatten(F.collect_list(F.array_distinct(search.terms(F.col("text")))))).alias("terms"))
    documents = documents.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    scored = search.dense(vectors.join(documents, "id"), _asked(spark, sf_dir, vectors), ("label",), asked).withColumnRenamed("overlap", "strong")
    return search.blend(scored, ["question", "label"], "strong", "cosine").select("question", "label", "id", F.round("blended", 6).alias("blended"))


def confidence(spark, sf_dir):
    """Mean of the three best cosines of each question, neutral 0.75 without any, with a level."""
    vectors = _vectors(spark, sf_dir)
    best = nearest(vectors, _asked(spark, sf_dir, vectors), 4).filter("id <> question")  # the question's own vector is among the four
    best = first_by(best.drop("rank"), ["question"], [F.desc("cosine"), "id"], 3)
    mean = best.groupBy("question").agg(F.avg("cosine").alias("mean"))
    score = F.coalesce("mean", F.lit(0.75))
    level = F.when(score >= 0.85, "HIGH").when(score >= 0.65, "MEDIUM").when(score >= 0.4, "LOW").otherwise("CRITICAL")
    return _texts(spark, sf_dir).select("question").join(mean, "question", "left").select("question", F.round(score, 3).alias("score"), level.alias("level"))


def members_by_community(spark, sf_dir):
    """At most max(1, k // n) members of each label that the scope admits, by id."""
    vectors = _vectors(spark, sf_dir)
    return first_by(vectors.filter("label in (1, 3, 5)"), ["label"], ["id"], max(1, K // 3)).select("label", "rank", "id")


QUERIES = {f.__name__: f for f in (dense_top_k, bm25_top_k, bm25_indexed, rank_fusion, hybrid_retrieve, rerank_by_label, confidence, members_by_community)}

_BASE = """
texts AS (SELECT item_id * 50 AS question, text AS asked_text FROM benchmark WHERE item_id * 50 IN (SELECT vec_id FROM embeddings)),
asked AS (SELECT vec_id AS question, embedding AS q FROM embeddings WHERE vec_id IN (SELECT question FROM texts)),
near AS (SELECT question, vec_id AS id, label, round(list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS cosine FROM embeddings, asked),
wanted AS (SELECT DISTINCT question, unnest(regexp_extract_all(lower(asked_text), '[a-z0-9]+')) AS term FROM texts),
words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (SELECT question, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN wanted USING (term), size GROUP BY question, id),
r1 AS (SELECT question, id, label, row_number() OVER (PARTITION BY question ORDER BY cosine DESC, id) - 1 AS r FROM near),
r2 AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) - 1 AS r FROM lex),
fused AS (SELECT r1.question, r1.id, r1.label, round(1.0 / (60 + r1.r) + coalesce(0.5 / (60 + r2.r), 0), 8) AS fused FROM r1 LEFT JOIN r2 ON r1.question = r2.question AND r1.id = r2.id AND r2.r < 160)
"""

ORACLE_SQL = {
    "dense_top_k": f"WITH {_BASE} SELECT question, id, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT question, id, cosine, row_number() OVER (PARTITION BY question ORDER BY cosine DESC, id) AS rank FROM near) WHERE rank <= 20",
    "bm25_top_k": f"WITH {_BASE} SELECT question, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM lex) WHERE rank <= 160",
    "bm25_indexed": f"WITH {_BASE} SELECT question, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM lex) WHERE rank <= 160",
    "rank_fusion": f"WITH {_BASE} SELECT question, id, fused FROM fused",
    "hybrid_retrieve": f"""WITH {_BASE},
best AS (SELECT * FROM (SELECT question, id % 50 AS anchor, id, label, fused, row_number() OVER (PARTITION BY question, id % 50 ORDER BY fused DESC, id) AS r FROM fused) WHERE r = 1),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, label ORDER BY fused DESC, anchor) AS g FROM best) WHERE g <= 3)
SELECT question, CAST(rank AS INTEGER) AS rank, anchor, id, label, fused FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY fused DESC, anchor) AS rank FROM kept) WHERE rank <= 20""",
    "rerank_by_label": f"""WITH {_BASE},
exact AS (SELECT question, vec_id AS id, label, list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS cosine FROM embeddings, asked),
seen AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
hits AS (SELECT w.question, s.id, count(*) AS n FROM wanted w JOIN seen s USING (term) GROUP BY w.question, s.id),
sizes AS (SELECT question, count(*) AS m FROM wanted GROUP BY question),
scored AS (SELECT e.question, e.label, e.id, e.cosine, coalesce(CAST(h.n AS DOUBLE), 0.0) / z.m AS strong FROM exact e JOIN documents d ON d.doc_id = e.id JOIN sizes z ON z.question = e.question LEFT JOIN hits h ON h.question = e.question AND h.id = e.id),
bounded AS (SELECT *, min(strong) OVER w AS ls, max(strong) OVER w AS ms, min(cosine) OVER w AS lc, max(cosine) OVER w AS mc FROM scored WINDOW w AS (PARTITION BY question, label))
SELECT question, label, id, round(0.6 * CASE WHEN ms - ls < 1e-9 THEN 1.0 ELSE (strong - ls) / (ms - ls) END + 0.4 * CASE WHEN mc - lc < 1e-9 THEN 1.0 ELSE (cosine - lc) / (mc - lc) END, 6) AS blended FROM bounded""",
    "confidence": f"""WITH {_BASE},
exact AS (SELECT question, vec_id AS id, list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS cosine FROM embeddings, asked WHERE vec_id <> question),
mean AS (SELECT question, avg(cosine) AS m FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY cosine DESC, id) AS r FROM exact) WHERE r <= 3 GROUP BY question),
s AS (SELECT question, coalesce(m, 0.75) AS m FROM texts LEFT JOIN mean USING (question))
SELECT question, round(m, 3) AS score, CASE WHEN m >= 0.85 THEN 'HIGH' WHEN m >= 0.65 THEN 'MEDIUM' WHEN m >= 0.4 THEN 'LOW' ELSE 'CRITICAL' END AS level FROM s""",
    "members_by_community": "SELECT label, CAST(rank AS INTEGER) AS rank, id FROM (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings WHERE label IN (1, 3, 5)) WHERE rank <= 6",
}
