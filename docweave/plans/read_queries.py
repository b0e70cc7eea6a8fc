"""Whole reads and the canonical layer on tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import canon, retrieve, tree
from docweave.plans.search_queries import _BASE, _asked, _documents, _texts, _vectors
from docweave.sources import corpus
from docweave.sources.corpus import SQL, table

K = 8


def _corpus(spark, sf_dir):
    """Articles with the vectors of their numbers; each is its own anchor. What is read of other nodes is their edges, and which articles they lie in."""
    node = corpus.nodes(spark, sf_dir).filter("kind = 'article'")
    vectors = _vectors(spark, sf_dir).select(F.concat(F.lit("C:"), "id").alias("id"), "embedding").join(node.select("id"), "id", "left_semi")
    closed = tree.closure(corpus.pathed(spark, sf_dir), kind="article")
    return retrieve.Corpus(node, corpus.edges(spark, sf_dir), closed, vectors, None, vectors.select("id", F.col("id").alias("anchor")))


def _questions(spark, sf_dir):
    """Every third is of all acts, every third of two, every third of one."""
    n = (F.col("question") / 50).cast("int")
    acts = F.when(n % 3 == 1, F.array(F.lit("REG0"), F.lit("REG1"))).when(n % 3 == 2, F.array(F.concat(F.lit("REG"), n % 5)))
    return _texts(spark, sf_dir).select(F.col("question").alias("case_id"), "text", acts.alias("acts"))


def whole_retrieve(spark, sf_dir):
    """Dense and lexical ranks in the scope of each question, fused, a quota for each act; behind them what cites the hits from other acts."""
    held = _corpus(spark, sf_dir)
    asked = _asked(spark, sf_dir, _vectors(spark, sf_dir))
    documents = _documents(spark, sf_dir).withColumn("id", F.concat(F.lit("C:"), "id"))
    return retrieve.retrieve(cut(_questions(spark, sf_dir)), asked, held, documents, K)


def role_duties(spark, sf_dir):
    """Provisions that oblige a role of their act: names and plurals in first sentences and titles."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    one, two = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    says = F.element_at(F.array(F.concat(F.lit("The "), one, F.lit(" shall keep records.")), F.concat(two, F.lit("s must not act.")), F.concat(F.lit("The "), two, F.lit(" may act.")), F.concat(F.lit("Goods near "), one, F.lit("ish things shall stay."))), (F.col("p_size") % 4 + 1).cast("int"))
    title = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Obligations of "), two, F.lit("s"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("The "), one)).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("On "), one))
    act = lambda n: F.concat(F.lit("REG"), n % 3)
    provisions = part.select(F.col("p_partkey").cast("string").alias("id"), act(F.col("p_partkey")).alias("celex"), title.alias("title"), F.concat(F.lit("2. "), says, F.lit(" More is said.")).alias("text"))
    roles = part.select(act(F.col("p_size")).alias("celex"), F.explode(F.array(one, two)).alias("term")).distinct()
    roles = roles.withColumn("role_id", F.concat("celex", F.lit("::role::"), "term"))
    return canon.obligations(provisions, roles)


def nested_roles(spark, sf_dir):
    """Terms made of two others by their definition (even numbers) or a curated list (odd ones), promoted from actors on until nothing is added; every seventh is defined otherwise. One act."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n, F.floor(n / 4).alias("a"), F.floor(n / 5).alias("b"))
    definition = F.when(n % 7 == 0, F.concat(F.lit("the t"), "a", F.lit(" or any t"), "b", F.lit(" that pays"))).when(n % 2 == 0, F.concat(F.lit("the t"), "a", F.lit(" or any t"), "b", F.lit("; and more"))).otherwise(F.lit("as listed"))
    terms = rows.select(F.concat(F.lit("id"), n).alias("term_id"), F.concat(F.lit("t"), n).alias("term"), F.concat(F.lit("k"), n).alias("term_key"), F.lit("REG0").alias("celex"), F.when((n <= 60) | (n % 97 == 0), "actor").otherwise("other").alias("category"), definition.alias("definition"))
    components = rows.filter((n % 2 == 1) & (n % 7 != 0)).select(F.lit("REG0").alias("celex"), F.concat(F.lit("k"), n).alias("term_key"), F.explode(F.array("a", "b")).alias("x")).select("celex", "term_key", F.concat(F.lit("k"), "x").alias("part"))
    return canon.promoted(terms, components, spark.createDataFrame([], "celex string, term_key string"))


QUERIES = {f.__name__: f for f in (whole_retrieve, role_duties, nested_roles)}

_ROUNDS = 9
_FIX = ",\n".join(
    f"p{i + 1} AS (SELECT k FROM p{i} UNION SELECT k FROM t WHERE k % 2 = 0 AND k % 7 <> 0 AND a <> b AND a IN (SELECT k FROM p{i}) AND b IN (SELECT k FROM p{i})"
    f" UNION SELECT k FROM t WHERE k % 2 = 1 AND k % 7 <> 0 AND a >= 1 AND a IN (SELECT k FROM p{i}) AND (b < 1 OR b IN (SELECT k FROM p{i})))"
    for i in range(_ROUNDS)
)

ORACLE_SQL = {
    "whole_retrieve": f"""WITH {_BASE}, {SQL},
held AS (SELECT id, celex FROM node WHERE kind = 'article'),
cases AS (SELECT question, CASE (question // 50) % 3 WHEN 1 THEN ['REG0', 'REG1'] WHEN 2 THEN ['REG' || ((question // 50) % 5)] END AS acts FROM texts),
d AS (SELECT n.question, h.id, h.celex, c.acts, n.cosine, row_number() OVER (PARTITION BY n.question ORDER BY n.cosine DESC, h.id) - 1 AS r
      FROM near n JOIN held h ON h.id = 'C:' || n.id JOIN cases c ON c.question = n.question WHERE c.acts IS NULL OR list_contains(c.acts, h.celex)),
w AS (SELECT l.question, h.id, row_number() OVER (PARTITION BY l.question ORDER BY l.score DESC, h.id) - 1 AS r
      FROM lex l JOIN node h ON h.id = 'C:' || l.id JOIN cases c ON c.question = l.question WHERE c.acts IS NULL OR list_contains(c.acts, h.celex)),
f AS (SELECT d.question, d.id, d.celex, d.acts, d.cosine, round(1.0 / (60 + d.r) + coalesce(0.5 / (60 + w.r), 0), 8) AS score FROM d LEFT JOIN w ON w.question = d.question AND w.id = d.id AND w.r < {8 * K}),
q AS (SELECT *, row_number() OVER (PARTITION BY question, celex ORDER BY score DESC, id) AS g FROM f),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM q WHERE coalesce(len(acts), 0) <= 1 OR g <= greatest(3, ceil({K} / len(acts)))) WHERE rank <= {K}),
cites AS (SELECT t.id AS target, c.anc AS id, count(*) AS n FROM (SELECT DISTINCT id, celex FROM top WHERE acts IS NULL) t JOIN edge e ON e.dst = t.id AND e.type = 'CITES' JOIN closure c ON c.desc_id = e.src JOIN held h ON h.id = c.anc AND h.celex <> t.celex GROUP BY t.id, c.anc),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, id) AS r FROM cites) WHERE r <= 10),
back AS (SELECT t.question, f.id, sum(f.n) AS n FROM top t JOIN few f ON f.target = t.id WHERE t.acts IS NULL AND NOT EXISTS (SELECT 1 FROM top x WHERE x.question = t.question AND x.id = f.id) GROUP BY t.question, f.id),
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, id) AS rank FROM back) WHERE rank <= 10)
SELECT question AS case_id, id, id AS leaf, CAST(rank AS INTEGER) AS rank, score, cosine, 'search' AS channel FROM top
UNION ALL SELECT question, id, NULL, CAST(rank + {K} AS INTEGER), 0.0, NULL, 'reverse' FROM ten""",
    "role_duties": """WITH p AS (SELECT p_partkey AS k, p_size AS s, string_split(p_name, ' ')[1] AS one, string_split(p_name, ' ')[2] AS two, 'REG' || (p_partkey % 3) AS celex FROM part),
said AS (SELECT k, celex, CASE k % 5 WHEN 0 THEN 'obligations of ' || two || 's' WHEN 1 THEN 'the ' || one WHEN 2 THEN 'on ' || one ELSE '' END AS title,
           CASE s % 4 WHEN 0 THEN 'the ' || one || ' shall keep records.' WHEN 1 THEN two || 's must not act.' WHEN 2 THEN 'the ' || two || ' may act.' ELSE 'goods near ' || one || 'ish things shall stay.' END AS sentence FROM p),
roles AS (SELECT DISTINCT 'REG' || (p_size % 3) AS celex, unnest(string_split(p_name, ' ')[1:2]) AS term FROM part),
named AS (SELECT *, CASE WHEN regexp_matches(term, '[^aeiou]y$') THEN regexp_replace(term, 'y$', 'ies') WHEN regexp_matches(term, '(s|x|z|ch|sh)$') THEN term || 'es' ELSE term || 's' END AS many FROM roles),
met AS (SELECT k, celex, term, many, title, sentence, regexp_matches(sentence, '(^|[^a-z0-9_])(' || many || '|' || term || ')([^a-z0-9_]|$)') AS in_text, regexp_matches(title, '(^|[^a-z0-9_])(' || many || '|' || term || ')([^a-z0-9_]|$)') AS in_title FROM said JOIN named USING (celex)),
judged AS (SELECT *, in_title AND trim(replace(replace(title, many, ''), term, '')) IN ('', 'the', 'a', 'an') AS whole FROM met WHERE in_text OR in_title),
sense AS (SELECT *, CASE WHEN title LIKE '%obligation%' THEN 'obligation' WHEN sentence LIKE '%must not%' THEN 'prohibition' WHEN regexp_matches(sentence, '(shall|must) ') THEN 'obligation' WHEN whole THEN 'obligation' END AS modality FROM judged)
SELECT CAST(k AS VARCHAR) AS provision, celex || '::role::' || term AS role, modality, CASE WHEN in_text THEN 'text' ELSE 'title' END AS cue FROM sense WHERE modality IS NOT NULL AND (in_text OR title LIKE '%obligation%' OR whole)""",
    "nested_roles": f"""WITH t AS (SELECT p_partkey AS k, p_partkey // 4 AS a, p_partkey // 5 AS b FROM part), p0 AS (SELECT k FROM t WHERE k <= 60 OR k % 97 = 0),
{_FIX}
SELECT 'id' || k AS term_id FROM p{_ROUNDS}""",
}
