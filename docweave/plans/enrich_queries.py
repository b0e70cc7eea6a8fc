"""Enrichment queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import enrich
from docweave.sources import corpus
from docweave.sources.corpus import SQL, table


def force_distribution(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, ("article", "recital", "guidance_section"))), (F.col("p_size") % 3 + 1).cast("int")).alias("kind"), F.when(F.col("p_partkey") % 7 == 0, F.lit("unknown")).alias("stated"))
    return part.groupBy(enrich.binding_force(F.col("kind"), F.col("stated")).alias("force")).agg(F.count("*").alias("n"))


def applicability(spark, sf_dir):
    order = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("act"), F.to_date("o_orderdate").alias("date"))
    return enrich.applicability(order, F.lit("1998-06-30").cast("date")).withColumn("next", F.date_format("next", "yyyy-MM-dd"))


def captions(spark, sf_dir):
    node = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("title"), F.concat(F.lit("Article "), "c_custkey").alias("display_ref"))
    seeds = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("id"), F.col("s_name").alias("seed_title"))
    return enrich.captions(node, seeds)


def preferred_versions(spark, sf_dir):
    """One line of each order: a returned one if there is one."""
    line = corpus.leaves(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("version"), "l_returnflag")
    return enrich.prefer(line, "l_orderkey", F.col("l_returnflag") == "R")


def role_links(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    provisions = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("REG"), F.col("p_partkey") % 5).alias("celex"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.lit("Makers shall act.")).otherwise(F.lit("Makers may act.")).alias("first_sentence"))
    roles = part.select(F.concat(F.lit("REG"), F.col("p_size") % 5).alias("celex"), F.substring_index("p_name", " ", -1).alias("role")).filter("celex <> 'REG3'").distinct()
    return enrich.role_obligations(provisions, roles.unionByName(roles.select("celex", F.lit("maker").alias("role")).distinct()))


def pointer_expansion(spark, sf_dir):
    line = corpus.leaves(spark, sf_dir)
    bag = line.filter("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("id")).agg(F.min("l_linenumber").alias("pos")).withColumn("celex", F.col("id") % 5)
    cites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.array((F.col("s_suppkey") + 1) % 10, (F.col("s_suppkey") + 5) % 10, (F.col("s_suppkey") * 3) % 10)).alias("target")).withColumn("place", F.col("target") % 4).distinct()
    return enrich.pointers(bag, cites.withColumn("target_celex", F.col("target") % 5), 3)


def unanchored_acts(spark, sf_dir):
    line = corpus.leaves(spark, sf_dir).select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("REG"), F.col("l_suppkey") % 3).alias("celex"), F.when(F.col("l_returnflag") == "R", "EXEMPTS").when(F.col("l_returnflag") == "A", "DEFINES").otherwise("OTHER").alias("role"))
    return enrich.unanchored(line)


def composite_confidence(spark, sf_dir):
    line = corpus.leaves(spark, sf_dir)
    score, level = enrich.composite({"coverage": F.col("l_suppkey") % 11 / 10, "relevance": F.col("l_partkey") % 5 / 4, "faithfulness": F.lit(0.5), "completeness": F.when(F.col("l_returnflag") == "N", 0.7).otherwise(1.0), "force": F.col("l_linenumber") / 7})
    return line.select("l_orderkey", "l_linenumber", score.alias("score"), level.alias("level"))


def community_samples(spark, sf_dir):
    node = corpus.nodes(spark, sf_dir).filter("kind in ('article', 'paragraph')")
    members = node.select(F.concat("celex", F.lit("-"), F.col("ord") % 9).alias("community"), "depth", "id", F.concat("kind", F.lit(" "), "ord").alias("ref"), "text")
    return enrich.samples(members, 5)


QUERIES = {f.__name__: f for f in (force_distribution, applicability, captions, preferred_versions, role_links, pointer_expansion, unanchored_acts, composite_confidence, community_samples)}

ORACLE_SQL = {
    "force_distribution": "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_size % 3 = 1 THEN 'interpretive' WHEN p_size % 3 = 2 THEN 'non_binding' ELSE 'binding' END AS force, count(*) AS n FROM part GROUP BY 1",
    "applicability": "SELECT o_custkey AS act, count(*) FILTER (WHERE d <= DATE '1998-06-30') AS applied, count(*) FILTER (WHERE d > DATE '1998-06-30') AS pending, strftime(min(CASE WHEN d > DATE '1998-06-30' THEN d END), '%Y-%m-%d') AS next FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY o_custkey",
    "captions": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE coalesce(s_name, 'Article ' || c_custkey) END AS caption FROM customer LEFT JOIN supplier ON s_suppkey * 2 = c_custkey",
    "preferred_versions": f"WITH {SQL} SELECT l_orderkey, version, l_returnflag FROM (SELECT l_orderkey, l_linenumber AS version, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber) AS r FROM leaf) WHERE r = 1",
    "role_links": """WITH roles AS (SELECT DISTINCT p_size % 5 AS c, string_split(p_name, ' ')[2] AS role FROM part WHERE p_size % 5 <> 3), wide AS (SELECT c, role FROM roles UNION SELECT c, 'maker' FROM roles)
SELECT DISTINCT p_partkey AS id, role FROM part JOIN wide ON c = p_partkey % 5 WHERE p_size % 2 = 0 AND (role = 'maker' OR role = string_split(p_name, ' ')[2])""",
    "pointer_expansion": f"""WITH {SQL}, bag AS (SELECT l_orderkey AS case_id, l_suppkey AS id, min(l_linenumber) AS pos FROM leaf WHERE l_linenumber <= 3 GROUP BY 1, 2),
t AS (SELECT s_suppkey AS id, unnest([(s_suppkey + 1) % 10, (s_suppkey + 5) % 10, (s_suppkey * 3) % 10]) AS target FROM supplier),
found AS (SELECT case_id, target, CASE WHEN bag.id % 5 = target % 5 THEN 1 ELSE 0 END AS inside, pos, target % 4 AS place FROM bag JOIN t ON t.id = bag.id),
new AS (SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM bag b WHERE b.case_id = f.case_id AND b.id = f.target)),
each AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, target ORDER BY inside, pos, place) AS r FROM new) WHERE r = 1)
SELECT case_id, CAST(rank AS INTEGER) AS rank, target AS id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY inside, pos, place, target) AS rank FROM each) WHERE rank <= 3""",
    "unanchored_acts": f"WITH {SQL} SELECT l_orderkey AS case_id, 'REG' || (l_suppkey % 3) AS celex FROM leaf GROUP BY 1, 2 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND count(*) FILTER (WHERE l_returnflag = 'A') = 0",
    "composite_confidence": f"""WITH {SQL}, s AS (SELECT l_orderkey, l_linenumber, round(0.35 * ((l_suppkey % 11) / 10.0) + 0.2 * ((l_partkey % 5) / 4.0) + 0.2 * 0.5 + 0.1 * CASE WHEN l_returnflag = 'N' THEN 0.7 ELSE 1.0 END + 0.15 * (CAST(l_linenumber AS DOUBLE) / 7), 3) AS score FROM leaf)
SELECT l_orderkey, l_linenumber, score, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.65 THEN 'MEDIUM' WHEN score >= 0.4 THEN 'LOW' ELSE 'CRITICAL' END AS level FROM s""",
    "community_samples": f"""WITH {SQL}, m AS (SELECT celex || '-' || (ord % 9) AS community, depth, id, '[' || kind || ' ' || ord || '] ' || text AS line FROM node WHERE kind IN ('article', 'paragraph')),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY depth, id) AS r FROM m) WHERE r <= 5)
SELECT community, string_agg(line, chr(10) ORDER BY r) AS text FROM k GROUP BY community""",
}
