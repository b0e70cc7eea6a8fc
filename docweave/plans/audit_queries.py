"""Audits, verdicts, exports and composed reads over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import audits, communities, retrieve, routing, text, tree
from docweave.sources import corpus, files
from docweave.sources.corpus import SQL, table


def conversation_export(spark, sf_dir):
    return files.conversation_markdown(table(spark, sf_dir, "conversations"))


def role_audit(spark, sf_dir):
    """Edges of each role: obligations are the corpus's, parts and equivalents by number."""
    edge = corpus.edges(spark, sf_dir, spark.createDataFrame([], "id string, parent_id string")).filter("type = 'OBLIGATION_OF'").select("src", "type", "dst")
    role = edge.select(F.col("dst").alias("role_id")).distinct()
    number = F.substring_index("role_id", ":", -1).cast("int")
    parts = role.filter(number % 2 == 0).select(F.col("role_id").alias("src"), F.lit("INCLUDES_ROLE").alias("type"), F.lit("ROLE:1").alias("dst"))
    same = role.filter(number % 3 == 0).select(F.col("role_id").alias("src"), F.lit("EQUIVALENT_ROLE").alias("type"), F.lit("ROLE:2").alias("dst"))
    return audits.role_audit(role, edge.unionByName(parts).unionByName(same))


def authority_coverage(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    node = part.select("p_brand", F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("force"), F.col("p_size") % 4)).alias("binding_force"), F.when(F.col("p_size") % 5 > 1, F.concat(F.lit("source"), F.col("p_size") % 5)).otherwise(F.lit("")).alias("source_type")).withColumnRenamed("p_brand", "celex")
    found = audits.authority_coverage(node)
    return found.select("celex", "n", "no_binding", "no_source", F.array_join("forces", ",").alias("forces"), F.array_join("sources", ",").alias("sources"))


def ablation_deltas(spark, sf_dir):
    """Wanted are the customers' order priorities; one run finds those of filled orders, the other those of even orders."""
    order = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("ref"), "o_orderstatus", "o_orderkey")
    return audits.ablation(order.filter("o_orderstatus = 'F'"), order.filter("o_orderkey % 2 = 0"), order)


def judged_runs(spark, sf_dir):
    """Users' events as graded runs: the whole part of the value is the score, the type the verdict."""
    event = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.floor("value").cast("double").alias("score"), F.col("event_type").alias("verdict"))
    kinds = ("view", "click", "purchase", "signup", "login", "logout", "search", "error")
    return routing.judge_summary(event, kinds)


def defects(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    graded = part.select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_retailprice")).alias("score"), F.when(F.col("p_size") % 3 == 0, "bad").otherwise("good").alias("reliance"), (F.col("p_partkey") % 4 - 2).alias("fabricated"), F.when(F.col("p_size") % 7 == 0, 2).alias("misattributed"), F.lit(0).alias("phantom"), (F.col("p_size") % 5 > 0).alias("key_passed"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Article 5"))).alias("missed"))
    found = routing.critical_defects(graded, ("bad",), "bad")
    return found.select("case_id", F.array_join("critical_defects", ";").alias("defects"), "reliance_final", "reliance_gated")


def surfaced_amendments(spark, sf_dir):
    """Paragraphs of each customer with the amendments of them in front."""
    node = cut(corpus.nodes(spark, sf_dir))
    edge = cut(corpus.edges(spark, sf_dir, node))
    held = retrieve.Corpus(node, edge, cut(tree.closure(corpus.with_paths(node, corpus.LEVELS))))
    bag = node.filter("kind = 'paragraph'").select(F.substring_index("parent_id", ":", -1).cast("long").alias("case_id"), "id", F.col("ord").cast("int").alias("rank"), F.lit(0.5).alias("score"), F.lit("search").alias("channel"))
    return retrieve.surface_amendments(bag, held).select("case_id", "id", "rank", "channel")


def obligation_walk(spark, sf_dir):
    """From each customer over links to two others, at most two steps."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ref"), F.col("c_mktsegment").alias("celex"))
    number = F.col("ref").cast("long")
    links = customer.select("ref", "celex", ((number * 7 + 1) % 100).cast("string").alias("target_ref"), F.when(number % 3 == 0, F.lit("BUILDING")).alias("target_celex"))
    return retrieve.obligation_walk(customer.filter("celex = 'MACHINERY'"), links)


def upper_communities(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    members = part.select(F.concat(F.lit("c"), F.col("p_size")).alias("community"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("celex"))
    dominant = part.select(F.concat(F.lit("c"), F.col("p_size")).alias("community"), F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("X_cpt_"), F.col("p_size") % 7)).alias("chapter")).distinct()
    upper, _ = communities.upper_communities(dominant, members)
    return upper.select("id", text.community_label(F.col("id")).alias("label"), "member_count", F.size("regulations").alias("acts"), F.array_join("parts", ",").alias("parts"))


def capped_items(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000).alias("item_id"), "text"))
    return item.select("item_id", text.capped_quote(F.col("text"), 80).alias("quote"))


QUERIES = {f.__name__: f for f in (conversation_export, role_audit, authority_coverage, ablation_deltas, judged_runs, defects, surfaced_amendments, obligation_walk, upper_communities, capped_items)}

ORACLE_SQL = {
    "conversation_export": "SELECT conv_id, '# Conversation' || chr(10) || chr(10) || string_agg('### ' || upper(substr(r, 1, 1)) || lower(substr(r, 2)) || chr(10) || chr(10) || coalesce(trim(text), ''), chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM (SELECT *, coalesce(role, 'unknown') AS r FROM conversations) GROUP BY conv_id",
    "role_audit": "SELECT 'ROLE:' || r AS role_id, n AS obligations, CAST(r % 2 = 0 AS BIGINT) AS parts, CAST(r % 3 = 0 AS BIGINT) AS equivalents, CAST(0 AS BIGINT) AS defined FROM (SELECT c_custkey % 25 AS r, count(*) AS n FROM customer GROUP BY 1)",
    "authority_coverage": """SELECT p_brand AS celex, count(*) AS n, count(*) FILTER (WHERE p_size % 4 = 0) AS no_binding, count(*) FILTER (WHERE p_size % 5 <= 1) AS no_source,
coalesce(string_agg(DISTINCT CASE WHEN p_size % 4 > 0 THEN 'force' || (p_size % 4) END, ',' ORDER BY CASE WHEN p_size % 4 > 0 THEN 'force' || (p_size % 4) END), '') AS forces,
string_agg(DISTINCT CASE WHEN p_size % 5 > 1 THEN 'source' || (p_size % 5) ELSE '' END, ',' ORDER BY CASE WHEN p_size % 5 > 1 THEN 'source' || (p_size % 5) ELSE '' END) AS sources FROM part GROUP BY p_brand""",
    "ablation_deltas": """WITH f AS (SELECT o_custkey AS c, o_orderpriority, max(CAST(o_orderstatus = 'F' AS INTEGER)) AS a, max(CAST(o_orderkey % 2 = 0 AS INTEGER)) AS b FROM orders GROUP BY 1, 2)
SELECT c AS case_id, round(avg(a), 6) AS recall_with, round(avg(b), 6) AS recall_without, round(avg(a) - avg(b), 6) AS delta, count(*) FILTER (WHERE a = 1 AND b = 0) AS recovered, count(*) FILTER (WHERE a = 0 AND b = 1) AS lost FROM f GROUP BY c""",
    "judged_runs": """WITH e AS (SELECT user_id AS c, floor(value) AS s, event_type AS v, list_position(['view', 'click', 'purchase', 'signup', 'login', 'logout', 'search', 'error'], event_type) AS p FROM events),
votes AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, p DESC) AS r FROM e WHERE p > 0 GROUP BY c, v, p)
SELECT e.c AS case_id, round(median(s), 2) AS median, round(avg(s), 3) AS mean, coalesce(max(votes.v), '(unparsed)') AS verdict FROM e LEFT JOIN votes ON votes.c = e.c AND r = 1 GROUP BY e.c""",
    "defects": """WITH g AS (SELECT p_partkey AS k, p_partkey % 11 > 0 AS graded, p_size % 3 = 0 AS bad, p_partkey % 4 - 2 AS f, p_size % 7 = 0 AS m, p_size % 5 > 0 AS passed, p_size % 2 = 0 AS missed FROM part)
SELECT k AS case_id, concat_ws(';', CASE WHEN f > 0 THEN 'fabricated_quotes=' || f END, CASE WHEN m THEN 'misattributed_quotes=2' END, CASE WHEN NOT passed THEN 'answer_key_failed(' || CASE WHEN missed THEN 'Article 5' ELSE 'state_recall_below_threshold' END || ')' END, CASE WHEN NOT graded THEN 'ungraded' WHEN bad THEN 'judge_verdict_unreliable' END) AS defects,
CASE WHEN bad OR f > 0 OR m OR NOT passed THEN 'bad' ELSE 'good' END AS reliance_final, NOT bad AND (f > 0 OR m OR NOT passed) AS reliance_gated FROM g""",
    "surfaced_amendments": f"""WITH {SQL}, bag AS (SELECT CAST(substr(parent_id, 3) AS BIGINT) AS c, id, ord FROM node WHERE kind = 'paragraph'),
am AS (SELECT DISTINCT b.c, x.id FROM bag b JOIN (SELECT n.id AS target, e.src AS id, row_number() OVER (PARTITION BY n.id ORDER BY cl.dist, e.src) AS r FROM node n JOIN closure cl ON cl.desc_id = n.id AND cl.dist <= 4 JOIN edge e ON e.dst = cl.anc AND e.type = 'AMENDS' WHERE n.kind = 'paragraph') x ON x.target = b.id AND x.r <= 10),
bags AS (SELECT c, id, 0 AS part, row_number() OVER (PARTITION BY c ORDER BY id) AS own, 'amendments' AS channel FROM am UNION ALL SELECT c, id, 1, ord, 'search' FROM bag),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, id ORDER BY part, own) AS r FROM bags) WHERE r = 1)
SELECT c AS case_id, id, CAST(row_number() OVER (PARTITION BY c ORDER BY part, own, id) AS INTEGER) AS rank, channel FROM once""",
    "obligation_walk": """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS ref, c_mktsegment AS celex, CAST((c_custkey * 7 + 1) % 100 AS VARCHAR) AS t, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS tc FROM customer),
l0 AS (SELECT ref, celex FROM c WHERE celex = 'MACHINERY'), l1 AS (SELECT DISTINCT c.t AS ref, c.tc AS celex FROM l0 JOIN c USING (ref, celex)), l2 AS (SELECT DISTINCT c.t AS ref, c.tc AS celex FROM l1 JOIN c USING (ref, celex))
SELECT ref, celex, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY ref, celex""",
    "upper_communities": """SELECT 'community::L1::X_cpt_' || (p_size % 7) AS id, 'Chapter ' || (p_size % 7) || ' (X)' AS label, count(*) AS member_count, CAST(count(DISTINCT p_brand) AS INTEGER) AS acts, string_agg(DISTINCT 'c' || p_size, ',' ORDER BY 'c' || p_size) AS parts FROM part WHERE p_size % 7 > 0 GROUP BY p_size % 7""",
    "capped_items": """WITH t AS (SELECT item_id, trim(text, ' ') AS x FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id + 1000000, text FROM documents)),
h AS (SELECT *, substr(x, 1, 80) AS head FROM t), l AS (SELECT *, CASE WHEN strpos(head, '. ') > 0 THEN length(head) - strpos(reverse(head), ' .') ELSE 0 END AS last FROM h)
SELECT item_id, CASE WHEN length(x) <= 80 THEN x ELSE rtrim(CASE WHEN last - 1 > 40 THEN substr(head, 1, last) ELSE head END, ' ') || ' […]' END AS quote FROM l""",
}
