"""Queries of the row operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import rows
from docweave.sources import corpus
from docweave.sources.corpus import SQL, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def latest_feedback(spark, sf_dir):
    """Every view, with the user's last error event."""
    events = _events(spark, sf_dir)
    last = rows.latest(events.filter("event_type = 'error'"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_id").alias("feedback_id"), F.col("value").alias("rating"))
    return events.filter("event_type = 'view'").select("event_id", "user_id").join(last, "user_id", "left")


def upsert_last_write(spark, sf_dir):
    """Customers' balances, overwritten by the last purchase of the user of the same number."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    new = _events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("user_id").cast("long").alias("id"), "value", "ts", "event_id")
    return rows.upsert(old.withColumn("ts", F.lit(None).cast(new.schema["ts"].dataType)).withColumn("event_id", F.lit(None).cast("long")), new, "id", [F.desc("ts"), F.desc("event_id")]).select("id", "value")


def keep_human_roles(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"), F.when(F.col("c_custkey") % 3 == 0, "human").otherwise("rule").alias("source"))
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"), F.lit("llm").alias("source"))
    return rows.keep_human(old, new, "id")


def context_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return rows.budget_cut(turns, ["conv_id"], ["turn"], F.col("size"), 1500).select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), "total")


def history_trim(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return rows.trim_history(turns, "conv_id", "turn", F.col("size")).select("conv_id", "turn", "total")


def merge_channels(spark, sf_dir):
    """Parts of an order's lines by price, before parts by line number, each part once."""
    line = corpus.leaves(spark, sf_dir)
    by_line = line.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("pos"))
    flagged = line.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", (10 - F.col("l_linenumber")).cast("long").alias("pos"))
    return rows.merge_unique([flagged, by_line], "l_partkey", ["l_orderkey"])


def graph_parity(spark, sf_dir):
    node = corpus.nodes(spark, sf_dir).filter("kind in ('article', 'paragraph')")
    other = node.filter("ord % 17 <> 3").withColumn("text", F.when(F.col("ord") % 11 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).withColumn("kind", F.when(F.col("ord") % 13 == 0, F.lit("annex")).otherwise(F.col("kind")))
    extra = node.filter("ord % 29 = 1").withColumn("id", F.concat(F.lit("X"), "id"))
    return rows.parity(node, other.unionByName(extra), "id", "text", "kind")


def token_conservation(spark, sf_dir):
    """How many words of each benchmark item are missing in its text without its every second word."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return rows.lost_tokens(words.select("id", "token"), words.filter("pos % 2 = 0").select("id", "token"), "id")


def judge_majority(spark, sf_dir):
    votes = _events(spark, sf_dir).select("user_id", "event_type")
    return rows.worst_majority(votes, "user_id", "event_type", F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0))


def crosslink_targets(spark, sf_dir):
    """Each line's candidates in order: the article of its part, that of its supplier, its document; the first that exists."""
    node = corpus.nodes(spark, sf_dir)
    line = corpus.leaves(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    candidates = F.array(F.struct(F.lit(0).alias("rank"), F.concat(F.lit("C:"), F.col("l_partkey") * 3).alias("target")), F.struct(F.lit(1).alias("rank"), F.concat(F.lit("N:"), "l_suppkey").alias("target")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("R:"), F.col("l_suppkey") % 5).alias("target")))
    wide = line.select("l_orderkey", "l_linenumber", F.explode(candidates).alias("x")).select("l_orderkey", "l_linenumber", "x.rank", "x.target")
    return rows.ranked_choice(wide, ["l_orderkey", "l_linenumber"], "rank", node, "target")


def integrity_checks(spark, sf_dir):
    node = corpus.nodes(spark, sf_dir)
    broken = node.withColumn("parent_id", F.when(F.col("ord") % 997 == 5, F.lit("none")).otherwise(F.col("parent_id"))).withColumn("text", F.when(F.col("ord") % 501 == 7, F.lit(" ")).otherwise(F.col("text")))
    return rows.integrity(broken.unionByName(node.filter("kind = 'chapter'")))


def dangling_edges(spark, sf_dir):
    """Edges by type whose source or target is not a node."""
    node, edge = corpus.nodes(spark, sf_dir).select("id"), corpus.edges(spark, sf_dir)
    source = edge.join(node.withColumnRenamed("id", "src"), "src", "left_anti").groupBy("type").agg(F.count("*").alias("n")).withColumn("end", F.lit("src"))
    target = edge.join(node.withColumnRenamed("id", "dst"), "dst", "left_anti").groupBy("type").agg(F.count("*").alias("n")).withColumn("end", F.lit("dst"))
    return source.unionByName(target)


def external_stubs(spark, sf_dir):
    """Targets outside the graph, each once, unless the catalogue (regions' chapters) has them."""
    edge = corpus.edges(spark, sf_dir)
    catalogue = table(spark, sf_dir, "nation").select(F.concat(F.lit("ROLE:"), F.col("n_nationkey")).alias("dst")).filter("cast(substring(dst, 6) as int) < 10")
    node = corpus.nodes(spark, sf_dir).select(F.col("id").alias("dst"))
    return edge.join(node, "dst", "left_anti").join(catalogue, "dst", "left_anti").groupBy("dst").agg(F.count("*").alias("n_edges"), F.min("type").alias("type"))


def role_rollup(spark, sf_dir):
    """Counts of nodes by regulation and kind, with totals."""
    node = corpus.nodes(spark, sf_dir)
    return node.rollup("celex", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("title").isNull()).alias("untitled"))


def wipe_document(spark, sf_dir):
    """Nodes and edges left by regulation when one regulation's nodes, and all edges at them, are removed."""
    node, edge = corpus.nodes(spark, sf_dir), corpus.edges(spark, sf_dir)
    gone = node.filter("celex = 'REG1'").select("id")
    left = edge.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left.groupBy("type").agg(F.count("*").alias("n"))


def snapshot_diff(spark, sf_dir):
    """Parts that an order's lines had in one run or the other, and not in both."""
    line = corpus.leaves(spark, sf_dir)
    a = line.filter("l_linenumber <= 4").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id")).distinct()
    b = line.filter("l_linenumber >= 3").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id")).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("dropped")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


def golden_recall(spark, sf_dir):
    """Share of each order's parts among the parts of the supplier's nation, and whether all are there."""
    line = corpus.leaves(spark, sf_dir)
    expected = line.select("l_orderkey", "l_partkey").distinct()
    found = line.filter("l_returnflag <> 'N'").select("l_orderkey", "l_partkey").distinct().withColumn("hit", F.lit(1))
    return expected.join(found, ["l_orderkey", "l_partkey"], "left").groupBy("l_orderkey").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"), (F.min(F.coalesce("hit", F.lit(0))) == 1).alias("complete"))


QUERIES = {f.__name__: f for f in (latest_feedback, upsert_last_write, keep_human_roles, context_budget, history_trim, merge_channels, graph_parity, token_conservation, judge_majority, crosslink_targets, integrity_checks, dangling_edges, external_stubs, role_rollup, wipe_document, snapshot_diff, golden_recall)}

ORACLE_SQL = {
    "latest_feedback": """WITH last AS (SELECT user_id, event_id AS feedback_id, value AS rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r = 1)
SELECT e.event_id, e.user_id, l.feedback_id, l.rating FROM events e LEFT JOIN last l ON l.user_id = e.user_id WHERE e.event_type = 'view'""",
    "upsert_last_write": """WITH new AS (SELECT user_id AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1)
SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT id FROM new) UNION ALL SELECT id, value FROM new""",
    "keep_human_roles": """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN a.value ELSE b.value END AS value, CASE WHEN a.id IS NOT NULL THEN 'human' ELSE 'llm' END AS source
FROM (SELECT c_custkey AS id, c_mktsegment AS value FROM customer WHERE c_custkey % 3 = 0) a FULL JOIN (SELECT p_partkey AS id, p_brand AS value FROM part) b ON a.id = b.id""",
    "context_budget": """SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CAST(total AS BIGINT) AS total FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM conversations) WHERE pos = 1 OR total <= 1500""",
    "history_trim": """WITH last AS (SELECT * FROM (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6)
SELECT conv_id, turn, CAST(total AS BIGINT) AS total FROM (SELECT conv_id, turn, sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM last) WHERE total <= 3000""",
    "merge_channels": f"""WITH {SQL}, both_ AS (SELECT l_orderkey, l_partkey, CAST(10 - l_linenumber AS BIGINT) AS pos, 0 AS channel FROM leaf WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 1 FROM leaf),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY channel, pos) AS r FROM both_) WHERE r = 1)
SELECT l_orderkey, l_partkey, channel, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY channel, pos, l_partkey) AS INTEGER) AS rank FROM first""",
    "graph_parity": f"""WITH {SQL}, a AS (SELECT id, text, kind, ord FROM node WHERE kind IN ('article', 'paragraph')),
b AS (SELECT id, CASE WHEN ord % 11 = 0 THEN text || ' ' ELSE text END AS text, CASE WHEN ord % 13 = 0 THEN 'annex' ELSE kind END AS kind FROM a WHERE ord % 17 <> 3 UNION ALL SELECT 'X' || id, text, kind FROM a WHERE ord % 29 = 1)
SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing_right' WHEN a.id IS NULL THEN 'missing_left' WHEN a.text <> b.text THEN 'text' WHEN a.kind <> b.kind THEN 'kind' END AS differs FROM a FULL JOIN b ON a.id = b.id) WHERE differs IS NOT NULL""",
    "token_conservation": """WITH split AS (SELECT item_id AS id, string_split(text, ' ') AS w FROM benchmark), words AS (SELECT id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM split),
a AS (SELECT id, token, count(*) AS n FROM words GROUP BY id, token), b AS (SELECT id, token, count(*) AS m FROM words WHERE pos % 2 = 0 GROUP BY id, token)
SELECT a.id, CAST(sum(greatest(n - coalesce(m, 0), 0)) AS BIGINT) AS lost FROM a LEFT JOIN b ON a.id = b.id AND a.token = b.token GROUP BY a.id""",
    "judge_majority": """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE r = 1""",
    "crosslink_targets": f"""WITH {SQL}, wide AS (SELECT l_orderkey, l_linenumber, 0 AS rank, 'C:' || (l_partkey * 3) AS target FROM leaf UNION ALL SELECT l_orderkey, l_linenumber, 1, 'N:' || l_suppkey FROM leaf UNION ALL SELECT l_orderkey, l_linenumber, 2, 'R:' || (l_suppkey % 5) FROM leaf)
SELECT l_orderkey, l_linenumber, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY rank) AS r FROM wide WHERE target IN (SELECT id FROM node)) WHERE r = 1""",
    "integrity_checks": f"""WITH {SQL}, x AS (SELECT id, CASE WHEN ord % 997 = 5 THEN 'none' ELSE parent_id END AS parent_id, depth, CASE WHEN ord % 501 = 7 THEN ' ' ELSE text END AS text FROM node UNION ALL SELECT id, parent_id, depth, text FROM node WHERE kind = 'chapter'),
up AS (SELECT x.id, x.parent_id, x.depth, x.text, y.depth AS above, y.id AS there FROM x LEFT JOIN x y ON y.id = x.parent_id)
SELECT 'duplicate_id' AS "check", count(*) AS n FROM (SELECT id FROM x GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'orphan', count(*) FROM up WHERE parent_id IS NOT NULL AND there IS NULL UNION ALL SELECT 'self_parent', count(*) FROM up WHERE parent_id = id
UNION ALL SELECT 'no_text', count(*) FROM up WHERE coalesce(trim(text), '') = '' UNION ALL SELECT 'depth', count(*) FROM up WHERE there IS NOT NULL AND depth <> above + 1""",
    "dangling_edges": f"WITH {SQL} SELECT type, count(*) AS n, 'src' AS \"end\" FROM edge WHERE src NOT IN (SELECT id FROM node) GROUP BY type UNION ALL SELECT type, count(*), 'dst' FROM edge WHERE dst NOT IN (SELECT id FROM node) GROUP BY type",
    "external_stubs": f"WITH {SQL} SELECT dst, count(*) AS n_edges, min(type) AS type FROM edge WHERE dst NOT IN (SELECT id FROM node) AND dst NOT IN (SELECT 'ROLE:' || n_nationkey FROM nation WHERE n_nationkey < 10) GROUP BY dst",
    "role_rollup": f"WITH {SQL} SELECT celex, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE title IS NULL) AS untitled FROM node GROUP BY ROLLUP (celex, kind)",
    "wipe_document": f"WITH {SQL}, gone AS (SELECT id FROM node WHERE celex = 'REG1') SELECT type, count(*) AS n FROM edge WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type",
    "snapshot_diff": f"""WITH {SQL}, a AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS id FROM leaf WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS id FROM leaf WHERE l_linenumber >= 3)
SELECT case_id, id, 'dropped' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT case_id, id, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "golden_recall": f"""WITH {SQL}, e AS (SELECT DISTINCT l_orderkey, l_partkey FROM leaf), f AS (SELECT DISTINCT l_orderkey, l_partkey, 1 AS hit FROM leaf WHERE l_returnflag <> 'N')
SELECT e.l_orderkey, round(avg(CAST(coalesce(hit, 0) AS DOUBLE)), 6) AS recall, min(coalesce(hit, 0)) = 1 AS complete FROM e LEFT JOIN f ON e.l_orderkey = f.l_orderkey AND e.l_partkey = f.l_partkey GROUP BY e.l_orderkey""",
}
