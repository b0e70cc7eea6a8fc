"""Queries on the tree and the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import graph, tree
from docweave.sources import corpus
from docweave.sources.corpus import SQL

KINDS = {"R": "document", "N": "chapter", "C": "article", "O": "paragraph", "L": "point"}


def _pathed(spark, sf_dir):
    return corpus.pathed(spark, sf_dir)


def tree_closure(spark, sf_dir):
    return tree.closure(_pathed(spark, sf_dir))


def tree_subtree(spark, sf_dir):
    pathed = cut(_pathed(spark, sf_dir))
    return tree.subtree(pathed, pathed.filter("kind = 'chapter'"), 6)


def tree_anchor(spark, sf_dir):
    return tree.anchor(_pathed(spark, sf_dir), KINDS, ("article", "chapter"))


def tree_flatten(spark, sf_dir):
    flat = tree.flatten(_pathed(spark, sf_dir), "article", 3000)
    return flat.select("id", tree.cap_text(F.col("text"), 3000).alias("text"), "full_length")


def tree_intervals(spark, sf_dir):
    """Each node's interval of places in pre-order."""
    return tree.numbered(tree.in_order(_pathed(spark, sf_dir).select("id", "depth", "key", "path"))).select("id", "begin", "end")


def tree_context(spark, sf_dir):
    found = tree.context_prefix(_pathed(spark, sf_dir))
    return found.select("id", "text", tree.strip_context(F.col("text")).alias("body"))


def tree_display(spark, sf_dir):
    return tree.display_path(_pathed(spark, sf_dir))


def graph_upsert_edges(spark, sf_dir):
    """Edges of known types whose both ends exist, once for each pair."""
    node = cut(corpus.nodes(spark, sf_dir).select("id", "parent_id"))
    edge = corpus.edges(spark, sf_dir, node).filter(F.col("type").isin("CITES", "AMENDS", "HAS_PART"))
    kept = edge.join(node.select(F.col("id").alias("src")), "src", "left_semi").join(node.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept.groupBy("src", "type", "dst").agg(F.min("ref_text").alias("ref_text"))


def _graph(spark, sf_dir, kind):
    """Nodes, edges and the closure's pairs with a node of a kind. None is stored: a read of the tables takes less than one of what is made of them."""
    pathed = _pathed(spark, sf_dir)
    node = corpus.nodes(spark, sf_dir)
    return node, corpus.edges(spark, sf_dir, node), tree.closure(pathed, kind=kind)


def _node_edge(spark, sf_dir):
    node = cut(corpus.nodes(spark, sf_dir))
    return node, cut(corpus.edges(spark, sf_dir, node))


def graph_expand(spark, sf_dir):
    node, edge, closed = _graph(spark, sf_dir, "article")
    return graph.expand(node.filter("kind = 'article'"), node, edge, closed)


def graph_reverse_cross(spark, sf_dir):
    node, edge, closed = _graph(spark, sf_dir, "article")
    return graph.reverse_cross_references(node.filter("kind = 'article'"), node, edge, closed, ("article",))


def graph_citing(spark, sf_dir):
    pathed = _pathed(spark, sf_dir)
    return graph.citing_by_lines(pathed, corpus.edges(spark, sf_dir, pathed), "chapter", ("article", "document"))


def graph_amendments(spark, sf_dir):
    node, edge, closed = _graph(spark, sf_dir, "paragraph")
    return graph.amendments(node.filter("kind = 'paragraph'"), edge, closed)


def graph_roles(spark, sf_dir):
    node, edge = _node_edge(spark, sf_dir)
    roles = edge.filter("type = 'OBLIGATION_OF'").select(F.col("dst").alias("role")).distinct()
    related = roles.select(F.col("role").alias("src"), F.concat(F.lit("ROLE:"), (F.substring_index("role", ":", -1).cast("int") * 3 + 1) % 25).alias("dst"))
    return graph.role_obligations(roles, related, node, edge)


def graph_chain(spark, sf_dir):
    node, edge = _node_edge(spark, sf_dir)
    return graph.chain(node.filter("kind = 'article'"), edge, ("TRIGGERS",), 2)


def graph_drilldown(spark, sf_dir):
    node, edge = _node_edge(spark, sf_dir)
    return graph.drilldown(edge.filter("type = 'CITES'").select(F.col("dst").alias("id")), node)


QUERIES = {f.__name__: f for f in (tree_closure, tree_subtree, tree_anchor, tree_flatten, tree_intervals, tree_context, tree_display, graph_upsert_edges, graph_expand, graph_reverse_cross, graph_citing, graph_amendments, graph_roles, graph_chain, graph_drilldown)}

_BODY = "CASE WHEN text IS NOT NULL AND trim(text) <> '' AND title IS DISTINCT FROM text THEN trim(text) END"
_REF = "upper(substr(kind, 1, 1)) || substr(kind, 2) || ' ' || ord"

ORACLE_SQL = {
    "tree_closure": f"WITH {SQL} SELECT anc, desc_id, dist FROM closure",
    "tree_subtree": f"WITH {SQL} SELECT anc AS root, id, dist AS level, key FROM closure JOIN pathed ON desc_id = id WHERE anc LIKE 'N:%' AND dist <= 6",
    "tree_anchor": f"WITH {SQL} SELECT id, coalesce(p2, p1) AS anchor FROM pathed",
    "tree_intervals": f"""WITH {SQL}, placed AS (SELECT id, row_number() OVER (ORDER BY key) - 1 AS begin FROM pathed), sizes AS (SELECT anc AS id, count(*) AS n FROM closure GROUP BY anc)
SELECT id, begin, begin + n - 1 AS "end" FROM placed JOIN sizes USING (id)""",
    "tree_flatten": f"""WITH {SQL}, bodies AS (SELECT id, {_BODY} AS body FROM node),
full_text AS (SELECT n.id, string_agg(b.body, ' ' ORDER BY p.key) AS text FROM node n LEFT JOIN closure c ON c.anc = n.id LEFT JOIN bodies b ON b.id = c.desc_id AND b.body IS NOT NULL LEFT JOIN pathed p ON p.id = b.id WHERE n.kind = 'article' GROUP BY n.id),
cut AS (SELECT id, text, substr(text, 1, 3000) AS head FROM full_text),
placed AS (SELECT *, CASE WHEN strpos(head, '.') > 0 THEN 3000 - strpos(reverse(head), '.') + 1 ELSE 0 END AS period FROM cut)
SELECT id, CASE WHEN length(text) <= 3000 THEN text WHEN period > 1500 THEN substr(text, 1, period) ELSE head END AS text, CAST(length(text) AS INTEGER) AS full_length FROM placed""",
    "tree_context": f"""WITH {SQL}, headed AS (SELECT id, {_REF} || ' - ' || title AS heading FROM node WHERE title IS NOT NULL),
above AS (SELECT p.id, concat_ws(' > ', a.heading, b.heading, c.heading, d.heading) AS headings FROM pathed p
  LEFT JOIN headed a ON a.id = p.p0 AND p.p0 <> p.id LEFT JOIN headed b ON b.id = p.p1 AND p.p1 <> p.id LEFT JOIN headed c ON c.id = p.p2 AND p.p2 <> p.id LEFT JOIN headed d ON d.id = p.p3 AND p.p3 <> p.id)
SELECT n.id, CASE WHEN body IS NOT NULL THEN CASE WHEN headings <> '' THEN headings || ' | ' ELSE '' END || body END AS text, body
FROM (SELECT id, {_BODY} AS body FROM node) n JOIN above ON above.id = n.id""",
    "tree_display": f"""WITH {SQL}, refs AS (SELECT id, {_REF} AS ref FROM node)
SELECT c.desc_id AS id, string_agg(r.ref, ' / ' ORDER BY c.dist DESC) AS display_path, max(CASE WHEN c.dist = 0 THEN r.ref END) AS display_ref FROM closure c JOIN refs r ON c.anc = r.id GROUP BY c.desc_id""",
    "graph_upsert_edges": f"WITH {SQL} SELECT src, type, dst, min(ref_text) AS ref_text FROM edge WHERE type IN ('CITES', 'AMENDS', 'HAS_PART') AND src IN (SELECT id FROM node) AND dst IN (SELECT id FROM node) GROUP BY src, type, dst",
    "graph_expand": f"""WITH {SQL}, anchors AS (SELECT id AS anchor, celex AS own FROM node WHERE kind = 'article'),
cited AS (SELECT a.anchor, a.own, e.dst AS id, min(c.dist) AS dist FROM anchors a JOIN closure c ON c.anc = a.anchor AND c.dist <= 5 JOIN edge e ON e.src = c.desc_id AND e.type = 'CITES' GROUP BY a.anchor, a.own, e.dst),
bags AS (SELECT anchor, 'parent' AS bag, dist, anc AS id FROM anchors JOIN closure ON desc_id = anchor WHERE dist BETWEEN 1 AND 3
 UNION ALL SELECT anchor, 'child', dist, desc_id FROM anchors JOIN closure ON anc = anchor WHERE dist BETWEEN 1 AND 5
 UNION ALL SELECT anchor, CASE WHEN celex = own THEN 'internal' ELSE 'cross' END, dist, node.id FROM cited JOIN node ON node.id = cited.id WHERE node.id <> anchor
 UNION ALL SELECT anchor, 'interpreted_by', 1, src FROM anchors JOIN edge ON dst = anchor AND type = 'INTERPRETS'),
ranked AS (SELECT anchor, bag, CAST(row_number() OVER (PARTITION BY anchor, bag ORDER BY dist, id) AS INTEGER) AS rank, id FROM bags)
SELECT * FROM ranked WHERE rank <= CASE bag WHEN 'parent' THEN 3 WHEN 'child' THEN 60 WHEN 'internal' THEN 12 WHEN 'cross' THEN 8 ELSE 4 END""",
    "graph_reverse_cross": f"""WITH {SQL}, counted AS (SELECT t.id AS target, a.id, count(*) AS n FROM node t JOIN edge e ON e.dst = t.id AND e.type = 'CITES' JOIN closure c ON c.desc_id = e.src JOIN node a ON a.id = c.anc AND a.kind = 'article' AND a.celex <> t.celex WHERE t.kind = 'article' GROUP BY t.id, a.id)
SELECT target, id, n FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, id) AS r FROM counted) WHERE r <= 10""",
    "graph_citing": f"""WITH {SQL}, nearest AS (SELECT desc_id, anc AS id FROM (SELECT c.*, row_number() OVER (PARTITION BY desc_id ORDER BY dist) AS r FROM closure c JOIN node n ON n.id = c.anc AND n.kind IN ('article', 'document')) WHERE r = 1)
SELECT t.id AS target, x.id, count(DISTINCT e.src) AS n FROM node t JOIN closure c ON c.anc = t.id AND c.dist <= 6 JOIN edge e ON e.dst = c.desc_id AND e.type = 'CITES' JOIN nearest x ON x.desc_id = e.src WHERE t.kind = 'chapter' AND x.id <> t.id GROUP BY t.id, x.id""",
    "graph_amendments": f"""WITH {SQL} SELECT target, CAST(rank AS INTEGER) AS rank, id, ref_text FROM (SELECT n.id AS target, e.src AS id, e.ref_text, row_number() OVER (PARTITION BY n.id ORDER BY c.dist, e.src) AS rank FROM node n JOIN closure c ON c.desc_id = n.id AND c.dist <= 4 JOIN edge e ON e.dst = c.anc AND e.type = 'AMENDS' WHERE n.kind = 'paragraph') WHERE rank <= 10""",
    "graph_roles": f"""WITH {SQL}, roles AS (SELECT DISTINCT dst AS role FROM edge WHERE type = 'OBLIGATION_OF'),
wide AS (SELECT role, role AS member FROM roles UNION SELECT role, 'ROLE:' || ((CAST(substr(role, 6) AS INTEGER) * 3 + 1) % 25) FROM roles),
found AS (SELECT DISTINCT role, n.id, n.kind FROM wide JOIN edge e ON e.dst = member AND e.type = 'OBLIGATION_OF' JOIN node n ON n.id = e.src)
SELECT role, CAST(rank AS INTEGER) AS rank, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY CASE WHEN kind = 'article' THEN 0 ELSE 1 END, id) AS rank FROM found) WHERE rank <= 400""",
    "graph_chain": f"""WITH {SQL}, t AS (SELECT DISTINCT src, dst FROM edge WHERE type = 'TRIGGERS'), s AS (SELECT id FROM node WHERE kind = 'article')
SELECT seed, id, min(hop) AS hop FROM (SELECT id AS seed, id, 0 AS hop FROM s UNION ALL SELECT id, dst, 1 FROM s JOIN t ON src = id UNION ALL SELECT s.id, b.dst, 2 FROM s JOIN t a ON a.src = s.id JOIN t b ON b.src = a.dst) GROUP BY seed, id""",
    "graph_drilldown": f"""WITH {SQL}, heads AS (SELECT DISTINCT n.id AS container FROM edge e JOIN node n ON n.id = e.dst WHERE e.type = 'CITES' AND length(n.text) <= 80)
SELECT container, CAST(rank AS INTEGER) AS rank, id, substr(text, 1, 500) AS text FROM (SELECT container, n.id, n.text, row_number() OVER (PARTITION BY container ORDER BY ord, n.id) AS rank FROM heads JOIN node n ON n.parent_id = container) WHERE rank <= 8""",
}
