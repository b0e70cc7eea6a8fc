"""Acts rendered from the tables as legal HTML, in both layouts, and parsed; the SQL states the tree from the tables alone."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions.storage import cut
from docweave.sources import corpus, legal_html
from docweave.sources.corpus import SQL, table


def _pages(spark, sf_dir):
    """One page a customer: orders are articles, lines with an even part paragraphs, others trail them; each has points by its supplier. Odd customers have the consolidated layout."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    line = corpus.leaves(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: c.cast("string")
    consolidated = F.col("o_custkey") % 2 == 1
    flag = F.concat(F.lit("Flag "), "l_returnflag", F.lit(" holds:"))
    old_point = F.concat(F.lit('<table width="100%"><tr><td>(a)</td><td>supplier '), text(F.col("l_suppkey")), F.lit("</td></tr></table>"))
    new_point = F.concat(F.lit('<div class="grid-container grid-list"><div class="grid-list-column-1">(a)</div><div class="grid-list-column-2"><p class="norm">supplier '), text(F.col("l_suppkey")), F.lit("</p></div></div>"))
    local = F.concat(F.lpad(text(F.col("n")), 3, "0"), F.lit("."), F.lpad(text(F.col("l_linenumber")), 3, "0"))
    old = F.concat(F.lit('<div id="'), local, F.lit('"><p class="oj-normal">'), flag, F.lit("</p>"), old_point, F.lit("</div>"), F.when(F.col("l_suppkey") % 3 == 0, F.lit('<p class="oj-normal">It goes on.</p>')).otherwise(F.lit("")))
    new = F.concat(F.lit('<div class="norm"><span class="no-parag">'), text(F.col("l_linenumber")), F.lit('. </span><span class="boldface">►M1</span><div class="inline-element">'), flag, new_point, F.lit("</div></div>"))
    paragraphs = rows.select("o_custkey", "n", "o_orderpriority", F.struct("l_linenumber", F.when(consolidated, new).otherwise(old).alias("html")).alias("p"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["html"]), "")
    head = F.concat(F.lit('<div id="art_'), text(F.col("n")), F.lit('"><div id="art_'), text(F.col("n")), F.lit('.tit_1"><p>'), "o_orderpriority", F.lit("</p></div>"))
    articles = paragraphs.groupBy("o_custkey", "n", "o_orderpriority").agg(join("p").alias("body")).select("o_custkey", F.struct("n", F.concat(head, "body", F.lit("</div>")).alias("html")).alias("a"))
    acts = articles.groupBy("o_custkey").agg(join("a").alias("body"))
    page = F.concat(F.lit('<html><div class="eli-main-title" id="tit_1">Act '), text(F.col("o_custkey")), F.lit('</div><div id="enc_1">'), "body", F.lit("</div></html>"))
    return acts.select(F.concat(F.lit("K"), text(F.col("o_custkey"))).alias("celex"), page.alias("html"))


def parsed_acts(spark, sf_dir):
    return legal_html.parse(_pages(spark, sf_dir), ("id", "kind", "number", "title", "text", "parent_id", "depth"))


def page_diagnosis(spark, sf_dir):
    """Structural ids on the pages, by act."""
    found = legal_html.diagnosis(_pages(spark, sf_dir))
    return found.filter(F.col("what").isin("id:article", "id:paragraph", "tag:table", "class:no-parag"))


def parsed_integrity(spark, sf_dir):
    """Nodes whose parent, path or place in it is wrong, of the parsed acts: none but one row of counts."""
    rows = cut(legal_html.parse(_pages(spark, sf_dir), ("id", "parent_id", "path", "depth")))
    parent = rows.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
    both = rows.join(parent, "parent_id", "left")
    bad = (F.col("parent_id").isNotNull() & F.col("above").isNull()) | (F.col("above").isNotNull() & (F.concat("above", F.array("id")) != F.col("path"))) | (F.col("depth") != F.size("path") - 1)
    return both.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad"))


QUERIES = {f.__name__: f for f in (parsed_acts, page_diagnosis, parsed_integrity)}

_TREE = f"""WITH {SQL}, o AS (SELECT o_orderkey, o_custkey AS c, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
l AS (SELECT o.*, 'K' || c || '_' AS act, l_linenumber AS k, l_suppkey AS s, l_returnflag AS f, lpad(CAST(n AS VARCHAR), 3, '0') || '.' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS local, c % 2 = 0 AND l_suppkey % 3 = 0 AS more FROM leaf JOIN o ON l_orderkey = o_orderkey),
tree AS (SELECT DISTINCT act || 'document' AS id, 'document' AS kind, CAST(NULL AS VARCHAR) AS number, CAST(NULL AS VARCHAR) AS title, 'Act ' || c AS text, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth FROM l
UNION ALL SELECT DISTINCT act || 'enc_1', 'enacting_terms', NULL, NULL, '', act || 'document', 1 FROM l
UNION ALL SELECT DISTINCT act || 'art_' || n, 'article', CAST(n AS VARCHAR), title, title, act || 'enc_1', 2 FROM l
UNION ALL SELECT act || local, 'paragraph', CAST(k AS VARCHAR), NULL, CASE WHEN more THEN '' ELSE 'Flag ' || f || ' holds:' END, act || 'art_' || n, 3 FROM l
UNION ALL SELECT act || local || '_sp_1', 'subparagraph', '1', NULL, 'Flag ' || f || ' holds:', act || local, 4 FROM l WHERE more
UNION ALL SELECT act || local || '_sp_2', 'subparagraph', '2', NULL, 'It goes on.', act || local, 4 FROM l WHERE more
UNION ALL SELECT act || local || CASE WHEN more THEN '_sp_1' ELSE '' END || '_pt_a', 'point', 'a', NULL, 'supplier ' || s, act || local || CASE WHEN more THEN '_sp_1' ELSE '' END, CASE WHEN more THEN 5 ELSE 4 END FROM l)
"""

ORACLE_SQL = {
    "parsed_acts": _TREE + "SELECT * FROM tree",
    "parsed_integrity": _TREE + "SELECT count(*) AS n, count(DISTINCT id) AS ids, CAST(0 AS BIGINT) AS bad FROM tree",
    "page_diagnosis": _TREE
    + """SELECT 'K' || c AS celex, what, n FROM (SELECT c, 'id:article' AS what, count(DISTINCT n) AS n FROM l GROUP BY c UNION ALL SELECT c, 'id:paragraph', count(*) FROM l WHERE c % 2 = 0 GROUP BY c
UNION ALL SELECT c, 'tag:table', count(*) FROM l WHERE c % 2 = 0 GROUP BY c UNION ALL SELECT c, 'class:no-parag', count(*) FROM l WHERE c % 2 = 1 GROUP BY c)""",
}
