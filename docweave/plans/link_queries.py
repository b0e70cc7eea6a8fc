"""Linking, extraction and verification queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import linking, rules, spans, tree, verify
from docweave.operators import text as texts
from docweave.sources import corpus
from docweave.sources.corpus import SQL, table


def _terms(spark, sf_dir):
    """First one and first two words of the benchmark items."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    item = table(spark, sf_dir, "benchmark").select(words.alias("w")).filter(F.size("w") > 1)
    return item.select(F.explode(F.array(F.get("w", F.lit(0)), F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))))).alias("term")).distinct()


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def dictionary_links(spark, sf_dir):
    return linking.dictionary_links(_documents(spark, sf_dir), _terms(spark, sf_dir))


def token_links(spark, sf_dir):
    return linking.token_links(_documents(spark, sf_dir), _terms(spark, sf_dir))


def catalogue_links(spark, sf_dir):
    line = corpus.leaves(spark, sf_dir).select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), F.col("l_suppkey") % 40).alias("number"), F.concat(F.lit("REG"), F.col("l_partkey") % 5).alias("celex"))
    catalogue = table(spark, sf_dir, "nation").select(F.concat(F.lit("S"), "n_nationkey").alias("number"), F.concat(F.lit("REG"), "n_regionkey").alias("target"))
    return linking.catalogue_status(line, catalogue)


def curated_targets(spark, sf_dir):
    pathed = corpus.with_paths(corpus.nodes(spark, sf_dir).filter("depth <= 2"), corpus.LEVELS)
    node = pathed.join(tree.display_path(pathed), "id").select("id", "celex", "depth", F.when(F.col("kind") == "article", F.concat(F.lit("Article "), F.col("ord") % 200)).otherwise(F.col("display_ref")).alias("display_ref"))
    customer = table(spark, sf_dir, "customer")
    wanted = customer.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ARTICLE "), F.col("c_custkey"))).otherwise(F.concat(F.lit("C:"), F.col("c_custkey"))).alias("ref"), F.concat(F.lit("REG"), F.col("c_custkey") % 5).alias("celex")).distinct()
    return linking.curated_targets(wanted, node)


def lookup_refs(spark, sf_dir):
    node = corpus.nodes(spark, sf_dir).filter("kind in ('article', 'point')")
    node = node.select("id", "depth", F.when(F.col("kind") == "article", F.concat(F.lit("Article "), "ord")).otherwise(F.concat(F.lit("Article "), F.regexp_extract("id", r"^L:(\d+)\.", 1), F.lit("("), "ord", F.lit(")"))).alias("display_ref")).withColumn("key", texts.reference_key(F.col("display_ref")))
    line = corpus.leaves(spark, sf_dir)
    wanted = line.select(F.concat(F.lit("Article "), "l_suppkey", F.lit("("), F.col("l_linenumber") + F.col("l_partkey") % 4, F.lit(")")).alias("ref")).distinct().withColumn("key", texts.reference_key(F.col("ref")))
    return linking.lookup_refs(wanted, node)


def first_definitions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.concat(F.lit("REG"), F.col("p_partkey") % 5).alias("celex"), F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("'"), "p_name", F.lit("' means a thing"))).otherwise(F.col("p_name")).alias("text"))
    return linking.first_definitions(rows)


def delegations(spark, sf_dir):
    """Citing points whose text has a delegation phrase, by phrase."""
    line = corpus.leaves(spark, sf_dir).select("l_orderkey", "l_linenumber", F.concat(F.lit("Goods "), F.element_at(F.array(*map(F.lit, ("set out in", "of", "Listed in", "shall comply with", "near"))), (F.col("l_partkey") % 5 + 1).cast("int")), F.lit(" Annex I")).alias("text"))
    return line.select("l_orderkey", "l_linenumber", rules.delegation_phrase(F.col("text")).alias("phrase")).filter("phrase is not null")


def extracted_references(spark, sf_dir):
    """References in the points' own texts."""
    found = spans.spans(corpus.points(spark, sf_dir), "text", "spans").select("id", F.explode("spans").alias("s"))
    return found.select("id", "s.kind", "s.start", "s.end", "s.match", F.col("s.groups")["article"].alias("article"), F.col("s.groups")["paragraph"].alias("paragraph"))


def quote_grounding(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("source"))
    return verify.grounding(quotes, sources)


def near_quotes(spark, sf_dir):
    """Quotes changed at the start (the second word), in the middle (at a third) or at the end against the documents; quote_id is item:place."""
    words = F.split("text", " ")
    put = lambda at: F.array_join(F.transform(words, lambda w, k: F.when(k == at, F.lit("more")).otherwise(w)), " ")
    changed = {"start": put(F.lit(1)), "middle": put(F.floor(F.size(words) / 3)), "end": F.concat(F.col("text"), F.lit(" more"))}
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), q.alias("quote")) for k, q in changed.items()))).alias("x")
    quotes = table(spark, sf_dir, "benchmark").select("item_id", places).select(F.concat_ws(":", "item_id", "x.place").alias("quote_id"), "x.quote")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("source"))
    return verify.near_grounding(verify.candidates(quotes, sources))


def phantom_guard(spark, sf_dir):
    """Answers of three lines that name articles; known are those up to 60 of the suppliers."""
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("See Article "), F.col("o_orderkey") % 150, F.lit("\nand\nAnnex "), F.when(F.col("o_orderkey") % 2 == 0, "II").otherwise("IV"), F.lit(" with Article "), F.col("o_orderkey") % 7).alias("text"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey < 60").select(F.concat(F.lit("Article "), "s_suppkey").alias("family")).unionByName(spark.range(1).select(F.lit("Annex II").alias("family")))
    return verify.phantom_lines(order, known)


def uncovered_citations(spark, sf_dir):
    """Points of returned lines that a customer's retrieved orders do not cover."""
    pathed = corpus.with_paths(corpus.nodes(spark, sf_dir), corpus.LEVELS)
    line = corpus.leaves(spark, sf_dir).filter("l_returnflag = 'R'").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    wanted = line.select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("L:"), "l_orderkey", F.lit("."), "l_linenumber").alias("id"))
    found = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("O:"), "o_orderkey").alias("id"))
    return verify.missing_citations(wanted, found, tree.closure(pathed).select(F.col("desc_id").alias("id"), "anc"))


def answer_keys(spark, sf_dir):
    """Each part's text against two slots of alternatives."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.concat("p_name", F.lit(" of size "), "p_size").alias("text"))
    keys = part.select("case_id", F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.lit("small").alias("alternative")), F.struct(F.lit(0).alias("slot"), F.lit("Red").alias("alternative")), F.struct(F.lit(1).alias("slot"), F.lit("size 1").alias("alternative")), F.struct(F.lit(1).alias("slot"), F.lit("5").alias("alternative")))).alias("x")).select("case_id", "x.slot", "x.alternative")
    return verify.answer_recall(part, keys)


def inline_references(spark, sf_dir):
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Article "), F.col("o_orderkey") % 9, F.lit(" then Annex II, Article 3 and Article "), F.col("o_orderkey") % 4, F.lit("(2)")).alias("text"))
    return order.select("o_orderkey", F.array_join(spans.ordered_refs(F.col("text")), "; ").alias("refs"))


QUERIES = {f.__name__: f for f in (dictionary_links, token_links, catalogue_links, curated_targets, lookup_refs, first_definitions, delegations, extracted_references, quote_grounding, near_quotes, phantom_guard, uncovered_citations, answer_keys, inline_references)}

_LINKS = """WITH split AS (SELECT list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
terms AS (SELECT DISTINCT unnest([w[1], w[1] || ' ' || w[2]]) AS term FROM split WHERE len(w) > 1),
pattern AS (SELECT ' (' || string_agg(replace(term, ' ', '  '), '|' ORDER BY length(term) DESC, term) || ') ' AS p FROM terms),
padded AS (SELECT doc_id AS id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', '  ', 'g') || ' ' AS t FROM documents),
found AS (SELECT id, unnest(regexp_extract_all(t, p, 1)) AS term FROM padded, pattern)
SELECT id, replace(term, '  ', ' ') AS term, count(*) AS n FROM found GROUP BY id, term"""

ORACLE_SQL = {
    "dictionary_links": _LINKS,
    "token_links": _LINKS,
    "catalogue_links": f"""WITH {SQL}, r AS (SELECT l_orderkey, l_linenumber, 'S' || (l_suppkey % 40) AS number, 'REG' || (l_partkey % 5) AS celex FROM leaf)
SELECT r.*, 'REG' || n_regionkey AS target, CASE WHEN n_regionkey IS NULL THEN 'skip' WHEN 'REG' || n_regionkey = celex THEN 'self' ELSE 'resolvable' END AS status FROM r LEFT JOIN nation ON number = 'S' || n_nationkey""",
    "curated_targets": f"""WITH {SQL}, x AS (SELECT id, celex, depth, lower(CASE WHEN kind = 'article' THEN 'Article ' || (ord % 200) ELSE upper(substr(kind, 1, 1)) || substr(kind, 2) || ' ' || ord END) AS key FROM node WHERE depth <= 2),
wanted AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'ARTICLE ' || c_custkey ELSE 'C:' || c_custkey END AS ref, 'REG' || (c_custkey % 5) AS celex FROM customer),
hits AS (SELECT w.ref, w.celex, x.id, x.depth, CASE WHEN x.id = w.ref THEN 0 ELSE 1 END AS exact FROM wanted w JOIN x ON x.celex = w.celex AND (x.id = w.ref OR x.key = lower(w.ref))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref, celex ORDER BY exact, depth, id) AS r, count(*) OVER (PARTITION BY ref, celex) AS n, min(exact) OVER (PARTITION BY ref, celex) AS e FROM hits) WHERE r = 1)
SELECT w.ref, w.celex, b.id, CASE WHEN b.id IS NULL THEN 'unresolved' WHEN e = 0 OR n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM wanted w LEFT JOIN best b ON w.ref = b.ref AND w.celex = b.celex""",
    "lookup_refs": f"""WITH {SQL}, x AS (SELECT id, depth, 'article' || ord AS key FROM node WHERE kind = 'article' UNION ALL SELECT id, depth, 'article' || regexp_extract(id, '^L:([0-9]+)', 1) || '(' || ord || ')' FROM node WHERE kind = 'point'),
wanted AS (SELECT DISTINCT 'Article ' || l_suppkey || '(' || (l_linenumber + l_partkey % 4) || ')' AS ref, 'article' || l_suppkey || '(' || (l_linenumber + l_partkey % 4) || ')' AS key, 'article' || l_suppkey AS up FROM leaf),
hits AS (SELECT ref, id, depth FROM wanted JOIN x USING (key) UNION ALL SELECT ref, id, depth FROM wanted w JOIN x ON x.key = w.up WHERE w.key NOT IN (SELECT key FROM x))
SELECT ref, CAST(rank AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY depth, id) AS rank FROM hits) WHERE rank <= 8""",
    "first_definitions": """SELECT celex, replace(p_name, ' ', '_') AS term_key, p_partkey AS id, p_name AS term FROM (SELECT *, 'REG' || (p_partkey % 5) AS celex, row_number() OVER (PARTITION BY p_partkey % 5, p_name ORDER BY p_partkey) AS r FROM part WHERE p_size % 3 > 0) WHERE r = 1""",
    "delegations": f"WITH {SQL} SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'set out in' WHEN 2 THEN 'Listed in' WHEN 3 THEN 'shall comply' END AS phrase FROM leaf) WHERE phrase IS NOT NULL",
    "extracted_references": f"""WITH {SQL} SELECT 'L:' || l_orderkey || '.' || l_linenumber AS id, 'explicit' AS kind, 13 AS start, 13 + length(m) AS "end", m AS match, CAST(l_suppkey AS VARCHAR) AS article, CAST(l_linenumber AS VARCHAR) AS paragraph
FROM (SELECT *, 'Article ' || l_suppkey || '(' || l_linenumber || ')' AS m FROM leaf)""",
    "quote_grounding": "SELECT item_id AS quote_id, CASE WHEN n > 0 THEN 'exact' ELSE 'absent' END AS verdict, n FROM (SELECT b.item_id, count(d.doc_id) AS n FROM benchmark b LEFT JOIN documents d ON strpos(regexp_replace(d.text, '\\s+', ' ', 'g'), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) > 0 GROUP BY b.item_id)",
    "phantom_guard": """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 150 AS x, o_orderkey % 2 = 0 AS even, o_orderkey % 7 AS y, (SELECT count(*) FROM supplier WHERE s_suppkey < 60) AS m FROM orders)
SELECT k AS answer_id, CASE WHEN x < m THEN 'See Article ' || x || chr(10) ELSE '' END || 'and' || CASE WHEN even AND y < m THEN chr(10) || 'Annex II with Article ' || y ELSE '' END AS text, CAST((x >= m) AS BIGINT) + CAST(NOT (even AND y < m) AS BIGINT) AS removed FROM a""",
    "uncovered_citations": f"WITH {SQL} SELECT o_custkey AS case_id, 'L:' || l_orderkey || '.' || l_linenumber AS id FROM leaf JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus <> 'F'",
    "answer_keys": """SELECT p_partkey AS case_id, round((CASE WHEN p_name LIKE 'small %' OR p_name LIKE 'red %' THEN 1 ELSE 0 END + CASE WHEN p_size IN (1, 5) THEN 1 ELSE 0 END) / 2.0, 6) AS recall FROM part""",
    "inline_references": """SELECT o_orderkey, array_to_string(list_filter([a, 'Annex II', CASE WHEN a <> 'Article 3' THEN 'Article 3' END, b], lambda v: v IS NOT NULL), '; ') AS refs FROM (SELECT o_orderkey, 'Article ' || (o_orderkey % 9) AS a, 'Article ' || (o_orderkey % 4) || '(2)' AS b FROM orders)""",
}
