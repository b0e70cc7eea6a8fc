"""Queries of the decision lists over sentences assembled from the tables; the SQL states the expected outcome of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import rules, text
from docweave.sources import corpus
from docweave.sources.corpus import SQL, table

#: title, text, kind, expected role and rule
PROVISIONS = [
    (None, "(3) 'provider' means a natural or legal person", "point", "DEFINES.quoted_means"),
    ("Penalties", "Member States shall act.", "article", "PENALTY.title"),
    (None, "Authorities may impose administrative fines.", "paragraph", "PENALTY.keyword"),
    ("Scope", "anything", "article", "SCOPE.title"),
    (None, "1. This Regulation applies to devices.", "paragraph", "SCOPE.opening_phrase"),
    ("Derogations", "The provider shall report.", "article", "EXEMPTS.title"),
    (None, "Paragraph 1 shall not apply where the provider is small.", "paragraph", "EXEMPTS.shall_not_apply"),
    (None, "All goods with the exception of toys.", "point", "EXEMPTS.exception_of"),
    (None, "An importer shall be considered a manufacturer when it relabels.", "paragraph", "EXTENDS_STATUS.deemed_actor"),
    (None, "Providers shall not place such goods on the market.", "paragraph", "PROHIBITION.explicit"),
    ("Rule 11", "Software is in class IIa.", "article", "CLASSIFICATION.rule_title"),
    (None, "Such devices are classified as class III.", "point", "CLASSIFICATION.class_assignment"),
    (None, "The system shall be deemed to be high-risk.", "point", "CLASSIFICATION.deemed_high_risk"),
    ("Conformity assessment", "The steps are listed.", "article", "PROCEDURAL.title"),
    (None, "The deployer shall keep logs.", "paragraph", "OBLIGATION.actor_shall"),
    (None, "It shall rain.", "paragraph", "UNCLASSIFIED.no_rule_matched"),
    (None, "Whereas the provider shall act.", "recital", "INTERPRETIVE.recital_kind"),
    ("Chapter", "The provider shall act.", "chapter", "STRUCTURAL.container_kind"),
    (None, "  ", "point", "UNCLASSIFIED.empty_text"),
]
QUESTIONS = [
    ("Which articles refer to Article 6 of the AI Act?", "reverse_reference"),
    ("Under the AI Act and the MDR, is our hospital device high-risk?", "legal_qualification"),
    ("How do the GDPR and the AI Act interact?", "cross_regulation"),
    ("What does Article 10 say?", "provision_lookup"),
    ("What is a notified thing?", "definition_lookup"),
    ("How does classification work under the AI Act?", "classification_chain"),
    ("Give an overview of the GDPR", "community_summary_search"),
    ("What must importers keep?", "role_obligations"),
    ("Tell me of the GDPR, the MDR", "cross_regulation"),
    ("How long does it take?", "general_compliance"),
]
SENTENCES = [("en", "You shall not pass", "prohibition"), ("en", "You shall pass.", "obligation"), ("en", "You may pass", "permission"), ("en", "It denotes a pass", "definition"), ("de", "Man darf nicht gehen", "prohibition"), ("de", "Man muss gehen", "obligation"), ("fr", "Il peut aller", "permission"), ("es", "They must go", "obligation"), ("fr", "Ce mot signifie aller", "definition"), ("de", "You shall", "other")]
DIRECTIVES = [("Article 2 is amended as follows: points are inserted", "amend"), ("point 3 is replaced by the following", "replace"), ("the following points are inserted", "insert"), ("a sentence is added", "add"), ("paragraph 4 is deleted", "delete"), ("nothing changes", "unknown")]
TERMS = [("provider", "a natural or legal person; who", "actor"), ("market authority", "some unit", "body"), ("device", "a thing. natural or legal person", "other")]


def _choice(df, key, options, fields):
    """Adds a row of options, by key modulo their number."""
    made = F.array(*[F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields, row)]) for row in options])
    return df.withColumn("x", F.get(made, F.pmod(F.col(key), F.lit(len(options))).cast("int")))


def classify_provisions(spark, sf_dir):
    line = _choice(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", PROVISIONS, ["title", "text", "kind", "want"])
    return line.select("id", rules.provision_role(F.col("x.kind"), F.col("x.title"), F.col("x.text"), F.lit(False)).alias("role"))


def route_questions(spark, sf_dir):
    asked = _choice(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), "id", QUESTIONS, ["question", "want"]).select("id", F.col("x.question").alias("q"))
    q = F.col("q")
    return asked.select("id", rules.question_route(q, rules.question_refs(q), rules.question_acts(q), rules.question_roles(q)).alias("route"))


def classify_modality(spark, sf_dir):
    rows = _choice(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", SENTENCES, ["lang", "text", "want"])
    return rows.select("id", rules.modality(F.col("x.text"), F.col("x.lang")).alias("modality"))


def classify_amendments(spark, sf_dir):
    rows = _choice(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", DIRECTIVES, ["text", "want"])
    return rows.select("id", rules.amendment_verb(F.col("x.text")).alias("verb"))


def classify_terms(spark, sf_dir):
    rows = _choice(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", TERMS, ["term", "body", "want"])
    return rows.select("id", rules.term_category(F.col("x.term"), F.col("x.body")).alias("category"))


def modality_counts(spark, sf_dir):
    """Roles of the tree's provisions by kind."""
    node = corpus.nodes(spark, sf_dir)
    return node.select("kind", rules.role_modality(F.col("title"), F.col("text")).alias("modality")).groupBy("kind", "modality").agg(F.count("*").alias("n"))


def reference_forms(spark, sf_dir):
    """Forms of references made of line and supplier numbers."""
    line = corpus.leaves(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey")
    ref = F.concat(F.lit("Article "), "l_suppkey", F.lit("("), "l_linenumber", F.lit("), point (a)"))
    node = F.concat(F.lit("32017R0745_"), text.padded(F.col("l_suppkey").cast("string")), F.lit("."), text.padded(F.col("l_linenumber").cast("string")))
    return line.select("l_orderkey", "l_linenumber", text.reference_key(ref).alias("ref_key"), text.base_family(ref).alias("family"), text.human_reference(node).alias("human"), text.numeric_act(F.substring_index(node, "_", 1)).alias("act"), text.slug(ref).alias("slug"), text.natural_key(ref).alias("natural"))


def expanded_ranges(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" to "), (F.col("p_size") + 3).cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") + 2).cast("string"), F.lit(" and "), (F.col("p_size") + 9).cast("string"))).alias("t"))
    return part.select("p_partkey", F.explode(text.expand_range(F.col("t"))).alias("article"))


def folded_titles(spark, sf_dir):
    doc = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("**A**–B ’ "), "text").alias("t"))
    return doc.select("item_id", text.folded(F.col("t")).alias("folded"))


QUERIES = {f.__name__: f for f in (classify_provisions, route_questions, classify_modality, classify_amendments, classify_terms, modality_counts, reference_forms, expanded_ranges, folded_titles)}


def _case(key, options):
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {k} THEN '{row[-1]}'" for k, row in enumerate(options)) + " END"


ORACLE_SQL = {
    "classify_provisions": f"SELECT o_orderkey AS id, {_case('o_orderkey', PROVISIONS)} AS role FROM orders",
    "route_questions": f"SELECT event_id AS id, {_case('event_id', QUESTIONS)} AS route FROM events",
    "classify_modality": f"SELECT o_orderkey AS id, {_case('o_orderkey', SENTENCES)} AS modality FROM orders",
    "classify_amendments": f"SELECT c_custkey AS id, {_case('c_custkey', DIRECTIVES)} AS verb FROM customer",
    "classify_terms": f"SELECT c_custkey AS id, {_case('c_custkey', TERMS)} AS category FROM customer",
    "modality_counts": f"""WITH {SQL} SELECT kind, modality, count(*) AS n FROM (SELECT kind, CASE WHEN lower(coalesce(title, '')) LIKE '%obligation%' THEN 'obligation' WHEN lower(text) LIKE '%shall not%' OR lower(text) LIKE '%must not%' THEN 'prohibition'
WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(shall|must)([^a-z0-9_]|$)') THEN 'obligation' END AS modality FROM node) GROUP BY kind, modality""",
    "reference_forms": f"""WITH {SQL} SELECT l_orderkey, l_linenumber, 'article' || l_suppkey || '(' || l_linenumber || ')(a)' AS ref_key, 'Article ' || l_suppkey AS family, 'Article ' || l_suppkey || '(' || l_linenumber || ')' AS human, '2017/745' AS act,
'article_' || l_suppkey || '_' || l_linenumber || '_point_a' AS slug, 'Article ' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '(' || lpad(CAST(l_linenumber AS VARCHAR), 12, '0') || '), point (a)' AS "natural" FROM leaf""",
    "expanded_ranges": "SELECT p_partkey, CAST(unnest(CASE WHEN p_size % 2 = 0 THEN range(p_size, p_size + 4) ELSE [p_size, p_size + 2, p_size + 9] END) AS INTEGER) AS article FROM part",
    "folded_titles": """SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace('a b '' ' || lower(regexp_replace(text, '\\*\\*|__|\\*', '', 'g')), '[-‐‑‒–—―−]', ' ', 'g'), '[‘’‚‛`´ʼ]', '''', 'g'), '\\s+', ' ', 'g')) AS folded FROM benchmark""",
}
