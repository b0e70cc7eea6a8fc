"""Audits of a parsed corpus and of answer runs: each gives rows of findings or counts, which an empty corpus passes.

Provisions have celex, id, kind, parent_id, text, title, display_ref. Defined results: null texts count as empty, repeated ids
each count, an act that one side lacks is a difference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.sources.corpus import first_by

# Containers that are not embedded, and dimensions of vectors.
NOT_EMBEDDED = ("document", "guidance_document", "preamble", "enacting_terms", "final_provisions", "annexes")
DIMENSIONS = (384, 768)
#: Text below an amending point that still counts as dropped.
LEAST_BELOW = 30
HUSK = r"(?i)(?:is|are)\s+(?:replaced by the following|inserted|added)\s*:\s*;?\s*$|the following [a-z -]+ (?:is|are) (?:inserted|added)\s*:\s*;?\s*$"


def source_parity(diagnosis: DataFrame, provisions: DataFrame) -> DataFrame:
    """celex, what, expected, actual of structural ids on the pages (celex, what: id:article ..., n) and parsed nodes, where they differ."""
    kinds = {"id:article": "article", "id:annex": "annex", "id:chapter": "chapter", "id:section": "section", "id:paragraph": "paragraph"}
    kind = reduce(lambda c, x: c.when(F.col("what") == x[0], F.lit(x[1])), kinds.items(), F.when(F.lit(False), F.lit("")))
    expected = diagnosis.withColumn("kind", kind).filter("kind is not null").groupBy("celex", "kind").agg(F.sum("n").alias("expected"))
    actual = provisions.filter(F.col("kind").isin(*kinds.values())).groupBy("celex", "kind").agg(F.count("*").alias("actual"))
    both = expected.join(actual, ["celex", "kind"], "full").select("celex", "kind", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.filter("expected <> actual")


def uncovered_ids(wanted: DataFrame, provisions: DataFrame) -> DataFrame:
    """Ids that a page has (celex, id) and the parsed act lacks."""
    return wanted.select("celex", "id").distinct().join(provisions.select("id"), "id", "left_anti").select("celex", "id")


def husks(provisions: DataFrame) -> DataFrame:
    """Amending points that end at their colon and have next to nothing below: their new text was lost."""
    below = provisions.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("below"))
    text = F.trim(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(" "), F.lit(" ")))
    return provisions.join(below, "id", "left").filter(text.rlike(HUSK) & (F.coalesce("below", F.lit(0)) < LEAST_BELOW)).select("celex", "id", F.substring(text, 1, 90).alias("text"))


def sampled_empty(provisions: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """Of n articles of each act, drawn by a hash, those without text: celex, id."""
    drawn = first_by(provisions.filter("kind = 'article'").withColumn("__h", F.xxhash64(F.lit(seed), "id")), ["celex"], ["__h", "id"], n)
    return drawn.filter("text is null or trim(text) = ''").select("celex", "id")


def heading_parity(sections: DataFrame, provisions: DataFrame) -> DataFrame:
    """celex, title, in_source, parsed: headings of guidance texts (celex, title) and parsed titles whose numbers differ, letter case and spaces aside."""
    key = F.lower(F.trim(F.regexp_replace("title", r"\s+", " "))).alias("title")
    a = sections.select("celex", key).groupBy("celex", "title").agg(F.count("*").alias("in_source"))
    b = provisions.filter("kind like 'guidance_%' and title is not null").select("celex", key).groupBy("celex", "title").agg(F.count("*").alias("parsed"))
    both = a.join(b, ["celex", "title"], "full").select("celex", "title", F.coalesce("in_source", F.lit(0)).alias("in_source"), F.coalesce("parsed", F.lit(0)).alias("parsed"))
    return both.filter("in_source <> parsed")


def readiness(provisions: DataFrame, vectors: DataFrame) -> DataFrame:
    """celex, no_vector, odd_dimension, no_ref: provisions that a read cannot use. vectors: id, embedding."""
    sized = vectors.select("id", F.size("embedding").alias("dim")).filter("embedding is not null") if "embedding" in vectors.columns else vectors
    rows = provisions.select("celex", "id", "kind", "display_ref").join(sized, "id", "left")
    wanted = ~F.col("kind").isin(*NOT_EMBEDDED)
    return rows.groupBy("celex").agg(F.count_if(wanted & F.col("dim").isNull()).alias("no_vector"), F.count_if(F.col("dim").isNotNull() & ~F.col("dim").isin(*DIMENSIONS)).alias("odd_dimension"), F.count_if((F.col("kind") == "article") & (F.coalesce("display_ref", F.lit("")) == "")).alias("no_ref"))


def rendered(provisions: DataFrame, shown: DataFrame) -> DataFrame:
    """Provisions whose text, spaces aside, the text shown for their root (celex, shown) does not have: celex, id."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    rows = provisions.filter("text is not null and trim(text) <> ''").join(shown, "celex", "left")
    return rows.filter(~F.coalesce(plain(F.col("shown")).contains(plain(F.col("text"))), F.lit(False))).select("celex", "id")


def lone_subparagraphs(provisions: DataFrame) -> DataFrame:
    """Subparagraphs whose parent is neither article nor paragraph, or that are the only one of theirs: celex, id, why."""
    parent = provisions.select(F.col("id").alias("parent_id"), F.col("kind").alias("above"))
    subs = provisions.filter("kind = 'subparagraph'")
    n = subs.groupBy("parent_id").agg(F.count("*").alias("n"))
    rows = subs.join(parent, "parent_id", "left").join(n, "parent_id", "left")
    why = F.when(F.col("above").isNull(), "no parent").when(~F.col("above").isin("article", "paragraph"), "parent").when(F.col("n") == 1, "single")
    return rows.withColumn("why", why).filter("why is not null").select("celex", "id", "why")


def ablation(with_graph: DataFrame, without: DataFrame, keys: DataFrame) -> DataFrame:
    """case_id, recall_with, recall_without, delta, recovered, lost of two runs (case_id, ref) against wanted citations (case_id, ref)."""
    flag = lambda run, name: keys.select("case_id", "ref").distinct().join(run.select("case_id", "ref").distinct().withColumn(name, F.lit(1)), ["case_id", "ref"], "left")
    both = flag(with_graph, "a").join(flag(without, "b"), ["case_id", "ref"]).na.fill(0, ["a", "b"])
    out = both.groupBy("case_id").agg(F.avg("a").alias("recall_with"), F.avg("b").alias("recall_without"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("recovered"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("lost"))
    rounded = [F.round(c, 6).alias(c) for c in ("recall_with", "recall_without")]
    return out.select("case_id", *rounded, F.round(F.col("recall_with") - F.col("recall_without"), 6).alias("delta"), "recovered", "lost")


def ablation_summary(deltas: DataFrame) -> DataFrame:
    """One row: mean recalls and delta, citations recovered and lost, cases improved, unchanged and regressed."""
    return deltas.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall_with", "recall_without", "delta")], F.coalesce(F.sum("recovered"), F.lit(0)).alias("recovered"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") == 0).alias("unchanged"), F.count_if(F.col("delta") < 0).alias("regressed"))


def authority_coverage(node: DataFrame) -> DataFrame:
    """celex, n, no_binding, no_source, forces, sources: where force and source of provisions are missing, and which occur."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return node.groupBy("celex").agg(F.count("*").alias("n"), F.count_if(empty("binding_force")).alias("no_binding"), F.count_if(empty("source_type")).alias("no_source"), F.array_sort(F.collect_set("binding_force")).alias("forces"), F.array_sort(F.collect_set("source_type")).alias("sources"))


def role_audit(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """role_id, obligations, parts, equivalents, defined: counts of each role's edges (src, type, dst), with zeros."""
    count = lambda kind, end: edges.filter(F.col("type") == kind).groupBy(F.col(end).alias("role_id")).agg(F.count("*").alias(kind))
    out = roles.select("role_id").distinct()
    for kind, end in (("OBLIGATION_OF", "dst"), ("INCLUDES_ROLE", "src"), ("EQUIVALENT_ROLE", "src"), ("INSTANTIATES", "dst")):
        out = out.join(count(kind, end), "role_id", "left")
    names = {"OBLIGATION_OF": "obligations", "INCLUDES_ROLE": "parts", "EQUIVALENT_ROLE": "equivalents", "INSTANTIATES": "defined"}
    return out.select("role_id", *[F.coalesce(k, F.lit(0)).alias(v) for k, v in names.items()])


def uncovered_roles(expected: DataFrame, roles: DataFrame, edges: DataFrame) -> DataFrame:
    """Roles that an act has to have (celex, term_key) without a node, or without any obligation: celex, term_key, why."""
    have = roles.select("celex", "term_key", "role_id")
    duty = edges.filter("type = 'OBLIGATION_OF'").select(F.col("dst").alias("role_id")).distinct().withColumn("duty", F.lit(True))
    rows = expected.join(have, ["celex", "term_key"], "left").join(duty, "role_id", "left")
    why = F.when(F.col("role_id").isNull(), "no role").when(F.col("duty").isNull(), "no obligation")
    return rows.withColumn("why", why).filter("why is not null").select("celex", "term_key", "why")


def grounded_wants(wants: DataFrame, provisions: DataFrame) -> DataFrame:
    """case_id, n, grounded, share: how many of an audit's wants (case_id, ref) name a provision that exists."""
    from docweave.operators.text import reference_key

    known = provisions.filter("display_ref is not null").select(reference_key(F.col("display_ref")).alias("key")).distinct().withColumn("there", F.lit(1))
    rows = wants.withColumn("key", reference_key(F.col("ref"))).join(known, "key", "left").groupBy("case_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("there"), F.lit(0)).alias("grounded"))
    return rows.withColumn("share", F.round(F.col("grounded") / F.col("n"), 6))


def flag_counts(answer: Column) -> Column:
    """Counts in the warning blocks of an answer: fabricated, misattributed, near, phantom, and quotes in all."""
    number = lambda pattern, group: F.coalesce(F.nullif(F.regexp_extract(answer, pattern, group), F.lit("")).cast("int"), F.lit(0))
    made, moved = r"(?i)FAITHFULNESS FLAG\*\*\s*[—-]\s*([0-9]+)\s+of\s+([0-9]+)", r"(?i)ATTRIBUTION FLAG\*\*\s*[—-]\s*([0-9]+)\s+of\s+([0-9]+)"
    return F.struct(number(made, 1).alias("fabricated"), number(moved, 1).alias("misattributed"), number(r"(?i)Wording check\*\*\s*[—-]\s*([0-9]+)\s+quote", 1).alias("near"), number(r"(?i)PHANTOM CITATION FLAG\*\*\s*[—-]\s*([0-9]+)\s+statement", 1).alias("phantom"), F.greatest(number(made, 2), number(moved, 2)).alias("quotes"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row of a graded run (score, fabricated, misattributed, near, phantom, timed_out, critical_defects): means, sums, the share without a critical defect."""
    return results.agg(F.count("*").alias("cases"), F.count("score").alias("graded"), F.round(F.avg("score"), 3).alias("mean"), F.round(F.median("score"), 2).alias("median"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fabricated", "misattributed", "near", "phantom")], F.count_if(F.coalesce("timed_out", F.lit(False))).alias("timed_out"), F.round(F.avg((F.size("critical_defects") == 0).cast("int")), 6).alias("clean"))
