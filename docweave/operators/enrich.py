"""Enrichment of provisions: force, applicability, captions, roles, pointers, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.sources.corpus import first_by

# Weights and levels of the confidence.
WEIGHTS = {"coverage": 0.35, "relevance": 0.20, "faithfulness": 0.20, "completeness": 0.10, "force": 0.15}
LEVELS = (("HIGH", 0.85), ("MEDIUM", 0.65), ("LOW", 0.40))
INTERPRETIVE, GUIDANCE = ("recital", "citation", "preamble"), "guidance"


def binding_force(kind: Column, stated: Column | None = None) -> Column:
    """As stated, else interpretive for recitals and the like, non_binding for guidance, binding for the rest."""
    derived = F.when(kind.isin(*INTERPRETIVE), "interpretive").when(kind.startswith(GUIDANCE), "non_binding").otherwise("binding")
    return derived if stated is None else F.coalesce(stated, derived)


def applicability(milestones: DataFrame, as_of: Column) -> DataFrame:
    """act, applied, pending, next: counts of milestones (act, date) at or before a day and after it, and the next one."""
    done = F.col("date") <= as_of
    return milestones.groupBy("act").agg(F.count_if(done).alias("applied"), F.count_if(~done).alias("pending"), F.min(F.when(~done, F.col("date"))).alias("next"))


def captions(node: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, caption: own title, else that of the seeds (id, seed_title), else the reference."""
    joined = node.join(seeds, "id", "left")
    return joined.select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "seed_title", "display_ref").alias("caption"))


def prefer(versions: DataFrame, key: str, preferred: Column) -> DataFrame:
    """One version of each key: the preferred one if there is one, then the smallest version."""
    return first_by(versions, [key], [F.when(preferred, 0).otherwise(1), "version"]).drop("rank")


def role_obligations(provisions: DataFrame, roles: DataFrame) -> DataFrame:
    """id, role: provisions (id, celex, title, first_sentence) of the role's act that name it, as whole words in any number, with a modal verb. roles: celex, role."""
    joined = provisions.join(roles, "celex")
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.concat_ws(" ", "title", "first_sentence")), "[^a-z0-9]+", " "), F.lit(" "))
    named = text.contains(F.concat(F.lit(" "), "role", F.lit(" "))) | text.contains(F.concat(F.lit(" "), "role", F.lit("s ")))
    modal = text.contains(" shall ") | text.contains(" must ")
    return joined.filter(named & modal).select("id", "role").distinct()


def pointers(bag: DataFrame, cites: DataFrame, most: int) -> DataFrame:
    """case_id, rank, id: what the rows of a bag (case_id, id, pos, celex) cite and the bag has not; other acts' first, then by place. cites: id, target, target_celex, place."""
    found = bag.join(cites, "id").withColumn("inside", (F.col("celex") == F.col("target_celex")).cast("int"))
    new = found.join(bag.select("case_id", F.col("id").alias("target")), ["case_id", "target"], "left_anti")
    each = new.groupBy("case_id", F.col("target").alias("id")).agg(F.min(F.struct("inside", "pos", "place")).alias("at"))
    return first_by(each, ["case_id"], ["at", "id"], most).select("case_id", "rank", "id")


def unanchored(bag: DataFrame) -> DataFrame:
    """case_id, celex of acts whose rows (case_id, celex, role) exempt something but define nothing."""
    return bag.groupBy("case_id", "celex").agg(F.max((F.col("role") == "EXEMPTS").cast("int")).alias("e"), F.max((F.col("role") == "DEFINES").cast("int")).alias("d")).filter("e = 1 and d = 0").select("case_id", "celex")


def composite(parts: dict[str, Column]) -> tuple[Column, Column]:
    """Weighted score, rounded to 3 places, and its level."""
    score = F.round(reduce(lambda a, b: a + b, [F.lit(w) * parts[k] for k, w in WEIGHTS.items()]), 3)
    level = reduce(lambda c, x: c.when(score >= x[1], x[0]), LEVELS[1:], F.when(score >= LEVELS[0][1], LEVELS[0][0])).otherwise("CRITICAL")
    return score, level


def samples(members: DataFrame, most: int) -> DataFrame:
    """community, text: its shallowest members' texts (depth, id, ref, text), each behind its reference, in order."""
    kept = first_by(members, ["community"], ["depth", "id"], most)
    line = F.concat(F.lit("["), "ref", F.lit("] "), "text")
    return kept.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def source_type(kind: Column, stated: Column | None = None) -> Column:
    """As stated, else guidance or regulation by kind."""
    derived = F.when(kind.startswith(GUIDANCE), "guidance").otherwise("regulation")
    return derived if stated is None else F.coalesce(stated, derived)


def applicability_status(acts: DataFrame, milestones: DataFrame, as_of: Column) -> DataFrame:
    """act, in_force, generally_applicable, applied, pending (arrays of date, scope, citation in order) as of a day.

    acts: act, entry_into_force, general_application. An act without milestones has empty arrays, one without a general date
    is not generally applicable.
    """
    one = F.struct("date", "scope", "citation")
    done = F.col("date") <= as_of
    lists = milestones.groupBy("act").agg(F.array_sort(F.collect_list(F.when(done, one))).alias("applied"), F.array_sort(F.collect_list(F.when(~done, one))).alias("pending"))
    kind = "array<struct<date:date,scope:string,citation:string>>"
    empty = F.array().cast(kind)
    return acts.join(lists, "act", "left").select("act", F.coalesce(F.col("entry_into_force") <= as_of, F.lit(False)).alias("in_force"), F.coalesce(F.col("general_application") <= as_of, F.lit(False)).alias("generally_applicable"), F.coalesce(F.col("applied").cast(kind), empty).alias("applied"), F.coalesce(F.col("pending").cast(kind), empty).alias("pending"))


def applicability_notes(acts: DataFrame, milestones: DataFrame, as_of: Column) -> DataFrame:
    """act, note: dates of an act of several milestones, or with one to come; others have no row. acts also has name."""
    state = applicability_status(acts, milestones, as_of).join(acts.select("act", "name", "entry_into_force", "general_application"), "act")
    state = state.filter((F.size("pending") > 0) | (F.size("applied") + F.size("pending") > 1))
    line = lambda x, mark: F.concat(F.lit("    - "), x["date"].cast("string"), F.lit(f" [{mark}] "), x["scope"], F.lit(" ("), x["citation"], F.lit(")"))
    lines = F.concat(F.transform("applied", lambda x: line(x, "applies")), F.transform("pending", lambda x: line(x, "NOT YET applicable")))
    general = F.when(~F.col("generally_applicable") & F.col("general_application").isNotNull(), F.concat(F.lit("; general application "), F.col("general_application").cast("string"))).otherwise(F.lit(""))
    head = F.concat("name", F.lit(" ("), "act", F.lit(") — in force since "), F.col("entry_into_force").cast("string"), general, F.lit(":"))
    return state.select("act", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("note"))


def community_captions(communities: DataFrame) -> DataFrame:
    """id, caption: the title of a community, else its label, else one made of its regulations and size."""
    made = F.concat(F.lit("Community of "), F.coalesce(F.col("member_count").cast("string"), F.lit("0")), F.lit(" provisions"), F.when(F.size("regulations") > 0, F.concat(F.lit(" in "), F.array_join(F.array_sort("regulations"), ", "))).otherwise(F.lit("")))
    return communities.select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("label"), F.lit("")), made).alias("caption"))


def completeness(passed: Column, corrective: Column, pointers_added: Column, roles_asked: Column, roles_found: Column) -> Column:
    """How complete a context is: less after a corrective read and without the roles asked for, more with what it points to."""
    score = F.when(passed, 1.0).otherwise(0.5) - F.when(corrective, 0.15).otherwise(0.0) + F.when(pointers_added, 0.1).otherwise(0.0) - F.when(roles_asked & ~roles_found, 0.25).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def inline_pointers(bag: DataFrame, node: DataFrame, most: int) -> DataFrame:
    """case_id, rank, id: provisions that the texts of a bag (case_id, id, pos, celex, text) name and the bag lacks, in its own act, in order of mention."""
    from docweave.operators.spans import ordered_refs
    from docweave.operators.text import reference_key

    named = bag.select("case_id", "pos", "celex", F.posexplode(ordered_refs(F.coalesce("text", F.lit("")), 50)).alias("place", "ref")).withColumn("key", reference_key(F.col("ref")))
    known = node.filter("display_ref is not null").select("celex", reference_key(F.col("display_ref")).alias("key"), "id")
    found = named.join(known, ["celex", "key"]).join(bag.select("case_id", "id"), ["case_id", "id"], "left_anti")
    each = found.groupBy("case_id", "id").agg(F.min(F.struct("pos", "place")).alias("at"))
    return first_by(each, ["case_id"], ["at", "id"], most).select("case_id", "rank", "id")


def summaries_of(parents: DataFrame, most: int) -> DataFrame:
    """community, text: of upper communities the summaries of their parts (community, part, member_count, summary), the largest first."""
    kept = first_by(parents.filter("summary is not null"), ["community"], [F.desc("member_count"), "part"], most)
    line = F.concat(F.lit("["), "part", F.lit("] "), "summary")
    return kept.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
