"""From pages to the tables of the graph, and from an answer to what is shown of it: the stages in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import canon, grounding, resolve, rules
from docweave.operators.text import definition_body, term_key
from docweave.sources import guidance, legal_html
from docweave.sources.corpus import first_by

_QUOTE = "'‘’‚‛“”\""


def definitions(provisions: DataFrame, articles: dict[str, str]) -> DataFrame:
    """term_id, term, term_key, celex, category, definition_type, source_id, definition: 'term' means ..., the first of each act and key.

    A definition is formal inside its act's article of definitions (articles: act to number), else inline.
    """
    found = F.regexp_extract("text", rf"^\s*(?:\([0-9a-z]+\)\s*|[0-9]+[.)]\s*)?[{_QUOTE}]([^{_QUOTE}]+)[{_QUOTE}]\s+(?i:means)\b", 1)
    rows = provisions.withColumn("term", F.trim(found)).filter("term <> ''").withColumn("term_key", term_key(F.col("term")))
    first = first_by(rows, ["celex", "term_key"], ["seq", "id"]).drop("rank")
    body = definition_body(F.col("text"))
    kind = F.when(rules.in_definitions_article(F.col("id"), F.col("celex"), articles), "formal").otherwise("inline")
    return first.select(F.concat("celex", F.lit("::term::"), "term_key").alias("term_id"), "term", "term_key", "celex", rules.term_category(F.col("term"), body).alias("category"), kind.alias("definition_type"), F.col("id").alias("source_id"), body.alias("definition"))


def legislation(pages: DataFrame, originals: DataFrame | None = None, articles: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """provisions, relations and terms of acts (celex, html): parsed, given their original's preamble, stamped, resolved.

    originals: celex, html of the original acts, whose preamble a consolidated one lacks.
    """
    rows = legal_html.parse(pages)
    if originals is not None:
        rows = legal_html.graft_preamble(rows, legal_html.parse(originals))
    rows = cut(legal_html.stamped(rows))
    return {"provisions": rows, "relations": resolve.resolve(rows), "terms": definitions(rows, articles or {})}


def guidance_documents(documents: DataFrame, names: dict[str, str]) -> dict[str, DataFrame]:
    """provisions and relations of guidance texts (celex, name, text). names: short names of acts to their numbers."""
    rows = cut(guidance.parse(documents).withColumn("binding_force", F.lit("non_binding")).withColumn("source_type", F.lit("guidance")))
    found = resolve.guidance_edges(rows, names)
    return {"provisions": rows, "relations": found.select("source", F.lit("CITES_EXTERNAL").alias("type"), "target", "ref_text", "number")}


#: The stages of the canonical layer, in their order.
STAGES = ("crosslinks", "amendments", "delegations", "term links", "roles", "provision roles", "curated edges", "communities")


def canonical(tables: dict[str, DataFrame], catalogue: DataFrame, components: DataFrame, derived: DataFrame, standalone: DataFrame) -> dict[str, DataFrame]:
    """roles, includes, obligations, delegations and amendments over provisions (celex, id, kind, title, text, path), relations and terms."""
    from docweave.operators import tree

    node = tables["provisions"]
    closed = cut(tree.closure(node.select("id", "path")))
    edge = tables["relations"].select(F.col("source").alias("src"), "type", F.col("target").alias("dst"), "ref_text")
    roles = cut(canon.actor_roles(tables["terms"], components, derived, standalone))
    return {
        "roles": roles, "includes": canon.includes(roles, components), "obligations": canon.obligations(node.select("id", "celex", "title", "text"), roles),
        "delegations": canon.delegations(edge, node), "amendments": canon.amendment_edges(node, closed, catalogue),
    }


def classifier_text(full: Column, capped: Column, raw: Column) -> Column:
    """What a provision is classified by: its whole flattened text, else the capped one, else its own."""
    return F.coalesce(full, capped, raw)


def linker_text(capped: Column, raw: Column) -> Column:
    """What roles are looked for in: the capped text, else the own one; null where a provision has no text of its own."""
    return F.when(F.coalesce(F.trim(raw), F.lit("")) != "", F.coalesce(capped, raw))


def by_route(cases: DataFrame, channels: dict[str, DataFrame], order: dict[str, tuple[str, ...]], otherwise: tuple[str, ...] = ("search",)) -> DataFrame:
    """case_id, id, rank, score, channel: the hits of the channels that a case's route asks for, in the route's order, each id where it comes first.

    channels: by name tables of case_id, id, rank, score, channel. cases: case_id, route.
    """
    place = lambda name: reduce(lambda c, x: c.when(F.col("route") == x[0], F.lit(x[1].index(name) if name in x[1] else -1)), order.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(otherwise.index(name) if name in otherwise else -1))
    parts = [hits.join(cases.select("case_id", "route"), "case_id").withColumn("part", place(name)).filter("part >= 0").select("case_id", "id", F.col("rank").alias("own"), "score", "channel", "part") for name, hits in channels.items()]
    once = first_by(reduce(DataFrame.unionByName, parts), ["case_id", "id"], ["part", "own"]).drop("rank")
    return first_by(once, ["case_id"], ["part", "own", "id"], 2**31 - 1).select("case_id", "id", "rank", "score", "channel")


def verified(answers: DataFrame, sources: DataFrame, families: DataFrame, names: dict[str, str]) -> DataFrame:
    """case_id, answer, phantoms, foreign, counts of quotes by bucket, replaced, removed: the checks of answers in their order.

    First lines that cite foreign law or what does not exist go, then quotes are judged, and last repaired; the counts are of
    the quotes before repair. answers: case_id, answer, question.
    """
    guarded = cut(grounding.guard_citations(answers, families, names))
    text = guarded.select("case_id", "answer").join(answers.select(F.col("case_id").cast("long").alias("case_id"), "question"), "case_id")
    quotes = grounding.check_quotes(text, sources)
    counts = quotes.groupBy("case_id").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("verified", "near", "unverified", "misattributed", "illustrative")])
    mended = grounding.repair_answers(text, sources)
    rows = guarded.drop("answer").join(mended, "case_id", "left").join(counts, "case_id", "left")
    return rows.na.fill(0, ["replaced", "removed", "verified", "near", "unverified", "misattributed", "illustrative"]).na.fill("", ["answer"])
