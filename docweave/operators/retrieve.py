"""Reads of the corpus that callers compose: by question, id, reference, role, chain, term, community and amendment.

Every read takes a table of cases, so many questions run as one plan. Cases have case_id; acts, where given, is an array of
act numbers, null or empty for no restriction, and is applied before any cut. Hits have case_id, id, rank (from 1), score
and channel; with_bags adds the context of each hit.

Defined results: null ids are left out, of repeated ones the first counts; a case without any hit has no row; ties go to
the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import graph, search
from docweave.operators.text import reference_key
from docweave.operators.vectors import nearest
from docweave.sources.corpus import first_by

#: Most provisions of a lookup by one reference, of a role's obligations, and least budget of a role.
PER_REFERENCE, PER_ROLE, ROLE_BUDGET = 8, 400, 14
#: Candidates for a reranker: so many times k, at most so many.
WIDER, WIDEST = 5, 48
#: Definitions added for the terms of the leading provisions.
LEADING, MOST_DEFINITIONS = 10, 15


@dataclass(frozen=True)
class Corpus:
    """node: id, kind, celex, depth, ord, parent_id, title, text, display_ref. edge: src, type, dst, ref_text. closed: anc, desc_id, dist.

    vectors: id, embedding. terms: term, celex, definition_type, category, source_id. anchors: id, anchor.
    """

    node: DataFrame
    edge: DataFrame
    closed: DataFrame
    vectors: DataFrame | None = None
    terms: DataFrame | None = None
    anchors: DataFrame | None = None


def admitted(celex: Column, acts: Column) -> Column:
    """The act is among acts, or acts restrict nothing."""
    return acts.isNull() | (F.size(acts) == 0) | F.array_contains(acts, celex)


def in_scope(regulations: Column, target: Column) -> Column:
    """A community's regulations meet the target; one without any is in every scope."""
    return regulations.isNull() | (F.size(regulations) == 0) | target.isNull() | (F.size(target) == 0) | F.arrays_overlap(regulations, target)


def hits(rows: DataFrame, order: list, channel: str, score: Column, most: int | None = None) -> DataFrame:
    """case_id, id, rank, score, channel: each id once, by the order, at most so many."""
    once = first_by(rows.filter("id is not null"), ["case_id", "id"], order).drop("rank")
    ranked = first_by(once, ["case_id"], [*order, "id"], most or 2**31 - 1)
    return ranked.select("case_id", "id", "rank", score.cast("double").alias("score"), F.lit(channel).alias("channel"))


def by_ids(wanted: DataFrame, corpus: Corpus) -> DataFrame:
    """Provisions by id (case_id, at, id), in the order of the wish, those that exist."""
    return hits(wanted.join(corpus.node.select("id"), "id", "left_semi"), ["at"], "ids", F.lit(0.0))


def parent_reference(ref: Column) -> Column:
    """Article 2(68) -> Article 2; null where a reference has no article above it."""
    found = F.regexp_extract(F.trim(ref), r"(?i)^article\s+([0-9]{1,3}[a-z]?)\s*\(", 1)
    return F.when(found != "", F.concat(F.lit("Article "), found))


def by_refs(wanted: DataFrame, corpus: Corpus, acts: bool = True, per_reference: int = PER_REFERENCE) -> DataFrame:
    """Provisions by reference (case_id, at, ref, acts): equal in normal form, the shallowest of each first; a qualified one that nothing matches stands for its article."""
    node = corpus.node.filter("display_ref is not null").withColumn("key", reference_key(F.col("display_ref"))).select("id", "celex", "depth", "key")
    scope = admitted(F.col("celex"), F.col("acts")) if acts else F.lit(True)

    def found(rows: DataFrame) -> DataFrame:
        return first_by(rows.withColumn("key", reference_key(F.col("ref"))).join(node, "key").filter(scope), ["case_id", "ref"], ["depth", "id"], per_reference)

    direct = found(wanted)
    lost = wanted.join(direct.select("case_id", "ref").distinct(), ["case_id", "ref"], "left_anti").withColumn("ref", parent_reference(F.col("ref"))).filter("ref is not null")
    known = direct.select("case_id", "key").distinct()
    above = found(lost).join(known, ["case_id", "key"], "left_anti")
    columns = ["case_id", "id", "at", "depth"]
    both = direct.select(*columns, F.lit(0).alias("late")).unionByName(above.select(*columns, F.lit(1).alias("late")))
    return hits(both, ["late", "at", "depth", "id"], "refs", F.lit(1.0))


def direct_provisions(wanted: DataFrame, corpus: Corpus) -> DataFrame:
    """by_refs within the acts; where the paragraph that a case names (column paragraph) is no child of what was found, the lookup without acts is added behind."""
    inside = by_refs(wanted, corpus)
    child = corpus.node.select(F.col("parent_id").alias("id"), F.col("display_ref").alias("child_ref"))
    named = wanted.filter("paragraph is not null").select("case_id", "paragraph").distinct()
    has = inside.join(named, "case_id").join(child, "id").filter((F.col("child_ref") == F.concat(F.lit("Paragraph "), "paragraph")) | F.col("child_ref").rlike(r"^Article [0-9]{1,3}[a-z]?\([0-9]+[a-z]?\)$") & (F.regexp_extract("child_ref", r"\(([^)]*)\)$", 1) == F.col("paragraph"))).select("case_id").distinct()
    missed = named.select("case_id").join(inside.select("case_id").distinct(), "case_id", "left_semi").join(has, "case_id", "left_anti")
    wider = by_refs(wanted.join(missed, "case_id", "left_semi"), corpus, acts=False)
    return merged([inside, wider])


def merged(channels: list[DataFrame], prepend: bool = False) -> DataFrame:
    """The channels one behind the other, each id where it comes first; prepend: later channels lead, and move what they share to the front."""
    parts = [c.withColumn("part", F.lit(-k if prepend else k)) for k, c in enumerate(channels)]
    rows = reduce(DataFrame.unionByName, parts)
    once = first_by(rows.withColumnRenamed("rank", "own"), ["case_id", "id"], ["part", "own"]).drop("rank")
    return first_by(once, ["case_id"], ["part", "own", "id"], 2**31 - 1).select("case_id", "id", "rank", "score", "channel")


def citing(targets: DataFrame, corpus: Corpus, kinds: tuple[str, ...], most: int = 40) -> DataFrame:
    """Provisions that cite a target (case_id, id) or what lies below it, rolled up to kinds; the most frequent first."""
    ids = targets.select("id").distinct()
    found = graph.citing_provisions(ids, corpus.node, corpus.edge, corpus.closed, kinds)
    rows = targets.select("case_id", F.col("id").alias("target")).join(found, "target").groupBy("case_id", "id").agg(F.sum("n").alias("n"))
    return hits(rows, [F.desc("n"), "id"], "citing", F.lit(0.0), most)


def by_roles(roles: DataFrame, related: DataFrame, corpus: Corpus, k: int = 8) -> DataFrame:
    """Obligations of roles (case_id, role, acts, vector): articles first, each kind by cosine with the case's vector; without an embedding last."""
    wide = graph.role_obligations(roles.select("role").distinct(), related, corpus.node, corpus.edge, PER_ROLE).select("role", "id", "kind")
    rows = roles.join(wide, "role").join(corpus.node.select("id", "celex"), "id").filter(admitted(F.col("celex"), F.col("acts")))
    scored = rows.join(corpus.vectors, "id", "left") if corpus.vectors is not None else rows.withColumn("embedding", F.lit(None).cast("array<double>"))
    near = F.when(F.col("vector").isNull(), 0.0).when(F.col("embedding").isNull(), -1.0).otherwise(search.dot(F.col("embedding"), F.col("vector")))
    scored = scored.withColumn("near", F.round(near, 6)).withColumn("other", (F.col("kind") != "article").cast("int"))
    return hits(scored, ["other", F.desc("near"), "id"], "roles", F.lit(1.0), max(k, ROLE_BUDGET))


def by_chain(seeds: DataFrame, corpus: Corpus, types: tuple[str, ...], seed_only: bool = False, most_seeds: int = 5) -> DataFrame:
    """Provisions reached from seeds (case_id, ref, acts) over some types of edges in two hops: seeds score 1, what they lead to 0.9.

    A case whose references lead nowhere falls back on the direct lookup.
    """
    found = by_refs(seeds.withColumn("at", F.lit(0)), corpus)
    seed = found.filter(F.col("rank") <= most_seeds)
    if seed_only:
        return seed
    reached = graph.chain(seed.select("id").distinct(), corpus.edge, types, 2).filter("hop > 0")
    further = seed.select("case_id", F.col("id").alias("seed")).join(reached, "seed").join(corpus.node.select("id"), "id", "left_semi").groupBy("case_id", "id").agg(F.min("hop").alias("hop"))
    chained = hits(further, ["hop", "id"], "chain", F.lit(0.9))
    lost = found.join(chained.select("case_id").distinct(), "case_id", "left_anti")
    return merged([seed.join(chained.select("case_id").distinct(), "case_id", "left_semi"), chained, lost])


def obligation_walk(start: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """ref, celex, hop: what curated links (ref, celex, target_ref, target_celex) lead to from start, each pair once with its least hop.

    A link without target_celex stays in its act.
    """
    level = start.select("ref", "celex").distinct().withColumn("hop", F.lit(0))
    out = level
    steps = links.select("ref", "celex", "target_ref", F.coalesce("target_celex", "celex").alias("target_celex"))
    for hop in range(1, depth + 1):
        level = level.join(steps, ["ref", "celex"]).select(F.col("target_ref").alias("ref"), F.col("target_celex").alias("celex")).distinct().withColumn("hop", F.lit(hop))
        out = out.unionByName(level)
    return out.groupBy("ref", "celex").agg(F.min("hop").alias("hop"))


def by_term(wanted: DataFrame, corpus: Corpus) -> DataFrame:
    """Definitions of terms (case_id, term): term, celex, definition_type, source_id, with the text and the parent's reference of the provision, by act."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    rows = wanted.withColumn("key", key(F.col("term"))).drop("term").join(corpus.terms.withColumn("key", key(F.col("term"))), "key")
    node = corpus.node.select(F.col("id").alias("source_id"), "text", "parent_id")
    parent = corpus.node.select(F.col("id").alias("parent_id"), F.col("display_ref").alias("parent_ref"))
    return rows.join(node, "source_id").join(parent, "parent_id", "left").select("case_id", "term", "celex", "definition_type", "source_id", "text", "parent_ref")


def by_category(category: str, corpus: Corpus, acts: list[str] | None = None) -> DataFrame:
    """Terms of a category, of some acts if given, by act and term."""
    rows = corpus.terms.filter(F.col("category") == category)
    if acts:
        rows = rows.filter(F.col("celex").isin(*acts))
    return rows.select("celex", "term", "definition_type", "source_id").orderBy("celex", "term")


def amendments(found: DataFrame, corpus: Corpus) -> DataFrame:
    """Amending provisions of what was found (case_id, id): case_id, id, amended, ref_text; of several ties of one amender the last target counts."""
    ids = found.select("id").distinct()
    some = graph.amendments(ids, corpus.edge, corpus.closed).select(F.col("target").alias("amended"), "id", "ref_text")
    rows = found.select("case_id", F.col("id").alias("amended")).distinct().join(some, "amended")
    return first_by(rows, ["case_id", "id"], [F.desc("amended")]).select("case_id", "id", "amended", "ref_text")


def surface_amendments(bag: DataFrame, corpus: Corpus) -> DataFrame:
    """The bag with the amendments of its provisions, and of their matched leaves (column leaf, if there), in front."""
    seen = bag.select("case_id", "id")
    if "leaf" in bag.columns:
        seen = seen.unionByName(bag.select("case_id", F.col("leaf").alias("id")).filter("id is not null"))
    found = amendments(seen, corpus)
    return merged([bag.select("case_id", "id", "rank", "score", "channel"), hits(found, ["id"], "amendments", F.lit(0.0))], prepend=True)


def recitals(vectors: DataFrame, node: DataFrame, questions: list[tuple[int, list[float]]], k: int, kinds: tuple[str, ...] = ("recital",)) -> DataFrame:
    """The k nearest provisions of some kinds for each question."""
    some = vectors.join(node.filter(F.col("kind").isin(*kinds)).select("id"), "id", "left_semi")
    scored = search.dense(some, questions).select(F.col("question").alias("case_id"), "id", F.round("cosine", 6).alias("cosine"))
    return hits(scored, [F.desc("cosine"), "id"], "recitals", F.col("cosine"), k)


def communities(summaries: DataFrame, questions: list[tuple[int, list[float]]], k: int, target: list[str] | None = None) -> DataFrame:
    """The k nearest community summaries (id, embedding, regulations) in scope of each question."""
    wanted = F.array(*map(F.lit, target)) if target else F.lit(None).cast("array<string>")
    scored = search.dense(summaries.filter(in_scope(F.col("regulations"), wanted)), questions).select(F.col("question").alias("case_id"), "id", F.round("cosine", 6).alias("cosine"))
    return hits(scored, [F.desc("cosine"), "id"], "communities", F.col("cosine"), k)


def community_members(found: DataFrame, members: DataFrame, node: DataFrame, k: int, kinds: tuple[str, ...]) -> DataFrame:
    """Members (community, id) of the communities found (case_id, id), shallowest first, max(1, k // n) of each of a case's n."""
    n = found.groupBy("case_id").agg(F.count("*").alias("n"))
    rows = found.select("case_id", F.col("id").alias("community"), F.col("rank").alias("of")).join(n, "case_id").join(members, "community").join(node.filter(F.col("kind").isin(*kinds)).select("id", "depth"), "id")
    few = first_by(rows, ["case_id", "community"], ["depth", "id"], 2**31 - 1).filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("n")))).withColumnRenamed("rank", "inside")
    return hits(few, ["of", "inside", "id"], "members", F.lit(0.0))


def community_summaries(table: DataFrame, level: int) -> DataFrame:
    """id, label, member_count, summary_text of a level; the label of level 0 is the id."""
    label = F.when(F.col("level") == 0, F.col("id")).otherwise(F.coalesce("label", "id"))
    return table.filter(F.col("level") == level).select("id", label.alias("label"), "member_count", "summary_text")


def covered(targets: DataFrame, found: DataFrame, node: DataFrame) -> DataFrame:
    """targets (case_id, ref, acts) with covered: a provision of just that reference, in one of its acts, is among what was found."""
    have = found.select("case_id", "id").join(node.select("id", "celex", F.col("display_ref").alias("ref")), "id").select("case_id", "ref", "celex")
    pairs = targets.withColumn("t", F.xxhash64("case_id", "ref", "acts"))
    hit = pairs.join(have, ["case_id", "ref"]).filter(admitted(F.col("celex"), F.col("acts"))).select("t").distinct().withColumn("covered", F.lit(True))
    return pairs.join(hit, "t", "left").drop("t").withColumn("covered", F.coalesce("covered", F.lit(False)))


def lookup_targets(targets: DataFrame, corpus: Corpus) -> DataFrame:
    """Curated targets (case_id, at, ref, acts) by reference, each in its own acts, in their order."""
    own = targets.withColumn("case", F.struct("case_id", "at"))
    found = by_refs(own.select(F.col("case").alias("case_id"), "at", "ref", "acts"), corpus)
    rows = found.select(F.col("case_id.case_id").alias("case_id"), F.col("case_id.at").alias("at"), "id", F.col("rank").alias("own"))
    return hits(rows, ["at", "own", "id"], "targets", F.lit(1.0))


def related_definitions(bag: DataFrame, corpus: Corpus, known: DataFrame, acts: DataFrame, most: int = MOST_DEFINITIONS) -> DataFrame:
    """Definitions of terms in the texts of the leading provisions: longest terms first, in-scope and formal ones preferred.

    known: case_id, term (already defined). acts: case_id, acts. Gives case_id, rank, term, celex, source_id.
    """
    from docweave.operators.linking import token_links

    leading = bag.filter(F.col("rank") <= LEADING).join(corpus.node.select("id", "text"), "id")
    texts = leading.select("id", "text").distinct()
    plain = corpus.terms.select(F.trim(F.regexp_replace(F.lower("term"), "[^a-z0-9]+", " ")).alias("term"), F.col("term").alias("as_written"), "celex", "definition_type", "source_id")
    found = token_links(texts, plain.select("term").distinct(), shadowed=True)
    rows = leading.select("case_id", "id").join(found, "id").select("case_id", "term").distinct().join(plain, "term")
    rows = rows.join(known.select("case_id", F.trim(F.regexp_replace(F.lower("term"), "[^a-z0-9]+", " ")).alias("term")), ["case_id", "term"], "left_anti").join(acts, "case_id", "left")
    best = first_by(rows, ["case_id", "term"], [F.desc(admitted(F.col("celex"), F.col("acts"))), F.desc(F.col("definition_type") == "formal"), "celex", "source_id"]).drop("rank")
    return first_by(best, ["case_id"], [F.desc(F.length("term")), "term"], most).select("case_id", "rank", F.col("as_written").alias("term"), "celex", "source_id")


def gap_provisions(wants: DataFrame, corpus: Corpus, have: DataFrame, most: int) -> DataFrame:
    """What an audit misses (case_id, at, want, acts): a definition by the term it names, anything else, or one that no term resolves, by reference.

    have: case_id, id, already there. At most so many new provisions for a case.
    """
    quoted = F.regexp_extract("want", "[‘“\"']([^’”\"']{2,60})[’”\"']", 1)
    of = F.regexp_extract("want", r"(?i)\bdefinition\s+of\s+([A-Za-z][\w\s/-]{1,58}?)\s*(?:[).,;]|$)", 1)
    term = F.when(F.col("want").rlike(r"(?i)\bdefin(?:ition|ed|es)\b"), F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(of, F.lit(""))))
    rows = wants.withColumn("term", F.trim(term))
    by = by_term(rows.filter("term is not null").select("case_id", "at", "acts", "term").withColumn("case_id", F.struct("case_id", "at", "acts")), corpus)
    by = by.filter(admitted(F.col("celex"), F.col("case_id.acts"))).groupBy("case_id").agg(F.min(F.struct("celex", "source_id"))["source_id"].alias("id"))
    defined = by.select(F.col("case_id.case_id").alias("case_id"), F.col("case_id.at").alias("at"), "id")
    other = rows.join(defined.select("case_id", "at"), ["case_id", "at"], "left_anti").select("case_id", "at", F.col("want").alias("ref"), "acts")
    numbered = by_refs(other, corpus).select("case_id", (F.col("rank") + 1_000_000).alias("at"), "id")
    new = defined.unionByName(numbered).join(have.select("case_id", "id"), ["case_id", "id"], "left_anti")
    return hits(new, ["at", "id"], "gaps", F.lit(0.0), most)


def retrieve(
    questions: DataFrame, vectors_of: list[tuple[int, list[float]]], corpus: Corpus, documents: DataFrame, k: int = 20, rerank: DataFrame | None = None, widen: bool = False
) -> DataFrame:
    """The whole read of questions (case_id, text, acts): dense and lexical ranks in scope, fused, collapsed to anchors, a quota for each act, reranked, cut to k.

    documents: id, text, the lexical index. rerank: case_id, id, strong, scores of another model, blended with the fused score;
    widen: more candidates are kept for it. Gives case_id, id (the anchor), leaf, rank, score, cosine, channel; for cases without
    acts, provisions of other acts that cite what was found come behind, of channel reverse.
    """
    many = min(WIDER * k, WIDEST) if widen or rerank is not None else k
    celex = corpus.node.select("id", "celex")
    scope = questions.select("case_id", "acts")
    scopes = {r.case_id: tuple(r.acts) if r.acts else None for r in scope.filter(F.col("case_id").isin([q for q, _ in vectors_of])).collect()}
    # An anchor lies in the act of its leaves.
    vectors = cut(corpus.vectors.join(celex, "id").join(corpus.anchors, "id").select("id", "embedding", "celex", "anchor"))
    near = nearest(vectors, vectors_of, many, "celex", "anchor", by_group=False, scopes=scopes)
    lexical = search.bm25(documents, questions.select(F.col("case_id").alias("question"), "text")).join(celex, "id").join(scope.withColumnRenamed("case_id", "question"), "question").filter(admitted(F.col("celex"), F.col("acts")))
    words = cut(search.ranks(lexical.withColumn("score", F.round("score", 6)).select("question", "id", "score"), "score", 8 * many))
    fused = cut(search.fused_candidates(vectors, vectors_of, near, words, "celex", scopes))
    best = search.collapse(fused, corpus.anchors).join(fused.select("question", "id", "cosine"), ["question", "id"])
    best = best.join(celex.withColumnRenamed("id", "anchor"), "anchor").join(scope.withColumnRenamed("case_id", "question"), "question")
    several = F.coalesce(F.size("acts"), F.lit(0)) > 1
    per = F.when(several, F.greatest(F.lit(3), F.ceil(F.lit(many) / F.size("acts")))).otherwise(F.lit(many))
    kept = first_by(best, ["question", "celex"], [F.desc("fused"), "anchor"], many, "in_act").filter((F.col("in_act") <= per) | ~several)
    pool = first_by(kept, ["question"], [F.desc("fused"), "anchor"], many).drop("rank")
    score, parts = F.col("fused"), ["question"]
    if rerank is not None:
        pool = pool.join(rerank.select(F.col("case_id").alias("question"), F.col("id").alias("anchor"), "strong"), ["question", "anchor"], "left").fillna({"strong": 0.0})
        pool = pool.withColumn("part", F.when(several, F.col("celex")).otherwise(F.lit("")))
        pool = search.blend(pool, ["question", "part"], "strong", "fused")
        budget = F.when(several, F.greatest(F.lit(1), F.ceil(F.lit(k) / F.size("acts")))).otherwise(F.lit(k))
        pool = first_by(pool, ["question", "part"], [F.desc("blended"), "anchor"], k, "in_part").filter(F.col("in_part") <= budget)
        score = F.round("blended", 6)
    top = first_by(pool.withColumn("score", score), parts, [F.desc("score"), "anchor"], k)
    found = top.select(F.col("question").alias("case_id"), F.col("anchor").alias("id"), F.col("id").alias("leaf"), "rank", "score", "cosine", F.lit("search").alias("channel"))
    free = questions.filter("acts is null or size(acts) = 0").select("case_id")
    targets = found.join(free, "case_id", "left_semi").select("case_id", "id")
    back = graph.reverse_cross_references(targets.select("id").distinct().join(corpus.node, "id"), corpus.node, corpus.edge, corpus.closed, ("article",))
    back = targets.select("case_id", F.col("id").alias("target")).join(back, "target").groupBy("case_id", "id").agg(F.sum("n").alias("n")).join(targets, ["case_id", "id"], "left_anti")
    back = first_by(back, ["case_id"], [F.desc("n"), "id"], 10)
    return found.unionByName(back.select("case_id", "id", F.lit(None).cast(found.schema["leaf"].dataType).alias("leaf"), (F.col("rank") + k).alias("rank"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cosine"), F.lit("reverse").alias("channel")))


def with_bags(found: DataFrame, corpus: Corpus, expanded: bool = True) -> DataFrame:
    """found with children (parents, children, siblings), cited (internal, cross) and interpreted: arrays of ids in bag order.

    expanded false: the graph's citations and interpretations stay empty, for a comparison without them.
    """
    bags = graph.expand(found.select("id").distinct(), corpus.node, corpus.edge, corpus.closed)
    names = {"children": ("parent", "child", "sibling"), "cited": ("internal", "cross"), "interpreted": ("interpreted_by", "interprets")}
    order = reduce(lambda c, x: c.when(F.col("bag") == x[1], F.lit(x[0])), enumerate(sum(names.values(), ())), F.when(F.lit(False), F.lit(0)))

    def listed(some: tuple[str, ...], keep: bool) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("bag").isin(*some) & F.lit(keep), F.struct(order.alias("o"), "rank", F.col("id").alias("i"))))), lambda x: x["i"])

    lists = bags.groupBy(F.col("anchor").alias("id")).agg(*[listed(some, expanded or name == "children").alias(name) for name, some in names.items()])
    empty = F.array().cast("array<string>")
    return found.join(lists, "id", "left").select(*found.columns, *[F.coalesce(name, empty).alias(name) for name in names])
