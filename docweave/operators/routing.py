"""What is decided before and after a read: detection, curated targets, gates, sufficiency, alignment and verdicts.

All work on tables of questions or cases, with column functions. Defined results: a null question asks nothing and gets the
general route; empty sets of acts, roles or references are no restriction; equal rows get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators import rules
from docweave.sources.corpus import first_by

# Routes that a missing role does not matter for, routes that need definitions of statuses or of roles.
NO_CLARIFICATION = ("definition_lookup", "provision_lookup", "reverse_reference", "community_summary_search", "classification_chain", "role_obligations")
STATUS_ROUTES, ROLE_ROUTES = ("legal_qualification", "cross_regulation"), ("role_obligations", "cross_regulation")
# Fixed value: words of a request that only wants to see a text.
MOST_SHOWN_WORDS = 16
GUIDANCE_WORDS = ("mdcg", "guidance")
#: Candidates for each act, more where guidance is among them.
PER_ACT, PER_ACT_WITH_GUIDANCE = 3, 4


def distinct_sorted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and its different values in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(f"{value}s"))


def detect(questions: DataFrame, acts: DataFrame, definitions: DataFrame, roles: DataFrame, k: int) -> DataFrame:
    """The whole detection of questions (case_id, question): acts, roles, refs, route, k.

    acts: act, alias (lower case, words). definitions: term, act, terms that tie a question to an act without naming it.
    roles: term, act. Questions and these tables are small; they are compared by the words of both.
    """
    line = F.concat(F.lit(" "), F.array_join(rules.words_of(F.col("question")), " "), F.lit(" "))
    asked = questions.select("case_id", "question", line.alias("line"))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(rules.words_of(c), " "), F.lit(" "))
    named = asked.join(F.broadcast(acts.select("act", spaced(F.col("alias")).alias("a")).filter("a <> '  '")), F.col("line").contains(F.col("a"))).select("case_id", "act").distinct()
    implied = asked.join(F.broadcast(definitions.select("act", spaced(F.col("term")).alias("a")).filter("a <> '  '")), F.col("line").contains(F.col("a"))).select("case_id", "act").distinct()
    both = named.unionByName(implied).distinct()
    sets = lambda rows, name: rows.groupBy("case_id").agg(F.array_sort(F.collect_set("act")).alias(name))
    out = asked.join(sets(named, "named_acts"), "case_id", "left").join(sets(both, "acts"), "case_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("named_acts", F.coalesce("named_acts", none)).withColumn("acts", F.coalesce("acts", none))
    held = asked.join(F.broadcast(roles.select("term", F.col("act").alias("of"), spaced(F.col("term")).alias("a"))), F.col("line").contains(F.col("a"))).select("case_id", "term", "of")
    held = held.join(out.select("case_id", "acts"), "case_id").filter((F.size("acts") == 0) | F.array_contains("acts", F.col("of")))
    spec = held.groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("term", F.col("of").alias("act")))).alias("roles"))
    out = out.join(spec, "case_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<struct<term:string,act:string>>")))
    refs = rules.question_refs(F.col("question"))
    out = out.withColumn("refs", F.coalesce(refs, none))
    guidance = F.exists("acts", lambda a: a.startswith("MDCG_"))
    budget = F.when(F.size("acts") > 1, F.greatest(F.lit(k), F.size("acts") * F.when(guidance, PER_ACT_WITH_GUIDANCE).otherwise(PER_ACT))).otherwise(F.lit(k))
    route = rules.question_route(F.coalesce("question", F.lit("")), F.col("refs"), F.col("named_acts"), F.transform("roles", lambda r: r["term"]))
    return out.select("case_id", "question", "named_acts", "acts", "roles", "refs", route.alias("route"), budget.alias("k"))


def curated_targets(cases: DataFrame, seeds: DataFrame) -> DataFrame:
    """case_id, at, ref, acts: curated provisions that a case (question, acts, roles) needs, in the seeds' order, each pair once.

    seeds: at, act, ref, words, needs, with: an act in scope brings a reference if the question has one of the words (none:
    always) and the scope one of the acts in needs (none: always). with: other words that forbid it.
    """
    rows = cases.select("case_id", "question", "acts").join(F.broadcast(seeds), F.array_contains(cases.acts, seeds.act))
    line = F.concat(F.lit(" "), F.array_join(rules.words_of(F.col("question")), " "), F.lit(" "))
    has = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda w: line.contains(F.concat(F.lit(" "), w, F.lit(" "))))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    kept = rows.filter((empty("words") | has(F.col("words"))) & (empty("needs") | F.arrays_overlap("acts", "needs")) & ~(~empty("without") & has(F.col("without"))))
    return kept.groupBy("case_id", "act", "ref").agg(F.min("at").alias("at")).select("case_id", "at", "ref", F.array("act").alias("acts"))


def asks_personally(question: Column) -> Column:
    """The question is of the asker's own duties."""
    return question.rlike(rules.PERSONAL)


def needs_role(detected: DataFrame, recognised: DataFrame, most: int = 6) -> DataFrame:
    """case_id, ask, options: whether a role has to be asked for, and which the acts in scope know (recognised: term, act, priority).

    Only where the route depends on it, no role, reference or definition is asked for, an act is in scope, the question is of
    the asker's own duties, neither a survey nor a comparison, and at least two roles come into question.
    """
    options = detected.select("case_id", F.explode("acts").alias("act")).join(recognised, "act").groupBy("case_id", "term").agg(F.min("priority").alias("priority"), F.array_sort(F.collect_set("act")).alias("acts"))
    listed = first_by(options, ["case_id"], ["priority", "term"], most).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("options"))
    q = F.coalesce(F.col("question"), F.lit(""))
    gate = ~F.col("route").isin(*NO_CLARIFICATION) & (F.size("refs") == 0) & (F.size("roles") == 0) & (F.size("acts") > 0) & rules.asks(q, "obligation")
    gate = gate & ~rules.compares(q) & ~rules.asks(q, "survey") & asks_personally(q)
    rows = detected.join(listed, "case_id", "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    ask = gate & (F.size("options") > 1)
    return rows.select("case_id", ask.alias("ask"), F.when(ask, F.col("options")).otherwise(F.array().cast("array<string>")).alias("options"))


def shows_text(detected: DataFrame) -> DataFrame:
    """case_id, ref, act: questions that only ask to see one provision of one act."""
    q = F.coalesce(F.col("question"), F.lit(""))
    opens, plain = rules.asks(q, "display"), ~rules.asks(q, "analysis") & (F.size(F.split(F.trim(q), r"\s+")) <= MOST_SHOWN_WORDS)
    return detected.filter(opens & plain & (F.size("refs") == 1) & (F.size("named_acts") == 1)).select("case_id", F.col("refs")[0].alias("ref"), F.col("named_acts")[0].alias("act"))


def sufficiency(cases: DataFrame, found: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """case_id, check, passed, detail: whether what was found is enough for a case's route.

    cases: case_id, route, refs, acts, roles. found: case_id, id, ref_key, celex, role (of the provision), by_role, community.
    targets: case_id, ref, covered (curated ones). anchors: celex, ref, the articles that define statuses.
    """
    from docweave.operators.text import reference_key

    base = cases.select("case_id", "route", "refs", "acts", F.size("roles").alias("n_roles"), F.coalesce(F.transform("roles", lambda r: r["act"]), F.array().cast("array<string>")).alias("role_acts"))
    of = found.groupBy("case_id").agg(F.collect_set("ref_key").alias("keys"), F.collect_set("celex").alias("found_acts"), F.collect_set("community").alias("communities"), F.coalesce(F.max(F.col("by_role")), F.lit(False)).alias("by_role"), F.count("id").alias("n"), F.collect_set(F.when(F.col("role") == "DEFINES", F.col("celex"))).alias("defines"), F.collect_set(F.when(F.col("role") == "EXEMPTS", F.col("celex"))).alias("exempts"))
    open_targets = targets.groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("ref")))).alias("open"))
    none = F.array().cast("array<string>")
    rows = base.join(of, "case_id", "left").join(open_targets, "case_id", "left")
    for c in ("keys", "found_acts", "communities", "defines", "exempts", "open"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    known = F.array(*[F.lit(r.celex) for r in anchors.select("celex").distinct().collect()]) if not anchors.isEmpty() else none
    needing = F.array_union(F.when(F.col("route").isin(*STATUS_ROUTES), F.col("exempts")).otherwise(none), F.when(F.col("route").isin(*ROLE_ROUTES), F.col("role_acts")).otherwise(none))
    rows = rows.withColumn("no_refs", F.filter("refs", lambda r: ~F.array_contains(F.col("keys"), reference_key(r)))).withColumn("no_acts", F.array_sort(F.array_except("acts", "found_acts")))
    rows = rows.withColumn("no_anchor", F.array_sort(F.array_intersect(F.array_except(needing, F.col("defines")), known)))
    listed = lambda c: F.array_join(F.col(c), ", ")
    route = F.col("route")
    checks = [
        ("definition_coverage", route == "definition_lookup", F.coalesce("n", F.lit(0)) > 0, F.lit("")),
        ("explicit_refs", (route == "provision_lookup") | ((route == "cross_regulation") & (F.size("refs") > 0)), F.size("no_refs") == 0, listed("no_refs")),
        ("role_coverage", (route == "role_obligations") | ((route == "cross_regulation") & (F.col("n_roles") > 0)), F.coalesce("by_role", F.lit(False)), F.lit("")),
        ("cross_reg_coverage", route == "cross_regulation", F.size("no_acts") == 0, listed("no_acts")),
        ("community_diversity", route == "cross_regulation", F.size("communities") != 1, F.lit("")),
        ("qualification_backbone", route == "legal_qualification", F.size("open") == 0, listed("open")),
        ("status_anchor", (F.size("no_anchor") > 0), F.lit(False), listed("no_anchor")),
    ]
    made = F.array(*[F.when(where, F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), F.when(~F.coalesce(passed, F.lit(False)), detail).alias("detail"))) for name, where, passed, detail in checks])
    return rows.select("case_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("case_id", "x.check", "x.passed", "x.detail")


#: The corrective reads in the order in which they are tried, by the check that asks for them.
RECOVERIES = (("qualification_backbone", "curated targets"), ("status_anchor", "status anchors"), ("explicit_refs", "explicit references"), ("role_coverage", "roles"), ("cross_reg_coverage", "missing acts"), ("definition_coverage", "definitions"))


def recoveries(checks: DataFrame) -> DataFrame:
    """case_id, step, read, detail: what to read again for the failed checks, in the fixed order."""
    order = reduce(lambda c, x: c.when(F.col("check") == x[1][0], F.lit(x[0])), enumerate(RECOVERIES, 1), F.when(F.lit(False), F.lit(0)))
    read = reduce(lambda c, x: c.when(F.col("check") == x[0], F.lit(x[1])), RECOVERIES, F.when(F.lit(False), F.lit("")))
    return checks.filter("not passed").select("case_id", order.alias("step"), read.alias("read"), "detail").filter("step is not null")


def fraction_passed(checks: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, coverage: the share of a case's checks that passed, 0.5 without any."""
    share = checks.groupBy("case_id").agg(F.avg(F.col("passed").cast("int")).alias("coverage"))
    return cases.select("case_id").join(share, "case_id", "left").select("case_id", F.coalesce("coverage", F.lit(0.5)).alias("coverage"))


def force_alignment(question: Column, acts: Column, binding: Column, non_binding: Column, total: Column) -> Column:
    """How well the binding force of what was found fits the question: guidance asked for, acts named, or neither."""
    guidance = F.least(F.lit(1.0), (non_binding + 0.3 * binding) / total)
    named = F.when(binding / total >= 0.7, 1.0).when(binding / total >= 0.4, 0.65).otherwise(0.3)
    return F.when(total <= 0, 0.0).when(rules.says(question, GUIDANCE_WORDS), guidance).when(F.size(acts) > 0, named).otherwise(0.7)


def critical_defects(results: DataFrame, unreliable: tuple[str, ...], worse: str) -> DataFrame:
    """results with critical_defects, reliance_final and reliance_gated: what rules out relying on a graded answer.

    results: case_id, score, reliance, fabricated, misattributed, phantom, key_passed, missed. Findings by rule bring a good
    verdict down to worse.
    """
    counted = [F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.lit(f"{label}="), F.col(c).cast("string"))) for c, label in (("fabricated", "fabricated_quotes"), ("misattributed", "misattributed_quotes"), ("phantom", "phantom_citations"))]
    missed = F.when(F.coalesce(F.size("missed"), F.lit(0)) > 0, F.array_join("missed", ",")).otherwise(F.lit("state_recall_below_threshold"))
    key = F.when(~F.coalesce("key_passed", F.lit(True)), F.concat(F.lit("answer_key_failed("), missed, F.lit(")")))
    judged = F.when(F.col("score").isNull(), "ungraded").when(F.col("reliance").isin(*unreliable), "judge_verdict_unreliable")
    out = results.withColumn("critical_defects", F.filter(F.array(*counted, key, judged), lambda x: x.isNotNull()))
    hard = reduce(lambda a, b: a | b, [c.isNotNull() for c in (*counted, key)])
    gated = hard & ~F.coalesce(F.col("reliance").isin(*unreliable), F.lit(False))
    return out.withColumn("reliance_final", F.when(gated, F.lit(worse)).otherwise(F.col("reliance"))).withColumn("reliance_gated", gated)


def revision_verdict(cites: Column, states: Column, fabricated: Column) -> Column:
    """helped, hurt or neutral, from what a revision changed in recall of citations and facts and in invented quotes."""
    return F.when((fabricated > 0) | (cites < 0) | (states < 0), "hurt").when((cites > 0) | (states > 0) | (fabricated < 0), "helped").otherwise("neutral")


def judge_summary(grades: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """case_id, median, mean, verdict of graded runs (case_id, score, verdict): the verdict of most, of ties the worse (order: best to worst)."""
    worst = reduce(lambda c, x: c.when(F.col("verdict") == x[1], F.lit(x[0])), enumerate(order), F.when(F.lit(False), F.lit(0)))
    votes = grades.withColumn("place", worst).filter("place is not null").groupBy("case_id", "verdict", "place").agg(F.count("*").alias("n"))
    best = first_by(votes, ["case_id"], [F.desc("n"), F.desc("place")]).select("case_id", "verdict")
    scores = grades.groupBy("case_id").agg(F.round(F.median("score"), 2).alias("median"), F.round(F.avg("score"), 3).alias("mean"))
    return scores.join(best, "case_id", "left").select("case_id", "median", "mean", F.coalesce("verdict", F.lit("(unparsed)")).alias("verdict"))


def parsed_grade(text: Column, phrases: tuple[str, ...]) -> Column:
    """score and reliance of a judge's text: the final score of 10, else the first; the first reliance phrase that stands in it."""
    final = F.regexp_extract(text, r"(?i)final\s*score\s*[:\-]?\s*\**\s*([0-9]+(?:\.[0-9]+)?)\s*/\s*10", 1)
    any_ = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*/\s*10", 1)
    score = F.coalesce(F.nullif(final, F.lit("")), F.nullif(any_, F.lit(""))).cast("double")
    reliance = reduce(lambda c, p: c.when(F.lower(text).contains(p.lower()), F.lit(p)), phrases, F.when(F.lit(False), F.lit(""))).otherwise(F.lit("(unparsed)"))
    return F.struct(score.alias("score"), reliance.alias("reliance"))


def in_buckets(rows: DataFrame, buckets: list[tuple[str, Column]], order: str) -> DataFrame:
    """rows with bucket and place: the first bucket whose condition holds, then the given order within it, numbered throughout by case."""
    number = reduce(lambda c, x: c.when(x[1][1], F.lit(x[0])), enumerate(buckets), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(len(buckets)))
    name = reduce(lambda c, x: c.when(x[1], F.lit(x[0])), buckets, F.when(F.lit(False), F.lit(""))).otherwise(F.lit("other"))
    return first_by(rows.withColumn("__b", number).withColumn("bucket", name), ["case_id"], ["__b", order], 2**31 - 1, "place").drop("__b")
