"""Canonical layer of the graph: actor roles, equivalences, delegations, amendments, and documents narrowed to provisions.

Terms have term_id, term, term_key, celex, category, source_id, definition. Roles have role_id ({celex}::role::{term_key}), term,
term_key, celex, source_type. Defined results: null texts link nothing, a null celex takes part in nothing, of repeated
edges the first stays; provision ids are unique.
"""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import patterns, rules
from docweave.operators.references import Reader
from docweave.operators.text import definition_body, first_sentence, term_key

#: Words that may stand between the names of a definition that only lists roles.
BETWEEN = ("a", "an", "the", "or", "and", "any", "other")


def role_id(key: Column, celex: Column) -> Column:
    return F.concat(celex, F.lit("::role::"), key)


def plural(term: str) -> str:
    """The last word in the plural: authority -> authorities, body -> bodies, process -> processes."""
    head, _, last = term.rpartition(" ")
    if re.search("[^aeiou]y$", last):
        last = last[:-1] + "ies"
    elif re.search("(s|x|z|ch|sh)$", last):
        last += "es"
    elif last:
        last += "s"
    return f"{head} {last}".strip()


def plural_column(term: Column) -> Column:
    return F.when(term.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(term, "y$", ""), F.lit("ies"))).when(term.rlike("(s|x|z|ch|sh)$"), F.concat(term, F.lit("es"))).otherwise(F.concat(term, F.lit("s")))


def named_in(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """id, role_id: texts (id, celex, text) that have the name of a role of their act, or its plural, as words: one automaton of all names, one pass."""
    low = F.lower("term")
    names = roles.select("celex", "role_id", F.explode(F.array(low, plural_column(low))).alias("pattern")).distinct()
    found = patterns.occurrences(texts.select("id", F.lower("text").alias("text")), names.select("pattern"), whole_words=True).select("id", "pattern").distinct()
    return found.join(texts.select("id", "celex"), "id").join(names, ["celex", "pattern"]).select("id", "role_id").distinct()


# --- roles -------------------------------------------------------------------------------------------------------


def first_clause(definition: Column) -> Column:
    return F.lower(F.element_at(F.split(F.coalesce(definition, F.lit("")), "[.;]"), 1))


def only_names(clause: Column, names: Column) -> Column:
    """A clause is nothing but at least two of the names that it has (in lower case), the longest taken out first, and words between."""
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(names), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    spaced = F.concat(F.lit(" "), F.regexp_replace(clause, r"[\s,:;()]+", "  "), F.lit(" "))
    rest = F.aggregate(ordered, spaced, lambda s, t: F.replace(s, F.concat(F.lit(" "), F.regexp_replace(t, r"\s+", "  "), F.lit(" ")), F.lit("  ")))
    left = F.filter(F.split(rest, r"\s+"), lambda w: (w != "") & ~w.isin(*BETWEEN))
    return (F.size(F.array_distinct(names)) > 1) & (F.size(left) == 0)


def promoted(terms: DataFrame, components: DataFrame, derived: DataFrame) -> DataFrame:
    """term_id of the terms that are roles: actors, and what is made of roles, until nothing is added.

    A semi-naive fixpoint: which names stand in which definitions, and which parts make which composite, is found once; each round joins what the
    round before has added with that, and looks at the terms it touches alone. It ends when a round adds nothing, after as many rounds as roles are
    nested. No act is one group.
    """
    own = cut(terms.filter("celex is not null").select("term_id", "celex", "term_key", F.lower("term").alias("name"), "category", first_clause(F.col("definition")).alias("clause")))
    clauses = own.filter("category <> 'actor' or category is null")
    said = patterns.occurrences(clauses.select(F.col("term_id").alias("id"), F.col("clause").alias("text")), own.select(F.col("name").alias("pattern")), whole_words=True)
    said = said.select(F.col("id").alias("term_id"), F.col("pattern").alias("name")).distinct().join(clauses.select("term_id", "celex", "clause"), "term_id")
    named = cut(said.join(own.select("celex", "name", F.col("term_id").alias("part_id")), ["celex", "name"]).filter("part_id <> term_id"))
    known = own.select("celex", F.col("term_key").alias("part"), F.col("term_id").alias("part_id"))
    also = derived.select("celex", F.col("term_key").alias("part")).distinct().withColumn("given", F.lit(True))
    parts = clauses.select("term_id", "celex", "term_key").join(components.select("celex", "term_key", "part").distinct(), ["celex", "term_key"])
    # Parts that the act neither defines nor derives are not asked for.
    parts = cut(parts.join(known, ["celex", "part"], "left").join(also, ["celex", "part"], "left").filter("part_id is not null or given").select("term_id", "part", "part_id", F.coalesce("given", F.lit(False)).alias("given")))
    out = delta = cut(own.filter("category = 'actor'").select("term_id"))
    touched = parts.select("term_id").distinct()
    while True:
        new = F.col("term_id").alias("part_id")
        touched = touched.unionByName(named.join(delta.select(new), "part_id").select("term_id")).unionByName(parts.join(delta.select(new), "part_id").select("term_id")).distinct().join(out, "term_id", "left_anti")
        have = out.select(new, F.lit(True).alias("have"))
        whole = parts.join(touched, "term_id", "left_semi").join(have, "part_id", "left").groupBy("term_id", "part").agg(F.max(F.coalesce("have", F.col("given"))).alias("there")).groupBy("term_id").agg(F.min("there").alias("all")).filter("all").select("term_id")
        lists = named.join(touched, "term_id", "left_semi").join(have, "part_id").groupBy("term_id", "clause").agg(F.collect_set("name").alias("names")).filter(only_names(F.col("clause"), F.col("names"))).select("term_id")
        delta = cut(whole.unionByName(lists).distinct())
        if delta.isEmpty():
            return out
        out, touched = cut(out.unionByName(delta)), delta.limit(0)


def actor_roles(terms: DataFrame, components: DataFrame, derived: DataFrame, standalone: DataFrame) -> DataFrame:
    """role_id, term, term_key, celex, category, source_id, definition, source_type of all roles.

    components: celex, term_key, part. derived: celex, term_key, term, roles that only composites name: added where the act has
    terms, not the role, and a composite with it. standalone: celex, term_key, term, added unless the role is there.
    """
    columns = ["term", "term_key", "celex", "category", "source_id", "definition"]
    own = terms.filter("celex is not null").select("term_id", *columns)
    found = own.join(promoted(own, components, derived), "term_id", "left_semi").select(*columns, F.lit("defined_term").alias("source_type"))
    none = [F.lit(None).cast("string").alias("source_id"), F.lit("").alias("definition")]
    composite = components.select("celex", F.col("part").alias("term_key")).distinct()
    more = derived.join(found.select("celex").distinct(), "celex", "left_semi").join(composite, ["celex", "term_key"], "left_semi").join(found.select("celex", "term_key"), ["celex", "term_key"], "left_anti")
    found = found.unionByName(more.select("term", "term_key", "celex", F.lit("derived").alias("category"), *none, F.lit("derived_role").alias("source_type")))
    alone = standalone.join(found.select("celex", "term_key"), ["celex", "term_key"], "left_anti")
    found = found.unionByName(alone.select("term", "term_key", "celex", F.lit("standalone").alias("category"), *none, F.lit("standalone_curated").alias("source_type")))
    return found.withColumn("role_id", role_id(F.col("term_key"), F.col("celex"))).dropDuplicates(["role_id"])


def includes(roles: DataFrame, components: DataFrame) -> DataFrame:
    """role, part, source_id: composite roles with their parts, curated ones or those that a definition only lists."""
    part = roles.select("celex", F.col("term_key").alias("part_key"), F.col("term").alias("part_term"), F.col("role_id").alias("part"))
    wide = roles.filter("category <> 'actor'").select("celex", "term_key", F.col("role_id").alias("role"), "source_id", "definition")
    curated = wide.join(components.select("celex", "term_key", F.col("part").alias("part_key")), ["celex", "term_key"]).join(part, ["celex", "part_key"]).filter("role <> part").select("role", "part", "source_id")
    open_ = cut(wide.join(curated.select("role").distinct(), "role", "left_anti").withColumn("clause", first_clause(definition_body(F.col("definition")))))
    said = patterns.occurrences(open_.select(F.col("role").alias("id"), F.col("clause").alias("text")), part.select(F.lower("part_term").alias("pattern")), whole_words=True)
    said = said.select(F.col("id").alias("role"), F.col("pattern").alias("name")).distinct()
    named = open_.join(said, "role").join(part.withColumn("name", F.lower("part_term")), ["celex", "name"]).filter("role <> part")
    only = named.groupBy("role", "clause").agg(F.collect_set("name").alias("names")).filter(only_names(F.col("clause"), F.col("names"))).select("role")
    return curated.unionByName(named.join(only, "role", "left_semi").select("role", "part", "source_id")).dropDuplicates(["role", "part"])


def equivalences(pairs: DataFrame) -> DataFrame:
    """Both directions of curated pairs (left_term, left_celex, right_term, right_celex, and what else): src, dst, and what else."""
    left, right = (role_id(term_key(F.col(f"{s}_term")), F.col(f"{s}_celex")) for s in ("left", "right"))
    rest = [c for c in pairs.columns if c not in ("left_term", "left_celex", "right_term", "right_celex")]
    return pairs.select(left.alias("src"), right.alias("dst"), *rest).unionByName(pairs.select(right.alias("src"), left.alias("dst"), *rest)).dropDuplicates(["src", "dst"])


def obligations(provisions: DataFrame, roles: DataFrame) -> DataFrame:
    """provision, role, modality, cue: provisions (id, celex, title, text) that oblige a role of their act.

    The role stands in the first sentence, or the title is its name or speaks of obligations; without a modal verb only a
    title that is the role's name obliges.
    """
    rows = provisions.filter("text is not null and text <> ''").select("id", "celex", F.coalesce("title", F.lit("")).alias("title"), first_sentence(F.col("text")).alias("sentence"))
    rows = cut(rows)
    asked = roles.filter("term is not null and term <> ''").select("celex", "role_id", "term").distinct()
    met = [named_in(rows.select("id", "celex", F.col(c).alias("text")), asked).withColumn(f"in_{c}", F.lit(True)) for c in ("sentence", "title")]
    hits = met[0].join(met[1], ["id", "role_id"], "full").select("id", "role_id", *[F.coalesce(f"in_{c}", F.lit(False)).alias(f"in_{c}") for c in ("sentence", "title")])
    both = hits.join(rows, "id").join(asked.select("role_id", "term").distinct(), "role_id")
    low, name = F.lower("title"), F.lower("term")
    in_title, in_text = F.col("in_title"), F.col("in_sentence")
    rest = F.trim(F.regexp_replace(F.replace(F.replace(low, plural_column(name), F.lit("")), name, F.lit("")), r"^[ .,:;-]+|[ .,:;-]+$", ""))
    is_title = in_title & rest.isin("", "the", "a", "an")
    modality = F.coalesce(rules.role_modality(F.col("title"), F.col("sentence")), F.when(is_title, "obligation"))
    kept = both.withColumn("modality", modality).filter("modality is not null").filter(in_text | (in_title & (low.contains("obligation") | is_title)))
    return kept.select(F.col("id").alias("provision"), F.col("role_id").alias("role"), "modality", F.when(in_text, "text").otherwise("title").alias("cue")).dropDuplicates(["provision", "role"])


# --- edges -------------------------------------------------------------------------------------------------------


def delegations(edge: DataFrame, node: DataFrame, authority: str = "binding") -> DataFrame:
    """src, dst, ref_text, phrase, authority: citations from outside the annexes into one, whose text hands on with a phrase."""
    kinds = node.select("id", "kind", "text")
    source = kinds.filter(~F.col("kind").startswith("annex")).select(F.col("id").alias("src"), "text")
    target = kinds.filter(F.col("kind").startswith("annex")).select(F.col("id").alias("dst"))
    rows = edge.filter("type = 'CITES'").join(source, "src").join(target, "dst").withColumn("phrase", rules.delegation_phrase(F.col("text")))
    return rows.filter("phrase is not null").select("src", "dst", F.coalesce("ref_text", F.lit("")).alias("ref_text"), "phrase", F.lit(authority).alias("authority")).dropDuplicates(["src", "dst"])


def amendment_edges(node: DataFrame, closed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """src, dst, amending, operation, target_ref: points below an article that says which act is amended, to what they open with.

    catalogue: number, celex. An act that is not in it, and the article's own, give nothing; a target has to exist.
    """
    plain = lambda c: F.regexp_replace(c, "[\\u00a0\\s]+", " ")
    number = F.regexp_extract(plain(F.col("text")), r"(?i)regulation ?\(EU\) ?([0-9]+/[0-9]+).{0,80}?\bis amended\b", 1)
    heads = node.filter("kind = 'article' and lower(text) like '%amended as follows%'").select(F.col("id").alias("anc"), F.col("celex").alias("amending"), number.alias("number"))
    heads = heads.join(catalogue.select("number", F.col("celex").alias("amended")), "number").filter("amended <> amending")
    below = heads.join(closed.filter("dist between 1 and 6"), "anc").join(node.select(F.col("id").alias("desc_id"), plain(F.col("text")).alias("says")), "desc_id")
    opening = r"(?i)^ ?(?:in |the following )?(article|annex) ([0-9]+[a-z]?|[IVXLC]+)\b"
    kind, value = F.lower(F.regexp_extract("says", opening, 1)), F.regexp_extract("says", opening, 2)
    operation = F.lower(F.regexp_extract("says", r"(?i)\b(replaced|inserted|deleted|amended|added|repealed)\b", 1))
    rows = below.withColumn("operation", operation).filter((kind != "") & (operation != ""))
    rows = rows.select(F.col("desc_id").alias("src"), F.concat("amended", F.when(kind == "annex", F.lit("_anx_")).otherwise(F.lit("_art_")), value).alias("dst"), "amending", "operation", F.concat(F.initcap(kind), F.lit(" "), value).alias("target_ref"))
    return rows.join(node.select(F.col("id").alias("dst")), "dst", "left_semi").dropDuplicates(["src", "dst"])


def target_ids(celex: str, parts: dict[str, str]) -> list[str]:
    """Ids that reference parts can mean in an act, the likeliest first: the paragraph, then the point of a list of definitions, then what lies above."""
    if parts.get("annex"):
        base = f"{celex}_anx_{parts['annex']}"
        deeper = [f"{base}_sec_{parts['section']}"] if parts.get("section") else []
        return [*([f"{base}_{parts['point']}"] if parts.get("point") else []), *deeper, base]
    article, para, point, sub = (parts.get(k) for k in ("article", "paragraph", "point", "subpoint"))
    if not article:
        return []
    whole = f"{celex}_art_{article}"
    out = []
    if para:
        base = f"{celex}_{int(article):03d}.{int(para):03d}" if para.isdigit() else whole
        out += [f"{base}_pt_{point}_rm_{sub}"] * bool(point and sub) + [f"{base}_pt_{point}"] * bool(point) + [base] * (not point) + [f"{whole}_pt_{para}"]
    elif point:
        out += [f"{whole}_pt_{point}_rm_{sub}"] * bool(sub) + [f"{whole}_pt_{point}"]
    return [*dict.fromkeys([*out, whole])]


def bound_parts(text: str | None, aliases: list[str], number: str | None) -> list[dict[str, str]]:
    """Parts of articles and annexes that a text ties to one act: 'Article 6(1) of the MDR', 'MDR Annex III', 'Annex VIII of Regulation (EU) 2017/745'."""
    r = Reader(text or "")
    names = [tuple(a.lower().split()) for a in aliases]

    def named(at: int) -> int | None:
        """Behind a name of the act, if one stands here."""
        for words in sorted(names, key=len, reverse=True):
            end = r.words(at, words)
            if end is not None:
                return end
        if number and r.is_(at, "act") and r.t[at].raw == number:
            return at + 1
        act = r.act(at) if at < len(r.t) else None
        return act[0] if act and number and act[1]["number"] == number else None

    out: list[dict[str, str]] = []
    for i in range(len(r.t)):
        found = r.article(i) or r.annex(i) if r.t[i].kind == "word" else None
        if found:
            at = found[0]
            if r.word(at, "of", "to", "under"):
                at += 1
                at += r.word(at, "the")
                if named(at) is not None:
                    out.append(found[1])
        end = named(i)
        if end is not None:
            at = r.comma(end)
            behind = r.article(at) or r.annex(at) if at < len(r.t) else None
            if behind:
                out.append(behind[1])
    return [x for k, x in enumerate(out) if x not in out[:k]]


def narrowed(edges: DataFrame, node_ids: DataFrame, term_sources: DataFrame, names: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """src, dst, fallback, how: edges of texts to whole documents (src, dst, celex, text), led to the provisions that the text ties to the act.

    First articles and annexes bound to it, each to the first of its ids that exists; else quoted terms it defines ("X" means;
    term_sources: celex, term, source_id); else the document. names: by act its number and short names.
    """

    def run(batches):
        for b in batches:
            rows = []
            for src, dst, celex, text in zip(*(b.column(c).to_pylist() for c in ("src", "dst", "celex", "text"))):
                number, aliases = names.get(celex, (None, []))
                options = [target_ids(celex, p) for p in bound_parts(text, aliases, number)]
                terms = [t.strip().lower() for t in re.findall("[\"'“‘]([^\"'“”‘’]{2,60})[\"'”’]\\s+means\\b", text or "", re.IGNORECASE)]
                rows.append((src, dst, celex, options, list(dict.fromkeys(terms))))
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["src", "dst", "celex", "options", "terms"])

    found = edges.select("src", "dst", "celex", "text").mapInArrow(run, "src string, dst string, celex string, options array<array<string>>, terms array<string>").distinct()
    each = found.select("src", "dst", F.posexplode("options").alias("at", "ids")).select("src", "dst", "at", F.posexplode("ids").alias("rank", "id"))
    bound = each.join(node_ids.select("id"), "id", "left_semi").groupBy("src", "dst", "at").agg(F.min_by("id", "rank").alias("new")).select("src", "dst", "new").distinct()
    loose = found.join(bound.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    defined = loose.select("src", "dst", "celex", F.explode("terms").alias("term")).join(term_sources.select("celex", F.lower(F.trim("term")).alias("term"), F.col("source_id").alias("new")), ["celex", "term"]).select("src", "dst", "new").distinct()
    led = bound.withColumn("how", F.lit("reference")).unionByName(defined.withColumn("how", F.lit("definition")))
    rest = found.join(led.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", F.col("dst"), F.lit(None).cast("string").alias("fallback"), F.lit("document").alias("how"))
    return led.select("src", F.col("new").alias("dst"), F.col("dst").alias("fallback"), "how").unionByName(rest)


def curated_patches(patches: DataFrame, node: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges src, dst, rationale of curated obligations (ref, celex, term, rationale), and those that stay unresolved, with why."""
    from docweave.operators.linking import curated_targets

    found = curated_targets(patches.select("ref", "celex").distinct(), node)
    rows = patches.join(found, ["ref", "celex"], "left").withColumn("term_key", term_key(F.col("term"))).join(roles.select("celex", "term_key", "role_id"), ["celex", "term_key"], "left")
    why = F.when(F.col("id").isNull(), "provision").when(F.col("role_id").isNull(), "role")
    return rows.filter(why.isNull()).select(F.col("id").alias("src"), F.col("role_id").alias("dst"), "rationale").dropDuplicates(["src", "dst"]), rows.filter(why.isNotNull()).select("ref", "celex", "term", why.alias("why"))
