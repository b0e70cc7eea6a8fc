"""References to nodes: structural context of each provision, an index of numbered provisions, and ranked candidates.

Provisions have celex, seq (document order), id, kind, number, parent_id, path (ids from the root to the node) and text.
A reference gets a list of candidate keys, the best first; the first that the index knows is its target.

Defined results: provisions without a number are in no index; of provisions with one key the last in order counts; a
reference without a known candidate, and one to its own provision, gives no edge; of several references between two
provisions the first stays; a null or empty text has none.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.storage import shared_dir, stored
from docweave.operators import references, scan

#: Kinds that carry numbers which keys are made of.
NUMBERED = ("chapter", "article", "paragraph", "subparagraph", "point", "annex")


def with_paths(provisions: DataFrame) -> DataFrame:
    """Adds path, by doubling: after k rounds a node knows its 2**k nearest ancestors, so a deep tree takes few joins."""
    up = provisions.select("id", F.col("parent_id").alias("above"), F.array("id").alias("path"))
    while True:
        other = up.select(F.col("id").alias("above"), F.col("above").alias("further"), F.col("path").alias("head"))
        up = up.join(other, "above", "left").select("id", F.col("further").alias("above"), F.concat(F.coalesce("head", F.array().cast("array<string>")), "path").alias("path"))
        if up.filter("above is not null").isEmpty():
            return provisions.drop("path").join(up.select("id", "path"), "id")


def _ancestor_numbers(provisions: DataFrame) -> DataFrame:
    """parent (the nearest ancestor) and, for each numbered kind, the number of the nearest provision of that kind at or above it.

    Children of one parent have the same ancestors, so paths are taken apart once a parent.
    """
    above = provisions.select(_ancestors().alias("above")).filter(F.size("above") > 0).groupBy(F.element_at("above", -1).alias("parent")).agg(F.any_value("above").alias("above"))
    above = above.select("parent", F.posexplode("above").alias("at", "anc"))
    numbers = provisions.filter(F.col("kind").isin(*NUMBERED)).select(F.col("id").alias("anc"), "kind", "number")
    nearest = [F.max(F.when(F.col("kind") == k, F.struct("at", "number")))["number"].alias(f"in_{k}") for k in NUMBERED]
    return above.join(numbers, "anc").groupBy("parent").agg(*nearest)


def _ancestors() -> Column:
    return F.filter("path", lambda x: x != F.col("id"))


def _with_ancestor_numbers(provisions: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (some of the provisions) with the numbers of their ancestors, null where there are none."""
    return rows.withColumn("parent", F.try_element_at(_ancestors(), F.lit(-1))).drop("path").join(_ancestor_numbers(provisions), "parent", "left").drop("parent")


def ancestor_numbers(provisions: DataFrame) -> DataFrame:
    """id and, for each numbered kind, the number of the nearest ancestor of that kind (in_chapter, in_article, ...)."""
    some = F.coalesce(*[F.col(f"in_{k}") for k in NUMBERED]).isNotNull()
    return _with_ancestor_numbers(provisions, provisions.select("id", "path")).filter(some)


def nearest_ancestor(provisions: DataFrame, kind: str) -> DataFrame:
    """id and the number of its nearest ancestor of a kind, null if it has none."""
    return provisions.select("id").join(ancestor_numbers(provisions).select("id", F.col(f"in_{kind}").alias("number")), "id", "left")


def _joined(*parts: Column) -> Column:
    """The parts with dots between, null if one is null."""
    return reduce(lambda a, b: F.concat(a, F.lit("."), b), parts)


def index(provisions: DataFrame) -> DataFrame:
    """celex, key_kind, key, target: compound keys of all numbered provisions; the last in document order counts.

    Points below paragraphs have a second key without the paragraph (key_kind some_point), where the first in order counts.
    Where provisions have the numbers of their nearest ancestors (in_article, in_paragraph, ...; kinds that are not there have none) instead of path, nothing is joined.
    """
    rows = provisions.filter("number is not null and number <> ''")
    if "path" not in provisions.columns:
        rows = rows.withColumns({f"in_{k}": F.lit(None).cast("string") for k in NUMBERED if f"in_{k}" not in provisions.columns})
    else:
        rows = _with_ancestor_numbers(provisions, rows.select("celex", "id", "seq", "kind", "number", "path"))
    n, art, par, pt = F.col("number"), F.col("in_article"), F.col("in_paragraph"), F.col("in_point")
    kind = F.col("kind")
    key = (
        F.when(kind.isin("article", "annex", "chapter", "recital"), n)
        .when(kind == "section", F.coalesce(_joined(F.col("in_chapter"), n), n))
        .when(kind == "paragraph", _joined(art, n))
        .when(kind == "subparagraph", _joined(art, par, n))
        .when(kind == "point", F.coalesce(_joined(art, par, n), _joined(art, n)))
        .when(kind == "roman_item", F.coalesce(_joined(art, par, pt, n), _joined(art, pt, n)))
        .when(kind.isin("annex_section", "annex_point"), _joined(F.col("in_annex"), n))
    )
    entry = lambda k, value: F.when(value.isNotNull(), F.struct(k.alias("key_kind"), value.alias("key")))
    some = F.lit("some_point")
    entries = F.array(entry(kind, key), entry(some, F.when((kind == "point") & par.isNotNull(), _joined(art, n))))
    keyed = rows.select("celex", "id", "seq", F.explode(F.array_compact(entries)).alias("x")).select("celex", "id", "seq", "x.key_kind", "x.key")
    # Nearly all keys are different, so rows are shuffled as they are: sums of a task would have id and seq twice, and be sorted for it.
    keyed = keyed.repartition("celex", "key_kind", "key").groupBy("celex", "key_kind", "key").agg(F.max_by("id", "seq").alias("last"), F.min_by("id", "seq").alias("first"))
    return keyed.select("celex", "key_kind", "key", F.when(F.col("key_kind") == some, F.col("first")).otherwise(F.col("last")).alias("target"))


def with_context(provisions: DataFrame) -> DataFrame:
    """Adds ctx_chapter, ctx_article, ctx_paragraph, ctx_subparagraph: numbers carried on in document order.

    An article ends the paragraph and subparagraph before it, a paragraph the subparagraph. The last of each kind is carried on by a scan over ranges of
    (celex, seq), so an act may be as long as the corpus; what has ended is older than what ended it.
    """
    kinds = ("chapter", "article", "paragraph", "subparagraph")
    rows = scan.ranged(provisions, ["celex"], ["seq"])
    last = scan.finished(scan.carried(rows, ["seq"], {f"__{k}": F.when(F.col("kind") == k, F.struct("seq", "number")) for k in kinds}))
    article, paragraph, sub = (F.col(f"__{k}") for k in kinds[1:])
    older = lambda x, than: than["seq"].isNotNull() & (x["seq"] < than["seq"])
    context = {
        "ctx_chapter": F.col("__chapter.number"),
        "ctx_article": article["number"],
        "ctx_paragraph": F.when(~older(paragraph, article), paragraph["number"]),
        "ctx_subparagraph": F.when(~older(sub, article) & ~older(sub, paragraph), sub["number"]),
    }
    return last.withColumns(context).drop(*[f"__{k}" for k in kinds])


def act_id(kind: Column, series: Column, number: Column, suffix: Column) -> Column:
    """ext_regulation_eu_2016_679: the parts that are there, in lower case, joined by underscores."""
    return F.concat_ws("_", F.lit("ext"), F.lower(kind), F.lower(series), F.translate(number, "/", "_"), F.lower(suffix))


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("match", T.StringType()), T.StructField("groups", T.MapType(T.StringType(), T.StringType()))]))
CONTEXT = ("chapter", "article", "paragraph", "subparagraph")


def _read(provisions: DataFrame, texts: bool) -> DataFrame:
    """The provisions in the order of (celex, seq), dealt out by ranges of it: part and n (numbers of the range and the row, in that order), found (the references of
    the text), and ctx_chapter, ... as far as the range tells; open has the bits of those that come from the ranges before. At the end of an act or
    a range stands a row of its own (end), with what goes on into the next range.

    A range is read as a stream: nothing of an act is kept but its four numbers. Without texts, references come without what they match.
    """
    import pyarrow as pa

    numbers = [c for c in provisions.columns if c in {f"in_{k}" for k in NUMBERED}]
    carried = ["celex", "id", "kind", "number", *numbers]
    ordered = provisions.repartitionByRange("celex", "seq").sortWithinPartitions("celex", "seq").select(*carried, "text")
    text = lambda name: T.StructField(name, T.StringType())
    own = [T.StructField("found", FOUND), *[text(f"ctx_{k}") for k in CONTEXT], T.StructField("open", T.IntegerType()), T.StructField("end", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType())]
    schema = T.StructType([*[T.StructField(c, ordered.schema[c].dataType) for c in carried], *own])
    kinds = [pa.list_(pa.struct([("kind", pa.string()), ("match", pa.string()), ("groups", pa.map_(pa.string(), pa.string()))])), *[pa.string()] * 4, pa.int32(), pa.bool_(), pa.int32(), pa.int64()]

    def run(batches):
        part = TaskContext.get().partitionId()
        row, act, now, unknown = part << 33, None, [None] * 4, 15
        types = None

        def ended():
            values = [[act], *[[None] for _ in carried[1:]], [None], *[[x] for x in now], [unknown], [True], [part], [row]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=schema.names)

        for b in batches:
            found, contexts, opened, begun = [], [], [], 0
            for at, (celex, kind, number, said) in enumerate(zip(*(b.column(c).to_pylist() for c in ("celex", "kind", "number", "text")), strict=True)):
                if types is None:
                    types, act = [*[b.schema.field(c).type for c in carried], *kinds], celex
                if celex != act:
                    if at > begun:
                        yield pa.RecordBatch.from_arrays([*[b.column(c).slice(begun, at - begun) for c in carried], *[pa.array(v, t) for v, t in zip([found, *(list(x) for x in zip(*contexts, strict=True)), opened, [False] * len(opened), [part] * len(opened), list(range(row - len(opened), row))], kinds, strict=True)]], names=schema.names)
                        found, contexts, opened, begun = [], [], [], at
                    yield ended()
                    act, now, unknown = celex, [None] * 4, 15
                    row += 1
                if kind in CONTEXT:
                    k = CONTEXT.index(kind)
                    now[k], unknown = number, unknown & ~(1 << k)
                    if k in (1, 2):  # an article ends the paragraph and the subparagraph before it, a paragraph the latter
                        now[k + 1 :], unknown = [None] * (3 - k), unknown & ((2 << k) - 1)
                found.append([{"kind": x["kind"], "match": x["match"] if texts else None, "groups": x["groups"]} for x in references.located_references(said)] if said else None)
                contexts.append(tuple(now))
                opened.append(unknown)
                row += 1
            if opened:
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(begun) for c in carried], *[pa.array(v, t) for v, t in zip([found, *(list(x) for x in zip(*contexts, strict=True)), opened, [False] * len(opened), [part] * len(opened), list(range(row - len(opened), row))], kinds, strict=True)]], names=schema.names)
        if types is not None:
            yield ended()

    return ordered.mapInArrow(run, schema)


def _items(rows: DataFrame) -> DataFrame:
    """Each reference of _read() rows, numbered in its text (at), with its parts p and the whole context; ranges and point lists one row a number (item)."""
    opened = lambda k: F.col("open").bitwiseAND(1 << k) != 0
    ends = rows.filter("end").select("celex", "part", "n", *[F.when(~opened(k), F.struct(F.col(f"ctx_{x}").alias("x"))).alias(f"__{x}") for k, x in enumerate(CONTEXT)])
    before = Window.partitionBy("celex").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(F.col("celex").alias("__celex"), F.col("part").alias("__part"), *[F.last(f"__{x}", ignorenulls=True).over(before).alias(f"__{x}") for x in CONTEXT])
    carries = carries.filter(F.coalesce(*[F.col(f"__{x}") for x in CONTEXT]).isNotNull())  # fewer than ranges
    cited = rows.filter("size(found) > 0").join(F.broadcast(carries), (F.col("part") == F.col("__part")) & F.col("celex").eqNullSafe(F.col("__celex")), "left")
    context = [F.when(opened(k), F.col(f"__{x}.x")).otherwise(F.col(f"ctx_{x}")).alias(f"ctx_{x}") for k, x in enumerate(CONTEXT)]
    each = cited.select("celex", "id", "n", *context, F.posexplode("found").alias("at", "s")).select("celex", "id", "n", *[f"ctx_{x}" for x in CONTEXT], "at", F.col("s.kind").alias("ref_kind"), F.col("s.match").alias("match"), F.col("s.groups").alias("p"))
    numbers = numbers_of(F.col("p"))
    return each.select("*", F.posexplode(F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(None).cast("string")))).alias("place", "item"))


def numbers_of(p: Column) -> Column:
    """The numbers of a range, an enumeration or a list of an annex's points; empty for other references and for spans too wide to list."""
    listed = F.split(F.coalesce(p["listed"], p["points"]), " ")
    first, last = (F.regexp_extract(p[k], r"^\(?([0-9]+)", 1).cast("long") for k in ("first", "last"))
    span = F.when((first <= last) & (last - first <= references.MOST_RANGE), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.when(p["first"].isNotNull(), span.cast("array<string>")).when(listed.isNotNull(), listed).otherwise(F.array().cast("array<string>"))


def _ends(p: Column) -> list[Column]:
    return [F.regexp_extract(p[k], r"^\(?([0-9]+)", 1).cast("decimal(38, 0)") for k in ("first", "last")]


def wide(ref_kind: Column, p: Column) -> Column:
    """Whether a reference is a span of more numbers than are listed."""
    first, last = _ends(p)
    return F.coalesce((ref_kind == "range") & p["first"].isNotNull() & (last - first > references.MOST_RANGE), F.lit(False))


def wide_spans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """celex, id, n, at, item, match, target: of spans of more numbers than are listed, what the index has between the ends."""
    p = F.col("p")
    first, last = _ends(p)
    spans = rows.filter(wide(F.col("ref_kind"), p)).select("celex", "id", "n", "at", "match", p["unit"].alias("key_kind"), first.alias("a"), last.alias("b"))
    number = known.filter(F.col("key").rlike("^[0-9]{1,38}$")).select("celex", "key_kind", "target", F.col("key").cast("decimal(38, 0)").alias("number"))
    return spans.join(number, ["celex", "key_kind"]).filter(F.col("number").between(F.col("a"), F.col("b"))).select("celex", "id", "n", "at", F.col("number").cast("string").alias("item"), "match", "target")


def _candidate(kind: str | Column, *parts: Column) -> Column:
    key = _joined(*parts)
    return F.when(key.isNotNull(), F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("key_kind"), key.alias("key")))


def _article_chain(article: Column, paragraph: Column, point: Column, subpoint: Column) -> list[Column]:
    """From the deepest node to the article; a point without a paragraph also stands for the first such point of the article."""
    loose = paragraph.isNull()
    only = lambda c: F.when(loose, c)
    return [
        _candidate("roman_item", article, paragraph, point, subpoint), _candidate("point", article, paragraph, point),
        only(_candidate("roman_item", article, point, subpoint)), only(_candidate("point", article, point)), only(_candidate("some_point", article, point)),
        _candidate("paragraph", article, paragraph), _candidate("article", article),
    ]


def candidates(ref_kind: Column, p: Column, item: Column, context: dict[str, Column]) -> Column:
    """The keys that a reference may mean, the best first. context: chapter, article, paragraph, subparagraph of its place."""
    null = F.lit(None).cast("string")
    part = lambda name: p[name]
    chapter, article, paragraph, subparagraph = (context[k] for k in ("chapter", "article", "paragraph", "subparagraph"))
    annex, section, point, sub, number = part("annex"), part("section"), part("point"), part("subpoint"), part("paragraph")
    listed = lambda options: F.filter(F.array(*options), lambda c: c.isNotNull())
    explicit = (
        F.when(part("points").isNotNull(), listed([_candidate("annex_point", annex, item), _candidate("annex", annex)]))
        .when(part("chapter").isNotNull(), listed([_candidate("section", part("chapter"), section)]))
        .when(part("reversed").isNotNull(), listed([_candidate("annex_section", annex, section), _candidate("annex", annex)]))
        .when(annex.isNotNull(), listed([_candidate("annex_point", annex, point), F.when(point.isNull(), _candidate("annex_section", annex, section)), _candidate("annex", annex)]))
        .otherwise(listed(_article_chain(part("article"), number, point, sub)))
    )
    this = F.when(part("this") == "article", listed([_candidate("article", article)])).when(part("this") == "paragraph", listed([_candidate("paragraph", article, paragraph)])).otherwise(listed([_candidate("subparagraph", article, paragraph, subparagraph)]))
    located = F.when(part("article").isNotNull(), F.when(point.isNotNull(), listed(_article_chain(part("article"), null, point, sub))).otherwise(listed([_candidate("article", part("article"))]))).when(
        point.isNotNull(), listed([_candidate("roman_item", article, number, point, sub), _candidate("point", article, number, point)])
    ).otherwise(listed([_candidate("paragraph", article, number)]))
    ordinal = reduce(lambda c, x: c.when(part("ordinal") == x[1], F.lit(str(x[0]))), enumerate(references.ORDINALS, 1), F.when(F.lit(False), null))
    here = F.coalesce(paragraph, F.lit("1"))
    relative = (
        F.when(part("this").isNotNull(), this)
        .when(part("via").isNotNull(), located)
        .when(part("the").isNotNull(), listed([_candidate("subparagraph", article, F.coalesce(number, paragraph), ordinal)]))
        .when(number.isNotNull(), F.when(point.isNotNull(), listed([_candidate("point", article, number, point)])).otherwise(listed([_candidate("paragraph", article, number)])))
        .when(point.isNotNull(), listed([_candidate("roman_item", article, here, point, sub), _candidate("point", article, here, point)]))
        .when(part("scope") == "chapter", listed([_candidate("section", chapter, section)]))
        .otherwise(listed([_candidate("none", null)]))
    )
    ranged = listed([_candidate(part("unit"), item)])
    return F.when(ref_kind == "explicit", explicit).when(ref_kind == "relative", relative).when(ref_kind == "range", ranged).otherwise(listed([_candidate("none", null)]))


EDGE = ["celex", "source", "type", "target", "ref_text"]


def resolve(provisions: DataFrame, texts: bool = True) -> DataFrame:
    """celex, source, type, target, ref_text: the edges of all references. CITES inside the act, CITES_EXTERNAL and AMENDS between acts.

    Provisions have path, or the numbers of their nearest ancestors as index() takes them. They are read once, in document order, and stored as a table of what they
    say; that table stays in the shared folder as long as the edges are read from it. From then on a row has the number of its provision in place of seq. The index
    holds the kinds of keys that are asked for; candidates meet it once, and what they find is shuffled once, by source. Without texts, ref_text is null.
    """
    spark = provisions.sparkSession
    numbers = [c for c in provisions.columns if c in {f"in_{k}" for k in NUMBERED}]
    rows = stored(_read(provisions.select("celex", "seq", "id", "kind", "number", *numbers, "text"), texts), f"{shared_dir(spark)}/references-{uuid.uuid4().hex}", "zstd")
    p = F.col("p")
    cited = _items(rows).withColumn("c", candidates(F.col("ref_kind"), p, F.col("item"), {k: F.col(f"ctx_{k}") for k in CONTEXT}))
    asked = cited.agg(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform("c", lambda x: x["key_kind"]))))).alias("kinds"), F.bool_or(wide(F.col("ref_kind"), p)).alias("wide")).first()
    known = index(provisions if "path" in provisions.columns else rows.filter("not end").select("celex", F.col("n").alias("seq"), "id", "kind", "number", *numbers))
    tried = cited.select("celex", "id", "n", "at", F.col("place").cast("string").alias("item"), "match", F.posexplode("c").alias("rank", "c")).select("celex", "id", "n", "at", "item", "match", "rank", "c.key_kind", "c.key")
    edge = lambda df, kind, source, target, text: df.select("celex", source.alias("source"), "n", "at", "item", "rank", F.lit(kind).alias("type"), target.alias("target"), text.alias("ref_text"))
    match = F.col("match") if texts else F.lit(None).cast("string")
    every = edge(tried.join(known.filter(F.col("key_kind").isin(asked["kinds"])), ["celex", "key_kind", "key"]), "CITES", F.col("id"), F.col("target"), match)
    if asked["wide"]:
        every = every.unionByName(edge(wide_spans(cited, known).withColumns({"item": F.concat(F.lit("wide "), "item"), "rank": F.lit(0)}), "CITES", F.col("id"), F.col("target"), match))
    whole = cited.withColumns({"item": F.col("place").cast("string"), "rank": F.lit(0)})
    said = F.concat_ws(" ", p["qualified"], "match") if texts else match
    every = every.unionByName(edge(whole.filter("ref_kind = 'external'"), "CITES_EXTERNAL", F.col("id"), act_id(p["type"], p["series"], p["number"], p["suffix"]), said))
    of = lambda who: act_id(p[f"{who}_type"], p[f"{who}_series"], p[f"{who}_number"], p[f"{who}_suffix"])
    first = lambda df: df.groupBy("celex", "source", "target").agg(F.min(F.struct("n", "at", "type", "ref_text")).alias("x"))
    # one act may amend another in very many provisions: these are summed up before they go to its place
    amends = first(edge(whole.filter("ref_kind = 'amended'"), "AMENDS", of("by"), of("base"), match)).select("celex", "source", "x.n", "x.at", F.concat(F.lit("amends "), "target").alias("item"), F.lit(0).alias("rank"), "x.type", "target", "x.ref_text")
    every = every.unionByName(amends).repartition("celex", "source")
    best = every.groupBy("celex", "source", "n", "at", "item", "type").agg(F.min(F.struct("rank", "target", "ref_text")).alias("x")).select("celex", "source", "n", "at", "type", "x.target", "x.ref_text")
    return first(best.filter("source <> target")).select("celex", "source", "x.type", "target", "x.ref_text").select(EDGE)


GUIDANCE = T.ArrayType(T.StructType([T.StructField("number", T.StringType()), T.StructField("ref_text", T.StringType()), T.StructField("how", T.StringType())]))


def guidance_edges(provisions: DataFrame, names: dict[str, str]) -> DataFrame:
    """source, target, number, ref_text, how: the acts that guidance texts refer to. names: short names of acts and their numbers."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("number", pa.string()), ("ref_text", pa.string()), ("how", pa.string())]))

    def run(batches):
        for b in batches:
            found = [references.guidance_references(v, names) for v in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, kind)], names=["id", "found"])

    schema = T.StructType([provisions.schema["id"], T.StructField("found", GUIDANCE)])
    rows = provisions.select("id", "text").mapInArrow(run, schema).select(F.col("id").alias("source"), F.explode("found").alias("x"))
    return rows.select("source", act_id(F.lit("regulation"), F.lit("eu"), F.col("x.number"), F.lit(None).cast("string")).alias("target"), "x.number", "x.ref_text", "x.how")
