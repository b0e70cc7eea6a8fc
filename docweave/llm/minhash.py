"""Near-duplicate documents by min-max hashing (operator 7).

A document is the set of its distinct runs of five words. Each of PERMUTATIONS permutations of the hashed set
gives both its minimum and its maximum, so 64 permutations make 128 values of a signature. Bands of ROWS values
propose candidates: two sets of similarity 0.85 share none of the 25 bands with a chance of 4e-7, of 0.8 with 5e-5.

Equal sets are first reduced to their smallest document. In a band's bucket all members are compared with one
leader, the member with the most neighbours over all bands, which is the text that near copies were made from;
each candidate is confirmed on the full sets. Buckets whose members are then still in different components
are finished exactly: members are joined on the rarest parts of their sets (two sets of Jaccard t share one of
their n - ceil(t n) + 1 rarest elements), so no link between different texts is lost and a group's pairs are
never all listed. Components of the links are found by star contractions on tables.

Defined results: a text that is null or has no word has no shingle, no link and is its own component; with fewer
than five words the whole sequence is one shingle. A null doc_id takes part in nothing: its component is null and
it is kept. The nodes of the links are the distinct sets, so rows that repeat a doc_id with another text are judged
one by one, and equal rows get equal results. Other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._components import components
from docweave.llm._frames import append_columns, materialise, read, release
from docweave.llm._words import U, mix, slices, words

SHINGLE_WORDS = 5
PERMUTATIONS = 64
ROWS = 5
PERCENT = 85
#: What a corpus is cleaned of: looser than the query, which has its own contract.
CORPUS_PERCENT = 80
SLICE_BYTES = 1 << 20
REST = "__dw_rest"

_rng = np.random.default_rng(1_299_709)
_COEFFICIENTS = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * U(2) + U(1)
_FLIPS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_FACTORS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_PLACES = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * U(2) + U(1)
BANDS = 2 * PERMUTATIONS // ROWS


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different shingle hashes of each text, one after the other, and where each text's begin."""
    w = words(column)
    h, counts = w.hashes(), w.counts
    runs = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    begins = np.concatenate(([0], np.cumsum(runs)))
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], runs) + np.repeat(w.first[:-1], runs)
    size = np.repeat(np.minimum(counts, SHINGLE_WORDS), runs)
    total = size.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    padded = np.concatenate([h, np.zeros(SHINGLE_WORDS, np.uint64)])
    for j in range(SHINGLE_WORDS):
        total += np.where(size > j, padded[at + j] * _COEFFICIENTS[j], U(0))
    total = mix(total)
    sets = [np.unique(total[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else total, np.concatenate(([0], np.cumsum(sizes)))


def signatures(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Minima and maxima under each permutation, for the sets that are not empty."""
    first = begins[:-1][np.diff(begins) > 0]
    out = np.empty((len(first), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS if len(first) else 0):
        permuted = (flat ^ _FLIPS[k]) * _FACTORS[k]
        out[:, 2 * k] = np.minimum.reduceat(permuted, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(permuted, first)
    return out


def _set_hashes(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; 0 of an empty one."""
    some = np.flatnonzero(np.diff(begins) > 0)
    one, two = np.zeros(len(begins) - 1, np.uint64), np.zeros(len(begins) - 1, np.uint64)
    if len(some):
        first = begins[:-1][some]
        one[some], two[some] = np.add.reduceat(flat, first), np.add.reduceat(mix(flat ^ U(0x51ED270B)), first)
    return one, two


def _describe(column: pa.Array) -> list[pa.Array]:
    """Size, two hashes of the set, and its band keys (none for an empty set)."""
    n = len(column)
    sizes, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    keys = np.zeros((n, BANDS), np.uint64)
    for a, b in slices(column, SLICE_BYTES):
        flat, begins = shingle_sets(column.slice(a, b - a))
        sizes[a:b] = np.diff(begins)
        some = a + np.flatnonzero(sizes[a:b])
        if not len(some):
            continue
        one[a:b], two[a:b] = _set_hashes(flat, begins)
        values = signatures(flat, begins)
        for band in range(BANDS):
            part = values[:, band * ROWS : (band + 1) * ROWS] * _PLACES
            keys[some, band] = mix(part.sum(axis=1, dtype=np.uint64) + U(band))
    rows = np.flatnonzero(sizes)
    offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
    return [pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[rows].reshape(-1).view(np.int64)))]


_DESCRIBED = T.StructType([T.StructField("n", T.LongType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def set_key() -> Column:
    """A distinct set's node: one number from its two hashes."""
    return F.xxhash64("one", "two")


def _members(ids: DataFrame) -> tuple[bytes, int]:
    """A bit set of fixed size for the ids of a table: which texts the second scan has to turn into sets. It may hold more."""
    bits = 1 << int(min(27, max(20, (16 * ids.count()).bit_length())))

    def pack(batches):
        out = np.zeros(bits, bool)
        for batch in batches:
            out[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    places = ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("place")).distinct()
    packed = places.repartition(1).mapInArrow(pack, "bits binary").first()
    return bytes(packed.bits) if packed else bytes(bits // 8), bits


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, items: the full sets of ids (id, doc_id: a distinct set's node and the document that stands for it)."""
    packed, bits = _members(ids.select(F.col("doc_id").alias("id")))
    wanted = docs.sparkSession.sparkContext.broadcast(packed)
    place = "__dw_place"

    def work(batches):
        told = set()  # a set that many rows of a partition repeat is handed on once
        for batch in batches:
            at = batch.column(place).to_numpy()
            chosen = np.flatnonzero(np.frombuffer(wanted.value, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1)
            part = batch.take(pa.array(chosen))
            for a, b in slices(part.column("text"), SLICE_BYTES):
                flat, begins = shingle_sets(part.column("text").slice(a, b - a))
                names = part.column("doc_id").slice(a, b - a)
                one, two = _set_hashes(flat, begins)
                new = []
                for k, key in enumerate(zip(names.to_numpy().tolist(), one.tolist(), two.tolist())):
                    if key not in told:
                        told.add(key)
                        new.append(k)
                rows = pa.array(new, pa.int64())
                items = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([names.take(rows), pa.array(one.view(np.int64)).take(rows), pa.array(two.view(np.int64)).take(rows), items.take(rows)], names=["doc_id", "one", "two", "items"])
        told.clear()
        release()

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias(place))
    found = rows.mapInArrow(work, "doc_id long, one long, two long, items array<long>").withColumn("id", set_key())
    return found.join(ids, ["id", "doc_id"], "left_semi").dropDuplicates(["id"]).select("id", "items")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("items").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - both
    sized = F.least(F.size("a"), F.size("b")) * 100 >= F.greatest(F.size("a"), F.size("b")) * percent
    return pairs.join(a, "u").join(b, "v").filter(sized & (F.lit(100) * both >= F.lit(percent) * union)).select("u", "v").distinct()


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """docs without the text, with n, one, two (size and hashes of the set), group (a number for each component), component, kept."""
    described = materialise(append_columns(docs, _DESCRIBED, lambda batch: _describe(batch.column("text")), [c for c in docs.columns if c != "text"]))
    grouped = described.filter("n > 0 and doc_id is not null").groupBy("one", "two").agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.first("bands").alias("bands"))
    sets_of = materialise(grouped.withColumn("id", set_key()))
    banded = sets_of.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialise(banded.join(shared, "band"))
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    leaders = members.join(degree, "id").groupBy("band").agg(F.max_by("id", F.struct("degree", F.bitwise_not("id"))).alias("u"))
    stars = members.join(leaders, "band").filter("id <> u").select("u", F.col("id").alias("v")).distinct()
    candidates = sets_of.select("id", "doc_id").join(members.select("id").distinct(), "id", "left_semi")
    sets = materialise(_sets(docs, candidates))
    links = materialise(_confirm(stars, sets, percent))
    found = materialise(components(links))
    links = links.union(_rest(members, found, sets, percent))
    # A component's name is the smallest document of its sets.
    linked = materialise(components(links)).withColumnRenamed("node", "id").join(sets_of.select("id", "doc_id"), "id")
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    names = sets_of.select("one", "two", "id", F.col("doc_id").alias("own")).join(linked.join(smallest, "component").select("id", "component", "smallest"), "id", "left")
    names = names.select("one", "two", F.coalesce("component", "id").alias("group"), F.coalesce("smallest", "own").alias("component"))
    out = described.drop("bands").join(names, ["one", "two"], "left")
    component = F.when(F.col("n") > 0, F.least(F.col("component"), F.col("doc_id"))).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.withColumn("component", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) without the text, with n_shingles, component_id and kept."""
    added = ("n_shingles", "component_id", "kept")
    others = [c for c in docs.columns if c not in ("doc_id", "text", *added)]
    # Other columns travel as one, whatever their names are.
    out = _judged(docs.select("doc_id", "text", *([F.struct(*others).alias(REST)] if others else [])), percent)
    columns = [F.col("doc_id") if c == "doc_id" else F.col(f"{REST}.{c}").alias(c) for c in docs.columns if c == "doc_id" or c in others]
    return out.select(*columns, F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _rest(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of buckets that are still in several components: an exact join on the rarest elements."""
    placed = members.select("band", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    left = materialise(placed.join(open_bands.select("band"), "band", "left_semi").select("id", "component").distinct())
    items = sets.join(left, "id").select("id", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    # Rarest first, of all these sets; elements of one component still count for the places of the others.
    common = items.groupBy("item").agg(F.count("*").alias("df"))
    ranked = items.join(common, "item").groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("ranked"))
    longest = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = ranked.select("id", "component", "n", F.posexplode(F.slice("ranked", F.lit(1), longest)).alias("place", "x")).select("id", "component", "n", "place", F.col("x.item").alias("item"))
    mixed = prefix.groupBy("item").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("item")
    prefix = prefix.join(mixed, "item", "left_semi")
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = F.least(F.col("a.n"), F.col("b.n")) * 100 >= F.greatest(F.col("a.n"), F.col("b.n")) * percent
    # The first common element of a pair that has to be linked leaves room behind it, in both, for the overlap needed.
    overlap = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    room = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= overlap
    pairs = a.join(b, F.col("a.item") == F.col("b.item")).filter((F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & sized & room)
    return _confirm(pairs.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct(), sets, percent)


def drop_duplicates(docs: DataFrame, percent: int = CORPUS_PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id.

    Where several rows have that doc_id, the one of the smallest hash stays. Rows without an id, and texts without a
    word, stay (of equal ones without a word, one of each doc_id). Only rows whose id is in a bit set of the ids that
    have a dropped or a repeated row are looked at again and shuffled; all others pass the scan.
    """
    judged = materialise(_judged(docs.select("doc_id", "text"), percent).filter("doc_id is not null").select("doc_id", "one", "two", "group", "kept"))
    unsure_ids = judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).filter("n > 1 or not kept").select("doc_id")
    known = judged.join(unsure_ids, "doc_id", "left_semi").distinct()
    packed, bits = _members(unsure_ids.select(F.col("doc_id").cast("long").alias("id")))
    wanted = docs.sparkSession.sparkContext.broadcast(packed)
    place, flag, rest = "__dw_place", "__dw_flag", "__dw_row"

    def mark(batch: pa.RecordBatch) -> list[pa.Array]:
        """Whether the id is in the bit set, and of those rows size and hashes of the set."""
        at = batch.column(place).fill_null(0).to_numpy(zero_copy_only=False)
        known = batch.column(place).is_valid().to_numpy(zero_copy_only=False)
        chosen = known & (np.frombuffer(wanted.value, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        rows = np.flatnonzero(chosen)
        n, one, two = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        column = batch.column("text").take(pa.array(rows))
        for a, b in slices(column, SLICE_BYTES):
            flat, begins = shingle_sets(column.slice(a, b - a))
            n[rows[a:b]] = np.diff(begins)
            one[rows[a:b]], two[rows[a:b]] = _set_hashes(flat, begins)
        return [pa.array(chosen), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]

    placed = docs.select(F.struct(*docs.columns).alias(rest), F.col("text"), F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))).alias(place))
    added = T.StructType([T.StructField(flag, T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n", "one", "two")]])
    marked = append_columns(placed, added, mark, [rest])
    keyed = marked.filter(flag).withColumn("doc_id", F.col(f"{rest}.doc_id"))
    # Equal rows, and rows of one id and set, are reduced before they are shuffled; a wordless text is alike to its equals only.
    same = F.when(F.col("n") == 0, F.xxhash64(F.to_json(rest))).alias("same")
    order = F.struct("one", "two", F.xxhash64(F.to_json(rest)), F.col(f"{rest}.text"))
    sets = keyed.groupBy("doc_id", "one", "two", same).agg(F.min_by(rest, order).alias(rest))
    left = sets.join(known, ["doc_id", "one", "two"], "left").filter(F.coalesce(F.col("kept"), F.lit(True)))
    one_each = left.groupBy("doc_id", "group", "same").agg(F.min_by(rest, order).alias(rest))
    return marked.filter(~F.col(flag)).select(f"{rest}.*").unionByName(one_each.select(f"{rest}.*"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), PERCENT).select("doc_id", "n_shingles", "component_id", "kept")
