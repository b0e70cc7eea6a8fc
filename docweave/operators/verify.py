"""Grounding of quotes and citations in sources, without comparing all with all."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.storage import cut
from docweave.operators import patterns
from docweave.operators.text import once

#: Most words of an anchor: a run of whole words of the quote that a source has to hold.
ANCHOR_WORDS = 4
#: A near quote: shares of it that the source has in order, and in one block.
RECALL, BLOCK = 0.9, 0.6
#: Characters that a source may have besides, on either side of the block: so many, and a tenth of the quote.
SLACK = 20


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _runs(words: Column, n: int) -> Column:
    """A hash of each run of n words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return once(hashes, lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>")))


def _anchors(quotes: DataFrame, near: bool) -> DataFrame:
    """quotes with size and anchor (null without a whole word): of the runs of size words the one of most characters, in the middle fifth if near."""
    length = F.length("quote")
    first, last = F.floor(length * 2 / 5).cast("int"), F.ceil(length * 3 / 5).cast("int")
    asked = quotes.withColumn("quote", _squeezed(F.col("quote"))).filter("quote <> ''")
    asked = asked.withColumn("part", F.substring("quote", first + 1, last - first) if near else F.col("quote")).withColumn("w", F.split("part", " "))
    # The first and the last may be parts of words.
    asked = asked.withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))).withColumn("size", F.least(F.size("w"), F.lit(ANCHOR_WORDS)))
    longest = lambda n: F.array_max(F.zip_with(_runs(F.col("w"), n), _sums(F.col("w"), n), lambda h, s: F.struct(s.alias("s"), h.alias("h"))))["h"]
    found = reduce(lambda c, n: c.when(F.col("size") == n, longest(n)), range(1, ANCHOR_WORDS + 1), F.when(F.lit(False), F.lit(0).cast("long")))
    return asked.select("quote_id", "quote", "part", "size", found.alias("anchor"))


def _sums(words: Column, n: int) -> Column:
    lengths = F.transform(words, lambda w: F.length(w))
    return once(lengths, lambda s: F.when(F.size(s) >= n, F.transform(F.sequence(F.lit(0), F.size(s) - n), lambda i: sum((F.get(s, i + k) for k in range(1, n)), F.get(s, i)))).otherwise(F.array().cast("array<int>")))


def candidates(quotes: DataFrame, sources: DataFrame, near: bool = True) -> DataFrame:
    """quote_id, quote, source_id, source (white space squeezed): sources that can hold a quote (near: or a block of BLOCK of it). quotes: quote_id, quote; sources: source_id, source.

    A block of 0.6 of a quote covers its middle fifth, wherever the rest was changed, and a source with the whole quote has all its words; so a run of
    the longest whole words in there (ANCHOR_WORDS at most) stands in the source. Only runs of lengths that occur are looked
    up. A quote too short for a whole word there is searched for by an automaton of all such quotes.
    """
    asked = cut(_anchors(quotes, near))
    held = sources.filter("source is not null").select("source_id", _squeezed(F.col("source")).alias("source"))
    sizes = sorted(r[0] for r in asked.filter("anchor is not null").select("size").distinct().collect())  # ANCHOR_WORDS at most
    found = held.select("source_id", F.split("source", " ").alias("w"))
    runs = F.array_distinct(F.concat(*[_runs(F.col("w"), n) for n in sizes])) if sizes else F.array().cast("array<bigint>")
    anchored = found.select("source_id", F.explode(runs).alias("anchor")).join(asked.select("quote_id", "anchor"), "anchor").select("quote_id", "source_id")
    short = asked.filter("anchor is null")
    met = patterns.occurrences(held.select(F.col("source_id").alias("id"), F.col("source").alias("text")), short.select(F.col("part").alias("pattern")))
    pairs = anchored.unionByName(met.select(F.col("id").alias("source_id"), F.col("pattern").alias("part")).distinct().join(short, "part").select("quote_id", "source_id"))
    return pairs.distinct().join(asked.select("quote_id", "quote"), "quote_id").join(held, "source_id")


def grounding(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quote_id, verdict (exact or absent), number of sources with the quote."""
    found = candidates(quotes, sources, near=False).filter(F.col("source").contains(F.col("quote"))).groupBy("quote_id").agg(F.count("*").alias("n"))
    return quotes.select("quote_id").join(found, "quote_id", "left").select("quote_id", F.when(F.col("n") > 0, "exact").otherwise("absent").alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of bits, a step for each character of b."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    whole = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def nearness(quote: str, source: str, block: float = BLOCK) -> tuple[float, float]:
    """Share of the quote found in order around a block of it in the source, and the block's share; (0, 0) without a block of at least block.

    The seed is the middle fifth, which each such block covers; every place of the seed is a diagonal, extended both ways to its
    whole block. What is left of the quote on either side is aligned with the source beside the block, at most SLACK and a
    tenth of the quote further than it is long.
    """
    n, best = len(quote), (0.0, 0.0)
    first, last = 2 * n // 5, -(-3 * n // 5)
    seed, slack = quote[first:last], SLACK + n // 10
    at = source.find(seed) if seed else -1
    while at >= 0:
        a, b = first, last
        while a and at - first + a and quote[a - 1] == source[at - first + a - 1]:
            a -= 1
        while b < n and at - first + b < len(source) and quote[b] == source[at - first + b]:
            b += 1
        if b - a >= block * n:
            left, right = at - first + a, at - first + b
            matched = b - a + common(quote[:a], source[max(0, left - a - slack) : left]) + common(quote[b:], source[right : right + n - b + slack])
            best = max(best, (matched / n, (b - a) / n))
        at = source.find(seed, at + 1)
    return best


def near_grounding(pairs: DataFrame, recall: float = RECALL, block: float = BLOCK) -> DataFrame:
    """quote_id, source_id, near of candidate pairs."""

    def run(batches):
        for b in batches:
            got = [nearness(q, s, block) if q else (0.0, 0.0) for q, s in zip(b.column("quote").to_pylist(), b.column("source").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("quote_id"), b.column("source_id"), pa.array([r >= recall and k >= block for r, k in got])], names=["quote_id", "source_id", "near"])

    schema = pairs.select("quote_id", "source_id").schema.add("near", "boolean")
    return pairs.select("quote_id", "quote", "source_id", "source").mapInArrow(run, schema)


def phantom_lines(answers: DataFrame, known: DataFrame) -> DataFrame:
    """answer_id, text without the lines that name a family (Article N, Annex N) that is not known, and how many went."""
    lines = answers.select("answer_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    named = lines.select("answer_id", "at", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"((?:Article|Annex) (?:[0-9]+|[IVX]+))"), F.lit(1)))).alias("family"))
    bad = named.join(known.select("family").distinct(), "family", "left_anti").select("answer_id", "at").distinct().withColumn("bad", F.lit(True))
    joined = lines.join(bad, ["answer_id", "at"], "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("bad").isNull(), F.struct("at", "line")))), lambda x: x["line"])
    return joined.groupBy("answer_id").agg(F.array_join(kept, "\n").alias("text"), F.count("bad").alias("removed"))


def missing_citations(wanted: DataFrame, found: DataFrame, chain: DataFrame) -> DataFrame:
    """Wanted (case_id, id) that neither are found (case_id, id) nor have an ancestor that is. chain: id, anc."""
    covered = wanted.join(chain, "id").join(found.select("case_id", F.col("id").alias("anc")), ["case_id", "anc"], "left_semi").select("case_id", "id").distinct()
    return wanted.join(covered, ["case_id", "id"], "left_anti")


def answer_recall(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """case_id, recall: share of a case's slots of which one alternative occurs in the answer, numbers as whole numbers. keys: case_id, slot, alternative."""
    pairs = answers.join(keys, "case_id")
    hit = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("alternative"), "[^a-z0-9]+", " "), F.lit(" ")))
    slots = pairs.groupBy("case_id", "slot").agg(F.max(hit.cast("int")).alias("hit"))
    return slots.groupBy("case_id").agg(F.round(F.avg("hit"), 6).alias("recall"))
