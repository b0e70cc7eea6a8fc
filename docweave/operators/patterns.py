"""Many patterns in many texts at once: one automaton (Aho and Corasick) for all, each text is read once.

Patterns are taken in slices of PATTERN_BYTES; each slice is an automaton, built from a broadcast of that size in each
task, and one pass over the texts. So a dictionary of any size is searched, and what a task holds is bounded.

Whole words of a dictionary of more than one slice are found by a join instead: runs of as many words as patterns have, with the patterns. So texts are read once, however
many patterns there are; only patterns of over WORDS words, or that don't begin and end with one, are left to automata.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.storage import cut
from docweave.functions.workers import prepare

PATTERN_BYTES = 4 << 20
WORDS = 8


def _slices(patterns: DataFrame, most: int) -> Iterator[list[str]]:
    held, size = [], 0
    for r in patterns.select("pattern").filter("pattern is not null and pattern <> ''").distinct().orderBy("pattern").toLocalIterator():
        held.append(r.pattern)
        size += len(r.pattern.encode())
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\w+", text)]  # the characters of _word


def _with_words(patterns: DataFrame) -> DataFrame:
    """pattern, words: the different patterns, with their words, 0 where a join can't find them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = []
            for p in b.column("pattern").to_pylist():
                at = _runs(p)
                words.append(len(at) if at and len(at) <= WORDS and at[0][0] == 0 and at[-1][1] == len(p) else 0)
            yield pa.RecordBatch.from_arrays([b.column("pattern"), pa.array(words, pa.int32())], names=["pattern", "words"])

    return patterns.select("pattern").filter("pattern is not null and pattern <> ''").distinct().mapInArrow(run, "pattern string, words int")


def _places(texts: DataFrame, sizes: list[int], schema: T.StructType) -> DataFrame:
    """id, pattern, start of each run of so many words of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found, starts = [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                at = _runs(text or "")
                for n in sizes:
                    for (start, _), (_, end) in zip(at, at[n - 1 :]):
                        rows.append(row)
                        found.append(text[start:end])
                        starts.append(start)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int32())], names=schema.names)

    return texts.select("id", "text").mapInArrow(run, schema)


def occurrences(texts: DataFrame, patterns: DataFrame, whole_words: bool = False, most: int = PATTERN_BYTES) -> DataFrame:
    """id, pattern, start (characters, from 0): each place of each pattern (pattern) in texts (id, text), overlapping ones too.

    whole_words: places with a letter, digit or underscore beside them don't count. A null or empty text or pattern has none; equal rows of texts
    are searched each.
    """
    spark = texts.sparkSession
    prepare(spark)
    schema = T.StructType([texts.schema["id"], T.StructField("pattern", T.StringType()), T.StructField("start", T.IntegerType())])

    def one(some: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for p in sent.value:
                machine.add_word(p, p)
            machine.make_automaton()
            for b in batches:
                rows, found, starts = [], [], []
                for row, text in enumerate(b.column("text").to_pylist()):
                    for last, p in machine.iter(text or ""):
                        start = last - len(p) + 1
                        if whole_words and (start and _word(text[start - 1]) or last + 1 < len(text) and _word(text[last + 1])):
                            continue
                        rows.append(row)
                        found.append(p)
                        starts.append(start)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int32())], names=schema.names)

        return texts.select("id", "text").mapInArrow(run, schema)

    parts = []
    if whole_words and (patterns.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) > most:
        held = cut(_with_words(patterns))
        sizes = sorted(r.words for r in held.select("words").distinct().collect() if r.words)
        parts = [_places(texts, sizes, schema).join(held.filter("words > 0").select("pattern"), "pattern").select(schema.names)] if sizes else []
        patterns = held.filter("words = 0")
    parts += [one(some) for some in _slices(patterns, most)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.select("id", F.lit("").alias("pattern"), F.lit(0).alias("start")).limit(0)
