"""Spans of a text column as arrays, by Arrow batches: references, quotes, and what else a function of a text finds."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.references import contained, located_references, references_in  # noqa: F401

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("groups", T.MapType(T.StringType(), T.StringType()))])


def quotes_in(text: str) -> list[dict]:
    """Quoted passages of 40 to 600 characters on one line."""
    return [{"kind": "quote", "start": m.start(1), "end": m.end(1), "match": m.group(1), "groups": []} for m in re.finditer(r"[\"“]([^\"“”\n]{40,600})[\"”]", text)]


def spans(df: DataFrame, text: str, out: str, find: Callable[[str], list[dict]] = located_references) -> DataFrame:
    """Adds the spans of a text column as an array; a null or empty text has none, other columns stay, one of the name out is replaced."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string()), ("groups", pa.map_(pa.string(), pa.string()))]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([find(v or "") for v in b.column(text).to_pylist()], kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def ordered_refs(text: Column, most: int = 6) -> Column:
    """Articles and annexes in a text, each once, in order of first appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:Article|Annex) (?:[0-9]+(?:\([0-9]+\))?|[IVX]+))"), F.lit(1))), 1, most)
