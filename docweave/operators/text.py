"""Scalar text operators: reference forms, normalisers, expansions of ranges."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that are folded; authority of sources; characters of a lexical query language.
DASHES, APOSTROPHES = "-‐‑‒–—―−", "‘’‚‛`´ʼ"
AUTHORITY = {"guidance": "persuasive", "harmonised_standard": "presumption_of_conformity", "implementing_act": "binding", "delegated_act": "binding", "common_specification": "binding"}
QUERY_MARKS = r'[+\-&|!(){}\[\]^"~*?:\\/]'


def reference_key(ref: Column) -> Column:
    """Lower case, without ', point ', ', indent ' and spaces: equal for the forms of one reference."""
    low = F.lower(ref)
    for part in (", point ", ", indent ", " "):
        low = F.replace(low, F.lit(part), F.lit(""))
    return low


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def term_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", "_")


def base_family(ref: Column) -> Column:
    """Article 5(1)(f) -> Article 5; null if it is no article or annex."""
    found = F.regexp_extract(ref, r"((?:Article|Annex) (?:[0-9]+[a-z]?|[IVX]+))", 1)
    return F.when(found != "", found)


def padded(number: Column) -> Column:
    """A number's digits, three at least; lpad alone would cut longer ones."""
    return F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0")


def human_reference(node_id: Column) -> Column:
    """{act}_art_N or {act}_0NN.00M -> Article N or Article N(M); numbers have three digits or more."""
    article = F.regexp_extract(node_id, r"_art_(\d+)$", 1)
    number, paragraph = (F.regexp_extract(node_id, r"_(\d{3,})\.(\d{3,})$", k) for k in (1, 2))
    whole = lambda c: F.regexp_replace(c, "^0+(?=[0-9])", "")
    return F.when(article != "", F.concat(F.lit("Article "), article)).when(number != "", F.concat(F.lit("Article "), whole(number), F.lit("("), whole(paragraph), F.lit(")")))


def numeric_act(celex: Column) -> Column:
    """32017R0745 -> 2017/745."""
    year, number = (F.regexp_extract(celex, r"^3(\d{4})[A-Z](\d{4})$", k) for k in (1, 2))
    return F.when(year != "", F.concat(year, F.lit("/"), number.cast("int").cast("string")))


def natural_key(x: Column) -> Column:
    """A text whose order is x's with runs of digits by value."""
    return F.regexp_replace(F.regexp_replace(x, r"([0-9]+)", "000000000000$1"), r"0*([0-9]{12})(?![0-9])", "$1")


def expand_range(text: Column) -> Column:
    """'102 to 104' -> [102, 103, 104]; '8, 9 and 11' -> [8, 9, 11]; at most one range, in ascending order."""
    first, last = (F.regexp_extract(text, r"([0-9]+)\s+to\s+([0-9]+)", k).cast("int") for k in (1, 2))
    listed = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(text.rlike(r"[0-9]+\s+to\s+[0-9]+") & (first <= last), F.sequence(first, last)).otherwise(listed)


def folded(x: Column) -> Column:
    """Verification form without NFKC: emphasis marks off, lower case, dashes as spaces, one kind of apostrophe, single spaces."""
    plain = F.lower(F.regexp_replace(x, r"\*\*|__|\*", ""))
    plain = F.translate(F.translate(plain, DASHES, " " * len(DASHES)), APOSTROPHES, "'" * len(APOSTROPHES))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def with_nfkc(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the NFKC form of a column; the only step of the normaliser that Spark has no function for."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            made = pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in b.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)

    return df.mapInArrow(run, schema)


def first_sentence(text: Column, most: int = 400) -> Column:
    """The first sentence, up to a period or semicolon before a space, without the enumerator in front; at most so long."""
    plain = F.trim(F.replace(text, F.lit(" "), F.lit(" ")))
    plain = F.regexp_replace(plain, r"^(?:[0-9]{1,3}\.|\([0-9]{1,3}\)|\([a-z]{1,2}\))\s+", "")
    return F.substring(F.element_at(F.split(plain, r"(?<=[.;])\s+"), 1), 1, most)


def definition_body(text: Column) -> Column:
    """What stands behind the first "means", else the whole text."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?i)\bmeans\b", 2)
    return F.trim(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))


def authority(source_type: Column) -> Column:
    """What weight an interpreting source has; an unknown or missing one is persuasive only."""
    known = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
    return F.coalesce(known[F.lower(F.trim(source_type))], F.lit("persuasive"))


def chapter_key(path: Column) -> Column:
    """The third part of a path, if it is a chapter or an annex."""
    part = F.get(F.split(path, "/"), F.lit(2))
    return F.when(part.contains("_cpt_") | part.contains("_anx_"), part)


def community_label(community: Column) -> Column:
    """community::L1::32024R1689_cpt_III -> Chapter III (32024R1689)"""
    part = F.replace(community, F.lit("community::L1::"), F.lit(""))
    celex, kind, number = (F.regexp_extract(part, "^([^_]*)_([^_]*)_?(.*)$", k) for k in (1, 2, 3))
    return F.concat(F.when(kind == "cpt", "Chapter").otherwise("Annex"), F.lit(" "), number, F.lit(" ("), celex, F.lit(")"))


def query_text(text: Column) -> Column:
    """A question without the marks of a query language, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, QUERY_MARKS, " "), r"\s+", " "))


def repaired_id(node_id: Column) -> Column:
    """{act}_art_5_2 -> {act}_005.002: ids that writers make up of an article and a paragraph."""
    act, article, paragraph = (F.regexp_extract(node_id, r"^(.*)_art_([0-9]{1,3})_([0-9]{1,3})$", k) for k in (1, 2, 3))
    return F.when(article != "", F.concat(act, F.lit("_"), F.lpad(article, 3, "0"), F.lit("."), F.lpad(paragraph, 3, "0"))).otherwise(node_id)


def capped_quote(text: Column, most: int) -> Column:
    """A quote cut behind the last sentence of its first characters, if that is past half, else there, with a mark of the cut."""
    plain = F.trim(text)
    head = F.substring(plain, 1, most)
    last = F.length(head) - F.locate(" .", F.reverse(head))  # the period of the last ". "
    cut = F.when((F.locate(". ", head) > 0) & (last - 1 > most // 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when((F.lit(most) <= 0) | (F.length(plain) <= most), plain).otherwise(F.concat(F.rtrim(cut), F.lit(" […]")))


def bold_references(text: Column) -> Column:
    """References in bold, line by line; headings, quotes and what is bold stay."""
    reference = r"(?<!\*)\b(Articles?\s+[0-9]+[a-z]?(?:\s*\([0-9]+[a-z]?\))*(?:\s*[–—-]\s*\([0-9]+[a-z]?\))?|Annex(?:es)?\s+[IVXLC]+(?:\s*\([0-9]+\))?|Recitals?\s+[0-9]+)(?!\*)"
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.ltrim(x).startswith("#") | F.ltrim(x).startswith(">"), x).otherwise(F.regexp_replace(x, reference, "**$1**")))
    return F.array_join(lines, "\n")


def parent_references(ref: Column) -> Column:
    """Article 5(1)(a) -> [Article 5(1), Article 5]; empty for others."""
    base = F.regexp_extract(ref, r"^(Article [0-9]+[a-z]?)", 1)
    brackets = F.regexp_extract_all(F.substring(ref, F.length(base) + 1, F.length(ref)), F.lit(r"(\([^()]+\))"), F.lit(1))
    none = F.array().cast("array<string>")
    chain = F.when(F.size(brackets) > 0, F.transform(F.sequence(F.size(brackets), F.lit(1), F.lit(-1)), lambda n: F.concat(base, F.array_join(F.slice(brackets, F.lit(1), n - 1), ""))))
    return F.when(base != "", F.coalesce(chain, none)).otherwise(none)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row: inside a lambda an expression would be worked out for each element."""
    return F.transform(F.array(value), use)[0]
