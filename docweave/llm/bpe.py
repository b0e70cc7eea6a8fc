"""Byte-level BPE encoding and decoding (operator 3).

A text of at most ``chunk_chars`` is one chunk. A longer one is cut into chunks that overlap, which are
pre-tokenised in parallel, each from its own start. Two neighbouring chunks agree from the first
pre-token boundary that both have in their overlap (a match depends only on what follows it), so the
text is cut there, and the pieces between two cuts are encoded in parallel. Where neighbours share no
boundary (one pre-token longer than the overlap) the two chunks are joined and encoded as one piece.
Decoding concatenates the bytes of the ids.

Defined results: a null or empty text has no ids; equal rows are encoded alike and all kept; an unknown or
null id is an error; other columns are kept as they are, one of the name of an added column is replaced. Long texts
are numbered as they are read, so the input has to come in the same order when a lost task is done again, as files do;
write the result of a shuffle before.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._frames import PREFIX, append_columns, read

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
#: A match is sure if the chunk goes on this far behind it: contractions look 3 characters ahead.
AHEAD = 4
#: The cache of encoded pieces starts anew at this size; it only saves work.
CACHE_PIECES = 100_000


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def vocabulary(path: str) -> list[bytes]:
    """The bytes of each id: all that decoding needs."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


class Codec:
    """Ranks and pattern, for one partition in a Python worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        ranks = read_ranks(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.iter = regex.compile(public_tokenizers.PATTERN).finditer
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.vocabulary[rank] = piece
        one = self._encoding._core_bpe.encode_single_piece

        class Cache(dict):
            def __missing__(self, piece: str) -> array:
                if len(self) >= CACHE_PIECES:
                    self.clear()
                ids = array("i", one(piece.encode("utf-8", "replace")))
                if len(piece) <= 256:
                    self[piece] = ids
                return ids

        self.cache = Cache()
        self.ids = self.cache.__getitem__

    def encode(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.ids, self.find(text)))

    def pieces_until(self, text: str, size: int) -> list[str]:
        """The pre-tokens of text up to the boundary at size; what follows is only looked at."""
        pieces = self.find(text)
        over = sum(map(len, pieces)) - size
        while over > 0:
            over -= len(pieces.pop())
        return pieces


def _lists(flat: array, offsets: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32)))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, digest: str | None = None) -> DataFrame:
    """df with the text replaced by its token ids (array<int>).

    digest: a column for the SHA-256 of the bytes that the ids decode to, made in the same pass, so that a task needs no second worker.
    """
    path = ranks_path or default_ranks_path()
    if not 4 * AHEAD <= overlap_chars < chunk_chars:
        raise ValueError("the overlap has to be shorter than a chunk")
    others = [c for c in df.columns if c not in (text, ids, digest)]
    body = F.coalesce(F.col(text), F.lit(""))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(digest, T.StringType(), False)] if digest else [])

    def whole(batch: pa.RecordBatch, c: Codec) -> list[pa.Array]:
        flat, offsets, digests = array("i"), [0], []
        for value in batch.column(text):
            flat.extend(c.encode(value.as_py() or ""))
            if digest:
                digests.append(hashlib.sha256(b"".join(map(c.vocabulary.__getitem__, flat[offsets[-1] :]))).hexdigest())
            offsets.append(len(flat))
        return [_lists(flat, offsets)] + ([pa.array(digests, pa.string())] if digest else [])

    short = append_columns(df.filter(F.length(body) <= chunk_chars), T.StructType(fields), whole, others, lambda: Codec(path))
    long = _encode_long(df.filter(F.length(body) > chunk_chars).drop(*([digest] if digest else [])), text, ids, path, chunk_chars, overlap_chars)
    if digest:
        long = decode(long, ids, PREFIX + "bytes", path).withColumn(digest, F.sha2(PREFIX + "bytes", 256)).drop(PREFIX + "bytes")
    return short.unionByName(long)


def _encode_long(df: DataFrame, text: str, ids: str, path: str, size: int, overlap: int) -> DataFrame:
    row, chunk, piece, rest, flat = (PREFIX + x for x in ("row", "chunk", "piece", "rest", "flat"))
    others = [c for c in df.columns if c not in (text, ids)]
    rest_of = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias(PREFIX + "none"))
    # The row's number is stable: the plan below is a scan whose order does not change when it is run again.
    chunks = (
        df.select(F.monotonically_increasing_id().alias(row), F.col(text), rest_of.alias(rest))
        .select(row, text, rest, F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))).alias(chunk))
        .select(row, chunk, F.substring(F.col(text), F.col(chunk) * size + 1, F.lit(size + overlap)).alias(piece), F.when(F.col(chunk) == 0, F.col(rest)).alias(rest))
        .repartition(row, chunk)
    )
    edges = T.StructType([T.StructField(PREFIX + x, T.ArrayType(T.IntegerType(), False), False) for x in ("head", "tail")])

    def pretokenise(batch: pa.RecordBatch, c: Codec) -> list[pa.Array]:
        """Sure boundaries in the first and the last overlap, relative to the chunk's start."""
        heads, tails = [], []
        for value in batch.column(piece):
            part = value.as_py()
            ends = [m.end() for m in c.iter(part)]
            sure = [0] + [e for e in ends if e <= len(part) - AHEAD]
            heads.append([e for e in sure if e <= overlap])
            tails.append([e - size for e in sure if e >= size])
        kind = pa.list_(pa.int32())
        return [pa.array(heads, kind), pa.array(tails, kind)]

    marked = append_columns(chunks, edges, pretokenise, state=lambda: Codec(path))
    spans = T.StructType([T.StructField(row, T.LongType()), T.StructField(chunk, T.IntegerType()), T.StructField(piece, T.StringType()), T.StructField(PREFIX + "n", T.IntegerType()), marked.schema[rest]])

    def stitch(table: pa.Table) -> pa.Table:
        """One text: its chunks with their edges. Gives the spans between the cuts, each with what the last match looks at."""
        parts = sorted(table.select([row, chunk, piece, PREFIX + "head", PREFIX + "tail"]).to_pylist(), key=lambda r: r[chunk])
        whole_text = "".join(p[piece][:size] for p in parts)
        cuts, tail = [0], None
        for k, p in enumerate(parts):
            if tail is not None:
                # A chunk's head counts only from a boundary of the chain that is known to be right.
                shared = tail & set(p[PREFIX + "head"])
                if shared:
                    cuts.append(k * size + min(shared))
                    tail = set(p[PREFIX + "tail"])
                else:
                    # No common boundary: pre-tokenise on from the last cut; what it finds is right.
                    tail = _tail_from(whole_text, cuts[-1], (k + 1) * size, overlap)
            else:
                tail = set(p[PREFIX + "tail"])
        cuts.append(len(whole_text))
        cuts = sorted(set(cuts))
        first = table.column(rest).filter(pa.compute.is_valid(table.column(rest))).combine_chunks()
        n = max(1, len(cuts) - 1)
        rows = [whole_text[a : b + AHEAD] for a, b in zip(cuts, cuts[1:])]
        index = pa.array([0] + [None] * (n - 1), pa.int32())
        return pa.table([pa.array([parts[0][row]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(rows, pa.string()), pa.array([b - a for a, b in zip(cuts, cuts[1:])], pa.int32()), first.take(index)], names=[f.name for f in spans.fields])

    cut = marked.groupBy(row).applyInArrow(stitch, spans).repartition(row, chunk)
    flats = T.StructType([T.StructField(flat, T.ArrayType(T.IntegerType(), False), False)])

    def encode_span(batch: pa.RecordBatch, c: Codec) -> list[pa.Array]:
        out, offsets = array("i"), [0]
        for part, n in zip(batch.column(piece), batch.column(PREFIX + "n")):
            out.extend(chain.from_iterable(map(c.ids, c.pieces_until(part.as_py(), n.as_py()))))
            offsets.append(len(out))
        return [_lists(out, offsets)]

    encoded = append_columns(cut, flats, encode_span, [row, chunk, rest], lambda: Codec(path))
    joined = encoded.groupBy(row).agg(F.max(F.col(rest)).alias(rest) if _orderable(encoded.schema[rest].dataType) else F.first(rest, ignorenulls=True).alias(rest), F.array_sort(F.collect_list(F.struct(chunk, flat))).alias(flat))
    columns = [F.col(f"{rest}.{c}").alias(c) for c in others]
    return joined.select(*columns, F.flatten(F.transform(flat, lambda x: x[flat])).alias(ids))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _tail_from(text: str, start: int, edge: int, overlap: int) -> set[int]:
    """Boundaries in the overlap after edge, found from the sure boundary at start."""
    end = min(len(text), edge + overlap)
    found, sure = set(), end - AHEAD if end < len(text) else end
    import public_tokenizers
    import regex

    for m in regex.compile(public_tokenizers.PATTERN).finditer(text, start, end):
        if edge <= m.end() <= sure:
            found.add(m.end() - edge)
    return found


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", ranks_path: str | None = None) -> DataFrame:
    """df with the concatenated bytes of the ids."""
    path = ranks_path or default_ranks_path()

    def work(batch: pa.RecordBatch, pieces: list[bytes]) -> list[pa.Array]:
        column = batch.column(ids)
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
        return [pa.array((b"".join(map(pieces.__getitem__, flat[a:b].tolist())) for a, b in zip(offsets, offsets[1:])), pa.binary(), size=len(column))]

    return append_columns(df, T.StructType([T.StructField(out, T.BinaryType(), False)]), work, state=lambda: vocabulary(path))


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), digest="decoded_sha256")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), "decoded_sha256")
