import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from docweave.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402


@pytest.fixture(scope="module")
def encoding():
    with open(bpe.default_ranks_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "\n\n\n x", "It's they'll we've I'd", "ab  \n\n  cd " * 40, "x" * 700, " " * 500, "a\r\n" * 200, "été 12345 ñandú ß😀😀 " * 30, "word\n\n\n\n" * 60, "'" * 300, "<|endoftext|> a"]


@pytest.mark.parametrize("chunk,overlap", [(65_536, 1_024), (64, 32), (40, 16)])
def test_same_ids_as_library_and_round_trip(spark, encoding, chunk, overlap):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, chunk string")
    rows = bpe.decode(bpe.encode(df, chunk_chars=chunk, overlap_chars=overlap)).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id % len(TEXTS)] or ""
        assert r.ids == encoding.encode_ordinary(text), text[:40]
        assert bytes(r.bytes).decode() == text
        assert r.chunk == "x"


def test_query_on_table(spark, sf_dir, encoding):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op3_byte_level_bpe(spark, sf_dir).collect():
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_empty_table_and_null_key(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df).count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert bpe.encode(df).select(F.size("ids")).distinct().count() == 1
