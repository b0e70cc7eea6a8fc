import hashlib
import math

import corpus_pipeline
from docweave.llm import bpe, minhash, mixing, pii, toxicity
from tests.llm.test_minhash import brute_rows


def inverse_poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def unit(doc_id):
    text = "" if doc_id is None else str(doc_id)
    return int(hashlib.md5(f"{mixing.SEED}:{text}".encode()).hexdigest()[:13], 16) / 2**52


def expected_counts(rows, weights=None):
    """rows: (doc_id, source). The number of copies of each, by brute force."""
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    w = {s: c**0.5 for s, c in n.items()} if weights is None else {s: v for s, v in weights.items() if s in n and v > 0}
    total = sum(w.values())
    return [inverse_poisson(w[s] / total * len(rows) / n[s], unit(i)) if s in w else 0 for i, s in rows]


def test_mixing_counts(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(900)] + [(None, None), (7, "hot"), (7, "hot"), (1000, None)]
    docs = spark.createDataFrame([(i, s, "t", "x") for i, s in rows], "doc_id long, source string, text string, copy_ string")
    for weights in (None, {"hot": 1.0, None: 3.0, "s1": 0.0, "absent": 5.0}):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.source or "", r.copy) for r in mixing.mix(docs, weights, copy="copy").collect()))
        want = sorted((i is None, i or 0, s or "", c + 1) for (i, s), n in zip(rows, expected_counts(rows, weights)) for c in range(n))
        assert got == want
    assert mixing.mix(docs.limit(0)).count() == 0
    old, mixing.MOST_BROADCAST = mixing.MOST_BROADCAST, 0
    try:
        assert mixing.mix(docs).count() == sum(expected_counts(rows))
    finally:
        mixing.MOST_BROADCAST = old


def test_large_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(0, "rare")] + [(k, "common") for k in range(1, 3000)], "doc_id long, source string")
    n = mixing.mix(docs, {"rare": 1.0, "common": 1.0}).filter("source = 'rare'").count()
    assert 1300 < n < 1700


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    rows = {r.doc_id: r for r in before}
    (_, f1), (_, f2), (_, f3), (_, f4), (_, f5) = corpus_pipeline.STAGES
    clean = f1(spark, docs, sf_dir).cache()
    assert clean.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.op6_toxicity(spark, sf_dir).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == set(rows) - toxic
    single = f2(spark, clean, sf_dir).cache()
    left = brute_rows([(r.doc_id, r.text) for r in clean.collect()], minhash.CORPUS_PERCENT)
    assert minhash.CORPUS_PERCENT == 80  # what a stage on word shingles takes; 85 is op7's own
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, component, _ in left if i == component)
    private = f3(spark, single, sf_dir).cache()
    assert private.columns == docs.columns
    for r in private.collect():
        assert not pii.base_spans(r.text)
        assert r.n_chars == len(r.text)
    mixed = f4(spark, private, sf_dir).cache()
    kept = [(r.doc_id, r.source) for r in private.collect()]
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for (i, _), n in zip(kept, expected_counts(kept)) for _ in range(n))
    final = f5(spark, mixed, sf_dir)
    texts = {r.doc_id: r.text for r in private.collect()}
    vocabulary = bpe.Codec(bpe.default_ranks_path()).vocabulary
    for r in final.collect():
        assert b"".join(vocabulary[i] for i in r.ids).decode() == texts[r.doc_id]
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count()


def test_stages_keep_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = minhash.drop_duplicates(docs).collect()
    assert sorted((r.doc_id or 0) for r in single) == [0, 1, 2, 3]
    for empty in (docs, docs.limit(0)):
        found = empty
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, found, sf_dir)
        found.collect()


def test_token_stage_with_clashing_names(spark):
    rows = [(1, "some text", "s", "x", 5, "y"), (1, "some text", "s", "x", 5, "y"), (None, None, None, None, None, None), (2, "", "s", "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, n_tokens int, decoded_sha256 string")
    got = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in got) == sorted((i or 0, 2 if t else 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert all(len(r.ids) == r.n_tokens for r in got) and set(got[0].asDict()) == {"doc_id", "source", "n_tokens", "ids", "decoded_sha256"}


def test_stages_keep_unlike_rows_of_one_id(spark, sf_dir):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (5, a + " x", "en", "s", 1), (5, b, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (5, b)] and kept.columns == docs.columns
