import random

import corpus_pipeline
from docweave.llm import bpe, pii
from tests.llm.test_minhash import shingles
from tests.llm.test_pipeline import expected_counts


def kept_at(rows, percent):
    """Ids left by comparing all pairs."""
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [i for i in ids if root(i) == i]


def test_stage_drops_near_copies_from_80(spark):
    r = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(104)]  # 100 shingles, 5 lost by a changed word inside
        texts.append(" ".join(base))
        for places in ((20, 70), (50,), (20, 50, 80)):  # similarity 90/110, 95/105, 85/115
            copy = list(base)
            for k in places:
                copy[k] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    chain = [f"c{k}" for k in range(300)]
    texts += [" ".join(chain[k : k + 104]) for k in range(0, 100, 10)]  # 90/110 to the next ones only
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(d.doc_id for d in stage(spark, docs, "").collect()) == kept_at(rows, 80)
    assert len(kept_at(rows, 85)) > len(kept_at(rows, 80))


def test_stages_after_it(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, toxic), (_, near), (_, private), (_, mixed), (_, tokens) = corpus_pipeline.STAGES
    clean = toxic(spark, docs, sf_dir).cache()
    single = near(spark, clean, sf_dir).cache()
    assert sorted(r.doc_id for r in single.collect()) == kept_at([(r.doc_id, r.text) for r in clean.collect()], 80)
    masked = private(spark, single, sf_dir).cache()
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert not any(pii.base_spans(t) for t in texts.values())
    copies = mixed(spark, masked, sf_dir).cache()
    kept = [(r.doc_id, r.source) for r in masked.collect()]
    assert sorted(r.doc_id for r in copies.collect()) == sorted(i for (i, _), n in zip(kept, expected_counts(kept)) for _ in range(n))
    vocabulary = bpe.Codec(bpe.default_ranks_path()).vocabulary
    for r in tokens(spark, copies, sf_dir).collect():
        assert b"".join(vocabulary[i] for i in r.ids).decode() == texts[r.doc_id]
    assert corpus_pipeline.run(spark, sf_dir).count() == copies.count()
