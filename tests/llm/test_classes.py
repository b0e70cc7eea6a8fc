import numpy as np
import pyarrow as pa

from docweave.llm import language, toxicity
from docweave.llm._charkn import CharKN
from docweave.llm._words import BLANK, Index, slices, words


def test_words_are_runs_of_solid_bytes():
    texts = [None, "", "  ", "Ab\tÉc\x0b d", "x", "y\x1cz w", "A" * 70]
    w = words(pa.array(texts, pa.string()))
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert got == ["ab", "Éc", "d", "x", "y\x1cz", "w", "a" * 70]
    assert w.counts.tolist() == [0, 0, 0, 3, 1, 2, 1]
    assert BLANK.sum() == 6
    same = words(pa.array(["b", "ab b ab"]))
    h = same.hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert slices(pa.array(["aa", "b" * 50, "c", "d"]), 4) == [(0, 1), (1, 2), (2, 4)]


def test_index_finds_like_a_set():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    asked = np.concatenate([keys[::7], rng.integers(0, 2**63, 500, dtype=np.uint64)])
    found = Index(keys).find(asked)
    known = {int(k): i for i, k in enumerate(keys)}
    assert found.tolist() == [known.get(int(k), len(keys)) for k in asked]
    assert Index(keys[:0]).find(asked).tolist() == [0] * len(asked)


def test_model_is_a_distribution():
    w = words(pa.array(["ab ac ba bb ab abc"]))
    counts = np.array([[1, 0], [2, 1], [0, 3], [1, 1], [4, 0], [1, 1]], float)
    model = CharKN.fit(w.data, w.starts, w.ends, counts, order=3, shared=1)
    total = np.zeros(2)
    alphabet = [bytes([c]) for c in range(256)]
    one = b"".join(b"b" + c for c in alphabet)
    text = np.frombuffer(one, np.uint8)
    # after "b": the chance of each second byte, from the words of two bytes
    at = np.arange(256) * 2
    total = np.exp(model.log_likelihoods(text, at, at + 2).astype(float))
    assert (total > 0).all() and (total.sum(axis=0) < 1).all()
    again = CharKN.load(model.dump())
    assert np.array_equal(again.log_likelihoods(text, at, at + 2), model.log_likelihoods(text, at, at + 2))


def test_toxicity_separates_planted_words(spark):
    rng = np.random.default_rng(3)
    plain = ["table", "green", "river", "stone", "walks", "singing", "house", "little"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(plain, 40))
        if i % 3 == 0:
            text[int(rng.integers(40))] = "vilename" + str(rng.choice(["s", "d", "r"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "a " * 20000 + "vilenames"), (None, "stone"), (1003, "river"), (1003, "river")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    out = {(r.doc_id, i): r.score for i, r in enumerate(toxicity.score(docs, lab, keep=["doc_id"]).collect())}
    assert len(out) == len(rows)
    right = sum((s >= toxicity.THRESHOLD) == (k % 3 == 0) for (k, _), s in out.items() if k is not None and k < 600)
    assert right >= 590
    assert all(0 <= s <= 1 for s in out.values())
    none = toxicity.score(docs, lab.limit(0), keep=["doc_id"])
    assert {r.score for r in none.collect()} == {0.0}
    only = toxicity.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), keep=["doc_id"])
    assert {r.score for r in only.collect()} == {1.0}
    assert toxicity.score(docs.limit(0), lab, keep=["doc_id"]).count() == 0


def test_toxicity_held_out(spark, sf_dir):
    rows = toxicity.op6_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_language_held_out(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op10_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) >= 0.9


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the river and the house", "en"), (2, "der fluss und das haus", "de"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " 12 !! "), (4, "the house"), (4, "the house"), (5, "das haus " * 9000)], "doc_id long, text string")
    out = sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, train).collect())
    assert [x[1] for x in out] == ["und", "und", "und", "en", "en", "de"]
    assert out[0][2] == 0.0 and all(0 <= x[2] <= 1 for x in out)
    assert {r.lang_pred for r in language.identify(docs, train.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), train).count() == 0
