import random
import re

import pytest

from docweave.llm import minhash
from docweave.llm._components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Components by comparing all pairs."""
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def family(r, base, n, share):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(max(1, int(len(words) * share * r.random()))):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def texts():
    r = random.Random(8)
    out = [None, "", " \t", "One two", "one TWO", "one two three", "a b c d e", "A b c d e", "a b c d e f", "É b", "é b"]
    for size, copies, share in ((60, 40, 0.05), (200, 60, 0.04), (40, 30, 0.1)):
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(size))
        out += [base, base.upper(), *family(r, base, copies, share)]
    chain = [f"c{k}" for k in range(400)]
    out += [" ".join(chain[k : k + 120]) for k in range(0, 100, 5)]  # each is similar to the next ones only
    return out


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts()))
    random.Random(1).shuffle(found)
    return [(i, t) for i, (_, t) in enumerate(found)]


def test_same_components_as_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, n string")
    docs = docs.withColumnRenamed("n", "source")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(0, 2, None, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    import numpy as np
    import pyarrow as pa

    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(900)]
    other = words[:850] + [f"y{k}" for k in range(50)]
    flat, begins = minhash.shingle_sets(pa.array([" ".join(words), " ".join(other)]))
    a, b = minhash.signatures(flat, begins)
    x, y = set(flat[: begins[1]].tolist()), set(flat[begins[1] :].tolist())
    assert abs(np.mean(a == b) - len(x & y) / len(x | y)) < 0.12


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1005, 1000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000, 1005: 1000}


def brute_rows(rows, percent=85):
    """Of rows (id, text) that may repeat ids: each row's set size, component and group, by comparing all pairs of sets."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[root(k)] = min(i, smallest.get(root(k), i))
    return [(i, len(s), smallest[root(k)], root(k)) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def repeated(seed):
    """Rows whose ids repeat: with equal texts, near copies, and texts that have nothing to do with each other."""
    r = random.Random(seed)
    base = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([3, 12, 60]))) for _ in range(14)]
    texts = [t for b in base for t in [b, b.upper(), *family(r, b, 2, 0.04)]]
    rows = [(r.randrange(25), r.choice(texts)) for _ in range(110)] + [(1, base[2]), (5, base[2] + " tail"), (5, base[3])]
    return rows + rows[:6] + [(3, ""), (3, ""), (3, " "), (3, None), (4, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_as_all_pairs(spark, seed):
    rows = repeated(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_rows(rows)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(got) == sorted((i, n, c, i == c) for i, n, c, _ in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_row_of_each_group_stays(spark, seed):
    rows = repeated(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    want = brute_rows(rows, 80)
    left = minhash.drop_duplicates(docs).collect()
    groups = {(i, t): g for (i, t), (_, _, _, g) in zip(rows, want)}
    with_words = [r for r in left if shingles(r.text)]
    assert sorted(groups[r.doc_id, r.text] for r in with_words) == sorted({g for (_, n, _, g) in want if n})
    assert all(r.doc_id == c for r in with_words for (i, t), (_, _, c, _) in zip(rows, want) if (i, t) == (r.doc_id, r.text))
    wordless = [(r.doc_id, r.text) for r in left if not shingles(r.text)]
    assert sorted(wordless, key=str) == sorted({(i, t) for i, t in rows if not shingles(t)}, key=str)


def test_unlike_rows_of_one_id(spark):
    a = " ".join(f"a{k}" for k in range(100))
    b = " ".join(f"b{k}" for k in range(100))
    docs = spark.createDataFrame([(1, a), (5, a + " more"), (5, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True)]
    assert sorted((r.doc_id, r.text[0]) for r in minhash.drop_duplicates(docs).collect()) == [(1, "a"), (5, "b")]


def test_very_long_text(spark):
    r = random.Random(4)
    long = " ".join(f"w{r.randrange(10**7)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " and a little more"), (3, "short text of five words")], "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]
