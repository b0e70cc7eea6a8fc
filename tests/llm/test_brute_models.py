"""The vectorised models against plain dictionaries and loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from docweave.llm import language, toxicity
from docweave.llm._charkn import DISCOUNT, END, START, CharKN
from docweave.llm._words import words


class Dictionaries:
    """Kneser-Ney by its definition: tokens at the highest order and at a word's start, different left extensions elsewhere."""

    def __init__(self, counted: dict[bytes, list[float]], order: int, shared: int):
        self.order, classes = order, len(next(iter(counted.values())))
        tokens = [defaultdict(lambda: [0.0] * classes) for _ in range(order + 1)]
        for word, n in counted.items():
            text = (START, *word, END)
            for p in range(1, len(text)):
                for k in range(1, min(order, p + 1) + 1):
                    for c in range(classes):
                        tokens[k][text[p - k + 1 : p + 1]][c] += n[c]
        self.share, self.weight = [None], [None]
        for k in range(1, order + 1):
            together = k <= shared
            found = {}
            for gram, n in tokens[k].items():
                if k == order or (gram[0] == START and k > 1):
                    found[gram] = [sum(n)] * classes if together else list(n)
                else:
                    left = [m for longer, m in tokens[k + 1].items() if longer[1:] == gram]
                    found[gram] = [float(sum(any(x > 0 for x in m) if together else m[c] > 0 for m in left)) for c in range(classes)]
            total, kinds = defaultdict(lambda: [0.0] * classes), defaultdict(lambda: [0] * classes)
            for gram, n in found.items():
                for c in range(classes):
                    total[gram[:-1]][c] += n[c]
                    kinds[gram[:-1]][c] += n[c] > 0
            self.share.append({g: [max(n[c] - DISCOUNT, 0) / total[g[:-1]][c] if total[g[:-1]][c] else 0.0 for c in range(classes)] for g, n in found.items()})
            self.weight.append({x: [DISCOUNT * kinds[x][c] / t[c] if t[c] else 1.0 for c in range(classes)] for x, t in total.items()})

    def log(self, word: bytes, c: int) -> float:
        text, out = (START, *word, END), 0.0
        for p in range(1, len(text)):
            chance = 1 / 256
            for k in range(1, min(self.order, p + 1) + 1):
                before = text[p - k + 1 : p]
                if before not in self.weight[k]:
                    break
                chance = self.share[k].get((*before, text[p]), [0.0] * 9)[c] + self.weight[k][before][c] * chance
            out += math.log(chance)
        return out


def fitted(counted, order, shared):
    w = words(pa.array([" ".join(k.decode() for k in counted)]))
    return CharKN.fit(w.data, w.starts, w.ends, np.array(list(counted.values()), float), order, shared)


def some_words(r, n, letters="abcdé"):
    return list({"".join(r.choice(letters) for _ in range(r.randint(1, 6))).encode() for _ in range(n)})


def test_kneser_ney_by_definition():
    for seed, (order, shared, classes) in enumerate([(3, 1, 2), (5, 2, 2), (4, 0, 3), (2, 2, 1)]):
        r = random.Random(seed)
        counted = {w: [float(r.choice([0, 0, 1, 2, 5])) for _ in range(classes)] for w in some_words(r, 60)}
        counted = {w: n if any(n) else [1.0] * classes for w, n in counted.items()}
        model, plain = fitted(counted, order, shared), Dictionaries(counted, order, shared)
        asked = some_words(r, 40, "abcdefé") + list(counted)[:10]
        w = words(pa.array([" ".join(k.decode() for k in asked)]))
        got = model.log_likelihoods(w.data, w.starts, w.ends)
        want = np.array([[plain.log(k, c) for c in range(classes)] for k in asked])
        assert np.abs(got - want).max() < 2e-4


def test_toxic_features_by_loops():
    r = random.Random(9)
    counted = {w: [float(r.randint(0, 3)), float(r.randint(0, 3)) + 0.0] for w in some_words(r, 80)}
    model = fitted(counted, 4, 2)
    vocabulary = [w.decode() for w in counted] + ["zzz", "qx"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 5, 16, 17, 60)] + ["", None, " "]
    got = toxicity.features(model, pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        parts = (text or "").split()
        if not parts:
            assert not row.any()
            continue
        w = words(pa.array([" ".join(parts)]))
        logs = model.log_likelihoods(w.data, w.starts, w.ends).astype(float)
        ratio = np.clip(logs[:, 1] - logs[:, 0], -20, 20)
        windows = [ratio[k : k + toxicity.WINDOW_WORDS].sum() / toxicity.WINDOW_WORDS for k in range(len(ratio))]
        want = [ratio.sum() / sum(len(p.encode()) + 1 for p in parts), max(windows), math.log1p(sum(max(x - 3, 0) for x in ratio)), ratio.max()]
        assert np.abs(row - want).max() < 1e-5


def plain_mixture(like):
    """Proportions and likelihood by loops, and the set of best penalised likelihood among the nested ones."""

    def em(allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(like[0]))]
        for _ in range(language.MOST_STEPS):
            sums = [0.0] * len(share)
            for run in like:
                whole = sum(a * b for a, b in zip(run, share))
                for k, (a, b) in enumerate(zip(run, share)):
                    sums[k] += a * b / whole
            now = [s / len(like) for s in sums]
            moved = max(abs(a - b) for a, b in zip(now, share))
            share = now
            if moved <= language.TOLERANCE:
                break
        return share, sum(math.log(sum(a * b for a, b in zip(run, share))) for run in like)

    first, _ = em(range(len(like[0])))
    order = sorted(range(len(first)), key=lambda k: (-first[k], k))
    best = None
    for size in range(1, len(order) + 1):
        share, total = em(order[:size])
        cost = -2 * total + (size - 1) * math.log(len(like))
        if best is not None and cost >= best[0]:
            break
        best = (cost, share)
    return best[1]


def test_mixtures_by_loops():
    r = random.Random(4)
    alphabets = ["abc", "def", "ghi", "jkl", "mno", "pqr"]
    counted = {}
    for k, letters in enumerate(alphabets):
        for w in some_words(r, 30, letters):
            counted[w] = [2.0 if c == k else 0.0 for c in range(len(alphabets))]
    model = fitted(counted, 3, 0)
    of = [[w.decode() for w, n in counted.items() if n[k]] for k in range(len(alphabets))]
    texts = [" ".join(r.choice(of[k]) for _ in range(40)) for k in range(6)]
    texts += [" ".join(" ".join(r.choice(of[k]) for _ in range(30)) for k in ks) for ks in ((0, 1), (2, 3, 4), (0, 1, 2, 3, 4), range(6))] + [None, "", "x y"]
    got = language.mixtures(model, pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        parts = (text or "").split()
        if not parts:
            assert not row.any()
            continue
        w = words(pa.array([" ".join(parts)]))
        logs = model.log_likelihoods(w.data, w.starts, w.ends).astype(float)
        runs = [logs[k : k + language.RUN_WORDS].sum(axis=0) for k in range(0, len(parts), language.RUN_WORDS)]
        like = [[math.exp(x - max(run)) + language.FLOOR for x in run] for run in runs]
        assert np.abs(row - plain_mixture(like)).max() < 1e-3
    assert (got[8] > 0).sum() == 5 and (got[9] > 0).sum() == 6  # sets of five and six languages are found
