"""The dynamic programming of the span model against all segmentations, and linear work on mixed texts."""

import time
from functools import lru_cache

from docweave.llm import pii


def exhaustive(text, model):
    """The best sum of segment scores over MARGIN, by trying every set of segments that do not overlap."""
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    segments = pii._segments(text, tokens, [True] * len(tokens))
    scores = {s: model.weights[r].sum(axis=0).max() - pii.MARGIN for s, r in zip(segments, model.rows(text, tokens, segments))}

    @lru_cache(None)
    def best(i):
        if i >= len(tokens):
            return 0.0
        return max([best(i + 1)] + [float(v) + best(j) for (a, j), v in scores.items() if a == i])

    return best(0), scores, tokens


def test_best_segmentation():
    model = pii.trained()
    texts = ["call 613-555-8758 now", "jane [at] example [dot] com", "10 . 0 . 0 . 1 and (613) 555 8758", "no data at all here", "a at b. de c", "ref 4111.1111.1111.1111 x", "x@y 12 34 56 78", "(613) 555-8758 jane at mail dot org"]
    for text in texts:
        want, scores, tokens = exhaustive(text, model)
        found = model.best(text, tokens, [True] * len(tokens))
        place = {a: k for k, (a, _) in enumerate(tokens)} | {("end", b): k + 1 for k, (_, b) in enumerate(tokens)}
        got = sum(float(scores[place[a], place["end", b]]) for a, b, _ in found)
        assert abs(got - want) < 1e-6, text
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_linear_work_on_mixed_texts():
    model = pii.trained()

    def seconds(n):
        text = " ".join(f"user{k}@mail{k}.example.com and call {200 + k % 700}-{300 + k % 600}-{1000 + k} today" for k in range(n))
        base = pii.base_spans(text)
        began = time.process_time()
        spans = pii.added_spans(text, base, model)
        assert len(spans) >= 0.9 * n
        return time.process_time() - began

    seconds(50)
    few, many = min(seconds(400) for _ in range(2)), min(seconds(3200) for _ in range(2))
    assert many < 8 * few * 2.5  # eight times the text, with room for a busy machine
