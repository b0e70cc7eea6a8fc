"""The shipped weights are those of the training code, and windows hold tokens of any length."""

import json

from docweave.llm import pii


def test_weights_are_reproduced(tmp_path):
    pii.write_weights(f"{tmp_path}/w.json")
    with open(f"{tmp_path}/w.json", encoding="utf-8") as f, open(pii.WEIGHTS, encoding="utf-8") as g:
        new, held = json.load(f), json.load(g)
    assert list(new) == list(held)
    assert max(abs(a - b) for n in new for a, b in zip(new[n], held[n])) < 1e-6


def test_long_labels_are_reached():
    model = pii.trained()
    for n in (20, 60, 300):
        text = f"write to jane [at] {'.'.join(['x'])}{'a' * n} [dot] {'b' * n} [dot] {'c' * n} [dot] {'d' * n} [dot] com today"
        (found,) = pii.added_spans(text, pii.base_spans(text), model)
        assert text[found[0] : found[1]] == text[len("write to ") : -len(" today")], n


def test_windows_hold_what_a_candidate_can_reach():
    text = " ".join(["word" * 30] * 40) + " 555 123 4567 " + " ".join(["tail" * 30] * 40)
    at = text.index("555")
    lo, hi = pii._reach(text, 0, len(text), at, at + 12)
    assert len(pii._TOKEN.findall(text[lo:at])) == pii.AROUND == len(pii._TOKEN.findall(text[at + 12 : hi]))
    assert pii._reach("a b", 0, 3, 1, 2) == (0, 3)
