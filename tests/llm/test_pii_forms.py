import pytest

from docweave.llm import pii


def found(text):
    return [(pii.KINDS[k], text[a:b]) for a, b, k in pii.added_spans(text, pii.base_spans(text), pii.trained())]


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("write to jane [at] example.com", "email", "jane [at] example.com"),
        ("ask jane (at) example.com today", "email", "jane (at) example.com"),
        ("write to jane at example.com now", "email", "jane at example.com"),
        ("host 10 . 0 . 0 . 1 is up", "ip", "10 . 0 . 0 . 1"),
        ("host 10 dot 0 dot 0 dot 1 is up", "ip", "10 dot 0 dot 0 dot 1"),
    ],
)
def test_forms_without_other_cues(text, kind, span):
    assert found(text) == [(kind, span)]


def test_at_in_a_sentence_is_no_address():
    for text in ("we met at noon. Es war kalt", "look at this. We met at noon.", "he was at home all day"):
        assert found(text) == []


def test_left_out_segments_never_beat_the_margin():
    model = pii.trained()
    dropped = 0
    for text, _ in pii.examples(150, seed=5):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        segments = pii._segments(text, tokens, [True] * len(tokens))
        kept = set(model.hopeful(text, tokens, segments))
        out = [s for s in segments if s not in kept]
        assert all(model.weights[r].sum(axis=0).max() <= pii.MARGIN for r in model.rows(text, tokens, out))
        dropped += len(out)
    assert dropped > 1000


@pytest.mark.parametrize(
    "text,spans",
    [
        ("10.0.0.1, 613-555-8758", [("phone", "613-555-8758")]),
        ("10.0.0.1,613-555-8758,10.0.0.2", [("phone", "613-555-8758")]),
        ("4111 1111 1111 1111, (613) 555-8758", [("phone", "(613) 555-8758")]),
        ("(613) 555-8758, 10.0.0.1, jane [at] example.com, 10.0.0.2, 416-555-1234", [("phone", "(613) 555-8758"), ("email", "jane [at] example.com"), ("phone", "416-555-1234")]),
    ],
)
def test_numbers_beside_base_spans(text, spans):
    assert pii.base_spans(text)
    assert found(text) == spans


@pytest.mark.parametrize("address", ["jane.doe [at] mail [dot] example [dot] com", "jane [dot] doe12 [at] mail [dot] example [dot] com", "jane.doe12 (at) dept (dot) mail (dot) example (dot) com", "jane dot doe12 at mail dot example dot com"])
def test_long_spelt_addresses_whole(address):
    assert found(f"write to {address} today") == [("email", address)]


def test_every_gold_span_is_a_candidate():
    for text, gold in pii.examples(2000, seed=21):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        spans = {(tokens[i][0], tokens[j - 1][1]) for i, j in pii._segments(text, tokens, [True] * len(tokens))}
        assert {(a, b) for a, b, _ in gold} <= spans


def test_training_refuses_gold_without_a_candidate():
    text = " . ".join("ab" for _ in range(40))
    with pytest.raises(ValueError):
        pii.SemiCrf.train([(text, [(0, len(text), 0)])], passes=1)
