import hashlib
import random
import re

import pytest

from docweave.llm import pii


def brute(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_is_leftmost_matches():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["1", "25", "4111 1111 1111 1111", "+1", ".", "-", " ", "@", "a", "b.c", "(", "é", "300.1.1.1", "1.2.3.4"]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000, "a@" * 150_000, "[.]" * 60_000, "12 " * 60_000):
        base = pii.base_spans(text)
        pii.added_spans(text[:60_000], base if len(text) <= 60_000 else pii.base_spans(text[:60_000]), pii.trained())


@pytest.mark.parametrize("text,kind,span", [("mail john.doe [at] example [dot] com now", 0, "john.doe [at] example [dot] com"), ("call (613) 555-8758 today", 3, "(613) 555-8758"), ("ip 10[.]0[.]0[.]1 ok", 1, "10[.]0[.]0[.]1")])
def test_added(text, kind, span):
    a = text.index(span)
    assert (a, a + len(span), kind) in pii.added_spans(text, pii.base_spans(text), pii.trained())


def test_look_alikes_stay():
    for text in ("on 12.05.2020 we met at home 12", "password=887c28e275db436f57 z", "nothing at all. The dot", ""):
        assert pii.added_spans(text, pii.base_spans(text), pii.trained()) == []


def test_held_out_sentences():
    right = wrong = gold_n = 0
    for text, gold in pii.examples(200, seed=99):
        base = pii.base_spans(text)
        got = {(a, b) for a, b, _ in base + pii.added_spans(text, base, pii.trained())}
        want = {(a, b) for a, b, _ in gold}
        right, wrong, gold_n = right + len(got & want), wrong + len(got - want - {(a, b) for a, b, _ in base}), gold_n + len(want)
    assert right >= 0.8 * gold_n and wrong <= 0.15 * gold_n


def test_query_and_mask(spark):
    rows = [(1, "x é a@b.cd and 1.2.3.4", "k"), (1, "x é a@b.cd and 1.2.3.4", "k"), (2, None, None), (None, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans_ string")
    got = pii.find(docs).collect()
    assert len(got) == 4
    first = next(r for r in got if r.doc_id == 1)
    assert [(s.kind, first.text[s.start : s.end]) for s in first.spans] == [("email", "a@b.cd"), ("ip", "1.2.3.4")]
    masked = sorted((r.doc_id or 0, r.text) for r in pii.mask(docs).collect() if r.text is not None)
    assert masked == [(0, ""), (1, "x é <EMAIL> and <IP>"), (1, "x é <EMAIL> and <IP>")]
    assert pii.find(docs.limit(0)).count() == 0


def test_query_counts(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op2_pii(spark, sf_dir).collect():
        spans = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.spans_text(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in range(4)]
        assert set(filter(None, pii.spans_text(spans).split(","))) <= set(r.spans.split(","))
