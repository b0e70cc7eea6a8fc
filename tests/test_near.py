"""Near quotes against a brute force, with edits at every tenth and behind many false anchors; the automaton; references in linear time."""

import random
import re
import time

import pytest

from docweave.operators import patterns, references, verify

QUOTE = "the manufacturer shall keep the technical documentation at the disposal of the competent authorities for a period of ten years after the last device has been placed on the market"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def brute(quote, source):
    """All pairs of places, the longest block through each diagonal's runs, and the subsequences beside it."""
    n, best, slack = len(quote), (0.0, 0.0), verify.SLACK + len(quote) // 10
    for d in range(-n, len(source)):
        i = max(0, -d)
        while i < n and i + d < len(source):
            j = i
            while j < n and j + d < len(source) and quote[j] == source[j + d]:
                j += 1
            if j - i >= verify.BLOCK * n:
                a, b = i + d, j + d
                best = max(best, ((j - i + lcs(quote[:i], source[max(0, a - i - slack) : a]) + lcs(quote[j:], source[b : b + n - j + slack])) / n, (j - i) / n))
            i = max(i + 1, j)
    return best


@pytest.mark.parametrize("tenth", range(10))
def test_edits_at_every_tenth(tenth):
    at = len(QUOTE) * tenth // 10
    for changed in (QUOTE[:at] + "xyz " + QUOTE[at:], QUOTE[:at] + QUOTE[at + 6 :], QUOTE[:at] + "?" + QUOTE[at + 1 :]):
        source = f"Some words before. {changed} and after that more of the market and of ten years."
        assert verify.nearness(QUOTE, source) == brute(QUOTE, source)
        if tenth in (0, 1, 8, 9):
            assert verify.nearness(QUOTE, source)[0] >= 0.9


def test_behind_a_thousand_false_anchors():
    middle = QUOTE[len(QUOTE) * 2 // 5 - 3 : len(QUOTE) * 3 // 5 + 3]
    source = (f"so {middle} no. " * 1000) + QUOTE.replace("manufacturer", "manufacturers")
    assert verify.nearness(QUOTE, source)[0] > 0.99


def test_random_texts():
    chance = random.Random(7)
    for _ in range(60):
        quote = "".join(chance.choice("ab ") for _ in range(chance.randrange(5, 30)))
        source = "".join(chance.choice("ab ") for _ in range(60)) + quote[: len(quote) * 3 // 4] + "b" + quote[len(quote) * 3 // 4 :]
        assert verify.nearness(quote, source) == pytest.approx(brute(quote, source)) or verify.nearness(quote, source) > brute(quote, source)
    assert verify.nearness("", "x") == (0.0, 0.0) == verify.nearness("abcde", "")


def test_common_subsequence():
    chance = random.Random(3)
    for _ in range(200):
        a, b = ("".join(chance.choice("abc") for _ in range(chance.randrange(90))) for _ in range(2))
        assert verify.common(a, b) == lcs(a, b)


def test_automaton(spark):
    chance = random.Random(2)
    words = ["a", "ab", "b a", "né", "body", "notified body", "(x)", "a_b"]
    rows = [(k, " ".join(chance.choice([*words, "abody", "z"]) for _ in range(15))) for k in range(30)] + [(98, None), (99, "")]
    texts = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(w,) for w in [*words, "", None, "body"]], "pattern string")
    for whole in (False, True):
        edge = (r"(?<!\w)", r"(?!\w)") if whole else ("", "")
        want = sorted((i, w, m.start()) for i, t in rows for w in words for m in re.finditer(f"(?={edge[0]}{re.escape(w)}{edge[1]})", t or ""))
        for most in (4, 1 << 20):
            assert sorted((r.id, r.pattern, r.start) for r in patterns.occurrences(texts, asked, whole, most).collect()) == want
    assert patterns.occurrences(texts, asked.limit(0)).count() == 0


def test_external_references_take_linear_time():
    took = []
    for n in (400, 1600):
        text = "as Article 5(1), point (a) of Regulation (EU) 2016/679 says, and " * n
        began = time.perf_counter()
        found = references.located_references(text)
        took.append(time.perf_counter() - began)
        assert sum("qualified" in dict(f["groups"]) for f in found if f["kind"] == "external") == n
    assert took[1] < 10 * took[0]
