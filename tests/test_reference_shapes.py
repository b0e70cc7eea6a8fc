"""Texts that differ in their numbers alone are read once, as each would be by itself."""

import random

from docweave.operators import references

WORDS = "see 12 60000 1/10000 4.2 (1) (a) (4a) ( 3 ) (ii) , and to . of /EC in Council 7a x9 thereof 5 point".split()
PHRASES = ["Article 5", "Articles 5 to 12", "Articles 5, 7 and 5(2)", "Article 5(1), point (b)(ii)", "points 4.5, 4.6 and point 5.1 of Annex III", "Section 5 of Chapter 2", "this Article", "paragraph 5, point (a)", "point (b) of this paragraph", "the first subparagraph of paragraph 5", "Article 5 of Regulation (EU) No 2016/5/EC", "Directive 5/46/EC as amended by Council Decision 5/12345", "referred to in paragraph 5", "Annex 5, Section A, point 5(a)"]


def test_as_by_itself():
    chance = random.Random(4)
    some = 0
    for _ in range(4000):
        text = "".join(chance.choice(chance.choice([WORDS, PHRASES])).replace("5", str(chance.randrange(10**chance.randrange(1, 8)))) + chance.choice([" ", " ", " ", ""]) for _ in range(chance.randrange(1, 8)))
        want = references._located(references.FOOTNOTE.sub("", text))
        assert references.located_references(text) == want, text
        some += len(want)
    assert some > 3000 and references.located_references(None) == []


def test_a_shape_is_read_once():
    references._shaped.cache_clear()
    for n in range(500):
        assert references.located_references(f"under Article {n}({n * n}), point (b)")[0]["match"] == f"Article {n}({n * n}), point (b)"
    assert references._shaped.cache_info().misses == 1
