import random

from docweave.operators import grounding
from docweave.operators.grounding import Source, Sources, attributed_to, checked, fold, repaired

LAW = "The manufacturer shall keep the technical documentation at the disposal of the competent authorities for ten years after the device was placed on the market."
OTHER = "Importers shall verify that the device is labelled in accordance with this Regulation and that the importer has been identified."
THIRD = "Distributors shall, before making a device available on the market, verify that the CE marking has been affixed to the device."


def bag():
    return Sources([("Article 10(8)", LAW), ("Article 13", OTHER), ("Article 14", THIRD), ("Recital 30", LAW.replace("ten", "many")), (None, "loose guidance text of some length that stands nowhere else in here")])


def test_fold():
    assert fold("**Machine-readable**  ‘AI’ – x y") == "machine readable 'ai' x y"
    assert fold("ﬁne") == "fine" and fold(None) == ""


def test_verdicts():
    s = Source(fold(LAW))
    assert s.verdict(LAW) == "exact" and s.verdict(LAW.replace("technical documentation", "technical-documentation")) == "exact"
    assert s.verdict(LAW.replace("keep the", "keep")) == "near"
    assert s.verdict("the manufacturer shall keep [...] after the device was placed on the market") == "exact"
    assert s.verdict("the manufacturer shall keep the technical documentation … and pay a fine of three million to the state") == "absent"
    assert s.verdict("Nothing of this kind was ever written down in any law of the union at all.") == "absent"
    assert s.verdict(LAW.replace("shall keep", "shall not ever keep or hold on to")[:60]) == "absent"
    assert Source("").verdict(LAW) == "absent" and s.verdict("") == "absent"


def test_near_is_found_wherever_it_was_changed():
    r = random.Random(3)
    words = [f"word{k}" for k in range(300)]
    text = " ".join(r.choice(words) for _ in range(4000))
    s = Source(fold(text))
    parts = text.split()
    for _ in range(30):
        a = r.randrange(3900)
        quote = parts[a : a + 25]
        quote[r.choice([0, 6, 24])] = "changed"
        assert s.verdict(" ".join(quote)) in ("near", "exact")


def test_attribution():
    quote = '"' + LAW + '"'
    say = lambda text: attributed_to(text, text.index('"') + 1, text.rindex('"'))
    assert say(f"Under Article 10(8), {quote}") == "Article 10(8)"
    assert say(f"{quote} (Annex IX, Chapter I)") == "Annex IX"
    assert say(f"Article 5 says so.\nNow {quote} (Article 10)") == "Article 10"
    assert say(f"See Article 3. Under Section 4.2 {quote}") is None
    assert say(f"Nothing here {quote}") is None
    assert say(f"{quote}\nArticle 7") is None


def test_buckets():
    answer = "\n".join([
        f'Article 10 says "{LAW}"', f'Article 13: "{LAW}"', f'Article 13: "{OTHER.replace("verify that the", "verify the")}"',
        'Article 10 adds "The manufacturer shall pay the authorities a yearly fee of one hundred thousand euro in gold."',
        'Your notice could read: "We are sorry to tell you that our product was recalled from all the shops."',
        f'"{LAW} {OTHER} {THIRD}"', 'As you say, "our device measures the heart rate of the patients in hospitals"', 'short "quote"',
    ])
    found = checked(answer, "Our device measures the heart rate of the patients in hospitals, is that fine?", bag())
    assert [(f["bucket"], f["why"]) for f in found] == [("verified", "exact"), ("misattributed", "of another provision"), ("near", "altered"), ("unverified", "not in any source"), ("illustrative", "own wording"), ("misattributed", "put together"), ("verified", "echo")]
    assert all(answer[f["start"] : f["end"]] == f["quote"] for f in found)
    assert checked("", None, bag()) == [] == checked("no quotes", None, bag())


def test_recitals_prove_no_displacement():
    only = Sources([("Article 25", "something else entirely about other things"), ("Recital 30", LAW)])
    assert checked(f'Article 25: "{LAW}"', None, only)[0]["bucket"] == "verified"


def test_repair():
    answer = f'Article 10(8): "The manufacturer shall keep technical documentation at disposal of the authorities for ten years after the device was placed." and Article 13: "An invented sentence that nothing in the law is like in any way at all, truly."'
    findings = checked(answer, None, bag())
    text, edits = repaired(answer, findings, bag())
    assert [e["action"] for e in edits] == ["replaced", "removed"] and LAW in text and grounding.REMOVED in text
    same, none = repaired("nothing", [], bag())
    assert same == "nothing" and none == []


FAMILIES = {"A": {"Article 1", "Article 5", "Annex I"}, "B": {"Article 1", "Article 9", "Annex II"}}
NAMES = {"mdr": "A", "2017/745": "A", "gdpr": "B", "2016/679": "B"}


def test_phantoms():
    bad = lambda line: grounding.phantoms(line, FAMILIES, NAMES)
    assert bad("Article 99 applies") == ["Article 99"] and bad("Article 5 applies") == []
    assert bad("Article 99 of Directive (EU) 2002/58") == []
    assert bad("MDR Article 9 applies") == ["Article 9"] and bad("**Article 9** GDPR") == []
    assert bad("Article 5, as amended by Regulation (EU) 2016/679") == []
    assert bad("Recital 4 of the MDR") == ["Recital 4"]
    assert bad("the MDR is a law that has much to say, and elsewhere, far from it, Article 9 stands") == []


def test_tables(spark):
    answers = spark.createDataFrame([(1, f'Article 10 says "{LAW}"', None), (2, None, None), (3, f'x "{LAW}"', None)], "case_id long, answer string, question string")
    sources = spark.createDataFrame([(1, "Article 10", LAW), (1, "Article 10", "more"), (4, "Article 1", "x")], "case_id long, ref string, text string")
    got = {(r.case_id, r.bucket) for r in grounding.check_quotes(answers, sources).collect()}
    assert got == {(1, "verified"), (3, "unverified")}
    fixed = {r.case_id: (r.replaced, r.removed) for r in grounding.repair_answers(answers, sources).collect()}
    assert fixed == {1: (0, 0), 3: (0, 1)}
    families = spark.createDataFrame([(a, f) for a, some in FAMILIES.items() for f in some], "act string, family string")
    lines = spark.createDataFrame([(1, "Article 5 holds.\nArticle 77 too.\n21 CFR Part 803"), (2, None)], "case_id long, answer string")
    kept = {r.case_id: (r.answer, r.phantoms, r.foreign) for r in grounding.guard_citations(lines, families, NAMES).collect()}
    assert kept == {1: ("Article 5 holds.", ["Article 77"], 1), 2: ("", [], 0)}
    cited = spark.createDataFrame([(1, "Article 5(1)(a), Annex IV and Recital 3; section 4")], "case_id long, answer string")
    context = spark.createDataFrame([(1, "Article 5"), (1, "Recital 3"), (2, "Annex IV")], "case_id long, ref string")
    assert [r.ref for r in grounding.uncovered_references(cited, context).collect()] == ["Annex IV"]


def test_longest_shared():
    import difflib

    r = random.Random(8)
    for _ in range(40):
        a, b = ("".join(r.choice("ab ") for _ in range(r.randrange(30))) for _ in "xy")
        assert grounding.longest_shared(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size
