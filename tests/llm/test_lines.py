"""Line-first cleaning: base counts by a loop, rules line by line, verdicts, broken texts."""

import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import lines

PROSE = "The committee met on Monday and agreed on a plan for the coming year. It will report again in the spring, when the figures are known."


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {p + k for p in places for k in range(8)}
    worded = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(worded) - len(set(worded)), len(hit), failed


TEXTS = [
    None, "", " \t\n\v\f\r ", "one", PROSE, PROSE + "\n" + PROSE, "a b c d e f g h " * 5, ("x y " * 500).strip(), "w " * 8, "w " * 9, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(30, 60))),
    "é ü   #*$%&|<> a\r\nb\r\nb\r\n\nb\n b\n", "\n".join(["same line here"] * 30), "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "𝔘𝔫𝔦 code\u0000point " * 4,
]


def test_base_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in lines.clean(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(TEXTS[r.doc_id]), r.doc_id


@pytest.mark.parametrize(
    "line, rule",
    [
        (PROSE, None),
        ("A heading without an end", "punctuation"),
        ("It was said “so it is.”", None),
        ("这是一个句子。", None),
        ("Home | News | Sport | Weather | More", "navigation"),
        ("Start » Shop » Shoes", "navigation"),
        ("Sign in", "navigation"),
        ("Homework is due on Friday.", None),
        ("© 2024 Example. All rights reserved.", "boilerplate"),
        ("Released under the MIT License.", "boilerplate"),
        ("This site uses cookies to improve your visit.", "boilerplate"),
        ("He went on at length about the cookie that his grandmother used to bake on winter evenings, and about the many neighbours who came in to taste it.", None),
        ("buy$$$ this*** now### for### cheap%%%.", "boilerplate"),
        ("BUY NOW AND SAVE MONEY.", "boilerplate"),
        ("great!! offer!! now!!", "boilerplate"),
        ("NATO met.", None),
    ],
)
def test_rule(spark, line, rule):
    words = F.array_remove(F.split("x", lines.SPACE), "")
    assert spark.createDataFrame([(line,)], "x string").select(lines.failed_rule(F.col("x"), words)).first()[0] == rule


def test_documents(spark):
    menu = "Home | News | Sport | Weather | More"
    texts = [PROSE, f"{menu}\n{PROSE}\n\nAll rights reserved.", "\n".join(" | ".join(f"{w}{k}" for w in ("home", "news", "sport", "more")) for k in range(6)) + "\n" + PROSE[:60], None]
    got = {r.doc_id: r for r in lines.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].kept for k in range(4)] == [True, True, False, False]
    assert got[0].text == PROSE and got[1].text == f"{PROSE}\n" and got[3].text is None
    assert got[1].n_failed == {"punctuation": 0, "navigation": 1, "boilerplate": 1} and got[1].n_lines == 3
    assert not got[2].base_failed and got[2].lost_chars * 2 > got[2].word_chars


def test_very_long_text(spark):
    """Half a million words, all alike or all different: linear, and whole."""
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("word "), 500_000)).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500_000)), lambda i: i.cast("string")), " ")).alias("text"))
    assert [(r.n_words, r.n_repeat_words) for r in lines.clean(docs).orderBy("doc_id").collect()] == [(500_000, 500_000), (500_000, 0)]


def test_columns_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE)], "doc_id long, text string").withColumns({c: F.lit("x") for c in (*lines.ADDED, "line", "words", "rule", "x", "i", "n", "end", "lang")})
    got = lines.clean(rows)
    assert len(got.columns) == len(set(got.columns)) and set(rows.columns) <= set(got.columns)
    assert [(r.kept, r.lang, r.line) for r in got.collect()] == [(True, "x", "x")] * 3
    assert lines.clean(rows.limit(0)).count() == 0


def test_no_python(spark, sf_dir):
    plan = lines.op11_line_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
