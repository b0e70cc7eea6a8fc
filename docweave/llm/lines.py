"""Line-first cleaning of documents (operator 11), in DataFrame functions only.

A text is split at \\n, and each line with a word is held against rules of three families:

* punctuation: no sentence ends in the line;
* navigation: bars, arrows and dots between short items, or a short line that begins like a menu entry;
* boilerplate: notices (rights, licences, cookies) in a line of at most NOTICE words, symbols or double exclamation marks at
  nearly every word, and lines in capitals only.

Lines that fail are removed; a document is rejected if it loses more than MOST_LOST percent of the characters of its words, or if its whole text
fails the two base rules: under LEAST_WORDS words, or more than MOST_REPEATED percent of its words in windows of
WINDOW words that the text has twice or more.

Everything is an expression over one row: nothing is shuffled, so a hot source or a large group of copies costs what its
rows cost. Windows are compared by a 64-bit hash. They are sorted, in the texts that repeat one at all, with their places, so
a text of one word over and over takes no more than n log n steps.

Defined results: a null or empty text has no words, is rejected and stays null or empty; lines without a word are neither judged nor
removed; all rows and columns stay, columns of the added names are replaced; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._frames import PREFIX, read

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
MOST_LOST = 50
NOTICE, MENU = 25, 6
SENTENCE_END = r"[.!?:;…。！？؟।]['\")\]»”’]*([\x20\x09-\x0D]|\z)"
DIVIDER = r"^[|»›→•·>/~_=-]+$"
MENU_ENTRY = r"^[^a-z]*(home|menu|search|login|log in|log out|sign in|sign up|register|next|previous|back|back to top|skip to content|read more|share|tweet|print|contact us|about us|sitemap)([^a-z]|\z)"
NOTICES = r"(all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie|enable javascript|lorem ipsum|unsubscribe|subscribe to|follow us|powered by)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "n_lines": "long", "n_failed": "map<string,long>", "lost_chars": "long", "kept": "boolean"}
RULES = ("punctuation", "navigation", "boilerplate")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: inside a lambda an expression would be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def failed_rule(line: Column, words: Column) -> Column:
    """The family of the first rule that a line with words fails, or null."""
    n = F.size(words)
    low = F.translate(line, UPPER, LOWER)
    dividers = F.size(F.filter(words, lambda w: w.rlike(DIVIDER)))
    menu = (dividers >= 2) & (4 * dividers >= n) | (n <= MENU) & low.rlike(MENU_ENTRY)
    loud = (n >= 3) & ((F.regexp_count(line, F.lit("!!")) * 2 >= n) | line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}"))
    notice = (n <= NOTICE) & low.rlike(NOTICES) | (F.regexp_count(line, F.lit(SYMBOL)) >= n) & (dividers < n) | loud
    return F.when(menu, "navigation").when(notice, "boilerplate").when(~line.rlike(SENTENCE_END), "punctuation")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of width words that are there twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = bound(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        beside = lambda s, k, d: F.coalesce(F.get(s, k + d)["x"] == F.get(s, k)["x"], F.lit(False))
        twice = bound(placed, lambda s: F.filter(F.transform(s, lambda x, k: F.when(beside(s, k, -1) | beside(s, k, 1), x["i"])), lambda i: i.isNotNull()))
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + width - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + width).alias("end"))
        return F.aggregate(F.sort_array(twice), begin, step, lambda a: a["n"])

    counted = bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) > width, counted).otherwise(F.lit(0))


def clean(docs: DataFrame, text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """docs with the failed lines taken out of text, the columns ADDED, and all rows: kept says which documents are good."""
    lines, words = PREFIX + "lines", PREFIX + "words"
    keep = [c for c in docs.columns if c not in ADDED]
    split = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), F.array_remove(F.split(x, SPACE), "").alias("words")))
    rows = docs.select(keep).withColumn(lines, split)
    judged = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.length(F.array_join(x["words"], "")).alias("chars"), F.when(F.size(x["words"]) > 0, failed_rule(x["line"], x["words"])).alias("rule")))
    rows = rows.withColumns({words: F.flatten(F.transform(lines, lambda x: x["words"])), lines: judged})
    worded = F.transform(F.filter(lines, lambda x: x["chars"] > 0), lambda x: x["line"])
    total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    of = lambda rule: F.size(F.filter(lines, lambda x: x["rule"] == rule)).cast("long")
    rows = rows.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": total(lines),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)).cast("long"),
            "n_dup_lines": bound(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long"),
            "n_repeat_words": repeated_words(F.col(words)).cast("long"),
            "n_lines": F.size(worded).cast("long"),
            "n_failed": F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*map(of, RULES))),
            "lost_chars": total(F.filter(lines, lambda x: x["rule"].isNotNull())),
            text: F.when(F.col(text).isNotNull(), F.array_join(F.transform(F.filter(lines, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))
    return rows.select(*keep, *ADDED)


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean(read(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = [F.col("n_failed")[r].alias(f"n_{r}") for r in RULES]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", *failed, "lost_chars")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT n, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words
      FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT n, line, len(words) AS k, length(array_to_string(words, '')) AS chars, translate(line, '{UPPER}', '{LOWER}') AS low,
             len(list_filter(words, lambda w: regexp_matches(w, {_quoted(DIVIDER)}))) AS dividers FROM l WHERE len(words) > 0),
r AS (SELECT n, line, chars,
             CASE WHEN dividers >= 2 AND 4 * dividers >= k OR k <= {MENU} AND regexp_matches(low, {_quoted(MENU_ENTRY)}) THEN 'navigation'
                  WHEN k <= {NOTICE} AND regexp_matches(low, {_quoted(NOTICES)}) OR len(regexp_extract_all(line, '{SYMBOL}')) >= k AND dividers < k
                       OR k >= 3 AND (2 * len(regexp_extract_all(line, '!!')) >= k OR regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}')) THEN 'boilerplate'
                  WHEN NOT regexp_matches(line, {_quoted(SENTENCE_END)}) THEN 'punctuation' END AS rule FROM m),
by_line AS (SELECT n, count(*) AS n_lines, sum(chars) AS word_chars, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost_chars,
                   count(*) FILTER (rule = 'punctuation') AS n_punctuation, count(*) FILTER (rule = 'navigation') AS n_navigation, count(*) FILTER (rule = 'boilerplate') AS n_boilerplate
            FROM r GROUP BY n),
w AS (SELECT n, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
windows AS (SELECT n, i, array_to_string(words[i:i + {WINDOW} - 1], ' ') AS x FROM (SELECT n, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM w)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, x) AS c FROM windows) WHERE c >= 2),
covered AS (SELECT n, count(DISTINCT p) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY n),
base AS (SELECT d.n, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{SYMBOL}')) AS BIGINT) AS n_symbols,
                CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
                CAST(coalesce(n_punctuation, 0) AS BIGINT) AS n_punctuation, CAST(coalesce(n_navigation, 0) AS BIGINT) AS n_navigation, CAST(coalesce(n_boilerplate, 0) AS BIGINT) AS n_boilerplate,
                CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
         FROM d JOIN w ON d.n = w.n LEFT JOIN by_line b ON d.n = b.n LEFT JOIN covered c ON d.n = c.n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept,
       n_lines, n_punctuation, n_navigation, n_boilerplate, lost_chars
FROM base
"""
