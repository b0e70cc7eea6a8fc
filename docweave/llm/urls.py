"""URL filter by rules and a tree of path templates for each host (operator 4).

A rule (host/path) fits its host and all subdomains if the url's path starts with the rule's; the longest wins.
Pages that a rule decides are the labelled ones. Each host gets a tree of path segments: digits and long
hexadecimal runs become wildcards; at each node, segments that are rare among its pages become one wildcard; and
branches whose labels (blocked, allowed, none) do not differ significantly from the whole node's are merged. A
template of the finished tree is rejected if its smoothed purity, (blocked + 1) / (labelled + 2), reaches PURITY;
so without labels nothing is rejected.

Only DataFrame functions are used. Pages are first counted by host and generalised path; the tree is grown on these
counts, and its verdicts return to the pages by a salted join, so a hot host or path does not meet in one task.
Paths have as many levels as they have segments; below a node of fewer than
COUNT pages every segment is rare, so what is left of a path is generalised at once, and one deep url adds no level.

Defined results: a null url, or one without ://, has an empty host and path and its own template; a null page_id is
kept; repeated rows are kept and judged alike; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._frames import PREFIX, materialise, read

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A segment stays a literal if it has this share of its node's pages, and this many.
SHARE, COUNT = 0.02, 5
#: Chi-square of two degrees of freedom at a chance of 0.001.
DIFFERENT = 13.82
PURITY = 0.8
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, or null, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits is the longest
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def general(path: Column) -> Column:
    """The path with long hexadecimal runs and digits replaced."""
    hexed = F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{hex}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def templates(counted: DataFrame) -> DataFrame:
    """counted: host, shape, n, blocked, allowed. Adds the template of each, with the template's purity."""
    rare = lambda segment: F.regexp_replace(segment, r"[^/{}.\-_]*[^/{}.\-_n0-9][^/{}.\-_]*", "*")
    live = counted.withColumn("pieces", F.split(F.regexp_replace("shape", "^/", ""), "/")).withColumn("template", F.lit(""))
    live, done, level = live.filter("pieces is not null"), [live.filter("pieces is null")], 0
    while not live.isEmpty():
        live = live.withColumn("segment", F.get("pieces", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
        child = live.groupBy("host", "template", "segment").agg(*sums)
        node = child.groupBy("host", "template").agg(*[F.sum(c).alias("all_" + c) for c in ("n", "blocked", "allowed")])
        joined = child.join(node, ["host", "template"])
        literal = (F.col("n") >= COUNT) & (F.col("n") >= SHARE * F.col("all_n"))
        kinds = [("blocked", "all_blocked"), ("allowed", "all_allowed")]
        sets = [(F.col(a), F.col(b)) for a, b in kinds] + [(F.col("n") - F.col("blocked") - F.col("allowed"), F.col("all_n") - F.col("all_blocked") - F.col("all_allowed"))]
        part = F.col("n") / F.col("all_n")
        # Of the child against the rest of the node.
        chi = sum((F.when((whole > 0) & (part < 1), (own - whole * part) * (own - whole * part) / (whole * part * (1 - part))).otherwise(0.0) for own, whole in sets), F.lit(0.0))
        named = F.when(~literal, rare(F.col("segment"))).when(chi < DIFFERENT, F.lit("+")).otherwise(F.concat(F.lit("="), F.col("segment")))
        names = joined.select("host", "template", "segment", named.alias("named"), (F.col("all_n") < COUNT).alias("small"))
        rows = live.join(names, ["host", "template", "segment"])
        left = F.transform(F.slice("pieces", F.lit(level + 1), F.size("pieces")), rare)
        template = F.when(F.col("small"), F.concat("template", F.lit("/"), F.array_join(left, "/"))).otherwise(F.concat("template", F.lit("/"), "named"))
        rows = materialise(rows.withColumn("template", template).withColumn("ended", F.col("small") | (F.size("pieces") <= level + 1)).drop("named", "segment", "small"))
        done.append(rows.filter("ended").drop("ended"))
        live, level = rows.filter("not ended").drop("ended"), level + 1
    rows = reduce(DataFrame.unionByName, done)
    judged = rows.groupBy("host", "template").agg(F.sum("blocked").alias("all_blocked"), F.sum(F.col("blocked") + F.col("allowed")).alias("labelled"))
    purity = (F.col("all_blocked") + 1) / (F.col("labelled") + 2)
    return rows.join(judged, ["host", "template"]).select("host", "shape", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, template and purity; the url stays."""
    salt, shape, given = PREFIX + "salt", PREFIX + "shape", PREFIX + "given"
    names = ("host", "path", "rule", "verdict", "template", "purity")
    clash = [c for c in pages.columns if c in names]
    rows = pages.drop(*clash).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn(given, verdict).withColumn(shape, general(F.col("path")))
    count_if = lambda what: F.sum(F.when(F.col(given) == what, 1).otherwise(0))
    counted = materialise(rows.groupBy("host", shape).agg(F.count("*").alias("n"), count_if("block").alias("blocked"), count_if("allow").alias("allowed")).withColumnRenamed(shape, "shape"))
    found = templates(counted).withColumnRenamed("shape", shape).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(url, *[c for c in rows.columns if c == "page_id"]), F.lit(SALTS)).cast("int"))
    learnt = F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow"))
    joined = spread.join(found, ["host", shape, salt])
    return joined.select(*[c for c in pages.columns if c not in clash], "host", "path", "rule", F.coalesce(F.col(given), learnt).alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")
