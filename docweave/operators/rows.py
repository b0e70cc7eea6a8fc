"""Row operators: upserts, first wins, budgets, trims, set differences, parity and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """Old rows whose key is not in new, and of new the last of each key in order."""
    last = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def keep_human(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New assignments (key, value, source), but old ones of source 'human' stay, and no others of the old."""
    a, b = old.filter("source = 'human'").alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    human = F.col(f"a.{key}").isNotNull()
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.when(human, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in old.columns if c != key])


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def budget_cut(rows: DataFrame, group: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Leading rows of each group while their sizes sum to the budget at most; the first always. Adds pos and total."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = rows.withColumn("pos", F.row_number().over(w)).withColumn("total", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter((F.col("pos") == 1) | (F.col("total") <= budget))


def trim_history(turns: DataFrame, group: str, order: str, size: Column, most_turns: int = 6, most_size: int = 3000) -> DataFrame:
    """The last turns of each conversation, from the oldest on while their sizes do not pass the limit."""
    last = turns.withColumn("__back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).filter(F.col("__back") <= most_turns)
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("total", F.sum(size).over(w)).filter(F.col("total") <= most_size).drop("__back")


def merge_unique(channels: list[DataFrame], key: str, group: list[str]) -> DataFrame:
    """Rows (group, key, pos) of channels, earlier channels first, each key of a group once; numbered from 1 as rank."""
    out = None
    for k, c in enumerate(channels):
        rows = c.withColumn("channel", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    first = out.withColumn("__r", F.row_number().over(Window.partitionBy(*group, key).orderBy("channel", "pos"))).filter("__r = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("channel", "pos", key))).select(*group, key, "channel", "rank")


def parity(left: DataFrame, right: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """key and what differs: missing_right, missing_left, text, kind. Equal rows are left out."""
    a, b = (d.select(F.col(key).alias(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"), F.col(kind).alias("k")).alias(n) for d, n in ((left, "a"), (right, "b")))
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    what = F.when(F.col(f"b.{key}").isNull(), "missing_right").when(F.col(f"a.{key}").isNull(), "missing_left").when(F.col("a.h") != F.col("b.h"), "text").when(~F.col("a.k").eqNullSafe(F.col("b.k")), "kind")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), what.alias("differs")).filter("differs is not null")


def lost_tokens(source: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """key, lost: how many tokens (key, token) of the source are not, as often, among the kept."""
    a = source.groupBy(key, "token").agg(F.count("*").alias("n"))
    b = kept.groupBy(key, "token").agg(F.count("*").alias("m"))
    return a.join(b, [key, "token"], "left").groupBy(key).agg(F.sum(F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))).alias("lost"))


def worst_majority(votes: DataFrame, group: str, vote: str, severity: Column) -> DataFrame:
    """The most frequent vote of each group; of equally frequent ones the most severe."""
    counted = votes.groupBy(group, vote).agg(F.count("*").alias("n"))
    return counted.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), severity.desc(), vote))).filter("__r = 1").select(group, vote, "n")


def ranked_choice(rows: DataFrame, key: list[str], rank: str, alive: DataFrame, target: str) -> DataFrame:
    """Of each key's candidates those of the least rank whose target is alive (id); keys without one are dropped."""
    live = rows.join(alive.select(F.col("id").alias(target)), target, "left_semi")
    return live.groupBy(*key).agg(F.min_by(target, F.col(rank)).alias(target), F.min(rank).alias(rank))


def integrity(node: DataFrame) -> DataFrame:
    """check, n: duplicate ids, orphans, self parents, nodes without text, depths that do not follow their parent's."""
    ids = node.groupBy("id").agg(F.count("*").alias("n"))
    up = node.select("id", "parent_id", "depth", "text").join(node.select(F.col("id").alias("parent_id"), F.col("depth").alias("above"), F.lit(True).alias("there")), "parent_id", "left")
    checks = [
        ids.agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("duplicate_id").alias("check"), "n"),
        up.agg(*[F.count_if(c).alias(name) for name, c in (("orphan", F.col("parent_id").isNotNull() & F.col("there").isNull()), ("self_parent", F.col("parent_id") == F.col("id")), ("no_text", F.coalesce(F.trim("text"), F.lit("")) == ""), ("depth", F.col("there") & (F.col("depth") != F.col("above") + 1)))]).select(F.expr("stack(4, 'orphan', orphan, 'self_parent', self_parent, 'no_text', no_text, 'depth', depth) as (check, n)")),
    ]
    return checks[0].unionByName(checks[1])
