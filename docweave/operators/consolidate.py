"""Amendment operations applied to the tree of an act, in their order."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.storage import shared_dir, stored
from docweave.operators import scan

NODE = "act string, id string, parent_id string, pos int, title string, text string"
REPORT = "act string, seq long, op string, target string, status string"
OPS = ("insert_after", "add", "replace", "heading", "delete")


def apply_operations(rows: list[dict], ops: list[dict]) -> tuple[list[dict], list[dict]]:
    """Nodes (id, parent_id, ord, title, text) after operations (seq, op, target, id, title, text), and what became of each.

    A node without a parent also gets top: ord and id of the first such node of rows that it is, or was put behind.
    """
    node = {r["id"]: dict(r) for r in rows}
    children: dict[str | None, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["ord"], r["id"])):
        children.setdefault(r["parent_id"] if r["parent_id"] in node else None, []).append(r["id"])
        if r["parent_id"] not in node:
            node[r["id"]]["top"] = (r["ord"], r["id"])
    report = []
    for o in sorted(ops, key=lambda o: o["seq"]):
        target, status = node.get(o["target"]), "applied"
        parent = None if target is None else target["parent_id"] if target["parent_id"] in node else None
        if target is None:
            status = "unresolved"
        elif o["op"] in ("insert_after", "add") and o["id"] in node:
            status = "duplicate"
        elif o["op"] == "insert_after":
            node[o["id"]] = {"id": o["id"], "parent_id": target["parent_id"], "title": o["title"], "text": o["text"], **({"top": target["top"]} if parent is None else {})}
            siblings = children[parent]
            siblings.insert(siblings.index(o["target"]) + 1, o["id"])
        elif o["op"] == "add":
            node[o["id"]] = {"id": o["id"], "parent_id": o["target"], "title": o["title"], "text": o["text"]}
            children.setdefault(o["target"], []).append(o["id"])
        elif o["op"] == "replace":
            target["text"] = o["text"]
            for child in children.pop(o["target"], []):
                _drop(child, node, children)
        elif o["op"] == "heading":
            target["title"] = o["title"]
        elif o["op"] == "delete":
            children[parent].remove(o["target"])
            _drop(o["target"], node, children)
        else:
            status = "unsupported"
        report.append({"seq": o["seq"], "op": o["op"], "target": o["target"], "status": status})
    out = [{**node[i], "pos": k + 1} for ids in children.values() for k, i in enumerate(ids) if i in node]
    return out, report


def _drop(root: str, node: dict, children: dict) -> None:
    left = [root]
    while left:
        x = left.pop()
        node.pop(x, None)
        left += children.pop(x, [])


#: Nodes of an act that are one task, about.
GROUP = 20_000
KEY, SHARE = "__act", "__share"


def _act_key(df: DataFrame) -> DataFrame:
    return df.withColumn(KEY, F.coalesce(F.concat(F.lit("a"), F.col("act").cast("string")), F.lit("")))  # no null: acts are joined by it


def _whole(keys: DataFrame, ops: DataFrame) -> DataFrame:
    """Acts (KEY) whose operations may reach beyond the part that they aim at: an id is given twice, or a new id is also aimed at, a node's or a parent's."""
    no = F.lit(0)
    made = F.col("op").isin("insert_after", "add")
    given = keys.select(KEY, "id", F.lit(1).alias("n"), no.alias("c"), no.alias("t")).unionByName(keys.filter("parent_id is not null").select(KEY, F.col("parent_id").alias("id"), no.alias("n"), no.alias("c"), F.lit(1).alias("t")))
    given = given.unionByName(ops.filter(made).select(KEY, "id", no.alias("n"), F.lit(1).alias("c"), no.alias("t"))).unionByName(ops.select(KEY, F.col("target").alias("id"), no.alias("n"), no.alias("c"), F.lit(1).alias("t")))
    seen = given.groupBy(KEY, "id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("t").alias("t"))
    return seen.filter("n > 1 or c > 1 or (c > 0 and (n > 0 or t > 0))").select(KEY).distinct()


def _tops(keys: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """KEY, id, top of the nodes: the node without a parent that they lie below; and the acts (KEY) that have circles, and so nodes below none. A join a level."""
    up = keys.select(KEY, F.col("id").alias("parent_id")).distinct()
    below = keys.filter("parent_id is not null")
    left = stored(below.join(up, [KEY, "parent_id"], "left_semi"), f"{folder}/left")
    roots = keys.filter("parent_id is null").unionByName(below.join(up, [KEY, "parent_id"], "left_anti").select(keys.columns))
    level = roots.select(KEY, "id", F.col("id").alias("top"))
    out, depth = level, 0
    while True:
        above = level.select(KEY, F.col("id").alias("parent_id"), "top")
        found = stored(left.join(above, [KEY, "parent_id"], "left").select(KEY, "id", "parent_id", "top"), f"{folder}/level{depth}")
        level, left = found.filter("top is not null").select(KEY, "id", "top"), found.filter("top is null").select(KEY, "id", "parent_id")
        out, depth = out.unionByName(level), depth + 1
        if left.isEmpty() or level.isEmpty():
            return out.dropDuplicates([KEY, "id"]), left.select(KEY).distinct()


def consolidate(nodes: DataFrame, ops: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Trees after operations, and their report. nodes: act, id, parent_id, ord, title, text; ops: act, seq, op, target, id, title, text.

    Operations depend on their order, but only on those that reach the same nodes: what lies below different nodes without a parent is apart, unless
    ids are shared. So such parts of an act, with the operations aimed at them, are dealt out by a hash, about group nodes to a task, and the nodes
    without a parent are numbered over the act by a scan, numbered(), which finishes the trees (the report needs none). An act whose ids are shared by parts, or that has circles, is one task.
    """
    spark = nodes.sparkSession
    folder = f"{shared_dir(spark)}/consolidated-{uuid.uuid4().hex}"
    keyed, asked = _act_key(nodes), _act_key(ops)
    keys = stored(keyed.select(KEY, "id", "parent_id"), f"{folder}/keys")
    most = keys.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0
    tops, circles = _tops(keys, folder)
    whole = F.broadcast(stored(_whole(keys, asked).unionByName(circles).distinct(), f"{folder}/whole").withColumn("__whole", F.lit(True)))
    share = F.when(F.col("__whole"), F.lit(0)).otherwise(F.pmod(F.xxhash64("top"), F.lit(max(1, -(-most // group))))).cast("int")

    def dealt(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
        of = tops.withColumnRenamed("id", "__id")
        placed = rows.join(of, (rows[KEY] == of[KEY]) & (rows[by] == of["__id"]), "left").select(rows[KEY], *[rows[n] for n in names], F.coalesce(of["top"], rows[by]).alias("top"))
        return placed.join(whole, KEY, "left").select(KEY, share.alias(SHARE), *names)

    def tree(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, _ = apply_operations(left.to_pylist(), right.to_pylist())
        act = (left if left.num_rows else right).column("act")[0].as_py()
        made = [{"act": act, **{k: r[k] for k in ("id", "parent_id", "pos", "title", "text")}, "top_ord": r["top"][0] if "top" in r else None, "top_id": r["top"][1] if "top" in r else None} for r in rows]
        return pa.Table.from_pylist(made, schema=pa.schema([("act", pa.string()), ("id", pa.string()), ("parent_id", pa.string()), ("pos", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("top_ord", pa.int64()), ("top_id", pa.string())]))

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        blank = {"title": None, "text": None}  # neither decides what becomes of an operation
        _, rows = apply_operations([{**r, **blank} for r in left.to_pylist()], [{**o, **blank} for o in right.to_pylist()])
        act = (left if left.num_rows else right).column("act")[0].as_py()
        return pa.Table.from_pylist([{"act": act, **r} for r in rows], schema=pa.schema([("act", pa.string()), ("seq", pa.int64()), ("op", pa.string()), ("target", pa.string()), ("status", pa.string())]))

    node, op = ["act", "id", "parent_id", "ord"], ["act", "seq", "op", "target", "id"]
    words = ["title", "text"]
    together = lambda some, f, schema: dealt(keyed, "id", node + some).groupBy(KEY, SHARE).cogroup(dealt(asked, "target", op + some).groupBy(KEY, SHARE)).applyInArrow(f, schema)
    made = together(words, tree, f"{NODE}, top_ord long, top_id string")
    return made, together([], report, REPORT)


def numbered(made: DataFrame) -> DataFrame:
    """The trees of consolidate() with the places of nodes without a parent counted over their act."""
    made = stored(made, f"{shared_dir(made.sparkSession)}/consolidated-{uuid.uuid4().hex}")
    order = ["top_ord", "top_id", "pos"]
    first = scan.running(scan.ranged(made.filter("top_id is not null"), ["act"], order), order, {"place": F.lit(1).cast("long")})
    first = scan.finished(first).withColumn("pos", F.col("place").cast("int"))
    names = ["act", "id", "parent_id", "pos", "title", "text"]
    return made.filter("top_id is null").select(names).unionByName(first.select(names))


def prune_relations(edge: DataFrame, live: DataFrame) -> DataFrame:
    """Edges whose source is alive, and whose target is or lies outside (ext_...)."""
    ids = live.select("id")
    inside = edge.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    outside = F.col("dst").startswith("ext_")
    return inside.filter(outside).unionByName(inside.filter(~outside).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(inside.columns))
