"""Exact top-k search by dual-tree traversal of cover trees (operator 5).

All vectors are dealt into blocks of bounded size, and the queries come to each block in groups. A block, and a group of queries, becomes a
cover tree: the children of a node lie in its covering radius, further from each other than the next, halved
scale, and one of them has the node's own point; each node keeps the largest distance to a point below it. The two trees are searched together: the inner product of a query below node q and a point below node p
is at most <q,p> + r_q |p| + r_p |q| + r_q r_p, and the pair of nodes is left out if that is below the
worst k-th score in the group of queries. Points that are left are scored exactly.

Defined results: vectors that are null, or have null or non-finite components, or no id, take no part; rows that
repeat an id count one by one, each as a candidate and, where asked, as a query of its own, equal rows too; a query is
compared with vectors of its own length only, and not with rows of its own id; fewer than k candidates are all
returned; ties go to the smaller id. Other columns are left out. Components up to 2**20 or so keep scores exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._frames import read
from docweave.llm._vectors import asked_of, ranked, searched, usable

DATA_BLOCK, QUERY_BLOCK = 8_192, 1_024
LEAF = 24
AT_ONCE = 256
#: Leaves of the query tree that lie below one node and are searched together.
GROUP = 64
#: Points scored at once.
CHUNK = 512


class CoverTree:
    """Flat arrays; node 0 is the root. The points below node x are order[low[x]:high[x]]."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.children: list[list[int]] = []
        self.order: list[np.ndarray] = []
        self._filled, self._squares = 0, np.einsum("ij,ij->i", points, points)
        if len(points):
            # Equal points stay together below the first of them.
            others = np.arange(1, len(points))
            self._grow(0, others, self._distances(np.array([0]), others)[0])
        self.order = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
        self.center, self.radius, self.low, self.high = np.array(self.center, np.int64), np.array(self.radius), np.array(self.low, np.int64), np.array(self.high, np.int64)

    def _distances(self, centers: np.ndarray, others: np.ndarray) -> np.ndarray:
        squares = self._squares[centers][:, None] + self._squares[others] - 2 * (self.points[centers] @ self.points[others].T)
        return np.sqrt(np.maximum(squares, 0))

    def _grow(self, center: int, members: np.ndarray, gaps: np.ndarray) -> int:
        """A node for center with members (without it) at the distances gaps. Depth is the number of halvings, which is small."""
        node = len(self.center)
        self.center.append(center)
        self.radius.append(float(gaps.max(initial=0.0)))
        self.low.append(self._filled)
        self.high.append(0)
        self.children.append([])
        if len(members) <= LEAF or self.radius[node] == 0:
            self.order.append(np.concatenate(([center], members)))
            self._filled += len(members) + 1
        else:
            scale = self.radius[node] / 2
            near = gaps <= scale
            self.children[node].append(self._grow(center, members[near], gaps[near]))
            left = members[~near]
            while len(left):
                # The next centres are chosen one by one among the first that are left; only their distances are made together.
                heads, free = left[:AT_ONCE], np.ones(len(left), bool)
                gaps = self._distances(heads, left)
                for h, other in enumerate(heads.tolist()):
                    if free[h]:
                        free[h] = False
                        near = free & (gaps[h] <= scale)
                        free[near] = False
                        self.children[node].append(self._grow(other, left[near], gaps[h][near]))
                left = left[free]
        self.high[node] = self._filled
        return node


class Index:
    """A cover tree with the ids and lengths of its points."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.tree = ids, CoverTree(np.asarray(vectors, np.float64))
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.tree.points, self.tree.points))


class _Best:
    def __init__(self, n: int, k: int):
        self.k, self.worst = k, np.full(n, -np.inf)
        self.scores: list[np.ndarray] = [np.empty(0)] * n
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[query], scores)), np.concatenate((self.ids[query], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.worst[query] = scores[order[-1]]


def search(data: Index, q_ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of data for each query: places of the queries, row ids, scores."""
    asked = Index(q_ids, vectors)
    q_tree, q_norm = asked.tree, asked.norm
    ids, tree, norm = data.ids, data.tree, data.norm
    best = _Best(len(q_ids), k)

    inner = np.array([len(c) > 0 for c in tree.children], bool)

    def bounds(nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Of each pair of a query node and a data node."""
        q, r = q_tree.center[nodes], q_tree.radius[nodes][:, None]
        c, s = tree.center[others], tree.radius[others]
        top = q_tree.points[q] @ tree.points[c].T + r * norm[c] + s * q_norm[q][:, None] + r * s
        return top + 1e-9 * np.abs(top) + 1e-6  # distances are rounded

    def worst(nodes: np.ndarray) -> np.ndarray:
        return np.array([best.worst[q_tree.order[q_tree.low[x] : q_tree.high[x]]].min() for x in nodes])

    def opened(nodes: np.ndarray, others: np.ndarray, until: float) -> np.ndarray:
        """The data nodes that some query node needs, with those of radius until or more replaced by their children."""
        while True:
            others = others[(bounds(nodes, others) >= worst(nodes)[:, None]).any(axis=0)]
            wide = inner[others] & (tree.radius[others] >= until)
            if not wide.any():
                return others
            others = np.concatenate([others[~wide], *[tree.children[o] for o in others[wide]]]).astype(np.int64)

    def visit(node: int, others: np.ndarray) -> None:
        kids = np.array(q_tree.children[node] or [node], np.int64)
        others = opened(np.array([node]), others, q_tree.radius[node] if q_tree.children[node] else 0.0)
        leaves = np.array([not q_tree.children[x] for x in kids])
        for a in range(0, int(leaves.sum()), GROUP):
            scan(kids[leaves][a : a + GROUP], others)
        for x in kids[~leaves].tolist():
            visit(x, others)

    def scan(nodes: np.ndarray, others: np.ndarray) -> None:
        """Scores what the leaves need, the most promising data nodes first."""
        others = opened(nodes, others, 0.0)
        if not len(others):
            return
        tops = bounds(nodes, others)
        order = np.argsort(-tops.max(axis=0), kind="stable")
        others, tops = others[order], tops[:, order]
        group = np.concatenate([q_tree.order[q_tree.low[x] : q_tree.high[x]] for x in nodes])
        sizes, a = np.cumsum(tree.high[others] - tree.low[others]), 0
        while a < len(others):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
            needed = (tops[:, a:b] >= worst(nodes)[:, None]).any(axis=0)
            if needed.any():
                chosen = np.concatenate([tree.order[tree.low[o] : tree.high[o]] for o in others[a:b][needed]])
                scores = q_tree.points[group] @ tree.points[chosen].T
                hits = (scores >= best.worst[group][:, None]) & (ids[chosen] != q_ids[group][:, None])
                for row in np.flatnonzero(hits.any(axis=1)):
                    hit = np.flatnonzero(hits[row])
                    best.offer(group[row], scores[row, hit], ids[chosen[hit]])
            a = b

    if len(q_ids) and len(ids):
        visit(0, np.zeros(1, np.int64))
    counts = [len(x) for x in best.ids]
    return np.repeat(np.arange(len(q_ids)), counts), np.concatenate(best.ids), np.concatenate(best.scores).astype(np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row of rows (vec_id, embedding) that is_query holds for, its k largest inner products of floor(scale * component) with all other rows."""
    whole = usable(rows).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")))
    found = searched(whole, asked_of(whole.filter(is_query)), data_block, query_block, k, Index, lambda index, ids, vectors: search(index, ids, vectors, k), T.LongType())
    return ranked(found, k)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT *, row_number() OVER () AS n FROM v WHERE vec_id % 50 = 0),
scored AS (SELECT q.n, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
           FROM q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
