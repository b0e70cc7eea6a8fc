"""Approximate nearest neighbours by hierarchical navigable small-world graphs (operator 9).

Rows are dealt into shards of bounded size by a hash, and every row is in the graph of its shard. A
vector gets a top layer from a hash of its id; in each layer it is linked to near vectors that are not nearer to
one of its other links than to itself, and back. The layers are flat arrays of neighbours. A query descends
greedily to layer 0 and keeps a beam of EF there; many queries go through a shard together. Results of the shards
are merged by their exact inner products.

Graphs are for the largest inner product: each vector gets one component more, which lifts all vectors of a shard
to the same length, so that nearness in the graph is the order of inner products. Of equal vectors one is a
vertex, which stands for the smallest ids that can be asked for.

Defined results: vectors that are null, zero, or have null or non-finite components, or no id, take no part; rows
that repeat an id count one by one, each as a candidate and, where asked, as a query of its own, equal rows too; a
query is compared with vectors of its own length and not with rows of its own id; with fewer candidates than k all
that are found; ties go to the smaller id. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._frames import read
from docweave.llm._vectors import asked_of, ranked, searched, usable

SHARD, QUERY_BLOCK = 8_192, 512
K = 20
LINKS, BASE_LINKS = 16, 32
#: Nearest vectors among which links are chosen.
NEAR = 48
EF = 96
#: Beam members expanded in one step.
EXPAND = 4


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _nearest(points: np.ndarray, k: int) -> np.ndarray:
    """Each point's k nearest others, nearest first. All points have one length, so these are the largest products."""
    out = np.empty((len(points), k), np.int32)
    for a in range(0, len(points), 512):
        products = points[a : a + 512] @ points.T
        products[np.arange(len(products)), np.arange(a, a + len(products))] = -np.inf
        top = np.argpartition(-products, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(products, top, axis=1), axis=1, kind="stable")
        out[a : a + 512] = np.take_along_axis(top, order, axis=1)
    return out


def _diverse(points: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row of near up to most links, none nearer to a link before it than to the row's point; the rest is filled up with the nearest to half."""
    n, k = near.shape
    out = np.zeros((n, k), bool)
    for a in range(0, n, 256):
        part = near[a : a + 256]
        vectors = points[part]
        own = np.einsum("ijk,ik->ij", vectors, points[a : a + 256])
        between = vectors @ vectors.transpose(0, 2, 1)
        kept = np.zeros(part.shape, bool)
        for j in range(k):
            shadowed = (kept & (between[:, j, :] > own[:, j, None])).any(axis=1)
            kept[:, j] = ~shadowed & (kept.sum(axis=1) < most)
        for j in range(min(k, most // 2)):
            kept[:, j] |= kept.sum(axis=1) < most // 2
        out[a : a + 256] = kept
    return out


def _layer(points: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array of a layer: up to most links of each vertex, -1 where there are fewer."""
    n = len(points)
    near = _nearest(points, min(NEAR, n - 1))
    chosen = _diverse(points, near, most // 2)
    a, j = np.nonzero(chosen)
    b = near[a, j].astype(np.int64)
    links = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
    # A vertex of too many links keeps half as the rule above, and the nearest of those back to it.
    strength = np.einsum("ij,ij->i", points[links[:, 0]], points[links[:, 1]])
    order = np.lexsort((-strength, links[:, 0]))
    links = links[order]
    place = np.arange(len(links)) - np.searchsorted(links[:, 0], links[:, 0])
    own = np.zeros(len(links), bool)
    keys, mine = links[:, 0] * n + links[:, 1], np.sort(a.astype(np.int64) * n + b)
    at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
    own = mine[at] == keys
    rank = np.lexsort((place, ~own, links[:, 0]))
    links = links[rank]
    place = np.arange(len(links)) - np.searchsorted(links[:, 0], links[:, 0])
    links, place = links[place < most], place[place < most]
    out = np.full((n, most + 2), -1, np.int32)
    out[links[:, 0], place] = links[:, 1]
    return _joined(points, out)


def _joined(points: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Adds two links for each part that the first vertex does not reach, so that all can be reached."""
    n, spare = len(points), links.shape[1] - 2
    reached, front = np.zeros(n, bool), np.array([0])
    while True:
        reached[front] = True
        while len(front):
            following = np.unique(links[front])
            following = following[following >= 0]
            front = following[~reached[following]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return links
        inside = np.flatnonzero(reached)
        free = inside[links[inside, spare + 1] < 0]
        x = lost[0]
        y = free[int(np.argmax(points[free] @ points[x]))] if len(free) else inside[0]
        links[y, spare if links[y, spare] < 0 else spare + 1] = x
        if links[x, spare] < 0:
            links[x, spare] = y
        front = np.array([x])


class Graph:
    """vectors: the vertices. ids[first[v]:first[v + 1]]: the rows of vertex v, smallest first. layers: vertices, neighbour array."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
        vertex = np.cumsum(new) - 1
        # A query gets at most k rows of a vertex, and those of its own id are none of them.
        start = np.flatnonzero(np.concatenate(([True], new[1:] | (ids[1:] != ids[:-1]))))
        keep = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids)))) < k
        ids, vertex = ids[keep], vertex[keep]
        place = np.arange(len(ids)) - np.searchsorted(vertex, vertex)
        keep = place < 2 * k
        self.ids, vertex = ids[keep], vertex[keep]
        self.vectors = vectors[new]
        n = len(self.vectors)
        self.first = np.searchsorted(vertex, np.arange(n + 1))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        if n > 1:
            length = np.einsum("ij,ij->i", self.vectors, self.vectors)
            lifted = np.hstack([self.vectors, np.sqrt(np.maximum(length.max() - length, 0))[:, None]]) / np.sqrt(length.max())
            lifted = lifted.astype(np.float32)
            u = (_mixed(self.ids[self.first[:-1]]) >> np.uint64(11)).astype(np.float64) / 2**53
            level = np.floor(-np.log(np.maximum(u, 1e-15)) / np.log(LINKS)).astype(int)
            for depth in range(int(level.max()) + 1):
                members = np.flatnonzero(level >= depth)
                if depth and len(members) < 8:
                    break
                self.layers.append((members, _layer(lifted[members], BASE_LINKS if depth == 0 else LINKS)))

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Vertices and inner products, best first; -1 where there are fewer."""
        if not self.layers:  # one vertex
            return np.zeros((len(queries), 1), np.int64), queries @ self.vectors.T
        points = self.vectors.astype(np.float32)
        asked = queries.astype(np.float32)
        members, _ = self.layers[-1]
        now = np.full(len(queries), members[0])
        for members, links in self.layers[:0:-1]:
            local = np.searchsorted(members, now)
            score = np.einsum("ij,ij->i", points[members[local]], asked)
            while True:
                near = links[local]
                scores = np.where(near >= 0, np.einsum("ijk,ik->ij", points[members[near]], asked), -np.inf)
                best = scores.argmax(axis=1)
                top = scores[np.arange(len(near)), best]
                better = top > score
                if not better.any():
                    break
                local = np.where(better, near[np.arange(len(near)), best], local)
                score = np.maximum(score, top)
            now = members[local]
        return self._beam(points, asked, queries, now, k, ef)

    def _beam(self, points, asked, queries, now, k, ef):
        links, rows = self.layers[0][1], np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(points) + 1), bool)
        seen[:, -1] = True
        beam = np.full((len(queries), ef), -1, np.int64)
        score = np.full((len(queries), ef), -np.inf, np.float32)
        done = np.ones((len(queries), ef), bool)
        beam[:, 0], score[:, 0], done[:, 0] = now, np.einsum("ij,ij->i", points[now], asked), False
        seen[rows[:, 0], now] = True
        live = np.arange(len(queries))
        while len(live):
            open_ = np.where(done[live], -np.inf, score[live])
            pick = np.argpartition(-open_, EXPAND - 1, axis=1)[:, :EXPAND]
            usable_ = np.take_along_axis(open_, pick, axis=1) > -np.inf
            at = live[:, None]
            done[at, pick] = True
            near = np.where(usable_[:, :, None], links[beam[at, pick]], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[at, near]] = -1
            seen[at, near] = True
            scores = np.where(near >= 0, np.einsum("ijk,ik->ij", points[near], asked[live]), -np.inf)
            all_scores = np.hstack([score[live], scores.astype(np.float32)])
            top = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
            score[live] = np.take_along_axis(all_scores, top, axis=1)
            beam[live] = np.take_along_axis(np.hstack([beam[live], near]), top, axis=1)
            done[live] = np.take_along_axis(np.hstack([done[live], near < 0]), top, axis=1)
            live = live[~done[live].all(axis=1)]
        exact = np.where(beam >= 0, np.einsum("ijk,ik->ij", self.vectors[beam], queries), -np.inf)
        order = np.argsort(-exact, axis=1, kind="stable")[:, : max(k, 1)]
        beam, exact = np.take_along_axis(beam, order, axis=1), np.take_along_axis(exact, order, axis=1)
        return beam, exact


def search(graph: Graph, q_ids: np.ndarray, q_vectors: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k rows of a shard for each query: places of the queries, row ids, inner products."""
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(q_ids), 256):
        vertices, _ = graph.search(q_vectors[a : a + 256], k + 1, ef)
        for place, (query, vector, found) in enumerate(zip(q_ids[a : a + 256], q_vectors[a : a + 256], vertices), a):
            found = found[found >= 0]
            ids = np.concatenate([graph.ids[graph.first[v] : graph.first[v + 1]] for v in found])
            products = np.repeat(graph.vectors[found] @ vector, graph.first[found + 1] - graph.first[found])
            other = ids != query
            ids, products = ids[other], products[other]
            order = np.lexsort((ids, -products))[:k]
            out_q.append(np.full(len(order), place))
            out_v.append(ids[order])
            out_s.append(products[order])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(rows: DataFrame, is_query: Column, k: int = K, ef: int = EF, shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row of rows (vec_id, embedding) that is_query holds for, k rows of large inner product with it."""
    whole = usable(rows, zero=False)
    build = lambda ids, vectors: Graph(ids, np.asarray(vectors, np.float64), k)
    found = searched(whole, asked_of(whole.filter(is_query)), shard, query_block, k, build, lambda graph, ids, vectors: search(graph, ids, np.asarray(vectors, np.float64), k, ef), T.DoubleType())
    return ranked(found, k)


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
