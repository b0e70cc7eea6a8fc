"""Hard-negative mining over k-means inverted lists (operator 12).

Vectors go into inverted lists by their nearest centroid and their label; a centroid is stored with its radius, the
largest distance of a row of it. By Cauchy and Schwarz no row of a list scores over <q,c> + |q| r, or under
<q,c> - |q| r, for the anchor q. An anchor visits lists by that upper bound, skips those outside its window of
scores, and stops when the next bound falls strictly below its k-th score, so that ties are still met.

Lists lie on shelves of about SHELF rows, near centroids together; a longer group of lists takes several shelves. An anchor is first sent to
the shelves of its best centroid, and then, with the k-th score that it has found there, to those other shelves that hold
a list which it still needs; shelves answer for themselves, and answers are merged by rank. This is done twice: for the
positives (own label, no window), and for the negatives (other labels, a window for each positive).

Centroids come from a sample of at most SAMPLE rows by a hash; every row is in a list, and results are exact
whatever the centroids are. They are at most CENTROIDS, and CENTROID_BYTES in all for a length of vectors, which bounds what is broadcast.

Defined results: rows without an id or label, without a vector, or with a null or non-finite component take no part;
vectors meet those of their own length only, and lengths that the sample doesn't hold have one list, always visited; an anchor's own
id is no candidate; rows that repeat an id count one by one, as candidates and as anchors; ties go to the smaller id;
fewer rows than asked for are all returned. Other columns are left out. Components up to 2**20 or so keep scores exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.llm._frames import materialise, read, release

SAMPLE, CENTROIDS, CENTROID_BYTES = 16_384, 1_024, 8 << 20
SHELF = 8_192
ROUNDS = 8
#: Rows that an anchor scores at least before it looks at its bounds again.
STEP = 256
POSITIVES, NEGATIVES = 5, 3
#: Of a positive's score, in hundredths: a negative scores from LOW to HIGH of it.
LOW, HIGH = 50, 95
ANY = 1 << 62
ASK = ["vec_id", "label", "key"]
NONE = -1


def means(points: np.ndarray, k: int) -> np.ndarray:
    """k centroids of points, or one for each different point if those are fewer."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centers = points[np.random.default_rng(k).choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(points, centers)[0]
        sums, sizes = np.zeros_like(centers), np.bincount(own, minlength=k)
        np.add.at(sums, own, points)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each point's nearest centre, and the distance."""
    place, gap = np.empty(len(points), np.int64), np.empty(len(points))
    for a in range(0, len(points), 1_024):
        some = points[a : a + 1_024]
        squares = np.einsum("ij,ij->i", centers, centers) - 2 * (some @ centers.T)
        place[a : a + 1_024] = best = squares.argmin(axis=1)
        gap[a : a + 1_024] = np.sqrt(((some - centers[best]) ** 2).sum(axis=1))
    return place, gap


def _matrix(batch: pa.RecordBatch, dim: int, at: np.ndarray) -> np.ndarray:
    """The vectors of the rows at, all of length dim."""
    return batch.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _bounds(mid: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and smallest score possible; distances are rounded."""
    slack = slack + 1e-9 * np.abs(mid) + 1e-6
    return mid + slack, mid - slack


def _needed(top: np.ndarray, low: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether some window (from, to, k-th score so far) wants each list: inside it, and not strictly below that score."""
    return ((100 * top >= windows[:, :1]) & (100 * low <= windows[:, 1:2]) & (top >= windows[:, 2:3])).any(axis=0)


class Lists:
    """The inverted lists of one shelf. The rows of list x are those from begin[x] to begin[x + 1]."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, clusters: np.ndarray, points: np.ndarray):
        order = np.lexsort((ids, clusters, labels))
        self.ids, labels, clusters, self.points = ids[order], labels[order], clusters[order], points[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(labels) != 0) | (np.diff(clusters) != 0))))
        self.begin, self.labels = np.append(new, len(ids)), labels[new]
        sizes = np.diff(self.begin)
        self.centers = np.add.reduceat(self.points, new, axis=0) / sizes[:, None]
        gaps = np.sqrt(((self.points - np.repeat(self.centers, sizes, axis=0)) ** 2).sum(axis=1))
        self.radius = np.maximum.reduceat(gaps, new)

    def search(self, own: int, label: int, vector: np.ndarray, windows: np.ndarray, k: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window its place, and the ids and scores of its k best."""
        lists = np.flatnonzero((self.labels == label) == same)
        top, low = _bounds(self.centers[lists] @ vector, math.sqrt(vector @ vector) * self.radius[lists])
        order = np.argsort(-top, kind="stable")
        lists, top, low = lists[order], top[order], low[order]
        windows = windows.copy()
        ids, scores = [np.empty(0, np.int64)] * len(windows), [np.empty(0, np.int64)] * len(windows)
        passed = np.cumsum(self.begin[lists + 1] - self.begin[lists])
        a = 0
        while a < len(lists) and top[a] >= windows[:, 2].min():
            b = max(a + 1, int(np.searchsorted(passed, (passed[a - 1] if a else 0) + STEP)))
            chosen = lists[a:b][_needed(top[a:b], low[a:b], windows)]
            a = b
            if not len(chosen):
                continue
            rows = np.concatenate([np.arange(self.begin[x], self.begin[x + 1]) for x in chosen])
            found = np.rint(self.points[rows] @ vector).astype(np.int64)
            for w, (least, most, worst) in enumerate(windows):
                hit = (100 * found >= least) & (100 * found <= most) & (found >= worst) & (self.ids[rows] != own)
                if hit.any():
                    s, i = np.concatenate((scores[w], found[hit])), np.concatenate((ids[w], self.ids[rows[hit]]))
                    best = np.lexsort((i, -s))[:k]
                    scores[w], ids[w] = s[best], i[best]
                    if len(best) == k:
                        windows[w, 2] = max(worst, s[best[-1]])
        return ((w, i, s) for w, (i, s) in enumerate(zip(ids, scores)))


class Index:
    """All rows in inverted lists on shelves: a table (dim, cluster, shelf, slice, vec_id, label, embedding), and the centroids with radii."""

    def __init__(self, rows: DataFrame, shelf: int = SHELF):
        """rows: vec_id, label, dim, embedding of whole numbers as doubles."""
        self.spark, self.shelf = rows.sparkSession, shelf
        n = rows.count()
        centers = self._centers(rows, n)
        held = materialise(self._assigned(rows, centers))
        known = held.filter(F.col("cluster") != NONE)
        found = {(r.dim, r.cluster): (r.n, r.radius) for r in known.groupBy("dim", "cluster").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
        self.plan, groups = {}, []
        for dim, c in centers.items():
            sizes = np.array([found.get((dim, k), (0, 0.0))[0] for k in range(len(c))])
            radius = np.array([found.get((dim, k), (0, 0.0))[1] for k in range(len(c))])
            group = nearest(c, means(c, max(1, int(sizes.sum() // shelf))))[0]
            slices = np.array([max(1, -(-int(x) // shelf)) for x in np.bincount(group, weights=sizes)])
            self.plan[dim] = (c, radius, group, slices)
            groups += [(dim, k, int(g), int(slices[g])) for k, g in enumerate(group)]
        self.others = max(1, -(-n // shelf))  # slices of a length without centroids
        self.shelves = sum(int(p[3].sum()) for p in self.plan.values()) + 1
        table = self.spark.createDataFrame(groups, "dim int, cluster int, shelf int, slices int")  # CENTROIDS rows a length at most
        placed = held.join(F.broadcast(table), ["dim", "cluster"], "left").withColumn("shelf", F.coalesce("shelf", F.lit(NONE)))
        each = F.xxhash64("vec_id", F.monotonically_increasing_id())  # held is stored, so its order is too
        self.rows = placed.withColumn("slice", F.pmod(each, F.coalesce("slices", F.lit(self.others))).cast("int")).drop("gap", "slices")
        self.sent = self.spark.sparkContext.broadcast(self.plan)

    @staticmethod
    def _centers(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
        share = min(1.0, SAMPLE / max(1, n))
        drawn = rows.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE)
        most = F.greatest(F.lit(1), F.lit(CENTROID_BYTES) / F.greatest(F.lit(1), 8 * F.col("dim")))  # rows of long vectors are bounded by their bytes too
        drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id")))).filter(F.col("k") <= most)
        by: dict[int, list] = {}
        for r in drawn.select("dim", "embedding").toLocalIterator():
            by.setdefault(r.dim, []).append(r.embedding)
        sampled = sum(map(len, by.values()))
        return {dim: means(np.array(some, np.float64), min(CENTROIDS, max(1, int(math.sqrt(n * len(some) / sampled))))) for dim, some in by.items() if dim}

    @staticmethod
    def _assigned(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(centers)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, gap = np.full(batch.num_rows, NONE, np.int32), np.zeros(batch.num_rows)
                for dim, at in _by_dim(batch):
                    if dim in sent.value:
                        cluster[at], gap[at] = nearest(_matrix(batch, dim, at), sent.value[dim])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(gap)], names=[*batch.schema.names, "cluster", "gap"])
            release()

        return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("gap", T.DoubleType())]))

    def _routed(self, asks: DataFrame, first: bool) -> DataFrame:
        """Each ask for each shelf that it is sent to: those of its best centroid, or the others that it still needs."""
        sent, others = self.sent, self.others

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, shelves, slices = [], [], []
                windows = batch.column("windows").to_pylist()
                for dim, at in _by_dim(batch):
                    if dim not in sent.value:
                        if first:
                            rows += at.tolist()
                            shelves += [NONE] * len(at)
                            slices += [others] * len(at)
                        continue
                    c, radius, group, many = sent.value[dim]
                    vectors = _matrix(batch, dim, at)
                    top, low = _bounds(vectors @ c.T, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None] * radius)
                    for row, up, down in zip(at.tolist(), top, low):
                        best = group[up.argmax()]
                        wanted = {best} if first else set(group[_needed(up, down, _windows(windows[row]))].tolist()) - {best}
                        rows += [row] * len(wanted)
                        shelves += wanted
                        slices += [int(many[g]) for g in wanted]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(shelves, pa.int32()), pa.array(slices, pa.int32())], names=[*batch.schema.names, "shelf", "slices"])
            release()

        routed = asks.mapInArrow(route, T.StructType([*asks.schema.fields, T.StructField("shelf", T.IntegerType()), T.StructField("slices", T.IntegerType())]))
        return routed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def answers(self, asks: DataFrame, first: bool, k: int, same: bool) -> DataFrame:
        """asks: vec_id, label, key, dim, embedding, windows. Gives vec_id, label, key, place of the window, found_id, score: k for each shelf at most."""
        place = ["dim", "shelf", "slice"]
        common = [*place, "kind", "vec_id", "label", "key", "cluster", "embedding", "windows"]
        asked = self._routed(asks, first).withColumns({"kind": F.lit(1), "cluster": F.lit(NONE)}).select(common)
        lists = self.rows.withColumns({"kind": F.lit(0), "key": F.lit(0).cast("long"), "windows": F.lit(None).cast(asks.schema["windows"].dataType)}).select(common)
        rows = lists.unionByName(asked).repartition(2 * self.shelves, *place).sortWithinPartitions(*place, "kind")
        out = "vec_id long, label long, key long, place int, found_id long, score long"
        names = ["vec_id", "label", "key", "place", "found_id", "score"]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, lists = None, [], None
            for batch in batches:
                at = np.stack([batch.column(c).to_numpy() for c in (*place, "kind")], axis=1)
                turns = np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1
                for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(at)]):
                    if a == b:
                        continue
                    if tuple(at[a, :3]) != now:
                        now, held, lists = tuple(at[a, :3]), [], None
                    part = batch.slice(a, b - a)
                    ids, labels, keys = (part.column(c).to_numpy() for c in ("vec_id", "label", "key"))
                    vectors = _matrix(part, int(at[a, 0]), np.arange(b - a))
                    if at[a, 3] == 0:
                        held.append((ids, labels, part.column("cluster").to_numpy(), vectors))
                        continue
                    if not held and lists is None:
                        continue  # a shelf without rows
                    if lists is None:
                        lists, held = Lists(*map(np.concatenate, zip(*held))), []
                    got: list[list[np.ndarray]] = []
                    for row, windows in enumerate(part.column("windows").to_pylist()):
                        for w, found, scores in lists.search(ids[row], labels[row], vectors[row], _windows(windows), k, same):
                            got.append([np.full(len(found), x) for x in (ids[row], labels[row], keys[row])] + [np.full(len(found), windows[w]["place"], np.int32), found, scores])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], names=names)
            now = held = lists = None
            release()

        return rows.mapInArrow(work, out)

    def best(self, asks: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """asks: vec_id, label, key, dim, embedding; windows: vec_id, label, key, place, least, most. The k best of each window: place, rank, found_id, score."""
        order = Window.partitionBy(*ASK, "place").orderBy(F.desc("score"), F.asc("found_id"))
        cut = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        together = lambda w: asks.join(w.groupBy(ASK).agg(F.sort_array(F.collect_list(F.struct("place", "least", "most", "worst"))).alias("windows")), ASK)
        first = materialise(cut(self.answers(together(windows.withColumn("worst", F.lit(-ANY).cast("long"))), True, k, same)))
        reached = first.filter(F.col("rank") == k).select(*ASK, "place", F.col("score").alias("worst"))
        rest = windows.join(reached, [*ASK, "place"], "left").withColumn("worst", F.coalesce("worst", F.lit(-ANY).cast("long")))
        return cut(first.drop("rank").unionByName(self.answers(together(rest), False, k, same)))


def _windows(some: list[dict]) -> np.ndarray:
    return np.array([(w["least"], w["most"], w["worst"]) for w in some], np.int64)


def mine(rows: DataFrame, is_anchor: Column, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shelf: int = SHELF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, embedding) that is_anchor holds for."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter("vec_id is not null and label is not null and embedding is not null")
    whole = whole.filter(~F.coalesce(bad, F.lit(True))).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))).withColumn("dim", F.size("embedding"))
    index = Index(whole, shelf)
    asks = whole.filter(is_anchor).groupBy("vec_id", "label", "dim", "embedding").agg(F.count("*").alias("times")).withColumn("key", F.xxhash64("embedding"))
    asks = materialise(asks)
    no = F.lit(ANY).cast("long")
    found = index.best(asks.drop("times"), asks.select(*ASK, F.lit(0).alias("place"), (-no).alias("least"), no.alias("most")), positives, True)
    found = materialise(found.select(*ASK, F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = found.select(*ASK, "place", (low * F.col("positive_score")).alias("least"), (high * F.col("positive_score")).alias("most"))
    worse = index.best(asks.drop("times"), windows, negatives, False)
    pairs = found.join(asks.select(*ASK, "times"), ASK).join(worse, [*ASK, "place"]).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return pairs.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.n, a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, d.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
           FROM v a JOIN v d ON a.vec_id <> d.vec_id AND len(a.e) = len(d.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.n, p.place ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN scored s ON p.n = s.n AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) WHERE rank <= 3
"""
