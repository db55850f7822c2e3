"""Centroid clustering of integer vectors with an n-simplex projection as the filter.

Distances to a few pivots are computed once for each vector and cached. The pivots span a base
simplex; with its distances to them a vector is an apex over that base: coordinates in the span
of the pivots and a height above it. Of two apexes, the distance is a lower bound of the distance
of their vectors, and the distance with one height turned to the other side an upper bound. A
centroid whose lower bound lies above another's upper bound cannot be the nearest; the rest are
compared exactly, in integers.

A round sums its vectors by cluster inside each task; only these sums are shuffled, and the
driver sees clusters x components numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import stored

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Pivots at most. Those that lie too near the span of the others are left out.
PIVOTS, FLAT = 8, 1e-3
#: Components below this are compared in 64-bit integers (64 squares of a difference fit), others in unbounded ones.
PLAIN = 1 << 27
#: Slack of the bounds against the squares of the distances they come from, far above their rounding.
SLACK = 1e-7
LONGEST = (1 << 63) - 1


def whole_components(embedding: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; beyond a long, the end of its range."""
    return F.transform(F.col(embedding), lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(embedding: str = "embedding", dimensions: int = DIMENSIONS) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return (F.size(embedding) == dimensions) & finite


class Simplex:
    """Base simplex of pivots (rows), and apexes over it."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS) -> None:
        points = candidates.astype(np.float64)
        chosen, gap = [0], ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(most, len(points)):
            inside = self._span(points[chosen])[1](points)
            height = np.sqrt(np.maximum(0.0, inside[:, -1]))
            at = int(height.argmax())
            if not np.isfinite(height[at]) or height[at] <= FLAT * np.sqrt(max(gap.max(), 1.0)):
                break
            chosen.append(at)
        self.pivots = points[chosen]
        self.base, _ = self._span(self.pivots)

    @staticmethod
    def _span(pivots: np.ndarray):
        """Lower-triangular coordinates of the pivots behind the first, and a function to the squared
        height of points above their span (last column)."""
        u = pivots[1:] - pivots[0]
        base = np.linalg.cholesky(u @ u.T) if len(u) else np.zeros((0, 0))

        def seen(points):
            v = points - pivots[0]
            y = np.linalg.solve(base, u @ v.T).T if len(u) else np.zeros((len(points), 0))
            return np.c_[y, (v ** 2).sum(1) - (y ** 2).sum(1)]
        return base, seen

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in self.pivots], axis=1)

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates from distances to the pivots; the last is the height."""
        first = distances[:, :1] ** 2
        if not len(self.base):
            return distances[:, :1]
        edge = (self.base ** 2).sum(1)
        y = np.linalg.solve(self.base, ((first + edge - distances[:, 1:] ** 2) / 2).T).T
        return np.c_[y, np.sqrt(np.maximum(0.0, first[:, 0] - (y ** 2).sum(1)))]


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of apexes x (rows) and c (columns)."""
    flat = ((x[:, None, :-1] - c[None, :, :-1]) ** 2).sum(2)
    a, b = x[:, -1:], c[None, :, -1]
    return flat + (a - b) ** 2, flat + (a + b) ** 2


def nearest(v: np.ndarray, distances: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, list[int], int]:
    """Cluster of each vector (ties: the smaller number), its squared distance, and how many exact
    comparisons that took."""
    plain = (np.abs(v) < PLAIN).all(1) & (v != np.iinfo(np.int64).min).all(1)
    x, c = simplex.apexes(distances), simplex.apexes(simplex.distances(centroids))
    low, high = bounds(x, c)
    slack = SLACK * (1.0 + distances.max(1, keepdims=True) ** 2 + simplex.distances(centroids).max(1)[None, :] ** 2)
    near = low - slack <= (high + slack).min(1, keepdims=True)
    # what overflows or rounds away is compared with all
    small = (np.abs(centroids) < PLAIN).all() and not (centroids == np.iinfo(np.int64).min).any()
    near |= ~plain[:, None] | ~np.isfinite(low) | (not small)
    row, at = np.nonzero(near)
    cluster, best = np.zeros(len(v), np.int64), [0] * len(v)
    for some in (plain, ~plain) if small else (np.ones(len(v), bool),):
        here = some[row]
        if not here.any():
            continue
        r, k = row[here], at[here]
        exact = small and some is plain
        d = ((v[r] - centroids[k]) ** 2).sum(1) if exact else ((v[r].astype(object) - centroids[k].astype(object)) ** 2).sum(1)
        order = np.lexsort((k, d, r)) if exact else np.array(sorted(range(len(r)), key=lambda i: (r[i], d[i], k[i])))
        first = order[np.r_[True, r[order][1:] != r[order][:-1]]]
        cluster[r[first]] = k[first]
        for i in first:
            best[r[i]] = int(d[i])
    return cluster, best, len(row)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _cached(simplex: Simplex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = simplex.distances(_matrix(batch.column(1), DIMENSIONS, np.int64))
            flat = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.ravel())
            yield pa.record_batch([batch.column(0), batch.column(1), flat], names=["vec_id", "v", "distances"])
    return run


def _summed(centroids: np.ndarray, simplex: Simplex):
    """Sums of the vectors of each cluster, a set for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.shape, dtype=object)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _matrix(batch.column(1), DIMENSIONS, np.int64)
            cluster, _, _ = nearest(v, _matrix(batch.column(2), len(simplex.pivots), float), centroids, simplex)
            for k in np.unique(cluster):
                part = v[cluster == k]
                fits = np.abs(part.astype(np.float64)).sum(0).max() < 2.0 ** 62
                total[k] += (part if fits else part.astype(object)).sum(0).astype(object)
            count += np.bincount(cluster, minlength=len(centroids))
        k, dim = np.nonzero(np.broadcast_to(count[:, None] > 0, centroids.shape))
        yield pa.record_batch([
            pa.array(k, pa.int32()), pa.array(dim, pa.int32()),
            pa.array([Decimal(int(x)) for x in total[k, dim]], pa.decimal128(38, 0)), pa.array(count[k], pa.int64())],
            names=["cluster", "dim", "total", "n"])
    return run


def _assigned(centroids: np.ndarray, simplex: Simplex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), DIMENSIONS, np.int64)
            cluster, best, _ = nearest(v, _matrix(batch.column(2), len(simplex.pivots), float), centroids, simplex)
            yield pa.record_batch([batch.column(0), pa.array(cluster, pa.int32()),
                                   pa.array([min(d, LONGEST) for d in best], pa.int64())], names=["vec_id", "cluster", "distance"])
    return run


def cluster_vectors(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of
    `embeddings` (vec_id, embedding).

    Kept are vectors of exactly DIMENSIONS components, none null or non-finite; others are absent.
    The first centroids are the kept vectors of smallest sha256('1:' + vec_id); of repeated ids the
    smaller vector goes first, equal rows may become several centroids. Rows without vec_id are
    clustered with a null id but are no first centroid, unless there are fewer vectors than
    clusters, when they come last. Fewer vectors than clusters: a centroid each. No vectors: no
    rows. Ties go to the smaller number; an emptied cluster stays where it is. Components beyond a
    long are held at its ends, and so are distances and their sums; within, all is exact. Other
    columns are not looked at.
    """
    kept = stored(embeddings.where(usable()).select("vec_id", whole_components().alias("v")), "whole")
    starts = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters).collect()
    if not starts:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["v"] for r in starts], dtype=np.int64)
    simplex = Simplex(centroids)
    cached = stored(kept.mapInArrow(_cached(simplex), "vec_id long, v array<long>, distances array<double>"), "pivots")
    for _ in range(rounds):
        sums = (cached.mapInArrow(_summed(centroids, simplex), "cluster int, dim int, total decimal(38,0), n long")
                .groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
        centroids = centroids.copy()
        for r in sums:  # clusters x components
            centroids[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    final = stored(cached.mapInArrow(_assigned(centroids, simplex), "vec_id long, cluster int, distance long"), "assigned")
    inertia = dict(final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    told = [F.struct(F.lit(min(int(inertia.get(k, 0)), LONGEST)).cast("long").alias("inertia"),
                     F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()).alias("sha"))
            for k, c in enumerate(centroids)]
    return final.select("vec_id", "cluster", "distance", F.array(*told)[F.col("cluster")].alias("told")).select(
        "vec_id", "cluster", "distance", F.col("told.inertia").alias("cluster_inertia"),
        F.lit(min(int(sum(inertia.values())), LONGEST)).cast("long").alias("inertia"), F.col("told.sha").alias("centroid_sha256"))
