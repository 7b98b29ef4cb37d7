"""Ball k-means: exact Lloyd rounds in which members are compared only with the centroids near their ball.

A cluster is a ball around its centroid. Only centroids within twice its radius can take members
from it (its neighbours). A member nearer to its own centroid than half the way to the nearest
neighbour is in the stable core and is compared with none; the others lie in annuli between the half
ways to one neighbour and the next, and are compared exactly with the neighbours up to theirs. All
arithmetic is on whole numbers, so a pass gives what a comparison with every centroid would give.

Each pass is one map over a table of members that Spark has written, with their last cluster; the
centroids, their mutual distances and the balls' radii (k x dims, k x k) go with the task. Sums by
cluster are added up within partitions and then by cluster and component, so the driver sees
k x dims sums for each round, whatever the input.

Vectors that are null, have another number of components, or hold a null or a number that is not
finite are left out. Components are floor(scale * x), held within +-`bound(dims)` (2^26 for 64
components, |x| up to 1,048,576), so that four times a squared distance fits a long. A null vec_id
is kept and hashed as no text; rows that repeat a vec_id are vectors of their own, and where hashes
tie the vector with the smaller components comes first. Fewer vectors than k give fewer clusters, an
empty table an empty result. Columns other than the two that are named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lists, map_arrow, written

#: The most centroids: their mutual distances are held by every task.
MOST_CLUSTERS = 4096


def bound(dims: int) -> int:
    """The power of two within which components are held."""
    return 1 << (isqrt((1 << 63) // (16 * dims)).bit_length() - 1)


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def whole_numbers(x: np.ndarray, scale: int, dims: int) -> np.ndarray:
    most = bound(dims)
    return np.clip(np.floor(x.astype(np.float64) * scale), -most, most).astype(np.int64)


@dataclass(frozen=True)
class Balls:
    centroids: np.ndarray  # k x dims
    between: np.ndarray  # k x k, squared distances
    neighbours: tuple[np.ndarray, ...]  # of each: those within reach, the nearest first

    @staticmethod
    def around(centroids: np.ndarray, radii: list[int] | None = None) -> Balls:
        """radii: no member is farther from its centroid than that; all are neighbours without them."""
        between = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
        near = []
        for i, row in enumerate(between):
            order = np.argsort(row, kind="stable")
            order = order[order != i]
            near.append(order if radii is None else order[row[order] <= min(4 * radii[i] ** 2, (1 << 63) - 1)])
        return Balls(centroids, between, tuple(near))

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and its squared distance, where nothing is known; the smaller number of equals."""
        best, distance = np.zeros(len(v), np.int32), ((v - self.centroids[0]) ** 2).sum(1)
        for j in range(1, len(self.centroids)):
            d = ((v - self.centroids[j]) ** 2).sum(1)
            nearer = d < distance
            best[nearer], distance[nearer] = j, d[nearer]
        return best, distance

    def again(self, v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for members of the balls `own`: the core stays, annuli are compared with their neighbours."""
        best, distance = own.copy(), ((v - self.centroids[own]) ** 2).sum(1)
        for i in np.unique(own):
            rows = np.flatnonzero(own == i)
            reach = 4 * distance[rows]
            for j in self.neighbours[i]:
                outside = reach >= self.between[i, j]
                if not outside.any():
                    break  # the others are farther still
                rows, reach = rows[outside], reach[outside]
                d = ((v[rows] - self.centroids[j]) ** 2).sum(1)
                nearer = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
                best[rows[nearer]], distance[rows[nearer]] = j, d[nearer]
        return best, distance


_STATE = "vec_id {}, vector array<int>, cluster int, distance long"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def starting(vectors: DataFrame, k: int, dims: int, scale: int, seed: str) -> np.ndarray:
    """The k usable vectors with the smallest sha256 of seed:vec_id, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(hashed, "vector").limit(k).select("vector").collect()
    return whole_numbers(np.array([r[0] for r in rows], np.float64).reshape(-1, dims), scale, dims)


def _assigned(state: DataFrame, balls: Balls, kind: str, dims: int, scale: int | None = None) -> DataFrame:
    """state with clusters and distances to the balls' centroids; with scale, of raw vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x = _matrix(b.column("vector"), dims)
            if scale is None:
                v = x.astype(np.int64)
                cluster, distance = balls.again(v, b.column("cluster").to_numpy().astype(np.int32))
            else:
                v = whole_numbers(x, scale, dims)
                cluster, distance = balls.first(v)
            yield {"vec_id": b.column("vec_id"), "vector": lists(v.ravel().astype(np.int32), [dims] * len(v), pa.int32()), "cluster": cluster, "distance": distance}

    return written(map_arrow(state, run, _STATE.format(kind)))


def _sums(state: DataFrame, k: int, dims: int) -> list[tuple]:
    """cluster, place, sum of the components, members, greatest squared distance: k x dims rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums, n, far = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            v, cluster = _matrix(b.column("vector"), dims).astype(np.int64), b.column("cluster").to_numpy()
            distance = b.column("distance").to_numpy()
            for i in np.unique(cluster):
                mine = cluster == i
                sums[i] += v[mine].sum(0)
                n[i] += mine.sum()
                far[i] = max(far[i], distance[mine].max())
        some = np.flatnonzero(n)
        yield {"cluster": some.astype(np.int32), "n": n[some], "far": far[some], "sums": lists(sums[some].ravel(), [dims] * len(some), pa.int64())}

    partial = map_arrow(state.select("vector", "cluster", "distance"), run, "cluster int, n long, far long, sums array<long>")
    each = partial.select("cluster", "n", "far", F.posexplode("sums").alias("place", "x"))
    return [tuple(r) for r in each.groupBy("cluster", "place").agg(F.sum("x"), F.sum("n"), F.max("far")).collect()]


def _moved(balls: Balls, sums: list[tuple]) -> Balls:
    """New centroids (floor of the mean; an empty one stays), with radii that hold after the move."""
    centroids, radii = balls.centroids.copy(), [0] * len(balls.centroids)
    for cluster, place, x, n, _ in sums:
        centroids[cluster, place] = x // n
    for cluster, far in {(c, f) for c, _, _, _, f in sums}:
        shift = int(((centroids[cluster] - balls.centroids[cluster]) ** 2).sum())
        radii[cluster] = isqrt(far) + 1 + isqrt(shift) + 1
    return Balls.around(centroids, radii)


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, *, dims: int = 64, scale: int = 64, seed: str = "1", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector, cluster, distance for every usable vector; the centroids): so many rounds of assigning and moving, and a last assignment."""
    if not 1 <= k <= MOST_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MOST_CLUSTERS}")
    raw = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("vector")).where(usable(F.col("vector"), dims))
    kind = raw.schema["vec_id"].dataType.simpleString()
    centroids = starting(raw, k, dims, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _STATE.format(kind)), centroids
    balls = Balls.around(centroids)
    state = _assigned(raw, balls, kind, dims, scale)
    for _ in range(rounds):
        balls = _moved(balls, _sums(state, len(centroids), dims))
        state = _assigned(state, balls, kind, dims)
    return state, balls.centroids


def with_inertia(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256; a sum beyond a long counts as the greatest long."""
    spark, most = state.sparkSession, (1 << 63) - 1
    by_cluster = {r[0]: int(r[1]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows at most
    total = min(sum(by_cluster.values()), most)
    rows = [(i, min(by_cluster[i], most), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i in sorted(by_cluster)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
