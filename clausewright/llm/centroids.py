"""Centroid clustering with exact integer arithmetic; the nearest centroid is found by the threshold algorithm.

Each dimension has a list of the centroids sorted by their value in it. From a vector's own value the lists are walked outward, one
step in each a round; centroids met for the first time get their exact distance. The squared distances of the lists' frontiers sum to
a bound that no centroid not yet met can be below, so the walk ends when that sum is strictly above the best distance: then no centroid
left can be as near, not even a tie with a smaller number.

A round reads the written integer vectors; each task sums its own vectors by cluster, so that a row for each cluster and task is
all that is shuffled, and the centroids, of fixed number and length, are all that the driver holds."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read, staged

#: Components are held to this, so that squared distances fit a long: with 256 steps a unit, numbers up to 524,288 either way are free.
LARGEST = 1 << 27
#: Vectors walked in step, and pairs whose distance is taken at a time.
TOGETHER, PAIRS = 2048, 32768
_FAR, _UNMET, _LONG = 1 << 29, np.iinfo(np.int64).max, (1 << 63) - 1


class Lists:
    """The sorted lists of centroids (an int64 matrix, one row each), with a far value at either end of each list."""

    def __init__(self, centroids: np.ndarray):
        k, d = centroids.shape
        self.centroids, self.dims = centroids, np.arange(d)
        self.who = np.argsort(centroids, axis=0, kind="stable").T
        self.values = np.full((d, k + 2), _FAR, np.int64)
        self.values[:, 0] = -_FAR
        self.values[:, 1:-1] = np.sort(centroids.T, axis=1)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of v, ties to the smaller number, and its squared distance."""
        parts = [self._nearest(v[a : a + TOGETHER]) for a in range(0, len(v), TOGETHER)] or [(np.zeros(0, np.int64),) * 2]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = len(self.centroids), self.dims
        up = np.stack([np.searchsorted(row[1:-1], x) for row, x in zip(self.values, v.T)], 1) + 1
        down = up - 1
        distance = np.full((len(v), k), _UNMET)
        live = np.arange(len(v))
        while len(live):
            above, below = self.values[dims, up[live]] - v[live], v[live] - self.values[dims, down[live]]
            frontier = (np.minimum(above, below) ** 2).sum(1)
            unmet = distance[live] == _UNMET
            going = unmet.any(1) & ~(frontier > distance[live].min(1))
            live, unmet = live[going], unmet[going]
            rising = above[going] <= below[going]
            met = self.who[dims, np.where(rising, up[live], down[live]) - 1]
            up[live] += rising
            down[live] -= ~rising
            fresh = np.zeros((len(live), k), bool)
            fresh[np.arange(len(live))[:, None], met] = True
            row, centroid = np.nonzero(fresh & unmet)
            for a in range(0, len(row), PAIRS):
                i, c = live[row[a : a + PAIRS]], centroid[a : a + PAIRS]
                distance[i, c] = ((v[i] - self.centroids[c]) ** 2).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(len(v)), best]


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, c: the vectors of so many components, none null or non-finite, as integers floor(scale * x)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            part = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False))
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            fine = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                c = np.clip(np.floor(scale * x[fine]), -LARGEST, LARGEST).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * dims), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fine)), lists], ["vec_id", "c"])

    plain = dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>")
    v = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).mapInArrow(run, "vec_id long, c array<int>")


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of each row of whole (vec_id, c)."""
    import pyarrow as pa

    def run(batches):
        lists = Lists(centroids)
        for batch in batches:
            cluster, distance = lists.nearest(_matrix(batch.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return whole.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means, those without vectors as they were."""
    import pyarrow as pa

    k, dims = centroids.shape

    def run(batches):
        lists, sums, counts = Lists(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), dims)
            cluster, _ = lists.nearest(v)
            np.add.at(sums, cluster, v)
            counts += np.bincount(cluster, minlength=k)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = whole.select("c").mapInArrow(run, "cluster long, n long, s array<long>")
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("s")[j].cast("decimal(38,0)")) for j in range(dims)]).collect():
        out[r[0]] = [int(s) // r[1] for s in r[2:]]
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, tag: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector in `vectors` (vec_id, embedding).

    Vectors of another length than dims, null ones and those with null or non-finite components take no part. Components beyond
    LARGEST steps count as LARGEST. The first centroids are the k vectors with the smallest SHA-256 of tag:vec_id, of equal ids the
    one with the smaller components first; vectors without id come last there, but are clustered like any other. With fewer than k
    vectors each is a centroid. Repeated rows are vectors of their own. An empty table gives an empty result; other columns are left
    out. A sum of distances that doesn't fit a long is null."""
    spark = vectors.sparkSession
    whole = staged(whole_vectors(vectors, dims, scale), "whole")
    hashed = whole.select("c", F.sha2(F.concat(F.lit(f"{tag}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    centroids = np.array([r.c for r in hashed.orderBy(F.col("h").asc_nulls_last(), "c").limit(k).collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(whole, centroids)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = staged(assigned(whole, centroids), "assigned")
    by = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda x: x if x <= _LONG else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(c, fits(x), fits(sum(by.values())), digest(centroids[c])) for c, x in by.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all embeddings, as clusters() says with its defaults."""
    return clusters(read(spark, sf_dir, "embeddings"))
