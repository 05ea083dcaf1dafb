"""Centroid clustering by the threshold algorithm.

Lloyd's rounds over whole-number vectors. The centroids of a round (``k`` rows,
``k`` a parameter) are sorted once per dimension. A vector is looked up in each
of these lists and the lists are walked outward from there, all at once: step t
shows, in every dimension, the centroid whose component is the t-th nearest. A
centroid is measured exactly when it is first seen. One that no list has shown
yet is at least as far, in every dimension, as the list's frontier, so the walk
stops as soon as the sum of the squared frontier distances is strictly greater than
the best exact distance. At equality it goes on: an unseen centroid with a smaller
number may tie. (Fagin, Lotem and Naor, "Optimal aggregation algorithms for
middleware", 2001, applied to lists that are read from the middle.)

Kept vectors are turned into whole numbers once and written to the shared folder;
every round is one scan of that table. A task sends ``k`` rows of exact sums
whatever it read, so repeated vectors and hot clusters cost nothing more, and only
``k`` centroids per round reach the driver.

Results: rows whose vector is null, of another length than ``width`` or holds null
or non-finite components are left out. Repeated rows count as often as they occur.
Starting rows come in the order of their hash, then (repeated vec_ids) of their
components; a null vec_id has no hash and comes last. With fewer rows than
``k`` there are fewer centroids; an empty table gives an empty result. Components
whose whole number would reach 2**27 are an error, as distances would leave
the range of long. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.integer_vectors import finite, matrix, scaled
from riskloom.session import checkpoint_dir, ship_package

CLUSTERS = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024
SEED = "3"
BATCH = 4096
_FAR = np.int64(1) << 40  # beyond every component, so that an exhausted side never comes next


class CentroidLists:
    """Centroids and, per dimension, their components in order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        k, width = self.centroids.shape
        self.order = np.argsort(self.centroids, axis=0, kind="stable").T  # (width, k)
        inner = np.take_along_axis(self.centroids.T, self.order, axis=1)
        edge = np.full((width, 1), _FAR)
        self.values = np.hstack([-edge, inner, edge])  # padded: list position p is at p + 1
        self.dims = np.arange(width)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller), its squared
        distance, and the steps walked, for each row of ``x``."""
        n, k = len(x), len(self.centroids)
        exact = np.full((n, k), np.iinfo(np.int64).max)
        steps = np.zeros(n, np.int64)
        right = np.empty(x.shape, np.int64)  # next entry to the right, to the left
        for d in self.dims:
            right[:, d] = np.searchsorted(self.values[d, 1:-1], x[:, d]) + 1
        left = right - 1
        rows, v = np.arange(n), x
        for _ in range(k):
            if not len(rows):
                break
            below, above = v - self.values[self.dims, left], self.values[self.dims, right] - v
            down = below <= above
            frontier = np.where(down, below, above)
            shown = self.order[self.dims, np.where(down, left, right) - 1]
            left, right = left - down, right + ~down
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], shown] = True
            new &= exact[rows] == np.iinfo(np.int64).max
            i, c = np.nonzero(new)
            gap = v[i] - self.centroids[c]
            exact[rows[i], c] = np.einsum("ij,ij->i", gap, gap)
            steps[rows] += 1
            go = np.einsum("ij,ij->i", frontier, frontier) <= exact[rows].min(1)
            rows, v, left, right = rows[go], v[go], left[go], right[go]
        best = exact.argmin(1)  # the first of equal distances
        return best, exact[np.arange(n), best], steps


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            yield part, matrix(part.column("v"), width)


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; a centroid
    without vectors stays."""
    k, width = centroids.shape
    lists = rows.sparkSession.sparkContext.broadcast(CentroidLists(centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, x in _parts(batches, width):
            near = lists.value.nearest(x)[0]
            np.add.at(total, near, x)
            count += np.bincount(near, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "total"])

    part = rows.select("v").mapInArrow(sums, "cluster long, n long, total array<long>")
    whole = (part.select("cluster", "n", F.posexplode("total").alias("at", "t")).groupBy("cluster", "at")
             .agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect())  # k x width numbers
    out = centroids.copy()
    for r in whole:
        out[r["cluster"], r["at"]] = r["t"] // r["n"]
    lists.unpersist()
    return out


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for
    every kept row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    ship_package(spark)
    folder = f"{checkpoint_dir(spark)}/clusters-{uuid.uuid4().hex}"
    kept = embeddings.select("vec_id", "embedding").where((F.size("embedding") == width) & finite("embedding"))
    kept.select("vec_id", scaled("embedding", scale).alias("v")).write.parquet(f"{folder}/vectors")
    rows = spark.read.parquet(f"{folder}/vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", name.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        none = F.lit(None)
        return rows.select("vec_id", none.cast("int").alias("cluster"), *[none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           none.cast("string").alias("centroid_sha256"))
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    lists = spark.sparkContext.broadcast(CentroidLists(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, width):
            near, far, _ = lists.value.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(far)],
                                             names=["vec_id", "cluster", "distance"])

    rows.mapInArrow(assign, schema).write.parquet(f"{folder}/assigned")
    placed = spark.read.parquet(f"{folder}/assigned")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = spark.createDataFrame(list(enumerate(digest)), "cluster int, centroid_sha256 string")  # k rows
    inertia = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = placed.agg(F.sum("distance").alias("inertia")).scalar()
    return (placed.join(F.broadcast(names.join(inertia, "cluster")), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256"))
