"""Centroid clustering by sort-means.

Each round every centroid orders the others by their distance from it. A vector scans them in the order of the centroid
it had before and stops at the first that lies strictly beyond twice its distance to that one: by the triangle inequality
none from there on is as near. Ties go to the smaller number, all arithmetic is in whole numbers, so rounds are exact
and equal to those of a full comparison.

A round is one pass without a shuffle of vectors: tasks read vectors with their assignment, write both anew, and end
their part of the table with one row of sums for each cluster they saw. Only the column of those rows is read to make the
next centroids. The driver holds k centroids. A table of a round is deleted when the next is written; nothing is kept in
executors, so one that is lost costs its tasks. Rounds end early if no centroid moves, as nothing changes after that.

Cases: vectors of another length than `components`, null ones and those with null or non-finite components are left
out; components beyond 2**27 as whole numbers are taken as that limit (whole_vectors); fewer vectors than k give as many
centroids; null ids are clustered and, with no hash, start a centroid only after all others; equal ids are one row each,
equal hashes are ordered by their vectors; equal starts leave the larger number empty, which stays; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.llm.shared import drop_durable, durable, ship, summed_vectors
from reelforge.llm.whole_vectors import blocks, capped, finite, lists, squared, whole

K, ROUNDS, SCALE, COMPONENTS, SALT = 40, 5, 256, 64, "2:"
STEP = 8  # centroids that a vector's scan takes at a time
STATE = "vec_id long, x array<int>, cluster int, distance long, kind int, slice int, counts binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vectors: DataFrame, components: int) -> DataFrame:
    """vec_id and v, as doubles, of each vector that takes part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return own.filter((F.size("v") == components) & finite("v"))


def starts(own: DataFrame, k: int, scale: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    by = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    rows = own.orderBy(by.asc_nulls_last(), "v").limit(k).select("v").collect()
    return whole(np.array([r.v for r in rows], np.float64), scale) if rows else np.empty((0, 0), np.int64)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others, nearest first, and a quarter of their squared distances, rounded up."""
    apart = squared(centroids, centroids)
    np.fill_diagonal(apart, -1)
    others = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return others, -(-np.take_along_axis(apart, others, axis=1) // 4)


def nearest(x: np.ndarray, centroids: np.ndarray, others: np.ndarray, quarter: np.ndarray, before: np.ndarray):
    """Number and squared distance of each row's nearest centroid; before: the number that each row had."""
    cluster, gap = before.astype(np.int64), x - centroids[before]
    distance = (gap * gap).sum(axis=1)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        scanned = np.searchsorted(quarter[a], distance[rows], side="right")  # those at twice the distance or nearer
        rows, scanned = rows[np.argsort(-scanned, kind="stable")], -np.sort(-scanned)
        for at in range(0, int(scanned[0]), STEP):
            own, step = rows[: np.searchsorted(-scanned, -at, side="left")], others[a, at : at + STEP]
            d = squared(x[own], centroids[step])
            least = d.min(axis=1)
            number = np.where(d == least[:, None], step, len(centroids)).min(axis=1)
            better = (least < distance[own]) | (least == distance[own]) & (number < cluster[own])
            cluster[own[better]], distance[own[better]] = number[better], least[better]
    return cluster, distance


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Component sums and, last, the count of each cluster."""
    member = (cluster == np.arange(k)[:, None]).astype(np.float64)
    return np.hstack([member @ x, member.sum(axis=1, keepdims=True)]).astype(np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """STATE rows: vectors (column v, doubles or whole numbers if scale is 0) with their nearest centroid, then each task's sums."""
    others, quarter = orders(centroids)

    def assign(batches):
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for t in blocks(batches, "v"):
            x = np.asarray(t["v"].combine_chunks().flatten()).reshape(len(t), -1)
            x = whole(x, scale) if scale else x.astype(np.int64)
            cluster, distance = nearest(x, centroids, others, quarter, np.asarray(t["cluster"]))
            sums += _sums(x, cluster, len(centroids))
            none = [pa.nulls(len(t), kind) for kind in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.record_batch([t["vec_id"].combine_chunks(), lists(x), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), *none], names=NAMES)
        seen = np.flatnonzero(sums[:, -1])
        none = [pa.nulls(len(seen), kind) for kind in (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64())]
        blobs = pa.array([sums[c].astype("<i8").tobytes() for c in seen], pa.binary())
        yield pa.record_batch([*none, pa.array(seen, pa.int32()), pa.array([0] * len(seen), pa.int32()), blobs], names=NAMES)

    return rows.select("vec_id", "v", "cluster").mapInArrow(assign, STATE)


NAMES = [part.split()[0] for part in STATE.split(", ")]


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids' next places: floors of their vectors' means."""
    k, d = centroids.shape
    sums = summed_vectors(state.filter("counts is not null").select("kind", "slice", "counts"), k, d + 1)
    n = sums[:, -1:]
    return np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), centroids)


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """RESULT row of each vector that takes part, after `rounds` rounds and one more assignment."""
    spark = vectors.sparkSession
    ship(spark)
    own = kept(vectors, components)
    centroids = starts(own, k, scale)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    state = durable(assigned(own.withColumn("cluster", F.lit(0)), centroids, scale), "clusters")
    for _ in range(rounds):
        new = moved(state, centroids)
        if (new == centroids).all():
            break
        centroids, old = new, state
        state = durable(assigned(old.filter("x is not null").select("vec_id", F.col("x").alias("v"), "cluster"), centroids, 0), "clusters")
        drop_durable(old)
    rows = state.filter("x is not null").select("vec_id", "cluster", "distance")
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, capped(s), capped(sum(inertia.values())), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select(*(part.split()[0] for part in RESULT.split(", ")))
