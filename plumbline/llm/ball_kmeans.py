"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and the distance of its furthest member. Vectors carry the ball
they are in. By the triangle inequality a centroid can be as near to a member as its own only if
the two centroids are at most twice the member's distance apart, so

* a ball's neighbours are the centroids within twice its radius, in order of their distance;
* members nearer than half the way to the first neighbour are the stable core and stay;
* the others lie in annuli: one beyond half the way to the k-th neighbour, but not to the next, is
  compared with k centroids;
* a ball is passed over whole if neither its centroid nor that of any neighbour has moved.

All comparisons are of squared distances in whole numbers, ties included, so the result is that of
comparing each vector with each centroid. After an update the radius is known as a bound, the old one plus
the way that the centroid went. The first assignment starts from one ball of all vectors.

A round is a pass over the vectors, without a shuffle, that writes them with their new balls, and an
aggregation of one row a ball (members, componentwise sums, radius, inertia), ``k`` rows on the driver. Tasks are
sent the centroids and their neighbours, k * (k + dimensions) numbers. The vectors as of the round before are
removed once the next are written, so a lost executor costs a part of a round.

Defined results: vectors that are null, have another number of components, or a null, infinite or undefined
component are left out; a component outside +-``bound_of(dims)`` is an error, as squared distances would
not fit a long; repeated rows are vectors of their own; a null identifier comes last among possible starts; starts with one
identifier go by their components; with fewer vectors than ``k`` there are as many clusters as
vectors; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.durable import discard
from plumbline.llm.common import made, where


@dataclass(frozen=True)
class Ball:
    """A final cluster: its number, centroid, members, largest squared distance and sum of them."""

    cluster: int
    centroid: tuple[int, ...]
    members: int
    radius2: int
    inertia: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.centroid)).encode()).hexdigest()


def bound_of(dims: int) -> int:
    """What components may be at most, so that four times a squared distance fits a long."""
    return isqrt((2**63 - 1) // (4 * dims)) // 2


def quantised(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the kept vectors in whole numbers, floor(scale * x)."""
    named = vectors.toDF(*(f"c{i}" for i in range(len(vectors.columns))))
    v = F.col(f"c{where(vectors, vector)}")
    finite = lambda x: x.isNotNull() & (x.cast("double") < float("inf")) & (x.cast("double") > float("-inf"))  # noqa: E731  NaN is above infinity
    kept = named.filter(v.isNotNull() & (F.size(v) == dims)).filter(F.forall(v, finite))
    bound = bound_of(dims)
    whole = lambda x: F.floor(
        F.when(F.abs(x.cast("double") * scale) <= bound, x.cast("double") * scale).otherwise(F.raise_error(F.lit(f"a component is outside +-{bound} / {scale}")))
    ).cast("int")
    return kept.select(F.col(f"c{where(vectors, key)}").alias("vec_id"), F.transform(v, whole).alias("v"))


def first_centroids(points: DataFrame, k: int, order: Column) -> np.ndarray:
    """The ``k`` vectors that come first by ``order``."""
    rows = points.select("v", order.alias("o"), "vec_id").orderBy(F.asc_nulls_last("o"), "vec_id", "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def neighbours(centroids: np.ndarray, radius: list[int | None], moved: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each ball: the centroids within twice its radius (None: no bound), nearest first, and their squared distances."""
    out = []
    for own, limit in enumerate(radius):
        gaps = ((centroids - centroids[own]) ** 2).sum(axis=1)
        near = gaps <= (4 * limit * limit if limit is not None and limit < 2**30 else 2**63 - 1)
        near[own] = False
        if limit is not None and not moved[own] and not moved[near].any():
            near[:] = False
        ids = np.flatnonzero(near)
        ids = ids[np.argsort(gaps[ids], kind="stable")]
        out.append((ids, gaps[ids]))
    return out


def nearest(vectors: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, of equally near ones the smallest number, and the squared distance."""
    best, least = own.copy(), ((vectors - centroids[own]) ** 2).sum(axis=1)
    for ball in np.unique(own):
        ids, gaps = near[ball]
        rows = np.flatnonzero(own == ball)
        annulus = np.searchsorted(gaps, 4 * least[rows], side="right")
        for k in range(annulus.max()):
            at = rows[annulus > k]
            d = ((vectors[at] - centroids[ids[k]]) ** 2).sum(axis=1)
            better = (d < least[at]) | ((d == least[at]) & (ids[k] < best[at]))
            best[at[better]], least[at[better]] = ids[k], d[better]
    return best, least


def assign(points: DataFrame, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], dims: int) -> DataFrame:
    """``points`` (vec_id, v, cluster) with their new cluster and distance."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
                best, least = nearest(v, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids, near)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "v", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance long")


def ball_kmeans(
    vectors: DataFrame, order: Column, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[Ball]]:
    """(vec_id, cluster, distance) of each kept vector, and the balls.

    ``order``: an expression over vec_id; the ``k`` vectors with its smallest values are the first
    centroids. Each round assigns all vectors and moves each centroid to the floor of its members' mean; then
    they are assigned once more. Rounds after which no centroid moves are left out, as they change nothing.
    """
    spark = vectors.sparkSession
    points = quantised(vectors, key, vector, dims, scale)
    centroids = first_centroids(points, k, order)
    state, last = points.withColumn("cluster", F.lit(0)), None
    if not len(centroids):
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), []
    near = neighbours(centroids, [None] * len(centroids), np.ones(len(centroids), dtype=bool))
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
    for done in range(rounds + 1):
        path = made(spark, "balls")
        out = assign(state, centroids, near, dims)
        out.write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(out.schema).parquet(path)
        if last:
            discard(spark, last)
        last = path
        rows = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), F.sum("distance").alias("inertia"), *sums).collect()
        if done == rounds:
            break
        moved, radius = np.zeros(len(centroids), dtype=bool), [0] * len(centroids)
        onward = centroids.copy()
        for r in rows:
            c = r["cluster"]
            onward[c] = [r[f"s{i}"] // r["n"] for i in range(dims)]
            way = int(((onward[c] - centroids[c]) ** 2).sum())
            moved[c], radius[c] = way > 0, _root(r["far"]) + _root(way)
        if not moved.any():
            break
        centroids, near = onward, neighbours(onward, radius, moved)
    by = {r["cluster"]: r for r in rows}
    balls = [
        Ball(c, tuple(map(int, v)), by[c]["n"] if c in by else 0, by[c]["far"] if c in by else 0, by[c]["inertia"] if c in by else 0)
        for c, v in enumerate(centroids)
    ]
    return state.select("vec_id", "cluster", "distance"), balls


def _root(square: int) -> int:
    """The square root, rounded up."""
    return isqrt(square - 1) + 1 if square > 0 else 0


def described(assigned: DataFrame, balls: list[Ball]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256; joined with one row a ball."""
    spark = assigned.sparkSession
    rows = [(b.cluster, b.inertia, b.sha256()) for b in balls]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(table), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(b.inertia for b in balls)).cast("long").alias("inertia"), "centroid_sha256")
