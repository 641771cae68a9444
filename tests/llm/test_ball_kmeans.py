"""Ball k-means against comparing every vector with every centroid."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ball_kmeans as B

SCHEMA = "vec_id long, embedding array<float>, `a.b` string, Cluster int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 9) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dims, scale):
    f32 = lambda x: float(np.float32(x))
    kept = [(i, tuple(math.floor(scale * f32(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(f32(x)) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda p: (p[0] is None, p[0] or 0, p[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own) if c == j]
            if members:
                centroids[j] = tuple(sum(x) // len(members) for x in zip(*members))
    out = [(i, *reversed(near(v))) for i, v in kept]
    return sorted(out, key=repr), centroids


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, [rng.uniform(-2, 2) for _ in range(3)]) for i in range(300)]
    out += [(1000 + i, [0.5, 0.5, -0.5]) for i in range(200)]  # a hot vector, also among the starts
    out += [(-3, [0.5, 0.5, -0.5]), (-2, [0.5, 0.5, -0.5]), (-1, [0.0, 0.0, 0.0])]
    out += [(2000 + i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate([(x, y) for x in range(-3, 4) for y in range(-3, 4)])]  # ties
    out += [(5, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (None, [0.1, 0.2, 0.3])]
    out += [(3000, None), (3001, []), (3002, [1.0, 2.0]), (3003, [1.0, None, 2.0]), (3004, [1.0, float("nan"), 2.0]), (3005, [float("inf"), 0.0, 0.0]), (3006, [0.0] * 4)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k, scale", [(7, 256), (25, 1), (25, 256), (1, 256), (10_000, 256)])
def test_same_as_all_comparisons(spark, rows, k, scale):
    got, balls = B.ball_kmeans(table(spark, rows).repartition(3), F.col("vec_id"), k, 4, 3, scale)
    want, centroids = brute(rows, k, 4, 3, scale)
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=repr) == want
    assert [b.centroid for b in balls] == centroids
    for b in balls:
        own = [d for _, c, d in found if c == b.cluster]
        assert (b.members, b.radius2, b.inertia) == (len(own), max(own, default=0), sum(own))
    shown = B.described(got, balls).first()
    assert shown["inertia"] == sum(d for _, _, d in found) and shown["cluster_inertia"] == balls[shown["cluster"]].inertia


def test_balls_spare_comparisons():
    """The core is compared with no other centroid, and unmoved balls with none at all."""
    centroids = np.array([[0, 0], [100, 0], [10_000, 0]], dtype=np.int64)
    near = B.neighbours(centroids, [60, 10, 10], np.array([True, True, True]))
    assert [n[0].tolist() for n in near] == [[1], [], []]
    assert [n[0].tolist() for n in B.neighbours(centroids, [60, 10, 10], np.array([False, False, True]))] == [[], [], []]
    vectors = np.array([[49, 0], [50, 0], [51, 0]], dtype=np.int64)
    best, least = B.nearest(vectors, np.array([0, 0, 0]), centroids, near)
    assert best.tolist() == [0, 0, 1] and least.tolist() == [2401, 2500, 2401]
    best, _ = B.nearest(vectors, np.array([1, 1, 1]), centroids, B.neighbours(centroids, [None] * 3, np.ones(3, dtype=bool)))
    assert best.tolist() == [0, 0, 1]


def test_edges(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got, balls = B.ball_kmeans(table(spark, rows), F.col("vec_id"), 4, 2, 3)
        assert got.count() == 0 and balls == []
        assert B.described(got, balls).count() == 0
    bound = B.bound_of(3)
    assert 4 * 3 * (2 * bound) ** 2 < 2**63
    far = [(1, [bound / 256 - 1, 0.0, 0.0]), (2, [-bound / 256 + 1, 0.0, 0.0])]
    assert B.ball_kmeans(table(spark, far), F.col("vec_id"), 2, 2, 3)[0].count() == 2
    with pytest.raises(Exception, match="a component is outside"):
        B.ball_kmeans(table(spark, [(1, [bound / 128, 0.0, 0.0])]), F.col("vec_id"), 2, 2, 3)
