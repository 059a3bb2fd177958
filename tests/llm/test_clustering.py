"""Lloyd's rounds against a plain loop in Python's integers, vectors of any size included."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import clustering as C


def floored(v, scale=64):
    return [math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x) for x in v]


def brute(rows, components, clusters, rounds, scale=64):
    kept = [(i, floored(v), v) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centroids = [r[1] for r in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v, _ in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    at = [near(v) for _, v, _ in kept]
    cap = lambda x: min(x, C.LARGEST)
    sums = [sum(d for d, k in at if k == own) for own in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, cap(d), cap(sums[k]), cap(sum(sums)), sha[k]) for (i, _, _), (d, k) in zip(kept, at, strict=True)), key=str)


def vectors(far):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in (rng.normal(size=6) + 3 * (i % 4)).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [None] + [1.0] * 5), (304, [float("nan")] * 6), (305, [float("-inf")] + [0.0] * 5), (306, [0.0] * 6), (307, [-0.0] * 6)]
    return rows + far


@pytest.mark.parametrize(
    "far", [[], [(400, [3e9, -3e9, 0.0, 1.0, 2.0, 3.0]), (401, [1e30] * 6), (402, [-1e30, 1e-30, 0.0, 0.0, 0.0, 0.0])], [(403, [1.7e308] * 6), (404, [-1.7e308] * 6)]], ids=["near", "far", "farthest"]
)
@pytest.mark.parametrize("clusters", [1, 7, 400])
def test_clusters_equal_brute_force(spark, far, clusters):
    rows = vectors(far)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit("x") for c in ("cluster", "distance", "order", "id", "v", "far")})
    got = C.clusters_of(df, components=6, clusters=clusters, rounds=3)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 6, clusters, 3)


def test_large_ids_beside_a_null_one(spark):
    rows = [(2**62 + 1, [0.0, 1.0]), (None, [0.0, 1.0]), (2**62 + 3, [5.0, 1.0])]
    got = C.clusters_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), components=2, clusters=2)
    assert sorted((r["vec_id"] for r in got.collect()), key=str) == sorted((r[0] for r in rows), key=str)


def test_nothing_to_cluster(spark):
    assert C.clusters_of(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert C.clusters_of(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_digits_add_up():
    for value in (0, 1, -1, 2**30, -(2**30) - 5, 10**40, -(10**300)):
        assert sum(d << C.DIGIT * p for p, d in C.digits(value)) == value and all(abs(d) < 1 << C.DIGIT for _, d in C.digits(value))
