"""Plain Lloyd clustering of quantised vectors, in integers.

Centroids are broadcast (a bounded number of vectors); each task gives its vectors to their nearest centroid and returns
one sum per cluster and component, which a groupBy merges. All arithmetic is exact: 64-bit integers where they hold the
squares, Python's integers for the rows (or rounds) where they don't. Sums travel as digits of 30 bits, so that no total
passes 64 bits either.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part and give no
row; repeated rows are vectors of their own, and a null id is kept (it comes last in the choice of first centroids); fewer
vectors than centroids give that many clusters; an empty table gives no rows; extra columns are ignored. A distance or
inertia past 64 bits is given as 2**63 - 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Components up to which a squared distance over 2 ** 7 components stays below 2 ** 63.
SAFE = 1 << 26
#: Bits of a digit of a sum, and the vectors that are compared at a time.
DIGIT, ROWS = 30, 4_096
LARGEST = (1 << 63) - 1


def takes_part(vector: Column, components: int) -> Column:
    """Exactly so many components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def _whole(x: float, scale: int) -> int:
    scaled = scale * x
    return math.floor(scaled) if math.isfinite(scaled) else scale * int(x)


def quantised(vectors: pd.Series, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of runs of vectors: floor(scale * x), as 64-bit integers where they are SAFE, else as Python's."""
    for lo in range(0, len(vectors), ROWS):
        raw = np.array(list(vectors.iloc[lo : lo + ROWS]), np.float64)
        with np.errstate(over="ignore"):
            near = np.floor(scale * raw)
        safe = np.abs(near).max(axis=1) < SAFE
        for is_safe, own in ((True, np.flatnonzero(safe)), (False, np.flatnonzero(~safe))):
            if len(own):
                yield lo + own, near[own].astype(np.int64) if is_safe else np.array([[_whole(float(x), scale) for x in raw[i]] for i in own], object)


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector: the lowest number among the nearest."""
    exact = v.dtype == object or any(abs(x) >= SAFE for c in centroids for x in c)
    v = v.astype(object) if exact else v
    squares = []
    for c in centroids:
        d = v - np.array(c, object if exact else np.int64)
        squares.append((d * d).sum(axis=1) if exact else np.einsum("ij,ij->i", d, d))
    if exact:
        at = np.array([min(range(len(centroids)), key=lambda k, i=i: (squares[k][i], k)) for i in range(len(v))])
        return at, np.array([squares[k][i] for i, k in enumerate(at)], object)
    table = np.stack(squares)
    at = table.argmin(axis=0)
    return at, table[at, np.arange(len(v))]


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer in base 2 ** DIGIT, with its sign on each digit."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if rest & (1 << DIGIT) - 1:
            yield place, sign * (rest & (1 << DIGIT) - 1)
        rest, place = rest >> DIGIT, place + 1


def _totals(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The sum of each (cluster, component); parts: (cluster, component, place, total)."""
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "place").agg(F.sum("total").alias("total")).collect():  # clusters x components x digits
        key = (r["cluster"], r["component"])
        out[key] = out.get(key, 0) + (r["total"] << DIGIT * r["place"])
    return out


_PARTS = "cluster int, component int, place int, total long"


def _part_rows(sums: dict[tuple[int, int], int]) -> pd.DataFrame:
    rows = [(k, j, place, digit) for (k, j), total in sums.items() for place, digit in digits(total)]
    return pd.DataFrame(rows, columns=["cluster", "component", "place", "total"]).astype({"cluster": "int32", "component": "int32", "place": "int32", "total": "int64"})


def cluster_sums(vectors: DataFrame, vector: str, scale: int, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(vectors, component sums) of each cluster. Component -1 counts the vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, v in quantised(batch[vector], scale):
                at, _ = nearest(v, shared.value)
                for k in np.unique(at).tolist():
                    own = v[at == k]
                    for j, total in enumerate([len(own), *own.sum(axis=0).tolist()], -1):
                        held[k, j] = held.get((k, j), 0) + int(total)
        yield _part_rows(held)

    sums = _totals(vectors.select(vector).mapInPandas(summed, _PARTS))
    shared.unpersist()
    return [(sums.get((k, -1), 0), [sums.get((k, j), 0) for j in range(len(c))]) for k, c in enumerate(centroids)]


def first_centroids(vectors: DataFrame, vector: str, scale: int, clusters: int, order: Column) -> list[list[int]]:
    """The quantised vectors that come first in the order; ties by their components."""
    rows = vectors.select(order.alias("order"), vector).orderBy(F.col("order").asc_nulls_last(), vector).limit(clusters).collect()
    return [[_whole(float(x), scale) for x in r[vector]] for r in rows]


def lloyd(vectors: DataFrame, vector: str, scale: int, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after so many rounds: each is its vectors' mean, rounded down; one without vectors stays."""
    for _ in range(rounds):
        sums = cluster_sums(vectors, vector, scale, centroids)
        centroids = [[s // n for s in total] if n else c for c, (n, total) in zip(centroids, sums, strict=True)]
    return centroids


def clusters_of(vectors: DataFrame, components: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    import hashlib

    rows = vectors.select(vec_id, vector).filter(takes_part(F.col(vector), components))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)
    centroids = lloyd(rows, vector, scale, first_centroids(rows, vector, scale, clusters, order), rounds)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    named = rows.select(F.col(vec_id).cast("string").alias("id"), F.col(vector).alias("v"))  # pandas has no null integers

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, distance, far = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64), np.full(len(batch), None, object)
            for rows_at, v in quantised(batch["v"], scale):
                at, squares = nearest(v, shared.value)
                cluster[rows_at] = at
                distance[rows_at] = [min(int(x), LARGEST) for x in squares] if squares.dtype == object else squares
                if squares.dtype == object:
                    far[rows_at] = [str(x) if x > LARGEST else None for x in squares]
            yield pd.DataFrame({"id": batch["id"], "cluster": cluster, "distance": distance, "far": far})

    placed = checkpointed(named.mapInPandas(assigned, "id string, cluster int, distance long, far string"))

    def inertias(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            exact = [int(f) if f is not None else int(d) for d, f in zip(batch["distance"], batch["far"], strict=True)] if batch["far"].notna().any() else None
            for k in batch["cluster"].unique().tolist():
                own = (batch["cluster"] == k).to_numpy()
                total = sum(x for x, is_own in zip(exact, own, strict=True) if is_own) if exact else sum(batch["distance"].to_numpy()[own].tolist())
                held[k, 0] = held.get((k, 0), 0) + total
        yield _part_rows(held)

    sums = _totals(placed.select("cluster", "distance", "far").mapInPandas(inertias, _PARTS))
    inertia = [sums.get((k, 0), 0) for k in range(len(centroids))]
    told = [(k, min(x, LARGEST), min(sum(inertia), LARGEST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, (x, c) in enumerate(zip(inertia, centroids, strict=True))]
    of_cluster = rows.sparkSession.createDataFrame(told, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return placed.join(F.broadcast(of_cluster), F.col("cluster") == F.col("_cluster")).select(F.col("id").cast(vectors.schema[vec_id].dataType).alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
