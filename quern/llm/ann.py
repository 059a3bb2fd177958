"""Nearest neighbours by inner product, from balanced posting lists.

Vectors get one more component that makes all norms equal, so that the largest inner product is the least Euclidean
distance on a sphere. Centroids on that sphere are fitted, with a penalty on large clusters, on a bounded sample (SAMPLE
vectors at most, by hash); every vector is indexed. The centroids (LISTS at most) are linked to a graph of near ones, held in
memory by each worker and searched best-first with a beam. A vector goes to its nearest list and, near a border, to
further lists (up to COPIES) within a ratio of the nearest one's distance, unless a chosen centroid lies nearer to theirs.
A query reads the lists whose distance is within a ratio of the nearest one's: the least ratio that finds the wanted share
of the sample's own neighbours. As the ratio is measured, it follows the data and not a constant.

Neighbouring lists stand on one shelf, which tasks score at once: a vector or query is sent to a shelf once, whatever
lists it has there. Every query first reads its lists on the shelf of its nearest list; the (k + 1)-th best score that it
finds there is a bound, and its other shelves give back only what reaches it. Shelves over BLOCK vectors, or with over
BLOCK queries, are split among tasks, so a list may hold any share of the rows. Scores are computed again for the found
pairs, in double precision, in one fixed order of summation.

Of equal vectors only the k + 1 smallest ids are listed: for a search of k, others can never be among the results, as
k equal vectors with smaller ids go before them. Equal queries are searched once, for k + 1, and then drop themselves.

Defined results: vectors that are null, zero, or have null or non-finite components neither search nor are found;
vectors of different lengths are searched apart, each among those of its own (lengths in use are few); repeated rows are
found as one; an id with several vectors is found by its best one and asks with each; a null id takes no part; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_hot
from .vectors import as_bytes, class_of, kind_of, matrix, takes_part

SAMPLE, LISTS, COPIES, BLOCK = 16_384, 1_024, 4, 4_096
#: Values that the sample, which each worker holds, has at most.
SAMPLE_VALUES = 4_194_304
#: Vectors per list to aim at, before copies; lists per shelf.
PER_LIST, SHELF = 256, 8
#: Sample vectors that are searched to measure the query ratio.
TRIED = 256


def augment(x: np.ndarray, norm: float) -> np.ndarray:
    """Unit vectors: x over norm, and what is missing to length 1."""
    x = x / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def queries(x: np.ndarray) -> np.ndarray:
    """Unit vectors without a further component: their distances to augmented vectors order by inner products."""
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def balanced_centroids(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """n unit centroids by k-means on the sphere whose distances grow with a cluster's size over the fair one."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), n, replace=False)]
    sizes = np.full(n, len(sample) / n)
    for _ in range(rounds):
        d = distances(sample, centroids)
        spread = np.median(d.min(axis=1))
        of = (d + 0.1 * spread * (sizes * n / len(sample) - 1)[None, :]).argmin(axis=1)
        sizes = np.bincount(of, minlength=n)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), sample[rng.integers(len(sample), size=n)])
    return centroids


class Graph:
    """Centroids, each linked to near ones, searched best-first for many vectors at once."""

    def __init__(self, centroids: np.ndarray, links: int = 16):
        self.centroids, n = centroids.astype(np.float32), len(centroids)
        self.apart = distances(centroids, centroids)
        near = np.argsort(self.apart, axis=1, kind="stable")[:, 1 : links + 1]
        linked = np.zeros((n, n), bool)
        linked[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = True
        linked |= linked.T
        np.fill_diagonal(linked, False)
        order = np.argsort(np.where(linked, self.apart, np.inf), axis=1, kind="stable")[:, : max(1, min(links + links // 2, n))]
        self.links = np.where(np.take_along_axis(linked, order, axis=1), order, np.arange(n)[:, None])  # a node itself where it has fewer
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest centroids found for each vector, nearest first, and their distances."""
        parts = [self._search(x[lo : lo + 512], min(beam, len(self.centroids))) for lo in range(0, len(x), 512)]
        return np.vstack([f for f, _ in parts]), np.vstack([d for _, d in parts])

    def _search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows, x = len(x), np.arange(len(x))[:, None], x.astype(np.float32)
        found = np.zeros((n, max(beam, len(self.entries))), np.int64)
        d = np.full(found.shape, np.inf, np.float32)
        found[:, : len(self.entries)] = self.entries
        d[:, : len(self.entries)] = distances(x, self.centroids[self.entries])
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        found, d = found[rows, order], d[rows, order]
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[:, self.entries] = True
        done = np.isinf(d)
        while True:
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                return found, d
            best = np.where(done[live], np.inf, d[live]).argmin(axis=1)
            done[live, best] = True
            to = self.links[found[live, best]]
            fresh = ~seen[live[:, None], to]
            seen[live[:, None], to] = True
            new = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.matmul(self.centroids[to], x[live][:, :, None])[:, :, 0]))
            new[~fresh] = np.inf
            all_d = np.hstack([d[live], new])
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            found[live] = np.take_along_axis(np.hstack([found[live], to]), order, axis=1)
            d[live] = np.take_along_axis(all_d, order, axis=1)
            done[live] = np.take_along_axis(np.hstack([done[live], ~fresh]), order, axis=1)

    def lists_for(self, x: np.ndarray, copies: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): a vector's lists: the nearest, and near ones that no chosen centroid shields."""
        found, d = self.search(x, 4 * copies)
        chosen = np.zeros(found.shape, bool)
        chosen[:, 0] = True
        for j in range(1, found.shape[1]):
            ok = (d[:, j] <= ratio * d[:, 0]) & (chosen.sum(axis=1) < copies)
            for i in range(j):
                ok &= ~chosen[:, i] | (self.apart[found[:, i], found[:, j]] > d[:, j])
            chosen[:, j] = ok
        row, at = np.nonzero(chosen)
        return row, found[row, at]

    def probes_for(self, x: np.ndarray, ratio: float, usual: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) of the lists that each query reads, by the ratio of their distances to the nearest one's; its nearest list.

        A query right at a centroid, as in a cluster of copies, reads as far as one at the usual distance would. The
        beam widens until it holds a list that is too far.
        """
        beam, rows, out, nearest = 32, np.arange(len(x)), [], np.zeros(len(x), np.int64)
        while len(rows):
            found, d = self.search(x[rows], beam)
            within = d <= ratio * np.maximum(d[:, :1], usual)
            short = within[:, -1] & (found.shape[1] < len(self.centroids))
            row, at = np.nonzero(within & ~short[:, None])
            out.append((rows[row], found[row, at]))
            nearest[rows] = found[:, 0]
            rows, beam = rows[short], 2 * beam
        return np.concatenate([r for r, _ in out]), np.concatenate([f for _, f in out]), nearest


def measured_ratio(graph: Graph, sample: np.ndarray, asked: np.ndarray, k: int, usual: float, copy_ratio: float, recall: float) -> float:
    """The least query ratio at which the lists read hold that share of the asked vectors' k nearest in the sample.

    asked: the sample's first vectors as queries, each of which leaves itself out.
    """
    row, at = graph.lists_for(sample, COPIES, copy_ratio)
    holds = np.zeros((len(sample), len(graph.centroids)), bool)
    holds[row, at] = True
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, :k]
    d = distances(asked, graph.centroids)
    d /= np.maximum(d.min(axis=1, keepdims=True), usual)
    needed = np.where(holds[near], d[:, None, :], np.inf).min(axis=2)
    needed = needed[np.isfinite(np.take_along_axis(score, near, axis=1))]
    return max(1.0, float(np.quantile(needed, recall))) + 1e-9 if len(needed) else 1.0


@lru_cache(maxsize=2)
def _graph(raw: bytes, width: int) -> Graph:
    return Graph(np.frombuffer(raw, "<f8").reshape(-1, width))


def top(scores: np.ndarray, bound: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k largest that reach its bound, ties to the smaller id.

    The scores given are those of matrix products; those returned are summed anew for each pair.
    """
    if scores.shape[1] > k:
        bound = np.maximum(bound, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    with np.errstate(invalid="ignore"):
        edge = bound - 1e-9 * np.maximum(1.0, np.abs(bound))
    row, at = np.nonzero(scores >= np.where(np.isinf(bound), -np.inf, edge)[:, None])
    exact = np.concatenate([np.zeros(0), *((x[row[i : i + 65_536]] * y[at[i : i + 65_536]]).sum(axis=1) for i in range(0, len(row), 65_536))])
    return _first(row, ids[at], exact, k)


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best different ids."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    again = np.lexsort((np.arange(len(row)), ids, row))  # by row and id, the best first
    first = np.ones(len(row), bool)
    first[again[1:]] = (row[again[1:]] != row[again[:-1]]) | (ids[again[1:]] != ids[again[:-1]])
    row, ids, score = row[first], ids[first], score[first]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def score_shelf(posts: pd.DataFrame, asks: pd.DataFrame, kind: str, k: int) -> pd.DataFrame:
    """(_ask, _id, score): the k best of each query among the vectors of the lists that it reads on this shelf."""
    y, ids = matrix(posts["vec"], kind), posts["_id"].to_numpy()
    stands = _members(posts["lists"])
    out = []
    for lo in range(0, len(asks), 1_024):
        part = asks.iloc[lo : lo + 1_024]
        x, bound = matrix(part["vec"], kind), part["bound"].to_numpy(float)
        found = []
        for at, reading in _members(part["lists"]).items():
            if at in stands:
                own = stands[at]
                row, hit, score = top(x[reading] @ y[own].T, bound[reading], x[reading], y[own], ids[own], k)
                found.append((reading[row], hit, score))
        if found:
            row, hit, score = _first(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            out.append(pd.DataFrame({"_ask": part["_ask"].to_numpy()[row], "_id": hit, "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"_ask": [], "_id": [], "score": []})


def _members(lists: pd.Series) -> dict[int, np.ndarray]:
    """The rows of each list, from each row's lists."""
    row = np.repeat(np.arange(len(lists)), lists.map(len).to_numpy(int))
    flat = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    return dict(zip(names.tolist(), np.split(row[order], starts[1:]), strict=True))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.97,
    query_ratio: float | None = None,
    copy_ratio: float = 1.2,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows, nearest first.

    query_ratio: how far a query reads; None measures it on the sample for that recall.
    """
    valid = vectors.filter(takes_part(F.col(embedding)) & F.col(vec_id).isNotNull())
    widths = sorted(r["w"] for r in valid.select(F.size(embedding).alias("w")).distinct().collect())
    id_type = vectors.schema[vec_id].dataType.simpleString()
    out = vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    for width in widths:
        rows = valid.filter(F.size(embedding) == width).select(F.col(vec_id).alias("_id"), is_query.alias("_q"), F.col(embedding).alias("_v"), class_of(embedding).alias("_c"))
        found = _search(as_bytes(rows, "_v", "vec").drop("_v"), width, kind_of(vectors, embedding), k, recall, query_ratio, copy_ratio)
        out = found if width == widths[0] else out.unionByName(found)
    return out


def _search(rows: DataFrame, width: int, kind: str, k: int, recall: float, query_ratio: float | None, copy_ratio: float) -> DataFrame:
    """search over rows (_id, _q, _c, vec) of one length."""
    spark, id_type = rows.sparkSession, rows.schema["_id"].dataType.simpleString()
    rows = checkpointed(rows)
    listed = rows.select("_c", "_id", "vec").dropDuplicates(["_c", "_id"])
    listed = listed.withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy("_id"))).filter(F.col("_n") <= k + 1)
    asked = rows.filter("_q").groupBy("_c").agg(F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("_n"))
    asked = checkpointed(asked.withColumn("_ask", F.monotonically_increasing_id()))

    @F.pandas_udf("double")
    def norm(raw: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(matrix(raw, kind), axis=1))

    n, largest = rows.agg(F.count(F.lit(1)), F.max(norm("vec"))).first()
    picked = rows.orderBy(F.xxhash64("_id"), "_id").select("_id", "vec").limit(max(1, min(SAMPLE, SAMPLE_VALUES // width))).toPandas().drop_duplicates("_id")
    plain = matrix(picked["vec"], kind)
    sample = augment(plain, largest)
    centroids = balanced_centroids(sample, max(1, min(LISTS, n // PER_LIST, len(sample))))
    shelves = balanced_centroids(centroids, -(-len(centroids) // SHELF))
    shelf_of = distances(centroids, shelves).argmin(axis=1)
    usual = float(np.median(distances(sample, centroids).min(axis=1)))
    if query_ratio is None:
        nearest = max(1, round(k * len(sample) / n))  # as near in the sample as the k-th of all rows
        query_ratio = measured_ratio(Graph(centroids), sample, queries(plain[:TRIED]), nearest, usual, copy_ratio, recall)
    shared = spark.sparkContext.broadcast(centroids.astype("<f8").tobytes())  # LISTS rows at most

    def on_shelves(part: pd.DataFrame, row: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        """A row of part for each shelf on which it has lists."""
        order = np.lexsort((at, shelf_of[at], row))
        row, at = row[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shelf_of[at[1:]] != shelf_of[at[:-1]])])) if len(row) else np.zeros(0, int)
        out = part.iloc[row[new]].reset_index(drop=True)
        return out.assign(shelf=shelf_of[at[new]].astype(np.int32), lists=np.split(at.astype(np.int32), new[1:]) if len(new) else [])

    def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = _graph(shared.value, width + 1)
        for batch in batches:
            for lo in range(0, len(batch), 2_048):
                part = batch.iloc[lo : lo + 2_048]
                yield on_shelves(part, *graph.lists_for(augment(matrix(part["vec"], kind), largest), COPIES, copy_ratio))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = _graph(shared.value, width + 1)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                row, at, nearest = graph.probes_for(queries(matrix(part["vec"], kind)), query_ratio, usual)
                out = on_shelves(part.assign(first=shelf_of[nearest]), row, at)
                yield out.assign(first=out["first"] == out["shelf"])

    posted = checkpointed(listed.select("_id", "vec").mapInPandas(stand, f"_id {id_type}, vec binary, shelf int, lists array<int>"))
    probed = checkpointed(asked.select("_ask", "vec").mapInPandas(ask, "_ask long, vec binary, first boolean, shelf int, lists array<int>"))

    def score(posts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(posts) or not len(asks):
            return pd.DataFrame({"_ask": [], "_id": [], "score": []})
        return score_shelf(posts, asks, kind, k + 1)

    def scored(asks: DataFrame) -> DataFrame:
        """(_ask, _id, score) of what asks (with their bounds) find on the shelves, shelf by shelf."""
        sizes = posted.groupBy("shelf").agg(F.count(F.lit(1)).alias("p")).join(asks.groupBy("shelf").agg(F.count(F.lit(1)).alias("q")), "shelf")
        sizes = F.broadcast(sizes.select("shelf", F.ceil(F.col("p") / BLOCK).cast("int").alias("_p"), F.ceil(F.col("q") / BLOCK).cast("int").alias("_w")))  # LISTS rows at most
        deal = lambda df, key, own, other: df.join(sizes, "shelf").withColumn("i", F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        left = deal(posted, "_id", "_p", "_w").select("shelf", "i", "j", "_id", "vec", "lists")
        right = deal(asks, "_ask", "_w", "_p").select("shelf", F.col("j").alias("i"), F.col("i").alias("j"), "_ask", "vec", "bound", "lists")
        keys = ["shelf", "i", "j"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, f"_ask long, _id {id_type}, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("_ask").orderBy(F.desc("score"), "_id")
        return found.groupBy("_ask", "_id").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)

    none = F.lit(float("-inf"))
    near = checkpointed(best(scored(probed.filter("first").withColumn("bound", none))).drop("_r"))
    bounds = near.groupBy("_ask").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("bound"))
    far = probed.filter("NOT first").join(bounds, "_ask", "left").withColumn("bound", F.coalesce("bound", none))
    found = best(near.unionByName(scored(far)))
    lists = found.groupBy("_ask").agg(F.array_sort(F.collect_list(F.struct("_r", "_id", "score"))).alias("found"))  # k + 1 entries
    asking = rows.filter("_q").select(F.col("_id").alias("query_id"), "_c").distinct()
    answers = join_hot(asking, asked.select("_ask", "_c", "_n").join(lists, "_ask").drop("_ask"), "_c", "_n")
    others = F.slice(F.filter("found", lambda x: x["_id"] != F.col("query_id")), 1, k)
    rows_out = answers.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return rows_out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit._id").alias("vec_id"), F.col("hit.score").alias("score"))
