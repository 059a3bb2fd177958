"""The vector operators against brute force, and their defined results for odd rows."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, components, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        x = centres[i % 12] + rng.normal(scale=0.08 if i % 3 else 0.9, size=16)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 12 % 4))
    same = rows[5][1]
    rows += [(300 + i, same, rows[5][2]) for i in range(40)]  # copies
    rows += [(400, [2 * v for v in same], rows[5][2]), (401, same, 3 - rows[5][2]), (402, same, None)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] + [1.0] * 15, 1), (504, [None] + [1.0] * 15, 1), (505, [], 1), (506, [1.0, 2.0], 1), (None, same, 1)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(odd_vectors(), SCHEMA).repartition(3).cache()


def valid(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("defer", [8_192, 12])
def test_links_equal_brute_force(vectors, monkeypatch, defer):
    monkeypatch.setattr(embedding_dedup, "DEFER", defer)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 6)
    clashing = vectors.withColumns({c: F.lit("x") for c in ("rep", "n", "key", "vec", "n_links", "component_id", "kept")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(clashing).collect()}
    rows = [r for r in odd_vectors() if r[0] is not None and valid(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    reach = linked.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = np.array([r[0] for r in rows])
    for i, r in enumerate(rows):
        assert got[r[0]] == (linked[i].sum() - 1, ids[reach[i]].min())
    for i in (402, 500, 501, 502, 503, 504, 505):
        assert got[i] == (0, i)
    assert got[None] == (0, None) and len(got) == len(odd_vectors())


def test_repeated_rows_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_links_of_an_id_with_several_vectors(spark):
    e1, e2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, e1, 1), (1, e2, 1), (2, [0.0, 1.0, 0.01], 1), (3, [0.0, 1.0, 0.02], 1), (4, [0.0, 0.0, 1.0], 1), (1, e1, 2)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_sketches_part_few_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    a, noise = rng.normal(size=(20_000, 64)), rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    apart = embedding_dedup._apart(embedding_dedup._sketches(a, 5), embedding_dedup._sketches(b, 5))
    assert apart.max() <= embedding_dedup.most_bits(0.93) < 48
    others = embedding_dedup._apart(embedding_dedup._sketches(a, 5), embedding_dedup._sketches(noise, 5))
    assert (others <= embedding_dedup.most_bits(0.93)).mean() < 0.001


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_vectors(empty).count() == 0
    assert ann.search(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4_096, 16])
def test_search_against_brute_force(vectors, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "PER_LIST", 16)
    clashing = vectors.withColumns({c: F.lit("x") for c in ("score", "rank", "query_id", "list", "vec", "i", "j")})
    out = ann.search(clashing, F.col("vec_id") % 20 == 0, 20).collect()
    rows = [r for r in odd_vectors() if r[0] is not None and valid(r[1])]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(found) == sorted(queries)
    right = 0
    for q in queries:
        s = (x * x[ids == q][0]).sum(axis=1)
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got, got[1:], strict=False))
        assert all(abs(g[2] - s[ids == g[1]][0]) < 1e-12 for g in got)
        right += len({g[1] for g in got} & set(ids[best]))
    assert right / (20 * len(queries)) >= 0.9


def test_repeated_rows_of_copies_take_no_places(spark):
    rng = np.random.default_rng(3)
    twice, often = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, twice, 1) for i in range(30)] * 2  # each of 30 copies stands twice
    rows += [(100, often, 1)] * 25 + [(i, often, 1) for i in range(101, 125)]  # one id as often as k + 1 and more
    rows += [(i, [float(v) for v in 0.3 * rng.normal(size=4).astype(np.float32)], 1) for i in range(200, 230)]
    out = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    vectors = {r[0]: np.array(r[1]) for r in rows}
    ids, x = np.array(list(vectors)), np.array(list(vectors.values()))
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(found) == [i for i in ids if i % 20 == 0]
    for q, got in found.items():
        s = (x * vectors[q]).sum(axis=1)
        assert got == [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]


def test_fewer_candidates_than_asked_for(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [2.0, 0.0], 1)], SCHEMA)
    out = ann.search(few, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in out] == [(1, 2, 2.0), (2, 1, 0.5)]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(1_000, 1_400)]
    hub = [(5, i) for i in range(2_000, 2_300)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(chain[::-1] + hub + [(7, 7), (8, None)], "a long, b long")).collect()}
    assert all(got[i] == 1_000 for i in range(1_000, 1_401)) and all(got[i] == 5 for i in range(2_000, 2_300)) and 7 not in got


def test_links_that_are_others_each_time_they_are_computed(spark):
    """A task may give any links that join the same nodes, so a second computation may give others."""

    def star(batches):
        for batch in batches:
            root = int.from_bytes(os.urandom(4), "little") % 300
            yield pd.DataFrame({"a": [root] * 300, "b": range(300)})

    got = components.connected_components(spark.range(1, numPartitions=1).mapInPandas(star, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(300)]


def test_lookups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    test_components_of_chains_and_hubs(spark)


def test_vectors_near_a_border_stand_in_several_lists():
    x = np.random.default_rng(2).normal(size=(4_000, 24))
    unit = ann.augment(x, np.linalg.norm(x, axis=1).max())
    graph = ann.Graph(ann.balanced_centroids(unit, 64))
    row, at = graph.lists_for(unit, 4, 1.2)
    assert 1.2 < len(row) / len(x) <= 4 and len(set(zip(row.tolist(), at.tolist(), strict=True))) == len(row)
    found, d = graph.search(unit, 64)
    assert (np.sort(found, axis=1) == np.arange(64)).all() and np.allclose(d, np.sort(ann.distances(unit, graph.centroids), axis=1), atol=1e-3)
    asked = ann.queries(x[:50])
    row, at, nearest = graph.probes_for(asked, 1.1, 0.0)
    exact = ann.distances(asked, graph.centroids)
    within = exact <= 1.1 * exact.min(axis=1, keepdims=True)
    assert (nearest == exact.argmin(axis=1)).mean() > 0.9 and len(row) <= within.sum() + 2 and len(row) >= 0.9 * within.sum()


def test_vectors_of_other_lengths_are_searched_apart(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5)], 1) for i in range(0, 60)] + [(100 + i, [1.0, float(i % 3), float(i % 4)], 1) for i in range(30)]
    out = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    assert {r["query_id"] for r in out} == {0, 20, 40, 100, 120} and all((r["query_id"] < 100) == (r["vec_id"] < 100) for r in out) and len(out) == 100
