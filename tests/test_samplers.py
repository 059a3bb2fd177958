"""Epoch orders are permutations, ranks partition them, reruns agree."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import samplers as S


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3_000), st.integers(0, 5), st.integers(0, 5))
def test_places_are_a_permutation(n, seed, epoch):
    keys = S.round_keys(seed, epoch)
    places = S.permuted(np.arange(n), n, keys)
    assert sorted(places.tolist()) == list(range(n))
    a, b = S.bases(n)
    assert n <= a * b < n + a + 1


def test_orders_are_mixed():
    n = 20_000
    one, other = (S.permuted(np.arange(n), n, S.round_keys(1, e)) for e in (0, 1))
    for x, y in ((np.arange(n), one), (one, other)):
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.03 and (x == y).sum() < 10
    halves = np.histogram2d(np.arange(n), one, bins=10)[0]
    assert halves.min() > 140 and halves.max() < 260
    assert S.permuted(np.array([2**50, 5]), 2**51, S.round_keys(0, 0)).max() < 2**51


@pytest.mark.parametrize(("n", "world"), [(10, 3), (9, 3), (2, 5), (1, 4), (0, 2)])
@pytest.mark.parametrize("shuffle", [True, False])
def test_ranks_partition_the_rows(spark, n, world, shuffle):
    df = spark.range(n).withColumnRenamed("id", "doc_id").repartition(3)
    rows = S.rank_samples(df, world, "doc_id", epoch=1, shuffle=shuffle).collect()
    each = -(-n // world)
    assert sorted((r["rank"], r["step"]) for r in rows) == [(k, s) for k in range(world) for s in range(each)]
    if n:
        counts = np.bincount([r["doc_id"] for r in rows], minlength=n)
        assert counts.max() - counts.min() <= 1 and counts.min() >= 1
    if not shuffle:
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["step"], r["rank"]))] == [i % n for i in range(each * world)]
    dropped = S.rank_samples(df, world, "doc_id", epoch=1, shuffle=shuffle, drop_last=True).collect()
    assert sorted((r["rank"], r["step"]) for r in dropped) == [(k, s) for k in range(world) for s in range(n // world)]
    assert len({r["doc_id"] for r in dropped}) == len(dropped)


def test_epochs_differ_and_reruns_agree(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    one, again, other = ([r["place"] for r in S.epoch_order(df.repartition(k), "doc_id", epoch=e).orderBy("doc_id").collect()] for k, e in ((2, 0), (7, 0), (2, 1)))
    assert one == again != other and sorted(one) == list(range(500))
