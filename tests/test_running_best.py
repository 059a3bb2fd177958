"""The running best by ranges against a plain loop."""

import random

import pytest

from quern.functions import scoring


def plain(rows, lower, patience):
    out, state = [], {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        best, since = state.get(g, (None, 0))
        better = v is not None and (best is None or (v < best if lower else v > best))
        best, since = (v, 0) if better else (best, 0 if best is None else since + 1)
        state[g] = (best, since)
        out.append((g, o, v, best, since, since >= patience))
    return out


@pytest.mark.parametrize("lower", [True, False])
def test_by_ranges(spark, lower):
    rng = random.Random(lower)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, float(rng.randint(0, 400)), float(rng.randint(300, 400))])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = scoring.running_best(df, "v", "o", ["g"], 20, lower)
        key = lambda r: (str(r[0]), r[1])
        assert sorted((tuple(r) for r in got.select("g", "o", "v", "best", "since_best", "stop").collect()), key=key) == sorted(plain(rows, lower, 20), key=key)
        whole = scoring.running_best(df.drop("g"), "v", "o", (), 20, lower)
        assert [r["since_best"] for r in whole.orderBy("o").collect()] == [x[4] for x in plain([(0, o, v) for _, o, v in rows], lower, 20)]
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert scoring.running_best(df.limit(0), "v", "o", ["g"]).count() == 0
