"""Rows of one key with different texts, repeated rows and null keys, in what joins by document."""

import numpy as np
import pytest

from quern.operators import contamination, dedup, gram_index, hash_filter
from quern.operators import training_examples as examples

DOCS = "doc_id long, text string"
ROWS = [(1, "a b c d e f tail"), (1, "q r s t k l m clean"), (None, "x a b c d e f"), (None, "nothing here"), (1, "a b c d e f tail"), (2, None)]


@pytest.fixture(scope="module")
def grams(spark):
    return contamination.benchmark_grams(spark.createDataFrame([(9, "a b c d e f")], "item_id long, text string"), 4)


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination(spark, grams, monkeypatch, most):
    for module in (contamination, dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame(ROWS, DOCS)
    found = contamination.hits(docs, grams)
    spans = contamination.contaminated_spans(docs, found)
    assert sorted(((r["doc_id"], r["start"], r["end"]) for r in spans.collect()), key=str) == [(1, 0, 11), (None, 2, 13)]
    got = contamination.decontaminate(docs, spans, threshold=2.0, replacement="#")
    assert sorted(((r["doc_id"], r["text"], r["contaminated"]) for r in got.collect()), key=str) == sorted(
        [(1, "# tail", True), (1, "# tail", True), (1, "q r s t k l m clean", False), (None, "x #", True), (None, "nothing here", False), (2, None, False)], key=str
    )


@pytest.mark.parametrize("most", [500_000, 0])
def test_exact_copies(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", most)
    rows = [(None, "a"), (5, "q"), (5, "r"), (4, "q"), (None, "z"), (7, "z"), (8, "s"), (8, "s"), (9, None), (10, None), (None, "n"), (None, "n")]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    want = sorted([(None, "a"), (4, "q"), (5, "r"), (7, "z"), (8, "s"), (9, None), (None, "n")], key=str)
    assert sorted((tuple(r) for r in dedup.first_copies(df).collect()), key=str) == want
    assert dedup.first_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_lines_go(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", most)
    rows = [(1, "a\nb"), (1, "a\nb"), (2, None), (3, " b \nc\n"), (4, "b"), (None, "b\nd"), (5, "")]
    out = dedup.without_lines(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("b",), (None,)], "line string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "a"), (1, "a"), (2, None), (3, "c\n"), (4, ""), (None, "d"), (5, "")], key=str)


def test_packing(spark):
    rows = [(1, [1, 2, 3, 0]), (1, [7, 8, 9, 0]), (2, [4, 5, 0])]
    out = examples.pack_stream(spark.createDataFrame(rows, "doc_id long, ids array<int>"), 2, 1_000_000).orderBy("example").collect()
    stream = [x for r in out for x in r["inputs"]]
    assert stream in ([1, 2, 3, 0, 7, 8, 9, 0, 4, 5], [7, 8, 9, 0, 1, 2, 3, 0, 4, 5])
    assert [x for r in out for x in r["targets"]] == [*stream[1:], 0]


def test_stored_grams(spark, tmp_path, grams):
    folder = str(tmp_path)
    first = gram_index.store_grams(grams, folder, buckets=4)
    written = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    spark.sql(f"DROP TABLE {gram_index._table(first.version)}")  # as in a new session
    again = gram_index.store_grams(grams, folder, buckets=4)
    assert again.version == first.version and {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == written
    other = contamination.benchmark_grams(spark.createDataFrame([(9, "a b c d e f"), (10, "k l m n")], "item_id long, text string"), 4)
    assert gram_index.store_grams(other, folder, buckets=4).version != first.version and len(gram_index.versions(spark, folder)) == 2
    (tmp_path / "0-broken" / "manifest").mkdir(parents=True)
    assert len(gram_index.versions(spark, folder)) == 2
    docs = spark.createDataFrame(ROWS, DOCS)
    key = lambda r: str(tuple(r))
    assert sorted(contamination.hits(docs, again).collect(), key=key) == sorted(contamination.hits(docs, grams).collect(), key=key)


def test_no_exchange_of_a_row_per_token(spark, tmp_path):
    """Millions of grams meet documents: of the join, only what passed the filter is shuffled; the grams' side isn't."""
    from pyspark.sql import functions as F

    many = spark.range(3_000_000).select(F.lit(1).alias("item_id"), F.lit(0).alias("pos"), F.lit(4).alias("n"), F.concat_ws(" ", F.col("id"), F.col("id") + 1, F.col("id") + 2, F.col("id") + 3).alias("gram"))
    index = gram_index.store_grams(many, str(tmp_path), buckets=4)
    assert index.filter.expected < 0.02
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.when(F.col("id") % 50 == 0, i + F.col("id")).otherwise(i * 7 + F.col("id") * 1_000_003).cast("string")), " ").alias("text"))
    hashed = docs.select("doc_id", contamination.digest("text"), contamination.let(contamination.tokens(F.col("text")), contamination._run_hashes(4)).alias("h4"))
    met = contamination.suspects(hashed, index, "doc_id")
    tokens = 200 * 198
    assert 4 * 198 <= met.count() < 4 * 198 + 0.04 * tokens
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = met.drop("n").join(index.rows, "hash")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and any("MapInArrow" in x for x in lines[exchanges[0] : exchanges[0] + 4]), plan  # only the suspects move
    assert sorted(r["doc_id"] for r in contamination.contaminated_documents(docs, index).collect()) == [0, 50, 100, 150]


def test_filter_lets_all_of_its_own_through(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    found = hash_filter.hash_filter(df, "h", 20_000)
    assert hash_filter.passing(df, F.col("h"), found).count() == 20_000
    others = spark.range(100_000, 200_000).select(F.xxhash64("id").alias("h"))
    assert hash_filter.passing(others, F.col("h"), found).count() <= 100_000 * found.expected * 1.5


@pytest.mark.parametrize("most", [500_000, 0])
def test_texts_of_copies_are_not_sorted(spark, monkeypatch, most):
    """Each row several times: one of each text is left, by a plan that neither sorts nor shuffles texts."""
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", most)
    df = spark.range(40_000).selectExpr("id % 1000 AS doc_id", "concat('text ', id % 900) AS text", "id % 3 AS more")
    out = dedup.first_copies(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("SortMergeJoin", "SortAggregate", "hashpartitioning") if x in plan], plan
    least = {}
    for i in range(40_000):
        least[f"text {i % 900}"] = min(i % 1_000, least.get(f"text {i % 900}", i))
    assert {r["text"]: r["doc_id"] for r in out.collect()} == least and out.count() == len(least)


def test_runs_are_hashed_from_their_tokens(spark):
    """Each token is hashed once, whatever the lengths of grams; runs in arrays have the hashes of grams, and none reaches into the next text."""
    from pyspark.sql import functions as F

    texts = [(1, "a b c d e a b"), (2, ""), (3, None), (4, "c"), (5, "a a a a a a"), (6, "É b Ünïcode b b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = contamination.tokens(F.col("text"))
    for n in (1, 2, 3, 13, 70):
        for r in docs.select(F.transform(words, lambda w: F.xxhash64(w)).alias("t"), contamination.let(words, contamination._run_hashes(n)).alias("h")).collect():
            assert gram_index.run_hashes(np.array(r["t"] or [], np.int64), n).tolist() == (r["h"] or [])
    every = contamination.benchmark_grams(docs.unionByName(spark.createDataFrame([(7, "b c a")], docs.schema)).withColumnRenamed("doc_id", "item_id"), 2).unionByName(
        contamination.benchmark_grams(spark.createDataFrame([(8, "d e a"), (9, "a b c")], "item_id long, text string"), 3)
    )
    found = contamination.hits(docs, every).select("doc_id", "pos", "n", "gram").collect()
    expected = {(k, i, n, " ".join(w[i : i + n])) for k, t in texts for w in [(t or "").lower().split()] for n in (2, 3) for i in range(len(w) - n + 1) if n == 2 or w[i : i + n] in (["d", "e", "a"], ["a", "b", "c"])}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    plan = contamination.suspects(docs.select("doc_id", contamination.digest("text"), F.transform(words, lambda w: F.xxhash64(w)).alias("tokens")), gram_index.passing_grams(every), "doc_id")
    assert "slice(" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() >= len(expected)
