from quern.streaming import incremental


def test_grams_go_on_where_they_stopped(spark):
    rows = spark.createDataFrame([(0, ["1", "2", "3"]), (1, ["4", "5", "6", "7"]), (2, ["8", "9", "10", "11"]), (3, ["12"]), (4, ["13"])], "line int, ngrams array<string>")
    assert [r["ngrams"] for r in incremental.remaining_grams(rows, 11, "line").orderBy("line").collect()] == [["12"], ["13"]]


def test_streamed_windows_equal_batch_windows(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = incremental.read_stream(spark, f"{tmp_path}/in", batch.schema)
    q = incremental.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("w")) == key(incremental.windowed_counts(batch, "1 day"))


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    """A batch that is killed after its rows were written, or after its entry was, gives no row twice when it runs again."""
    import pytest

    from quern.operators import contamination
    from quern.streaming.ledger import Ledger

    schema = "doc_id long, text string"
    grams = contamination.benchmark_grams(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), 3)
    for i in range(3):
        spark.createDataFrame([(i, "x a b c d"), (10 + i, "clean text")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    run = lambda: incremental.decontaminate_stream(spark, f"{tmp_path}/in/*", schema, grams, f"{tmp_path}/out", f"{tmp_path}/state", 1).awaitTermination()
    ledger, real, calls = Ledger(spark, f"{tmp_path}/out"), Ledger.position, []

    def killed(self):  # after the first batch, once its successor's rows are about to be noted
        calls.append(1)
        if len(calls) == 2:
            spark.createDataFrame([(99, 0, 0, 1, "half written")], incremental.HITS).write.parquet(f"{tmp_path}/out/batch=1")
            raise RuntimeError("killed")
        return real(self)

    monkeypatch.setattr(Ledger, "position", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    assert ledger.committed() == [0]
    monkeypatch.setattr(Ledger, "position", real)
    run()
    run()
    assert ledger.committed() == [0, 1, 2] and ledger.position() == 6
    assert sorted((r["doc_id"], r["pos"]) for r in ledger.found(incremental.HITS).collect()) == [(i, p) for i in range(3) for p in (1, 2)]
    assert not ledger.commit(2, spark.createDataFrame([(5, "a b c d")], schema), lambda new: contamination.hits(new, grams))
    documents, found, position = incremental.search_state(ledger)
    assert position == 6 and documents.count() == 3 and {r["gram"]: r["documents"] for r in found.collect()} == {"a b c": 3, "b c d": 3}


def test_a_batch_of_streamed_grams_is_searched_by_all_cores(spark, sf, monkeypatch):
    from pathlib import Path

    from quern.plans import corpus_catalog

    asked, search = [], incremental.decontaminate_stream
    monkeypatch.setattr(incremental, "decontaminate_stream", lambda spark, path, *rest: asked.append((path, rest[-1])) or search(spark, path, *rest))
    found = corpus_catalog.streamed_grams(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    assert found.first()["position"] == spark.read.parquet(f"{sf}/documents.parquet").count()
    path, files = asked[0]
    assert files >= spark.sparkContext.defaultParallelism > 1
    assert len(list(Path(path.removeprefix("file:")).glob("*.parquet"))) == 3 * files
