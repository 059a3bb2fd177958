"""zstd files frame by frame; table functions; the mergeable sketch."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from quern.functions import table_functions as T
from quern.sources import documents, zstd_frames


def written(path, text, sizes, rng, streamed=False):
    raw, at = b"", 0
    while at < len(text):
        n = rng.choice(sizes)
        compressor = zstandard.ZstdCompressor(write_checksum=rng.random() < 0.5, write_content_size=rng.random() < 0.5)
        raw += compressor.compress(text[at : at + n])
        if rng.random() < 0.2:
            raw += (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"extra"
        at += n
    path.write_bytes(raw)


@pytest.mark.parametrize("end", [b"", b"\n"])
def test_lines_across_frames(spark, tmp_path, end):
    rng = random.Random(len(end))
    want = {}
    for name, sizes in (("a", [3, 40, 700]), ("b", [100_000]), ("c", [1, 2, 5])):
        lines = [("é" * rng.choice([0, 1, 5, 60]) + str(i)).encode() for i in range(60 if name == "c" else 400)]
        written(tmp_path / f"{name}.jsonl.zst", b"\n".join(lines) + end, sizes, rng)
        want[name] = [x.decode() for x in lines]
    (tmp_path / "empty.jsonl.zst").write_bytes(b"")
    rows = zstd_frames.lines(spark, f"{tmp_path}/*.zst", 200).collect()
    for name, lines in want.items():
        own = sorted((r["line_num"], r["value"]) for r in rows if r["path"].endswith(f"/{name}.jsonl.zst"))
        assert own == list(enumerate(lines))
    assert len(rows) == sum(map(len, want.values()))


def test_frames_go_to_several_tasks(spark, tmp_path):
    rng = random.Random(0)
    written(tmp_path / "a.jsonl.zst", b"".join(b'{"id": %d}\n' % i for i in range(30_000)), [20_000], rng)
    lines = zstd_frames.lines(spark, f"{tmp_path}/a.jsonl.zst", 2_000)
    by = lines.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by) > 1 and sum(r["count"] for r in by) == 30_000
    read = documents.read_jsonl(spark, f"{tmp_path}/a.jsonl.zst", "id long", ordinals=True)
    assert read.filter("id = line_num").count() == 30_000


def test_broken_files_fail(spark, tmp_path):
    raw = zstandard.ZstdCompressor().compress(bytes(random.Random(0).randbytes(5_000)))
    for i, bad in enumerate((raw[:-20], b"plain text", raw + b"xx")):
        (tmp_path / f"{i}.zst").write_bytes(bad)
        with pytest.raises(Exception, match="zstd|Zstd"):
            zstd_frames.lines(spark, f"{tmp_path}/{i}.zst").count()


def test_table_functions(spark):
    T.register(spark)
    spark.createDataFrame([(1, "aa\n\nbb\n\ncc", "x"), (2, None, "y"), (3, "", "z"), (4, "dd", None)], "k int, body string, tag string").createOrReplaceTempView("texts_in")
    rows = spark.sql(r"SELECT * FROM chunks(TABLE(texts_in), 3, 'body', '\n\n') ORDER BY k, chunk").collect()
    assert [tuple(r) for r in rows] == [(1, "aa\n\nbb", "x", 1, 2), (1, "cc", "x", 2, 2), (4, "dd", None, 1, 1)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM chunks(TABLE(texts_in), 3, 'text', ',')").collect()
    spark.createDataFrame([(1, 0, 5, "a"), (1, 6, 9, "b"), (1, 11, 12, "c"), (2, 3, 4, "d"), (1, 2, 3, "e")], "k int, start int, end int, note string").createOrReplaceTempView("spans_in")
    rows = spark.sql("SELECT * FROM merged_spans(TABLE(spans_in) PARTITION BY k ORDER BY start)").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 9, "a"), (1, 11, 12, "c"), (2, 3, 4, "d")]


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") % 9_000).alias("v")).repartition(6)
    want = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    exact = {r["g"]: r["n"] for r in T.smallest_hashes(df, ["g"], F.col("v"), 20_000).select("g", T.distinct_estimate(F.col("hashes"), 20_000).alias("n")).collect()}
    assert exact == want
    rough = {r["g"]: r["n"] for r in T.smallest_hashes(df, ["g"], F.col("v"), 512).select("g", T.distinct_estimate(F.col("hashes"), 512).alias("n")).collect()}
    assert all(abs(rough[g] - n) < 0.2 * n for g, n in want.items())
    nulls = spark.createDataFrame([("a", None), ("b", 1.5), (None, 2.5)], "g string, v double")
    assert {r["g"]: len(r["hashes"]) for r in T.smallest_hashes(nulls, ["g"], F.col("v")).collect()} == {"a": 0, "b": 1, None: 1}
    assert len(T.smallest_hashes(df, [], F.col("v"), 100).first()["hashes"]) == 100


def test_documents_go_to_a_file_for_each_range(spark, sf, tmp_path, monkeypatch):
    from quern.plans import corpus_catalog

    monkeypatch.setattr(corpus_catalog, "_folder", lambda name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = corpus_catalog.zstd_frames(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]
    assert sorted((r["line_num"], r["doc_id"]) for r in rows) == list(enumerate(ids))
    assert len([p for p in tmp_path.glob("zstd/*.zst") if p.stat().st_size]) > 1


def test_batches_of_long_lines_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zstd_frames, "BATCH", 2_000_000)
    written(tmp_path / "a.zst", b"".join(b"%d" % i * 300_000 + b"\n" for i in range(10)), [500_000], random.Random(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        sizes = zstd_frames.lines(spark, f"{tmp_path}/a.zst").mapInArrow(lambda batches: (b.select(["line_num"]) for b in batches), "line_num long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["line_num"] for r in sizes) == list(range(10))
