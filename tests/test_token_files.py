"""Token files against a plain numpy writer, byte for byte; tasks that die; parts read by ranges."""

from pathlib import Path

import numpy as np
import pytest

from quern.sources import token_files as tf

SCHEMA = "doc_id long, ids array<int>"


def plain(rows, folder, parts, kind="<u4"):
    """What numpy writes: contiguous, near-equal numbers of documents, larger parts first."""
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0]))
    parts = max(1, min(parts, len(rows)))
    for i, own in enumerate(np.array_split(np.arange(len(rows)), parts)):
        ids = [np.asarray(rows[k][1], kind) for k in own]
        np.concatenate([*ids, np.zeros(0, kind)]).astype(kind).tofile(folder / f"train-part-{i + 1}-of-{parts}.bin")
        np.array([*(len(x) for x in ids), len(ids)], kind).tofile(folder / f"train-part-{i + 1}-of-{parts}.idx")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    return [(int(i), rng.integers(0, 60_000, rng.integers(0, 40)).tolist()) for i in rng.permutation(300)] + [(1_000, None), (1_001, [])]


@pytest.mark.parametrize("dtype", ["uint32", "uint16"])
@pytest.mark.parametrize("parts", [1, 7, 1_000])
def test_files_equal_numpy(spark, rows, tmp_path, parts, dtype):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    tf.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "a"), parts=parts, dtype=dtype)
    plain(rows, tmp_path / "b", parts, tf.KINDS[dtype])
    want = {p.name: p.read_bytes() for p in (tmp_path / "b").iterdir()}
    assert {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir() if p.suffix in (".bin", ".idx")} == want
    assert not (tmp_path / "a" / "_temporary").exists()


def test_reads_by_ranges(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    back = tf.write_token_files(spark.createDataFrame(rows, SCHEMA), folder, docs_per_part=120)
    kept = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])
    assert [r["ids"] for r in back.orderBy("part", "doc").collect()] == [r[1] for r in kept]
    one = tf.examples(spark, folder, 16).orderBy("part", "example").collect()
    many = tf.examples(spark, folder, 16, task_tokens=64)
    assert many.rdd.getNumPartitions() > 30 and many.orderBy("part", "example").collect() == one
    for part in range(3):
        stream = [x for _, ids in kept[120 * part : 120 * (part + 1)] for x in ids]
        own = [r for r in one if r["part"] == part]
        assert len(own) == (len(stream) - 1) // 16
        assert [x for r in own for x in r["inputs"]] == stream[: 16 * len(own)] and [x for r in own for x in r["targets"]] == stream[1 : 16 * len(own) + 1]


def test_repeated_and_null_keys(spark, tmp_path):
    rows = [(1, [1, 2, 3]), (1, [7, 8, 9]), (None, [5]), (None, [5]), (1, [1, 2, 3])]
    back = tf.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "t"), parts=5)
    got = [r["ids"] for r in back.orderBy("part", "doc").collect()]
    assert got[:2] == [[5], [5]] and sorted(got[2:]) == [[1, 2, 3], [1, 2, 3], [7, 8, 9]]


def test_a_killed_task_leaves_no_file(spark, rows, tmp_path):
    folder = tmp_path / "t"
    df = spark.createDataFrame(rows, SCHEMA)
    tf.write_token_files(df, str(folder), parts=3)
    before = {p.name: p.read_bytes() for p in Path(folder).iterdir()}
    with pytest.raises(Exception, match="uint16"):
        tf.write_token_files(df.unionByName(spark.createDataFrame([(2_000, [1 << 17])], SCHEMA)), str(folder), parts=4, dtype="uint16")
    assert {p.name: p.read_bytes() for p in Path(folder).iterdir()} == before


def test_an_attempt_that_was_repeated_counts_once(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1], pa.int32()), pa.array([[1, 2], [3], [4]], pa.list_(pa.int32()))], names=["part", "ids"])
    writer = tf._Writer({"path": str(tmp_path), "parts": "2"}, True)
    writer.write(iter([batch]))  # its message never arrives
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"train-part-{i}-of-2.{k}" for i in (1, 2) for k in ("bin", "idx")]
    assert np.fromfile(tmp_path / "train-part-1-of-2.bin", "<u4").tolist() == [1, 2, 3]
    with pytest.raises(RuntimeError):
        writer.commit([writer.write(iter([batch])), writer.write(iter([batch]))])
    assert np.fromfile(tmp_path / "train-part-1-of-2.bin", "<u4").tolist() == [1, 2, 3]


def test_nothing_to_write(spark, tmp_path):
    assert tf.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), parts=3).count() == 0
    assert tf.examples(spark, str(tmp_path / "t"), 8).count() == 0


def test_a_task_reads_many_small_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i] * (i % 5 + 3)) for i in range(400)], "doc_id long, ids array<int>")
    back = tf.write_token_files(rows, str(tmp_path), docs_per_part=2)
    made = tf.examples(spark, str(tmp_path), 4)
    most = 8 * spark.sparkContext.defaultParallelism
    assert back.rdd.getNumPartitions() <= most < 200 and made.rdd.getNumPartitions() <= most
    assert [(r["part"], r["doc"], r["ids"]) for r in back.orderBy("part", "doc").collect()] == [(i // 2, i % 2, [i] * (i % 5 + 3)) for i in range(400)]
    laid = [[i] * (i % 5 + 3) + [i + 1] * ((i + 1) % 5 + 3) for i in range(0, 400, 2)]
    told = [(p, e, x[e * 4 : e * 4 + 4], x[e * 4 + 1 : e * 4 + 5]) for p, x in enumerate(laid) for e in range((len(x) - 1) // 4)]
    assert [tuple(r) for r in made.orderBy("part", "example").collect()] == told
