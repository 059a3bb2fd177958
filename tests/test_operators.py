import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import cleaning, scoring
from quern.functions.predicates import compiled
from quern.operators import chat, curation
from quern.operators import training_examples as examples
from quern.plans import catalog, pipeline
from quern.sources import documents


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"s{i % 3}", "x" if i % 2 else None, float(i)) for i in range(20)], "doc_id long, source string, tag string, score double")


def test_predicates_are_two_valued(rows):
    assert rows.filter(compiled('.tag == "x"')).count() + rows.filter(~compiled('.tag == "x"')).count() == 20
    assert rows.filter(compiled("$[?(@.score > 3 & @.score <= 5)]")).count() == 2
    assert rows.filter(compiled('(.source == "s1" or .source == "s2") and not .score < 10')).count() == 7
    with pytest.raises(ValueError):
        compiled("@@ nonsense")


def test_route_takes_the_first_match_and_drops_others(rows):
    out = curation.route(rows, {"low": ".score < 5", "mid": ".score < 10"})
    assert {r["group"]: r["n"] for r in out.groupBy("group").agg(F.count("*").alias("n")).collect()} == {"low": 5, "mid": 5}


def test_sampling_keeps_the_first(rows):
    assert [r["doc_id"] for r in curation.first_k(rows, {"s0": 2, "s2": 1, "none": 4}, "source", ["doc_id"]).orderBy("doc_id").collect()] == [0, 2, 3]


def test_split_sizes_correct_for_too_few():
    assert curation.split_sizes({"dev": 10, "test": 10, "train": None}, 100, 100.0, 1) == {"dev": 10, "test": 10, "train": None}
    assert curation.split_sizes({"dev": 10, "test": 10}, 100, 100.0, 1, available=15) == {"dev": 7, "test": 8}


def test_splits_partition_the_rows(rows):
    out = curation.assign_splits(rows, {"dev": 3, "test": 4, "train": None})
    assert out.count() == 20 and {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"dev": 3, "test": 4, "train": 13}
    assert curation.assign_splits(rows, {"dev": 3}).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .\n", max_size=12), max_size=8), st.integers(1, 12))
def test_chunks_keep_paragraphs_and_sizes(paragraphs, least):
    text = "\n\n".join(paragraphs)
    chunks = curation.chunks_of(text, least, "\n\n")
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(chunks)) == squeeze(text)
    assert all(sum(c in "ab" for c in x) >= least for x in chunks[:-1])


def test_packing_keeps_every_whole_token(spark):
    rows = [(i, list(range(100 * i, 100 * i + 3 + i * 2))) for i in range(12)]
    out = examples.pack_stream(spark.createDataFrame(rows, "doc_id long, ids array<int>"), 10, 1_000_000).orderBy("example").collect()
    stream = [x for _, ids in rows for x in ids]
    assert len(out) == (len(stream) - 1) // 10
    assert [x for r in out for x in r["inputs"]] == stream[: len(out) * 10]
    assert [x for r in out for x in r["targets"]] == stream[1 : len(out) * 10 + 1]
    owners = [i for i, (_, ids) in enumerate(rows) for _ in ids]
    assert [x for r in out for x in r["doc_ids"]] == owners[: len(out) * 10]


def test_labels_mask_all_but_the_assistant(spark):
    talk = spark.createDataFrame([(1, 0, "user", "hi you"), (1, 1, "assistant", "yes sir"), (2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    row = chat.labels(talk).filter("conv_id = 1").first()
    assert [x for x in row["labels"] if x != "-100"] == ["yes", "sir", "<|endoftext|>", "\n"] or [x for x in row["labels"] if x != "-100"][:2] == ["yes", "sir"]
    assert len(row["inputs"]) == len(row["labels"])
    assert chat.loss_counts(talk).count() == 1
    assert chat.render(talk, prompt=True).filter("conv_id = 2").first()["rendered"] == "<|user|>\nx<|endoftext|>\n<|assistant|>\n"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_best(n, m, seed):
    from itertools import permutations

    gain = np.random.default_rng(seed).integers(0, 5, (n, m)) / 4
    pairs = scoring.best_assignment(gain)
    a, b = (gain, m) if n <= m else (gain.T, n)
    best = max(sum(a[i, j] for i, j in enumerate(p)) for p in permutations(range(b), min(n, m)))
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
    assert abs(sum(gain[i, j] for i, j in pairs) - best) < 1e-9


def test_answers_are_normalised(spark):
    assert cleaning.number_aware("The 5 well-known, (Cats)!") == "5.0 well known cats"
    df = spark.createDataFrame([("The_Cat's  hat, an apple",)], "t string")
    assert df.select(cleaning.normal_answer(F.col("t"))).first()[0] == "cat s hat apple"
    assert scoring.spans_score(["5", "cat"], ["cat", "5.0"]) == (1.0, 1.0)
    assert scoring.spans_score(["6"], ["5"]) == (0.0, 0.0)


def test_cleaning(spark):
    df = spark.createDataFrame([("Is it so _ ?", "a b c d", "a x c")], "q string, s string, t string")
    row = df.select(cleaning.cut_question(F.col("q")), cleaning.word_difference("s", "t"), cleaning.split_context(F.lit("ab  "), F.lit("c"))["continuation"], cleaning.compound_extension(F.lit("a/b.c.json.gz"))).first()
    assert row[0] == "Is it so" and row[1] == "a _ c _" and row[2] == "  c" and row[3] == ".c.json.gz"


def test_jsonl_round_trips(spark, tmp_path):
    import zstandard

    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, text string")
    counts = documents.compact(df.coalesce(1), f"{tmp_path}/out", 3)
    assert counts.agg(F.sum("num_docs"), F.max("num_docs")).first()[:] == (7, 3)
    assert documents.read_jsonl(spark, f"{tmp_path}/out", "id int, text string").count() == 7
    (tmp_path / "a.jsonl.zstd").write_bytes(zstandard.compress(b'{"id": 1, "m": {"u": "x"}}\n{"id": 2, "m": null}\n'))
    read = documents.read_jsonl(spark, f"{tmp_path}/a.jsonl.zstd", ordinals=True)
    bound = documents.bind(read, {"id": "id", "u": "m.u", "source": None}, defaults={"source": F.lit("s"), "u": F.lit("none")})
    assert [(r["line_num"], r["id"], r["u"], r["source"]) for r in bound.orderBy("line_num").collect()] == [(0, "1", "x", "s"), (1, "2", "none", "s")]


def test_token_binaries(spark, tmp_path):
    encoded = spark.createDataFrame([(i, list(range(i, i + 5))) for i in range(4)], "doc_id long, ids array<int>")
    packed = documents.write_token_binaries(encoded.coalesce(1), f"{tmp_path}/bin")
    made = documents.binary_examples(packed, 4).collect()
    assert all(r["inputs"][1:] == r["targets"][:-1] for r in made)
    assert sum(len(np.frombuffer(r["tokens"], "<u4")) for r in packed.collect()) == 20


def test_declared_pipelines(tmp_path, rows):
    (tmp_path / "base.yaml").write_text("substitutions:\n  low: 5\n")
    (tmp_path / "main.yaml").write_text('include: base.yaml\npipeline:\n  - id: document_filter\n    args: {exclude: [".score < $low"]}\n  - id: remove_json_keys\n    call_kwargs: {keys_to_remove: [tag]}\n')
    config = pipeline.load(tmp_path / "main.yaml")
    out = pipeline.run(config, rows)
    assert out.count() == 15 and "tag" not in out.columns
    with pytest.raises(KeyError):
        pipeline.run({"pipeline": [{"id": "unknown"}]}, rows)
    with pytest.raises(ValueError):
        pipeline.step("grouper")(lambda df: df)
    assert pipeline.overridden({"a": {"b": 1}}, ["--a.b", "2"]) == {"a": {"b": 2}}


def plain_spans(predicted, gold):
    """(exact, F1) by trying every pairing."""
    p, g = [cleaning.number_aware(x) for x in predicted], [cleaning.number_aware(x) for x in gold]
    number = lambda w: cleaning.as_number(w) is not None

    def gain(a, b):
        a, b = set(a.split()), set(b.split())
        if any(map(number, a)) and not any(number(w) for w in a & b):
            return 0.0
        return scoring.set_f1(b, a)

    n = max(len(p), len(g))
    square = [[gain(g[i], p[j]) if i < len(g) and j < len(p) else 0.0 for j in range(n)] for i in range(n)]
    best = max(sum(square[i][j] for i, j in enumerate(order)) for order in itertools.permutations(range(n)))
    return float(set(p) == set(g) and len(p) == len(g)), best / n


SPANS = st.lists(st.sampled_from(["cat", "dog", "the", "", "5", "5.0", "cat-dog", "dog\ncat", "cat 5", "dog 6 cat", "6", "."]), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(SPANS, SPANS)
def test_spans_score_equals_every_pairing(predicted, gold):
    exact, f1 = scoring.spans_score(predicted, gold)
    want = plain_spans(predicted, gold)
    assert exact == want[0] and abs(f1 - want[1]) <= 0.005 + 1e-9


def test_spans_score_reads_whole_turns(spark, tmp_path):
    talks = [
        ["one two three four five six", "one two three four seven eight"],
        ["one two three four five six", "six five four three two one"],
        ["a b", "c the d-e 5", "5.0 d e"],
        ["", "x"],
    ]
    rows = [(c, t, "user", text) for c, texts in enumerate(talks) for t, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): (r["exact"], r["f1"]) for r in catalog.QUERIES["spans_score"](spark, str(tmp_path)).collect()}
    want = {(c, t): plain_spans(a.split(" "), b.split(" ")) for c, texts in enumerate(talks) for t, (a, b) in enumerate(zip(texts, texts[1:], strict=False))}
    assert set(got) == set(want) and got[0, 0] == (0.0, 0.67) and got[1, 0] == (1.0, 1.0)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 0.005 + 1e-9 for k in want)


def test_text_cleaning_keeps_questions(spark, tmp_path):
    texts = ["Who is it?", "Is it 5?", "a  ?", "all of  the rest.", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["question"], r["stopped"], r["last"]) for r in catalog.QUERIES["text_cleaning"](spark, str(tmp_path)).collect()}
    want = [("Who is it?", "Who is it?", "it?"), ("Is it", "Is it 5?", "5?"), ("a  ?", "a  ?", "?"), ("all of  the rest", "all of  ", "rest."), (None, None, None)]
    assert got == dict(enumerate(want))


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f'{{"id": {i}}}' if i % 5 else "" for i in range(4_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"id": 9}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = documents.read_jsonl(spark, f"{tmp_path}/*.jsonl", "id long", ordinals=True)
        assert got.rdd.getNumPartitions() > 3
        found = {(r["path"][-7:], r["line_num"]): r["id"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {**{("a.jsonl", i): i for i in range(4_000) if i % 5}, ("b.jsonl", 0): 9}


def test_counts_follow_proportions():
    counts = curation.proportional_counts({"a": 10, "b": 90}, {"a": 1.0, "b": 2.0})
    assert counts == {"a": 33, "b": 67}
    assert curation.proportional_counts({"a": 10}, {"a": 1.0, "b": 1.0}, 5) == {"a": 3, "b": 2} and curation.proportional_counts({}, {}) == {}


@pytest.mark.parametrize("per", ["source", None])
def test_large_groups_split_as_small_ones(spark, per):
    rows = spark.createDataFrame([(i, "hot" if i % 10 else None if i % 20 else "cold") for i in range(1_000)], "doc_id long, source string")
    out = curation.assign_splits(rows, {"dev": 7, "test": 5, "train": None}, per=per)
    counts = {(r["source"] if per else 0, r["split"]): r["count"] for r in out.groupBy(*([per] if per else []), "split").count().collect()}
    assert counts == ({("hot", "dev"): 7, ("hot", "test"): 5, ("hot", "train"): 888, (None, "dev"): 7, (None, "test"): 5, (None, "train"): 38, ("cold", "dev"): 7, ("cold", "test"): 5, ("cold", "train"): 38} if per else {(0, "dev"): 7, (0, "test"): 5, (0, "train"): 988})


def test_best_threshold_is_that_of_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(round(float(rng.uniform()), 2), float(rng.integers(0, 3)) / 2, bool(rng.integers(0, 4) > 0)) for _ in range(300)]
    best, at, now = 0.0, 0.0, 0.0
    for doubt in sorted({r[0] for r in rows}):
        now += sum(r[1] if r[2] else -1.0 for r in rows if r[0] == doubt)
        if now > best:
            best, at = now, doubt
    got = scoring.best_threshold(spark.createDataFrame(rows, "doubt double, score double, has_answer boolean")).first()
    assert abs(got["best"] - 100 * (best + sum(not r[2] for r in rows)) / len(rows)) < 1e-9 and got["threshold"] == at


def test_open_cells_equal_the_masks(spark, monkeypatch):
    rows = [([0, 0, 1, 1, 1],), ([3, 1, 3],), ([2] * 4,), ([],), (None,), ([1, 2, 1],)]
    df = spark.createDataFrame(rows, "doc_ids array<int>")
    monkeypatch.setattr(examples, "CELLS", 9)
    mask = F.flatten(examples.boundary_mask(F.col("doc_ids")))
    out = df.select(examples.open_cells(F.col("doc_ids")).alias("n"), F.size(F.filter(mask, lambda x: x)).alias("want"), "doc_ids").collect()
    assert [r["n"] for r in out] == [None if r["doc_ids"] is None else r["want"] for r in out]
    assert "ArrowEvalPython" in df.select(examples.open_cells(F.col("doc_ids")))._jdf.queryExecution().executedPlan().toString()  # no lambda over 512 x 512 cells


def test_following_value_by_ranges(spark):
    from quern.operators.staging import with_following

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i * 3, None if i % 5 == 0 else f"v{i}") for i in range(300)], "k long, v string")
        out = with_following(df, "k", "v", "n")
        rows, tasks = out.orderBy("k").collect(), out.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["n"] for r in rows] == [None if i % 5 == 0 or i == 300 else f"v{i}" for i in range(1, 301)]
    assert tasks > 1  # not one for all rows


def test_batches_are_cut_into_slices(monkeypatch):
    import pyarrow as pa

    from quern.operators import staging

    monkeypatch.setattr(staging, "SLICE", 1_000)
    batch = pa.RecordBatch.from_pydict({"i": list(range(500)), "t": ["x" * (i % 50) for i in range(500)]})
    parts = list(staging.slices(batch))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert len(parts) > 10 and max(p.nbytes for p in parts) < 2_000
    assert [len(p) for p in staging.slices(batch.slice(0, 0))] == [0]


def test_encoding_by_slices(spark, monkeypatch):
    """Slices of lists keep their offsets: the same ids whatever the size of a slice."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, cast(id % 7 as int)), i -> concat('w', (id * i) % 11))) AS text").coalesce(1)
    vocab = examples.vocabulary(docs)
    want = {r["doc_id"]: r["ids"] for r in examples.encode_words(docs, vocab).collect()}
    real = examples.slices
    monkeypatch.setattr(examples, "slices", lambda batch: (part for whole in real(batch) for part in (whole.slice(lo, 7) for lo in range(0, len(whole), 7))))
    assert {r["doc_id"]: r["ids"] for r in examples.encode_words(docs, vocab).collect()} == want
