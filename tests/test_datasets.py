"""Declared runs: accounts, taking up where a run stopped; the Bloom step."""

import pytest
import yaml
from pyspark.sql import functions as F

from quern.operators import bloom, curation, dedup
from quern.plans import datasets, pipeline

CONFIG = """
pipeline:
  - {id: document_filter, input: documents, output: kept, args: {exclude: [".doc_id < 3"]}}
  - {id: sampler, output: few, args: {order: [doc_id], value: lang, source_regex_to_value_to_samples: {s1: {en: 1}}}}
  - {id: filter_json_keys, input: kept, args: {keys_to_keep: [doc_id]}}
"""


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, "ab" * i, "en" if i % 2 else "de", f"s{i % 3}") for i in range(10)], "doc_id long, text string, lang string, source string")


def test_accounts(spark, docs, tmp_path):
    frames, accounts = datasets.run(yaml.safe_load(CONFIG), {"documents": docs}, str(tmp_path))
    rows = [tuple(r) for r in accounts.orderBy("step").collect()]
    few = 7 - 2 + 1 - (1 if 4 % 2 else 0)  # of s1 (4 and 7) one en row stays
    assert rows[0] == (0, "document_filter", ["documents"], "kept", 10, 7, 2 * sum(range(3, 10)))
    assert rows[1][:6] == (1, "sampler", ["kept"], "few", 7, few) and rows[2] == (2, "filter_json_keys", ["kept"], "filter_json_keys", 7, 7, None)
    assert frames["filter_json_keys"].columns == ["doc_id"] and frames["few"].count() == few


def test_a_run_goes_on_where_it_stopped(spark, docs, tmp_path, monkeypatch):
    config, calls = yaml.safe_load(CONFIG), []
    known = pipeline.steps()

    def failing(df, **args):
        calls.append("sampler")
        if len(calls) == 1:
            raise RuntimeError("lost")
        return known["sampler"](df, **args)

    def counted(df, **args):
        calls.append("filter")
        return known["document_filter"](df, **args)

    monkeypatch.setattr(pipeline, "steps", lambda: {**known, "sampler": failing, "document_filter": counted})
    with pytest.raises(RuntimeError):
        datasets.run({"pipeline": config["pipeline"][1:]}, {"kept": docs}, str(tmp_path / "x"))
    datasets.run(config, {"documents": docs}, str(tmp_path / "y"))
    before = list(calls)
    _, accounts = datasets.run(config, {"documents": docs}, str(tmp_path / "y"))
    assert calls == before and accounts.count() == 3  # nothing ran again
    config["pipeline"][0]["args"]["exclude"] = [".doc_id < 5"]
    _, accounts = datasets.run(config, {"documents": docs}, str(tmp_path / "y"))
    assert [r["num_documents"] for r in accounts.orderBy("step").collect()][0] == 5 and calls[len(before) :] == ["filter", "sampler"]


def test_declarations_that_cannot_run(spark, docs, tmp_path):
    for step, error in (({"id": "nothing"}, KeyError), ({"id": "sampler", "input": "absent"}, KeyError), ({"id": "filter_json_keys", "output": "documents", "args": {"keys_to_keep": []}}, ValueError)):
        with pytest.raises(error):
            datasets.run({"pipeline": [step]}, {"documents": docs}, str(tmp_path))


def test_every_step_of_the_survey_is_there():
    names = "downloader remove_json_keys filter_json_keys map_jsonl document_filter safe_filter document_tagger bloom_filter grouper sampler document_splitter split_maker merger ngram_writer contaminated_span_tagger decontaminator mds_writer memmap_writer eval_harness_document_writer elastic_search_indexer dataset_stats_reporter"
    assert set(names.split()) <= set(pipeline.steps())


def test_splits_shrink_by_file(spark):
    rows = [(i, "a") for i in range(3)] + [(10 + i, "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, file string")
    for per, want in (("file", {("a", "dev"): 1, ("a", "test"): 2, ("b", "dev"): 5, ("b", "test"): 6, ("b", "train"): 9}), (None, {("dev",): 5, ("test",): 6, ("train",): 12})):
        out = curation.assign_splits(df, {"dev": 5, "test": 6, "train": None}, per=per, shrink=True)
        got = {tuple(r)[:-1]: r["n"] for r in out.groupBy(*([per] if per else []), "split").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == want


@pytest.mark.parametrize("bits", [24, 1])
def test_bloom_equals_exact(spark, bits):
    rows = [(None, "a"), (5, "q"), (5, "r"), (4, "q"), (None, "z"), (7, "z"), (8, "s"), (8, "s"), (9, None), (10, None)] + [(100 + i, f"text {i % 900}") for i in range(1_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    key = lambda r: str(tuple(r))
    assert sorted(bloom.first_copies(df, bits_per_row=bits).collect(), key=key) == sorted(dedup.first_copies(df).collect(), key=key)
    assert bloom.first_copies(df.limit(0)).count() == 0


def test_suspects_are_as_few_as_stated(spark):
    single = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text")).repartition(24)
    assert bloom.suspects(single).count() <= bloom.RATE * 60_000
    copied = single.unionByName(single.filter("doc_id < 500").withColumn("doc_id", F.col("doc_id") + 100_000)).repartition(24)
    found = bloom.suspects(copied)
    assert 1_000 <= found.count() <= 1_000 + bloom.RATE * 60_000
    assert {r["doc_id"] % 100_000 for r in found.collect()} >= set(range(500))
    plan = bloom.first_copies(copied)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not scans, "texts don't shuffle"
