"""Pipelines declared in YAML: steps by name, each a function on DataFrames, composed lazily.

A file may include others (``include: name``, beside it unless a folder is given) and have ``substitutions``, whose
values replace ``$name`` in its text (``$$`` is a dollar sign). ``pipeline`` lists steps with ``id``, ``args`` and
``call_kwargs``. A step gets the frame that the one before returned; nothing is written in between.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path
from string import Template
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[..., DataFrame]
_STEPS: dict[str, Step] = {}
_INCLUDE = re.compile(r"^include:[ \t]*(\S.*?)[ \t]*$", re.MULTILINE)


def step(name: str) -> Callable[[Step], Step]:
    """Registers a function under a name, once."""

    def add(function: Step) -> Step:
        if name in _STEPS:
            raise ValueError(f"step {name} exists")
        _STEPS[name] = function
        return function

    return add


def steps() -> dict[str, Step]:
    return dict(_STEPS)


def _included(path: Path, above: tuple[Path, ...] = ()) -> str:
    if path in above:
        raise ValueError(f"{path} includes itself")

    def text_of(found: re.Match) -> str:
        name = Path(found[1])
        return _included(name if name.parent != Path(".") or name.is_absolute() else path.parent / name, (*above, path))

    return _INCLUDE.sub(text_of, path.read_text())


def load(path: str | Path) -> dict[str, Any]:
    """The configuration, with includes and substitutions done."""
    import yaml

    text = _included(Path(path))
    config = yaml.safe_load(text) or {}
    if config.get("substitutions"):
        config = yaml.safe_load(Template(text).safe_substitute(config["substitutions"]))
    return config


def overridden(config: dict[str, Any], arguments: list[str]) -> dict[str, Any]:
    """config with ``--a.b value`` pairs put in, as the type of the value that they replace."""
    for name, value in zip(arguments[::2], arguments[1::2], strict=True):
        *path, last = name.lstrip("-").split(".")
        at = config
        for part in path:
            at = at.setdefault(part, {})
        old = at.get(last)
        at[last] = type(old)(value) if old else value
    return config


def run(config: dict[str, Any], df: DataFrame) -> DataFrame:
    """The frame after all steps."""
    for entry in config.get("pipeline", []):
        if entry["id"] not in _STEPS:
            raise KeyError(f"no step {entry['id']}; there are {', '.join(sorted(_STEPS))}")
        df = _STEPS[entry["id"]](df, **{**(entry.get("args") or {}), **(entry.get("call_kwargs") or {})})
    return df


def _register() -> None:
    from quern.operators import bloom, chat, contamination, curation, dedup, gram_index
    from quern.operators import training_examples as examples
    from quern.sources import documents, token_files

    step("remove_json_keys")(lambda df, keys_to_remove: curation.drop_columns(df, keys_to_remove))
    step("filter_json_keys")(lambda df, keys_to_keep: curation.keep_columns(df, keys_to_keep))
    step("map_jsonl")(lambda df, json_transforms: run({"pipeline": json_transforms}, df))
    step("document_filter")(lambda df, exclude, null_policy="keep": curation.exclude(df, exclude, null_policy=null_policy))
    step("safe_filter")(lambda df, exclude: curation.exclude(df, exclude))
    step("grouper")(lambda df, group_to_jsonpath, to="group": curation.route(df, group_to_jsonpath, to))

    @step("sampler")
    def sampler(
        df: DataFrame, order: list[str], value: str, value_to_samples: dict | None = None, source_regex_to_value_to_samples: dict | None = None, source: str = "source"
    ) -> DataFrame:
        if source_regex_to_value_to_samples is None:
            return curation.first_k(df, value_to_samples or {}, value, order)
        return curation.first_k_by_source(df, source_regex_to_value_to_samples, source, value, order)

    step("document_splitter")(lambda df, min_chars_per_chunk, delimiter="\n\n": curation.chunk_documents(df, min_chars_per_chunk, delimiter))

    @step("split_maker")
    def split_maker(
        df: DataFrame, split_to_size: dict | None = None, random_seed: int = 0, split_to_num_examples: dict | None = None, context_len: int = 1024, avg_num_tokens_per_doc: float = 1024.0, file: str | None = None, key: str = "doc_id"
    ) -> DataFrame:
        if split_to_num_examples is None:
            return curation.assign_splits(df, split_to_size or {}, key, random_seed, file)
        files = df.select(file).distinct().count() if file else 1
        return curation.assign_splits(df, curation.split_sizes(split_to_num_examples, context_len, avg_num_tokens_per_doc, max(1, files)), key, random_seed, file, shrink=True)

    step("downloader")(lambda df, num_shards, order: documents.shard_urls(df, num_shards, order))
    step("document_tagger")(lambda df: dedup.length_tags(df).withColumn("personal", dedup.personal_spans(F.col("text"))))
    step("exact_deduplicator")(lambda df, key="doc_id", text="text": dedup.first_copies(df, key, text))
    step("bloom_filter")(lambda df, key="doc_id", text="text", bits_per_row=bloom.BITS_PER_ROW: bloom.first_copies(df, key, text, bits_per_row))
    step("render_chat")(lambda df, prompt=False: chat.render(df, prompt))

    @step("ngram_writer")
    def ngram_writer(df: DataFrame, default_ngram_size: int = 13, source_to_ngram_size: dict | None = None, source: str | None = None, key: str = "item_id", text: str = "text") -> DataFrame:
        return contamination.benchmark_grams(df, default_ngram_size, key, text, sizes=source_to_ngram_size, source=source)

    @step("contaminated_span_tagger")
    def contaminated_span_tagger(df: DataFrame, ngrams: DataFrame, index: str | None = None, key: str = "doc_id", text: str = "text", greedy: bool = False, delimiter: str | None = None) -> DataFrame:
        grams = gram_index.store_grams(ngrams, index) if index else ngrams
        return contamination.contaminated_spans(df, contamination.hits(df, grams, key, text), key, text, greedy=greedy, delimiter=delimiter)

    @step("decontaminator")
    def decontaminator(
        df: DataFrame, benchmark: str | None = None, spans: DataFrame | None = None, ngram_size: int = 13, threshold: float = 1.0, replacement_text: str = "", drop_entire_doc: bool = False, key: str = "doc_id"
    ) -> DataFrame:
        if spans is None:
            if benchmark is None:
                raise ValueError("decontaminator needs spans or a benchmark")
            grams = contamination.benchmark_grams(df.sparkSession.read.parquet(benchmark), ngram_size)
            spans = contamination.contaminated_spans(df, contamination.hits(df, grams, key), key)
        marked = contamination.decontaminate(df, spans, key, threshold=threshold, replacement=replacement_text, drop_whole=drop_entire_doc)
        return marked.filter(~F.col("dropped")).select(*df.columns)

    @step("eval_harness_document_writer")
    def eval_harness_document_writer(df: DataFrame, order: str, task: str, split: str, text: str = "text") -> DataFrame:
        return documents.benchmark_documents(df, order, F.expr(text), F.expr(task), F.expr(split))

    @step("elastic_search_indexer")
    def elastic_search_indexer(df: DataFrame, path: str, text: str = "text") -> DataFrame:
        return documents.indexing_accounts(df, df.filter(F.length(text) > 0), path)

    def encoded(df: DataFrame, key: str, text: str) -> DataFrame:
        return examples.encode_words(df, examples.vocabulary(df, text), key, text)

    @step("mds_writer")
    def mds_writer(df: DataFrame, context_len: int, num_tokens_per_chunk: int, split: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
        own = df.filter(F.col("split") == split) if split else df
        return examples.pack_stream(encoded(own, key, text), context_len, num_tokens_per_chunk, key)

    @step("memmap_writer")
    def memmap_writer(df: DataFrame, destination: str, num_shards: int, split: str = "train", of_split: str | None = None, dtype: str = "uint32", key: str = "doc_id", text: str = "text") -> DataFrame:
        own = df.filter(F.col("split") == of_split) if of_split else df
        made = token_files.write_token_files(encoded(own, key, text), destination, num_shards, key=key, split=split, dtype=dtype)
        return made.groupBy("part").agg(F.count(F.lit(1)).alias("num_docs"), F.sum(F.size("ids")).alias("num_tokens"))

    @step("dataset_stats_reporter")
    def dataset_stats_reporter(df: DataFrame, context_len: int) -> DataFrame:
        return examples.dataset_report(df, context_len)

    @step("merger")
    def merger(df: DataFrame, destination: str, max_docs_per_file: int) -> DataFrame:
        documents.compact(df, destination, max_docs_per_file)
        return df


_register()
