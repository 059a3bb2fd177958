"""Fixed-length training examples from tokenised documents, their shards, manifests and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tokens import tokens
from quern.operators.staging import even_part, light, slices, staged, with_ordinal


def vocabulary(docs: DataFrame, text: str = "text", special: int = 1) -> DataFrame:
    """(term, docs, id): distinct word tokens numbered in their order, after `special` reserved ids, and in how many texts they are."""
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    return with_ordinal(terms, "term", to="id").withColumn("id", (F.col("id") + special).cast("int"))


#: Terms of a vocabulary that each worker holds: those in most texts. Only words beyond them are joined.
VOCABULARY = 50_000


def encode_words(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """(key, ids): the word ids of each non-empty text, with an end token. The deterministic default tokeniser.

    Words that the vocabulary lacks are left out. Documents are encoded where they lie, in Arrow batches, with the VOCABULARY
    terms that tasks hold. What is left in a larger vocabulary are rare words: their occurrences alone are
    joined to the other terms, and their ids come back to the token lists that wait for them.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.length(text) > 0)
    often = F.col("docs") if "docs" in vocab.columns else F.lit(0)
    vocab = staged(vocab.select("term", F.col("id").cast("int").alias("id"), often.alias("often")))
    total = vocab.count()
    held = vocab if total <= VOCABULARY else vocab.orderBy(F.desc("often"), "term").limit(VOCABULARY)
    known = held.select("term", "id").toArrow()
    shared = spark.sparkContext.broadcast((known["term"].to_pylist(), known["id"].to_numpy()))  # VOCABULARY terms at most
    waiting = total > VOCABULARY
    name, kind = docs.schema[key].name, docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = shared.value
        ids = dict(zip(terms, numbers.tolist(), strict=True))
        for batch in chain.from_iterable(map(slices, batches)):
            found = batch.column(1)
            words = found.flatten().cast(pa.string()).dictionary_encode()
            own = np.fromiter((ids.get(w, -1) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            at = own[words.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int64)
            there = np.ones(len(at), bool) if waiting else at >= 0
            sizes = np.diff(found.offsets.to_numpy())
            of = np.repeat(np.arange(len(sizes)), sizes)[there]
            edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)) + 1)])
            out = np.full(edges[-1], end, np.int32)
            out[np.arange(len(of)) + of] = at[there]
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(out))]
            if waiting:
                lacking = np.flatnonzero(at < 0)
                counts = np.concatenate([[0], np.cumsum(np.bincount(of[lacking], minlength=len(sizes)))])
                columns.append(pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), words.take(pa.array(lacking)).dictionary_decode()))
            yield pa.RecordBatch.from_arrays(columns, names=[name, "ids", "rare"][: len(columns)])

    coded = rows.select(key, tokens(F.col(text)).alias("t")).mapInArrow(encode, f"`{name}` {kind}, ids array<int>" + (", rare array<string>" if waiting else ""))
    if not waiting:
        return coded
    coded = staged(coded.withColumn("_row", F.monotonically_increasing_id()))
    others = vocab.join(held.select("term"), "term", "left_anti").select("term", "id")
    asked = coded.select("_row", F.posexplode("rare").alias("at", "term"))
    told = asked.join(others, "term", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(-1)).alias("id")))).alias("told"))

    @F.arrow_udf("array<int>")
    def filled(ids: pa.Array, told: pa.Array) -> pa.Array:
        out = []
        for own, rare in zip(ids, told, strict=True):
            values = own.values.to_numpy(zero_copy_only=False).copy()
            if rare.is_valid:
                values[values < 0] = np.asarray(rare.as_py(), np.int32)
            out.append(values[values >= 0])
        return pa.array(out, pa.list_(pa.int32()))

    waiting_rows = coded.filter(F.size("rare") > 0).join(told, "_row").select(key, filled(F.col("ids"), F.col("told.id")).alias("ids"))
    return coded.filter(F.size("rare") == 0).select(key, "ids").unionByName(waiting_rows)


def encode_with(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], key: str = "doc_id", text: str = "text", end: int | None = None) -> DataFrame:
    """(key, ids) by any tokeniser: encoder makes, on a worker, a function from a text to its ids."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = encoder()
        return texts.map(lambda t: np.array([*encode(t), *([] if end is None else [end])], np.int32))

    return docs.filter(F.length(text) > 0).select(key, ids(F.col(text)).alias("ids"))


def pack_stream(encoded: DataFrame, context: int, tokens_per_chunk: int, key: str = "doc_id", shard: str | None = None, source: Column | None = None) -> DataFrame:
    """(shard, chunk, example, uid, source_id, inputs, targets, doc_ids): documents laid end to end and cut.

    A shard's documents, in the order of their keys, go to ceil(tokens / tokens_per_chunk) contiguous, near-equal runs of
    documents. Within a chunk, example e has tokens e * context onwards as inputs and those one further as targets; the
    last tokens, which don't fill an example and its last target, are left out. doc_ids number a chunk's documents. No
    group is larger than an example: documents are cut at example borders before tokens come together.
    """
    rows = encoded.select(F.col(key).alias("_key"), "ids", F.size("ids").alias("_n"), (F.col(shard) if shard else F.lit(0)).alias("shard"), (source if source is not None else F.lit(None).cast("string")).alias("_source"))
    rows = staged(rows.withColumns({"_row": F.monotonically_increasing_id(), "_tie": F.xxhash64("ids")}))  # keys may repeat
    totals = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_docs"), F.sum("_n").alias("_tokens"))
    plan = totals.withColumn("_chunks", F.least(F.greatest(F.lit(1), F.ceil(F.col("_tokens") / tokens_per_chunk)), F.col("_docs")).cast("int"))
    plan = light(plan)
    placed = staged(with_ordinal(rows.select("shard", "_key", "_tie", "_row", "_n", "_source"), "shard", "_key", "_tie", "_row", to="_o"))  # by ranges: a shard may hold all rows
    firsts = placed.groupBy("shard").agg(F.min("_o").alias("_zero"))
    placed = placed.join(light(firsts), "shard").withColumn("_o", F.col("_o") - F.col("_zero")).drop("_zero").join(plan, "shard")
    size, larger = F.floor(F.col("_docs") / F.col("_chunks")), F.col("_docs") % F.col("_chunks")
    edge = larger * (size + 1)
    chunk = F.when(F.col("_o") < edge, F.floor(F.col("_o") / (size + 1))).otherwise(larger + F.floor((F.col("_o") - edge) / size))
    placed = placed.withColumn("chunk", chunk.cast("int"))
    order = Window.partitionBy("shard", "chunk").orderBy("_o")
    placed = placed.withColumn("_from", F.sum("_n").over(order) - F.col("_n")).withColumn("_doc", F.row_number().over(order) - 1)
    placed = staged(placed)
    modes = placed.groupBy("shard", "chunk", "_source").agg(F.count(F.lit(1)).alias("_c"), F.min("_o").alias("_first"))
    modes = modes.groupBy("shard", "chunk").agg(F.max_by("_source", F.struct("_c", -F.col("_first"))).alias("source_id"), F.sum("_c").alias("_in"))
    lengths = placed.groupBy("shard", "chunk").agg(F.sum("_n").alias("_total"))
    cut = placed.join(rows.select("_row", "ids"), "_row").join(lengths, ["shard", "chunk"])
    cut = cut.withColumn("_examples", F.floor((F.col("_total") - 1) / context).cast("int")).filter("_examples > 0")
    # an example needs context + 1 tokens: a document gives to each one that its tokens overlap
    first = F.greatest(F.lit(0), F.floor((F.col("_from") - 1) / context)).cast("int")
    last = F.least(F.col("_examples") - 1, F.floor((F.col("_from") + F.col("_n") - 1) / context)).cast("int")
    parts = cut.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b").withColumn("example", F.explode(F.sequence("_a", "_b")))
    at = F.greatest(F.lit(0), F.col("example") * context - F.col("_from")).cast("int")
    to = F.least(F.col("_n"), (F.col("example") + 1) * context + 1 - F.col("_from")).cast("int")
    parts = parts.withColumn("_at", at).withColumn("_to", to).filter("_at < _to")
    piece = F.struct(F.col("_doc").alias("doc"), F.slice("ids", F.col("_at") + 1, F.col("_to") - F.col("_at")).alias("ids"))
    groups = parts.select("shard", "chunk", "example", piece.alias("p")).groupBy("shard", "chunk", "example").agg(F.array_sort(F.collect_list("p"), lambda x, y: (x["doc"] - y["doc"]).cast("int")).alias("p"))
    whole = F.flatten(F.col("p.ids"))
    owners = F.flatten(F.transform("p", lambda x: F.array_repeat(x["doc"].cast("int"), F.size(x["ids"]))))
    out = groups.withColumn("_ids", whole).withColumn("_own", owners).join(modes.select("shard", "chunk", "source_id"), ["shard", "chunk"]).join(plan.select("shard", "_chunks"), "shard")
    start = F.col("example") * context
    uid = F.concat_ws("-", F.lit("shard"), F.col("shard"), F.lit("chunk"), F.col("chunk"), F.lit("of"), F.col("_chunks"), F.lit("idx"), start, F.lit("to"), start + context)
    return out.select("shard", "chunk", "example", uid.alias("uid"), "source_id", F.slice("_ids", 1, context).alias("inputs"), F.slice("_ids", 2, context).alias("targets"), F.slice("_own", 1, context).alias("doc_ids"))


def manifest(encoded: DataFrame, examples: DataFrame, context: int, shard: str | None = None) -> DataFrame:
    """(shard, docs, num_tokens, num_tokens_floor, examples, packed_tokens): both token counts of each shard."""
    name = (F.col(shard) if shard else F.lit(0)).alias("shard")
    read = encoded.select(name, F.size("ids").alias("n")).groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("num_tokens"))
    made = examples.groupBy("shard").agg(F.count(F.lit(1)).alias("examples"))
    whole = F.col("num_tokens") - F.col("num_tokens") % context
    return read.join(made, "shard", "left").select("shard", "docs", "num_tokens", whole.alias("num_tokens_floor"), F.coalesce("examples", F.lit(0)).alias("examples"), (F.coalesce("examples", F.lit(0)) * context).alias("packed_tokens"))


def boundary_mask(doc_ids: Column) -> Column:
    """Rows i of the block-diagonal causal mask: whether token i may see token j."""
    return F.transform(doc_ids, lambda own, i: F.transform(doc_ids, lambda other, j: (other == own) & (j <= i)))


def masks(doc_ids: np.ndarray) -> np.ndarray:
    """The block-diagonal causal masks of examples of one length (a row each): [example, i, j], whether token i may see token j."""
    size = doc_ids.shape[1]
    return (doc_ids[:, :, None] == doc_ids[:, None, :]) & np.tri(size, dtype=bool)


#: Cells of masks that a task holds.
CELLS = 1 << 22


def open_cells(doc_ids: Column) -> Column:
    """How many cells of each example's mask (boundary_mask) are open. Masks are made and counted in arrays, some at a time, and go nowhere."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = np.nan_to_num(pa.compute.list_value_length(batch).to_numpy(zero_copy_only=False)).astype(np.int64)
            out = np.zeros(len(batch), np.int64)
            for size in set(sizes.tolist()) - {0}:
                at = np.flatnonzero(sizes == size)
                step = max(1, CELLS // size**2)
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    out[some] = masks(batch.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), size)).sum((1, 2))
            yield pa.array(out, mask=~np.asarray(batch.is_valid()))

    return count(doc_ids)


def dataset_report(parts: DataFrame, context: int, token_units: float = 1e9, sample_units: float = 1e6) -> DataFrame:
    """One row per dataset from parts (dataset, split, docs, samples, shards, docs_dropped, docs_before, complete)."""

    def of(split: str, column: str) -> Column:
        return F.sum(F.when(F.col("split") == split, F.col(column)).otherwise(0))

    rows = parts.groupBy("dataset").agg(
        (of("dev", "samples") * context / token_units).alias("dev_tokens"),
        (of("train", "samples") * context / token_units).alias("train_tokens"),
        (of("dev", "samples") / sample_units).alias("dev_samples"),
        (of("train", "samples") / sample_units).alias("train_samples"),
        of("train", "docs").alias("train_docs"),
        of("dev", "docs").alias("dev_docs"),
        F.sum("docs").alias("total_docs"),
        F.sum("docs_dropped").alias("contaminated_docs"),
        F.sum("docs_before").alias("total_docs_pre_decontam"),
        F.bool_and("complete").alias("decontam_successful"),
        F.try_divide(of("train", "samples"), of("train", "shards")).alias("avg_samples_per_shard"),
    )
    return (
        rows.withColumn("total_tokens", F.col("dev_tokens") + F.col("train_tokens"))
        .withColumn("total_samples", F.col("dev_samples") + F.col("train_samples"))
        .withColumn("percent_contaminated_docs", 100.0 * F.col("contaminated_docs") / F.col("total_docs_pre_decontam"))
    )


def shard_of(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """df with shard (from 0): contiguous, near-equal runs of rows in the given order, larger ones first."""
    total = df.count()
    return with_ordinal(df, *order, to="_o").withColumn("shard", even_part(F.col("_o"), total, shards)).drop("_o")


def special_tokens(first: int, names: Sequence[str]) -> dict[str, int]:
    """The ids of special tokens, which follow an ordinary vocabulary of `first` ids, in the order given."""
    if len(set(names)) < len(names):
        raise ValueError("a special token is named twice")
    return {name: first + i for i, name in enumerate(names)}


def token_ids(words: Column, table: Mapping[str, int], unknown: int | None = None) -> Column:
    """The ids of an array of tokens in a small table; others are unknown, or left out."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    ids = F.transform(words, lambda w: F.coalesce(known[w], F.lit(unknown).cast("int")))
    return ids if unknown is not None else F.filter(ids, lambda i: i.isNotNull())


def right_padded(ids: Column, length: int, pad: int) -> Column:
    """ids cut to the length and filled up with pad."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def multiple_choice(rows: DataFrame, task: str, pad: int, ignore: int = -100) -> DataFrame:
    """Rows of one task (task, input_ids, target_ids) as padded input_ids and labels; only the last target counts."""
    own = rows.filter(F.col("task") == task).withColumn("_ids", F.concat("input_ids", "target_ids"))
    longest = own.agg(F.max(F.size("_ids"))).first()[0] or 0
    size = F.size("_ids")
    labels = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == size - 2, F.element_at("_ids", -1)).otherwise(F.lit(ignore)))
    return own.select(right_padded(F.col("_ids"), longest, pad).alias("input_ids"), right_padded(labels, longest, ignore).alias("labels"))
