"""Benchmark contamination: n-gram joins instead of a search index.

Documents' grams meet those of the benchmark as 64-bit hashes, and are compared as text where hashes are equal. Every
task holds a bit map of the benchmark's hashes and lets only suspects through, so that no row per token is made, however many
grams there are; suspects are joined to the grams, which are broadcast while they are few and bucketed on disk
otherwise (gram_index). Texts are read again for the few documents that are hit, where they lie: the keys of these
documents are broadcast, or, beyond a count, a filter of them goes before the join.

A document is its key and the hash of its text (`digest`): rows of one key with different texts are different
documents, null keys are keys, and repeated rows share what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tokens import let, ngrams, token_offsets, tokens
from quern.operators.gram_index import StoredGrams, gram_hash, passing_grams, run_hashes
from quern.operators.hash_filter import hash_filter, may_hold, passing
from quern.operators.staging import BROADCAST_ROWS, light, null_safe_join, slices, staged


def gram_rows(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", mode: str = "simple") -> DataFrame:
    """(key, pos, gram): every n-gram of every document with its first token's number."""
    return docs.select(key, F.posexplode(ngrams(tokens(F.col(text), mode), n)).alias("pos", "gram"))


def benchmark_grams(items: DataFrame, n: int, key: str = "item_id", text: str = "text", mode: str = "simple", sizes: dict | None = None, source: str | None = None) -> DataFrame:
    """(key, pos, gram, n, num_ngrams): n-grams of benchmark items. sizes: another n for some values of source."""
    parts = []
    for size in sorted({n, *(sizes or {}).values()}):
        own = [s for s, k in (sizes or {}).items() if k == size]
        rows = items
        if sizes and source:
            listed = F.coalesce(F.col(source).isin(list(sizes)), F.lit(False))
            rows = items.filter(F.col(source).isin(own) | (~listed if size == n else F.lit(False)))
        grams = ngrams(tokens(F.col(text), mode), size)
        parts.append(rows.select(key, F.lit(size).alias("n"), F.size(grams).alias("num_ngrams"), F.posexplode(grams).alias("pos", "gram")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ngram_index(grams: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per distinct gram: how often and in how many items it occurs, and the item of its first occurrence."""
    return grams.groupBy("gram").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct(key).alias("items"),
        F.min_by(key, F.struct(key, "pos")).alias("first_item"),
    )


def _run_hashes(n: int) -> Callable[[Column], Column]:
    """From an array of tokens to the hashes of its runs of n."""
    return lambda words: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: gram_hash(F.slice(words, i, F.lit(n)))))


def digest(text: str) -> Column:
    """What tells documents of one key apart."""
    return F.xxhash64(text).alias("digest")


def hits(docs: DataFrame, grams: DataFrame | StoredGrams, key: str = "doc_id", text: str = "text", mode: str = "simple") -> DataFrame:
    """(key, digest, pos, n, gram) where a document holds a benchmark gram, for each n that the benchmark's grams have.

    Documents give a hash for each token; those of runs of n are made of these in arrays, and only what passes the grams' filter goes on.
    What meets a gram's hash is written down once, and the tokens of those few documents are then compared with the grams.
    """
    index = grams if isinstance(grams, StoredGrams) else passing_grams(grams)
    own = tokens(F.col(text), mode)
    met = staged(suspects(docs.select(key, digest(text), F.transform(own, lambda w: F.xxhash64(w)).alias("tokens")), index, key).drop("n").join(index.rows, "hash").select(key, "digest", "pos", "n", "gram"))
    words = touched(docs, met, key, text).select(key, digest(text), own.alias("_w"))
    same = F.array_join(F.slice("_w", F.col("pos") + 1, F.col("n")), " ") == F.col("gram")
    return staged(null_safe_join(words, light(met), [key, "digest"]).filter(same).select(key, "digest", "pos", "n", "gram").distinct())


def suspects(hashed: DataFrame, index: StoredGrams, key: str) -> DataFrame:
    """(key, digest, pos, n, hash) of the runs that pass the filter.

    hashed: key, digest, and an array of the hashes of all `tokens`, or else one of the hashes of all runs for each n.
    """
    shared, sizes, by_token = hashed.sparkSession.sparkContext.broadcast(index.filter), index.sizes, "tokens" in hashed.columns
    names = [key, "digest", "pos", "n", "hash"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            for column, n in enumerate(sizes, 2):
                listed = batch.column(2 if by_token else column)
                first = listed.offsets.to_numpy()
                first = first - first[0]
                found = listed.flatten().to_numpy(zero_copy_only=False)
                found = run_hashes(found, n) if by_token else found
                at = np.flatnonzero(shared.value.probe(found))
                row = np.searchsorted(first, at, "right") - 1
                if by_token:  # a run ends in the text that it begins in
                    inside = at + n <= first[row + 1]
                    at, row = at[inside], row[inside]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(found[at])], names=names
                )

    schema = f"`{key}` {hashed.schema[key].dataType.simpleString()}, digest long, pos int, n int, hash long"
    return hashed.mapInArrow(probe, schema)


def touched(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with rows in found, without a shuffle of other texts."""
    keys = staged(found.select(key, "digest").distinct())
    n = keys.count()
    marked = docs.withColumn("_digest", F.xxhash64(text))
    if n > BROADCAST_ROWS:
        named = keys.withColumn("_h", F.xxhash64(key, "digest"))
        marked = passing(marked, F.xxhash64(key, "_digest"), hash_filter(named, "_h", n))
    return null_safe_join(marked, light(keys.withColumnRenamed("digest", "_digest"), n), [key, "_digest"], "left_semi").drop("_digest")


def contaminated_documents(docs: DataFrame, grams: DataFrame | StoredGrams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the documents that hold any benchmark gram."""
    return hits(docs, grams, key, text).select(key).distinct()


def contaminated_sources(grams: DataFrame, found: DataFrame, key: str = "item_id") -> DataFrame:
    """Per benchmark item with a gram in some document: its grams, and which of them were found."""
    met = grams.join(found.select("gram").distinct(), "gram", "left_semi")
    return met.groupBy(key).agg(F.max("num_ngrams").alias("num_source_ngrams"), F.array_sort(F.collect_set("gram")).alias("contaminated_ngrams"))


def merged(spans: DataFrame, *key: str) -> DataFrame:
    """Spans (key, start, end) merged where one starts at most one character after all before it have ended."""
    key = key or ("doc_id",)
    order = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)
    islands = spans.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def contaminated_spans(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "simple", greedy: bool = False, delimiter: str | None = None) -> DataFrame:
    """(key, digest, start, end): the merged character spans of all hits.

    greedy: a span reaches to the neighbouring tokens. delimiter (one character): a span grows to the delimited
    segments that it touches, with the delimiter after the last of them unless no segment follows.
    """
    document = F.struct(F.col(key).alias("key"), "digest").alias("_doc")  # structs are equal where nulls within are
    hit = staged(touched(docs, found, key, text).select(key, digest(text), text).dropDuplicates([key, "digest"]).select(document, text))
    at = token_offsets(hit, "_doc", text, mode)
    if greedy:
        order = Window.partitionBy("_doc").orderBy("pos")
        at = at.withColumn("_from", F.coalesce(F.lag("end").over(order), F.col("start"))).withColumn("_to", F.coalesce(F.lead("start").over(order), F.col("end")))
    else:
        at = at.withColumn("_from", F.col("start")).withColumn("_to", F.col("end"))
    first = found.select(document, "pos", (F.col("pos") + F.col("n") - 1).alias("_last"))
    spans = first.join(at.select("_doc", "pos", F.col("_from").alias("start")), ["_doc", "pos"])
    spans = spans.join(at.select("_doc", F.col("pos").alias("_last"), F.col("_to").alias("end")), ["_doc", "_last"]).select("_doc", "start", "end").distinct()
    if delimiter:
        spans = _rounded(hit, merged(spans, "_doc"), "_doc", text, delimiter)
    return merged(spans, "_doc").select(F.col("_doc.key").alias(key), "_doc.digest", "start", "end")


def _rounded(docs: DataFrame, spans: DataFrame, key: str, text: str, delimiter: str) -> DataFrame:
    pieces = docs.select(key, F.posexplode(F.split(F.col(text), f"\\Q{delimiter}\\E", -1)).alias("_i", "_s"))
    order = Window.partitionBy(key).orderBy("_i")
    stop = F.sum(F.length("_s") + 1).over(order) - 1
    segments = pieces.withColumn("_stop", stop).withColumn("_start", F.col("_stop") - F.length("_s")).filter(F.col("_stop") > F.col("_start"))
    segments = segments.withColumn("_next", F.lead("_start").over(order)).select(key, "_start", "_stop", "_next")
    inside = spans.join(segments, key).filter((F.col("_stop") > F.col("start")) & (F.col("_start") < F.col("end")))
    last = F.max_by(F.coalesce("_next", "_stop"), "_start")
    return inside.groupBy(key, "start", "end").agg(F.least(F.min("_start"), F.col("start")).alias("_from"), last.alias("_to")).select(key, F.col("_from").alias("start"), F.col("_to").alias("end"))


def replaced(text: Column, spans: Column, replacement: str) -> Column:
    """text with each of the sorted, disjoint spans (array of structs start, end) replaced."""
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    kept = F.zip_with(ends, starts, lambda e, s: F.substring(text, e + 1, s - e))
    return F.array_join(kept, replacement)


def decontaminate(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 1.0, replacement: str = "", drop_whole: bool = False) -> DataFrame:
    """docs with contaminated, fraction (of the characters that spans cover), dropped, and text with spans replaced.

    A document is dropped if its fraction is the threshold or more, or, with drop_whole, if it has any span. Rows that
    are dropped stay, marked, so that statistics can count them; an empty text has fraction 0. Spans without a digest hold
    for all rows of their key.
    """
    spans = staged(spans.withColumnRenamed("digest", "_digest"))
    on = [key, *(c for c in ("_digest",) if c in spans.columns)]
    per_doc = staged(spans.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans")))
    n, rows = spans.count(), docs.withColumn("_digest", F.xxhash64(text))
    if n <= BROADCAST_ROWS:
        rows = null_safe_join(rows, F.broadcast(per_doc), on, "left").drop("_digest")
    else:  # only rows that may have spans meet them in a shuffle
        rows = rows.withColumn("_there", may_hold(F.xxhash64(*on), hash_filter(per_doc.withColumn("_h", F.xxhash64(*on)), "_h", per_doc.count()), docs.sparkSession))
        rows = null_safe_join(rows.filter("_there"), per_doc, on, "left").unionByName(rows.filter("NOT _there"), allowMissingColumns=True).drop("_there", "_digest")
    covered = F.aggregate("_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    fraction = F.when(F.col("_spans").isNull() | (F.length(text) == 0), F.lit(0.0)).otherwise(covered / F.length(text))
    rows = rows.withColumn("contaminated", F.col("_spans").isNotNull()).withColumn("fraction", fraction)
    dropped = F.col("contaminated") if drop_whole else F.col("contaminated") & (F.col("fraction") >= threshold)
    cleaned = F.when(F.col("contaminated"), replaced(F.col(text), F.col("_spans"), replacement)).otherwise(F.col(text))
    return rows.withColumn("dropped", dropped).withColumn(text, cleaned).drop("_spans")


def span_identity(docs: DataFrame, spans: DataFrame, position: list[str], doc_id: str = "id") -> DataFrame:
    """spans with success: whether the document at their position has their id (or there is one at all)."""
    there = docs.select(*position, F.col(doc_id).alias("_there"))
    return spans.join(there, position, "left").withColumn("success", F.col(doc_id).eqNullSafe(F.col("_there"))).drop("_there")


def decontamination_stats(marked: DataFrame, shard: str | None = None) -> DataFrame:
    """One row: documents, dropped ones and their percentage; with shard, also those in shards that were touched."""
    if shard:
        touched = marked.filter("contaminated").select(shard).distinct().withColumn("_touched", F.lit(1))
        marked = marked.join(touched, shard, "left")
    counts = [
        F.sum(F.col("dropped").cast("long")).alias("num_docs_dropped"),
        F.count(F.lit(1)).alias("num_docs_total"),
        *([F.count("_touched").alias("num_docs_in_touched_shards")] if shard else []),
    ]
    return marked.agg(*counts).withColumn("percent_docs_dropped", F.when(F.col("num_docs_total") > 0, 100.0 * F.col("num_docs_dropped") / F.col("num_docs_total")))
