"""Readers and writers: JSON lines (plain, gzip, zstd), packed binaries, benchmark items, lists of URLs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.staging import even_part, light, with_ordinal
from quern.sources import zstd_frames


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None, ordinals: bool = False) -> DataFrame:
    """Documents from JSON lines. With a schema, columns; without, ``data`` (VARIANT) for whatever the lines hold.

    ordinals adds path and line_num (from 0 in each file). zstd files are decoded frame by frame (zstd_frames), as the suffix
    ``.zstd`` isn't one that Hadoop knows; everything else is read by Spark.
    """
    if path.rstrip("*").endswith((".zst", ".zstd")):
        lines = zstd_frames.lines(spark, path)
    elif ordinals:
        lines = _numbered_lines(spark, path)
    elif schema is not None:
        return spark.read.schema(schema).json(path)
    else:
        lines = spark.read.text(path)
    names = [c for c in ("path", "line_num") if c in lines.columns and ordinals]
    rows = lines.filter(F.length(F.trim("value")) > 0)
    if schema is None:
        return rows.select(*names, F.parse_json("value").alias("data"))
    kind = schema.simpleString() if isinstance(schema, T.StructType) else schema
    return rows.select(*names, F.from_json("value", kind).alias("r")).select(*names, "r.*")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number. Files are read as Spark splits them, never whole.

    Lines of a block follow each other, so that a line's number is its place behind the block's first line plus the lines
    of the file's blocks before. Only a row for each block crosses the network.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = lines.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    placed = lines.join(light(blocks.drop("_n")), ["path", "_block"])
    return placed.select("path", (F.col("_at") - F.col("_first") + F.col("_before")).alias("line_num"), "value")


def write_jsonl(df: DataFrame, path: str, compression: str = "gzip", rows_per_file: int | None = None, by: str | None = None) -> None:
    """One JSON object a line; with rows_per_file, files of at most so many rows; with by, a folder for each value."""
    writer = df.write.mode("overwrite").option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(by) if by else writer).json(path)


def compact(df: DataFrame, path: str, rows_per_file: int, compression: str = "gzip") -> DataFrame:
    """Writes few, even files; returns (path, num_docs) of what was written."""
    spark = df.sparkSession
    write_jsonl(df.hint("rebalance"), path, compression, rows_per_file)
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("num_docs"))


def bind(df: DataFrame, properties: Mapping[str, str | None], data: str = "data", defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Columns from paths into a VARIANT: the value as text, or the default where the path is None or finds nothing.

    An explicit JSON null stays null. `created` gets the present time by default.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    known = {"created": now, **(defaults or {})}
    out = []
    for name, path in properties.items():
        default = known.get(name, F.lit(None).cast("string"))
        if path is None:
            out.append(default.alias(name))
            continue
        found = F.try_variant_get(F.col(data), f"$.{path.removeprefix('$.')}", "variant")
        value = F.try_variant_get(F.col(data), f"$.{path.removeprefix('$.')}", "string")
        out.append(F.when(found.isNull(), default).otherwise(value).alias(name))
    return df.select(*[c for c in df.columns if c != data], *out)


def indexing_accounts(read: DataFrame, kept: DataFrame, path: str = "path") -> DataFrame:
    """(path, num_lines, num_docs_added, delta): what was read and what went on, per file."""
    lines = read.groupBy(path).agg(F.count(F.lit(1)).alias("num_lines"))
    added = kept.groupBy(path).agg(F.count(F.lit(1)).alias("num_docs_added"))
    both = lines.join(added, path, "left").withColumn("num_docs_added", F.coalesce("num_docs_added", F.lit(0)))
    return both.withColumn("delta", F.col("num_lines") - F.col("num_docs_added"))


def benchmark_documents(items: DataFrame, order: str, text: Column, task: Column, split: Column) -> DataFrame:
    """(id, source, split, index, text): items numbered per task and split; those without text use up a number and go."""
    rows = items.select(task.alias("source"), split.alias("split"), text.alias("text"), F.col(order).alias("_o"))
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("source", "split").orderBy("_o")) - 1)
    return rows.filter("text IS NOT NULL").select(F.concat_ws("-", "source", "split", F.col("index").cast("string")).alias("id"), "source", "split", "index", "text")


def split_counts(items: DataFrame, task: str, split: str, text: str) -> DataFrame:
    """Per task, and pivoted by split: items, those with text and those without."""
    known = ["test", "train", "validation"]
    return items.groupBy(task).pivot(split, known).agg(F.count(F.lit(1)).alias("n_total"), F.count(text).alias("n_with_text"), F.count_if(F.col(text).isNull()).alias("n_none"))


def shard_urls(urls: DataFrame, shards: int, order: str) -> DataFrame:
    """urls with shard (from 1) and its name: contiguous, near-equal shards, larger ones first."""
    total = urls.count()
    rows = with_ordinal(urls, order, to="_o").withColumn("shard", even_part(F.col("_o"), total, shards) + 1).drop("_o")
    return rows.withColumn("shard_name", F.concat(F.lit("shard-"), F.col("shard").cast("string"), F.lit(f"-of-{shards}")))


def destination(path: Column, root: str, to: str, suffixes: Mapping[str, str] | None = None) -> Column:
    """Where a file below root goes below `to`, with its suffix mapped: the longest that fits; others stay."""
    moved = F.when(path.startswith(root), F.concat(F.lit(to), F.substring(path, F.lit(len(root) + 1), F.length(path)))).otherwise(path)
    out = moved
    for old, new in sorted((suffixes or {}).items(), key=lambda x: len(x[0])):
        out = F.when(moved.endswith(old), F.concat(F.substring(moved, F.lit(1), F.length(moved) - len(old)), F.lit(new))).otherwise(out)
    return out


def empty_files(accounts: DataFrame, path: str = "path", kept: str = "num_docs_added") -> DataFrame:
    """The files that nothing is left of, to be removed."""
    return accounts.filter(F.col(kept) == 0).select(path)


def shards_of_ranks(sharded: DataFrame, world: int) -> DataFrame:
    """(rank, shards): every rank with the sorted shards that are its own; ranks without any have none."""
    ranks = sharded.sparkSession.range(world).select(F.col("id").cast("int").alias("rank"))
    own = sharded.select("shard").distinct().groupBy((F.col("shard") % world).cast("int").alias("rank")).agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    return ranks.join(own, "rank", "left").select("rank", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def of_rank(sharded: DataFrame, rank: int, world: int) -> DataFrame:
    """The shards of one of `world` ranks."""
    return sharded.filter(F.col("shard") % world == rank)


def write_token_binaries(encoded: DataFrame, folder: str, key: str = "doc_id", docs_per_part: int = 10_000) -> DataFrame:
    """Packs ids (array<int>) into binaries: (part, first, tokens BINARY of uint32, counts BINARY of uint32) rows as Parquet.

    counts holds the tokens of each document and, last, the number of documents. A part is docs_per_part documents in the
    order of their keys, whatever batches or partitions they come in; it must fit into a task's memory.
    """

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_o")
        ids = [np.asarray(x, "<u4") for x in part["ids"]]
        counts = np.array([*(len(x) for x in ids), len(ids)], "<u4")
        return pd.DataFrame({"part": [part["part"].iloc[0]], "first": [str(part[key].iloc[0])], "tokens": [b"".join(x.tobytes() for x in ids)], "counts": [counts.tobytes()]})

    placed = with_ordinal(encoded.select(key, "ids"), key, to="_o").withColumn("part", F.floor(F.col("_o") / docs_per_part).cast("long"))
    rows = placed.groupBy("part").applyInPandas(pack, "part long, first string, tokens binary, counts binary")
    rows.write.mode("overwrite").parquet(folder)
    return encoded.sparkSession.read.parquet(folder)


def binary_examples(packed: DataFrame, context: int) -> DataFrame:
    """(first, example, inputs, targets) of each binary: (n - 1) // context examples, targets one further."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, raw in zip(batch["first"], batch["tokens"], strict=True):
                ids = np.frombuffer(raw, "<u4").astype(np.int32)
                n = (len(ids) - 1) // context
                if n > 0:
                    yield pd.DataFrame({"first": first, "example": range(n), "inputs": list(ids[: n * context].reshape(n, context)), "targets": list(ids[1 : n * context + 1].reshape(n, context))})

    return packed.select("first", "tokens").mapInPandas(cut, "first string, example int, inputs array<int>, targets array<int>")


def expanded_scores(pairs: DataFrame, score: str = "score", count: str = "count") -> DataFrame:
    """A row for each of `count` occurrences of a score. Weighted aggregates do without it."""
    return pairs.filter(F.col(count) > 0).select(score, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("_i")).drop("_i")
