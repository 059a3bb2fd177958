"""Table functions and a mergeable aggregate, for SQL and DataFrames.

    register(spark)
    SELECT * FROM chunks(TABLE(documents), 600, 'text', 'doc_id')
    SELECT * FROM merged_spans(TABLE(spans) PARTITION BY doc_id ORDER BY start)

Both take any table: `chunks` keeps its other columns, `merged_spans` the ones it is partitioned by.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.operators.curation import chunks_of


class Chunks:
    """A row for each chunk of a text, with its other columns, chunk (from 1), of and the chunk as the text.

    Arguments: the table; the least counting characters of a chunk; the text column; the delimiter of paragraphs.
    A null or empty text has no chunks.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, least: AnalyzeArgument, text: AnalyzeArgument, delimiter: AnalyzeArgument) -> AnalyzeResult:
        names = table.dataType.names
        for n in ("chunk", "of"):
            if n in names:
                raise ValueError(f"the table has a column {n} already")
        if text.value not in names:
            raise ValueError(f"the table has no column {text.value}")
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField("chunk", T.IntegerType()), T.StructField("of", T.IntegerType())]))

    def eval(self, row: Any, least: int, text: str, delimiter: str) -> Iterator[tuple]:
        at = row.__fields__.index(text)
        found = chunks_of(row[at], least, delimiter) if row[at] else []
        for i, chunk in enumerate(found, 1):
            yield (*row[:at], chunk, *row[at + 1 :], i, len(found))


class MergedSpans:
    """Spans (start, end) of a partition, in the order of their starts, merged where one starts at most one character behind another.

    Further columns are those of the first span of each merged one.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not {"start", "end"} <= set(table.dataType.names):
            raise ValueError("the table needs the columns start and end")
        return AnalyzeResult(table.dataType)

    def __init__(self) -> None:
        self.held: list | None = None

    def eval(self, row: Any) -> Iterator[tuple]:
        self.start, self.end = row.__fields__.index("start"), row.__fields__.index("end")
        if self.held and row[self.start] <= self.held[self.end] + 1:
            self.held[self.end] = max(self.held[self.end], row[self.end])
        else:
            if self.held:
                yield tuple(self.held)
            self.held = list(row)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield tuple(self.held)


def register(spark: SparkSession) -> None:
    """The table functions under their SQL names."""
    spark.udtf.register("chunks", udtf(Chunks))
    spark.udtf.register("merged_spans", udtf(MergedSpans))


def smallest_hashes(df: DataFrame, by: list[str], value: Column, k: int = 1_024) -> DataFrame:
    """(by, hashes): a mergeable sketch of each group, the k smallest different 64-bit hashes of a value, ascending.

    Tasks sketch what they read before anything is shuffled; sketches merge by union. Null values don't count; a
    group of nulls alone has an empty sketch.
    """
    hashed = df.select(*by, F.when(value.isNotNull(), F.xxhash64(value)).alias("_h"))
    group = F.struct(*by).alias("_g") if by else F.struct(F.lit(0).alias("all")).alias("_g")
    kind = hashed.select(group).schema["_g"].dataType.simpleString()

    schema = to_arrow_type(hashed.select(group).schema["_g"].dataType)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Any, np.ndarray]] = {}
        for batch in batches:
            groups = batch.column(0).to_pylist()
            names = np.array([repr(g) for g in groups], object)
            there = np.asarray(batch.column(1).is_valid())
            values = batch.column(1).fill_null(0).to_numpy()
            for name in dict.fromkeys(names.tolist()):
                own = names == name
                old = held.get(name, (groups[int(own.argmax())], np.zeros(0, np.int64)))
                held[name] = (old[0], np.unique(np.concatenate([old[1], values[own & there]]))[:k])
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in held.values()], schema), pa.array([h.tolist() for _, h in held.values()], pa.list_(pa.int64()))], names=["_g", "hashes"])

    parts = hashed.select(group, "_h").mapInArrow(sketch, f"_g {kind}, hashes array<bigint>")
    merged = parts.groupBy("_g").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))), 1, k).alias("hashes"))
    return merged.select(*[F.col(f"_g.{c}").alias(c) for c in by], "hashes")


def distinct_estimate(hashes: Column, k: int = 1_024) -> Column:
    """Different values by a sketch: exact while there are fewer than k."""
    n = F.size(hashes)
    spread = (F.element_at(hashes, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(n < k, n.cast("double")).otherwise((k - 1) / spread)
