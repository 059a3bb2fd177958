"""Cutting lineage, files for all executors, and gapless ordinals without one task for all rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def on_one_machine(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local session, as in tests, may name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def published(spark: SparkSession, name: str, content: bytes) -> str:
    """The path of a file with that content in the shared folder, written through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    for lo in range(0, len(content), 1 << 20):
        out.write(bytearray(content[lo : lo + (1 << 20)]))
    out.close()
    return path.toString()


#: Rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def light(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, staged, and marked for broadcast where it has at most BROADCAST_ROWS rows (or entries, as counted by the caller).

    A staged frame has no statistics, so that Spark by itself would shuffle the other side, texts and all.
    """
    df = staged(df)
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


#: Bytes of a batch, about, that a task turns into other things at a time.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch in runs of rows of about SLICE bytes: what a task makes of one is many times as large, and Spark's batches may hold 64 MB."""
    step = max(1, len(batch) * SLICE // max(SLICE, batch.nbytes))
    for lo in range(0, max(1, len(batch)), step):
        yield batch.slice(lo, step)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on columns of the same names, nulls being equal; right's other names must be new."""
    named = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return left.join(named, same, how).drop(*[f"_on{i}" for i in range(len(on))])


def rank_within(df: DataFrame, group: list[str], range_: Column, order: list[str], to: str) -> DataFrame:
    """Adds to: each row's place (from 0, gapless) in its group, by the order, of which range_ is a coarser form.

    A group may hold any share of the rows: each of its ranges is sorted on its own and offset by the sizes of those
    before it. Null groups are groups.
    """
    df = df.withColumn("_b", range_)
    key = [*group, "_b"]
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    sizes = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(key)], "_before")
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(key)]
    placed = own.join(sizes, same, "inner").withColumn(to, (F.col("_own") + F.col("_before")).cast("long"))
    return placed.drop("_b", "_own", "_before", *[f"_g{i}" for i in range(len(key))])


def with_ordinal(df: DataFrame, *order: str, to: str = "ordinal") -> DataFrame:
    """Adds each row's place (from 0) in the order of the columns, which should tell rows apart.

    Rows are dealt by ranges of the order, each range is numbered on its own and offset by the sizes of those before it:
    one small row per range crosses the network a second time.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(offsets, "_range").withColumn(to, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def with_following(df: DataFrame, order: str, value: str, to: str) -> DataFrame:
    """Adds to: the value of the row behind each in the order of a column, which should tell rows apart; null behind the last.

    Each range of the order is looked at on its own; its last row gets the first value of the next range that has rows.
    """
    ranged = staged(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy("_range").agg(F.min_by(F.struct(value), F.struct(F.col(order).isNotNull(), order)).alias("_first"))  # nulls come first
    nexts = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_next"))  # a row for each range
    own = F.lead(F.struct(value)).over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_own", own).join(nexts, "_range").withColumn(to, F.coalesce("_own", "_next").getField(value)).drop("_range", "_own", "_next")


def even_part(ordinal: Column, total: int, parts: int) -> Column:
    """Which of `parts` contiguous, near-equal parts (larger ones first) a row with that ordinal belongs to, from 0."""
    parts = max(1, min(parts, total or 1))
    size, larger = divmod(total, parts)
    if not size:
        return F.lit(0)
    edge = larger * (size + 1)
    return F.when(ordinal < edge, F.floor(ordinal / (size + 1))).otherwise(larger + F.floor((ordinal - edge) / size)).cast("int")
