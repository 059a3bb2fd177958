"""What the operators of this subpackage share: cutting lineage, joining hot keys, running totals within groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.staging import shared_folder

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of this machine where a local session names none."""
    return shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the checkpoint folder.

    Later reads, also those after a lost executor, come from there and not from the plan above it.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but those used under names that clash with nothing, and a function that names them as before."""
    names = df.columns
    plain = [n if n in used else f"c{i}__aside" for i, n in enumerate(names)]
    back = dict(zip(plain, names, strict=True))

    def restored(out: DataFrame) -> DataFrame:
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return df.toDF(*plain), restored


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with keyed (one row per key), where a few keys may hold most rows.

    weight: column of keyed with a key's number of rows. Keys that hold over 1/share of all rows - fewer than
    share of them, whatever the input - are broadcast, so that their rows stay where they are; the others shuffle.
    keyed is written once, as it is read three times. The weight column is dropped.
    """
    keyed = checkpointed(keyed)
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * share > F.lit(total)
    hot, cold = keyed.filter(is_hot).drop(weight), keyed.filter(~is_hot).drop(weight)
    near = rows.join(F.broadcast(hot), key, "inner")
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "inner")
    return near.unionByName(far)


def hash_bucket(key: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash, in the order of the (signed) hash."""
    return F.shiftright(key, 64 - bits).cast("int") if bits else F.lit(0)


def bits_for(n: int, rows_per_bucket: int = 8_192, most: int = 20) -> int:
    """Bits for about rows_per_bucket rows in a bucket."""
    return max(0, min(most, (max(1, n // rows_per_bucket) - 1).bit_length()))


def running_rank(df: DataFrame, group: str, key: str, ties: list[str], bits: int, to: str) -> DataFrame:
    """Adds to: each row's place, from 0 and gapless, among the rows of its group, in the order of the hash key.

    A group may hold any share of the rows: it is dealt by ranges of the key (its first bits), each range is sorted
    on its own, and ranges are offset by the sums of those before them - never one task for a group.
    """
    df = df.withColumn("_b", hash_bucket(F.col(key), bits))
    offsets = (
        df.groupBy(group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_b").orderBy(key, *ties)) - 1)
    return own.join(offsets, [group, "_b"]).withColumn(to, (F.col("_own") + F.col("_before")).cast("long")).drop("_b", "_own", "_before")
