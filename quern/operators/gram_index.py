"""The benchmark's grams as a stored, versioned table: bucketed and sorted by hash, with a bit map of the hashes.

A version is a folder named after its content (number of grams, and sums of their hashes), with three parts: `grams`, `filter`
and, written last, `manifest`. A folder without a complete manifest isn't a version. The same grams give the same version,
which is then opened instead of written; other grams stand beside it. As the table is bucketed, a join with it
shuffles only the other side: the few runs of tokens that passed the bit map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.hash_filter import HashFilter, bit_rows, bits_for, from_rows, hash_filter
from quern.operators.staging import light, staged


@dataclass
class StoredGrams:
    """rows: (hash, n, gram); sizes: the lengths of grams that there are."""

    version: str
    sizes: list[int]
    rows: DataFrame
    filter: HashFilter


#: Bits by which a gram's hash is turned before the next token's is put in.
_TURN = 5


def gram_hash(words: Column) -> Column:
    """The hash of a gram, from its array of tokens: their hashes, each turned by its place, in one."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda h, w: F.shiftleft(h, _TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - _TURN)).bitwiseXOR(F.xxhash64(w)))


def run_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """gram_hash of the n tokens from each one on, whatever texts they are of, from the tokens' (signed) hashes."""
    own, size = tokens.view(np.uint64), max(0, len(tokens) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = (out << np.uint64(_TURN) | out >> np.uint64(64 - _TURN)) ^ own[i : i + size]
    return out.view(np.int64)


def gram_hashes(grams: DataFrame) -> DataFrame:
    """(hash, n, gram) of the distinct grams."""
    return grams.select("n", "gram").distinct().select(gram_hash(F.split("gram", " ")).alias("hash"), "n", "gram")


def passing_grams(grams: DataFrame) -> StoredGrams:
    """The grams of this session: written once, broadcast while they are few."""
    rows = staged(gram_hashes(grams))
    sizes = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}  # the few lengths in use
    total = sum(sizes.values())
    return StoredGrams("", sorted(sizes), light(rows, total), hash_filter(rows, "hash", total))


def store_grams(grams: DataFrame, folder: str, buckets: int = 64) -> StoredGrams:
    """The version of these grams below the folder, written unless it is there."""
    spark = grams.sparkSession
    rows = staged(gram_hashes(grams))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("hash"), F.lit(0)).alias("x"), F.coalesce(F.bit_xor(F.xxhash64("n", "gram")), F.lit(0)).alias("y")).first()
    version = f"{sums['n']}-{sums['x'] & (1 << 64) - 1:016x}{sums['y'] & (1 << 64) - 1:016x}"
    if version not in versions(spark, folder):
        bits = bits_for(sums["n"])
        sizes = sorted(r["n"] for r in rows.select("n").distinct().collect())
        table = _table(version)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        rows.repartition(buckets, "hash").write.mode("overwrite").format("parquet").bucketBy(buckets, "hash").sortBy("hash").option("path", f"{folder}/{version}/grams").saveAsTable(table)
        bit_rows(rows, "hash", bits).write.mode("overwrite").parquet(f"{folder}/{version}/filter")
        manifest = spark.createDataFrame([(version, sums["n"], sizes, bits, buckets)], "version string, grams long, sizes array<int>, bits int, buckets int")
        manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/{version}/manifest")
    return open_grams(spark, folder, version)


def _table(version: str) -> str:
    return f"grams_{version.replace('-', '_')}"


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The complete versions below the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/manifest/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().getParent().getName() for f in found)


def open_grams(spark: SparkSession, folder: str, version: str) -> StoredGrams:
    """A stored version. A session that hasn't written it gets its table from the manifest."""
    m = spark.read.schema("version string, grams long, sizes array<int>, bits int, buckets int").json(f"{folder}/{version}/manifest").first()
    table = _table(version)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (hash BIGINT, n INT, gram STRING) USING parquet OPTIONS (path '{folder}/{version}/grams') CLUSTERED BY (hash) SORTED BY (hash) INTO {m['buckets']} BUCKETS"
    )
    found = from_rows(spark.read.parquet(f"{folder}/{version}/filter"), m["bits"], m["grams"])
    return StoredGrams(version, list(m["sizes"]), spark.table(table), found)
