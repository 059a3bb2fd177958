"""A bit map of 64-bit hashes, built by the executors and held by every task, that lets only suspects through.

Two bits stand for a hash. With SPACING bits for each, fewer than 2 % of other hashes pass (the filter's `expected`); the map
has at most MOST_BITS, beyond which more of them pass. It decides nothing: what passes is compared exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each hash, and of the largest map (128 MB).
SPACING, MOST_BITS = 16, 30
_PART = 15  # bits of the number of bits in a row of Spark's bitmap aggregate


@dataclass
class HashFilter:
    bits: int
    hashes: int
    map: np.ndarray

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the (signed) hashes may be in the set."""
        out = np.ones(len(hashes), bool)
        for place in places(hashes, self.bits):
            out &= (self.map[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return out

    @property
    def expected(self) -> float:
        """The share of other hashes that pass."""
        return float((1 - np.exp(-2 * self.hashes / 2.0**self.bits)) ** 2)


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each hash: from its lower and upper half."""
    mask = (1 << bits) - 1
    return [hashes & mask, (hashes >> 64 - bits) & mask]


def bits_for(hashes: int) -> int:
    return min(MOST_BITS, max(_PART, (SPACING * max(1, hashes) - 1).bit_length()))


def bit_rows(df: DataFrame, hash_: str, bits: int) -> DataFrame:
    """(part, bits): rows of 2 ** 15 bits of the map of a column of hashes."""
    mask = (1 << bits) - 1
    at = F.explode(F.array(F.col(hash_).bitwiseAND(F.lit(mask)), F.shiftright(F.col(hash_), 64 - bits).bitwiseAND(F.lit(mask)))).alias("at")
    rows = df.filter(F.col(hash_).isNotNull()).select(at)
    return rows.groupBy(F.shiftright("at", _PART).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << _PART) - 1))).alias("bits"))


def from_rows(rows: DataFrame, bits: int, hashes: int) -> HashFilter:
    """The filter on the driver, 2 ** MOST_BITS bits at most."""
    out = np.zeros((1 << bits - _PART, 1 << _PART - 3), np.uint8)
    for r in rows.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return HashFilter(bits, hashes, out.reshape(-1))


def hash_filter(df: DataFrame, hash_: str, hashes: int) -> HashFilter:
    """A filter of a column that has so many different hashes."""
    bits = bits_for(hashes)
    return from_rows(bit_rows(df, hash_, bits), bits, hashes)


def may_hold(hash_: Column, found: HashFilter, spark: SparkSession) -> Column:
    """Whether a hash may be in the filter's set."""
    shared = spark.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def may(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.probe(batch.to_numpy(np.int64)))

    return may(hash_)


def passing(df: DataFrame, hash_: Column, found: HashFilter) -> DataFrame:
    """The rows of df whose hash may be in the filter's set, without a shuffle."""
    return df.filter(may_hold(hash_, found, df.sparkSession))
