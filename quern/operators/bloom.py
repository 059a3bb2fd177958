"""Removal of exact copies behind a blocked Bloom filter: texts and their keys stay where they lie unless they are suspects.

Tasks put the digests of their rows into two filters of the same size: `once`, for digests that were met, and `twice`, for
those that `once` had already. Filters of different tasks are merged in a tree: what is in both `once` is `twice`. A
row whose digest isn't in the merged `twice` has no copy anywhere. The others are suspects: only their keys and digests (128
bits) are grouped, which confirms or clears them, so that the result is that of the exact step.

A digest has a block of 512 bits and one bit in each of its eight words. At BITS_PER_ROW bits for a row, at most RATE of
the rows without a copy are suspects. Filters have at most 2 ** MOST_BITS bits: beyond, more rows are suspects, and the result
is the same. At most BUILDERS tasks build filters, so that merging moves BUILDERS filters, whatever the input.

Defined results: as dedup.first_copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.dedup import digested, without_later_copies

BITS_PER_ROW, RATE, MOST_BITS, BUILDERS = 24, 0.01, 29, 128
_WORDS = 8
#: Blocks of a row of the filter that travels.
_RANGE = 1 << 10


def blocks_for(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    """Blocks of 512 bits, a power of two."""
    bits = max(1, rows) * bits_per_row
    return 1 << max(0, min(MOST_BITS, (bits - 1).bit_length()) - 9)


def places(a: np.ndarray, b: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest, and the bit set in each of its words."""
    shifts = np.arange(0, 6 * _WORDS, 6, dtype=np.uint64)
    return a & (blocks - 1), np.uint64(1) << (b.astype(np.uint64)[:, None] >> shifts & np.uint64(63))


def holds(filter_: np.ndarray, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (filter_[block] & bits == bits).all(axis=1)


def _add(filter_: np.ndarray, block: np.ndarray, bits: np.ndarray) -> None:
    for w in range(_WORDS):
        np.bitwise_or.at(filter_[:, w], block, bits[:, w])


def built(batches: Iterator[tuple[np.ndarray, np.ndarray]], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(once, twice) of batches of digests."""
    once, twice = np.zeros((blocks, _WORDS), np.uint64), np.zeros((blocks, _WORDS), np.uint64)
    for a, b in batches:
        pairs, n = np.unique(np.stack([a, b]), axis=1, return_counts=True)
        block, bits = places(pairs[0], pairs[1], blocks)
        again = (n > 1) | holds(once, block, bits)
        _add(twice, block[again], bits[again])
        _add(once, block, bits)
    return once, twice


def merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return one[0] | other[0], one[1] | other[1] | (one[0] & other[0])


def twice_filter(digests: DataFrame, blocks: int) -> np.ndarray:
    """The merged filter of digests that may be there twice. digests: two longs."""
    schema = "part int, task int, once binary, twice binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = built(((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows), blocks)
        task = TaskContext.get().partitionId()
        for lo in range(0, blocks, _RANGE):
            if once[lo : lo + _RANGE].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo // _RANGE], pa.int32()), pa.array([task], pa.int32()), *(pa.array([x[lo : lo + _RANGE].tobytes()], pa.binary()) for x in (once, twice))], names=["part", "task", "once", "twice"]
                )

    def merge(part: pa.Table) -> pa.Table:
        held = None
        for once, twice in zip(part.column("once"), part.column("twice"), strict=True):
            own = tuple(np.frombuffer(x.as_py(), np.uint64) for x in (once, twice))
            held = own if held is None else merged(held, own)
        return pa.table({"part": part.column("part")[:1], "task": pa.array([part.column("task")[0].as_py() // 16], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("once", "twice"), held, strict=True)}})

    parts = digests.coalesce(BUILDERS).mapInArrow(build, schema)
    level = parts.groupBy("part", F.floor(F.col("task") / 16)).applyInArrow(merge, schema)  # 16 filters at a time
    whole = level.groupBy("part").applyInArrow(merge, schema)
    out = np.zeros((blocks, _WORDS), np.uint64)
    for r in whole.select("part", "twice").toLocalIterator():  # 2 ** MOST_BITS bits at most
        own = np.frombuffer(r["twice"], np.uint64).reshape(-1, _WORDS)
        out[r["part"] * _RANGE : r["part"] * _RANGE + len(own)] = own
    return out


def suspects(df: DataFrame, key: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """(key, two halves of the digest) of the rows that may have a copy."""
    rows = digested(df, text).select(key, "_a", "_b")
    blocks = blocks_for(rows.count(), bits_per_row)
    shared = df.sparkSession.sparkContext.broadcast(twice_filter(rows.select("_a", "_b"), blocks))

    @F.pandas_udf("boolean")
    def may(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(holds(shared.value, *places(a.to_numpy(np.int64), b.to_numpy(np.int64), blocks)))

    return rows.filter(may("_a", "_b"))


def first_copies(df: DataFrame, key: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """One row for each distinct text: that of the smallest key (null keys last); of repeated rows, one of them."""
    return without_later_copies(digested(df, text), suspects(df, key, text, bits_per_row), key).drop("_a", "_b")
