"""Orders of an epoch without a sort: a keyed permutation of ordinals, and what each rank reads of it.

An ordinal is two digits, of base a and b with a * b just above the number of rows. ROUNDS rounds add to one digit a hash of the
other, in turn; that is a permutation of a * b numbers, and walking on from those beyond the last row makes it one of the
rows. Each row finds its own place, so that an epoch costs no shuffle.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.staging import with_ordinal

ROUNDS = 6
_BITS = (1 << 31) - 1
#: Odd multipliers of the hash (fixed values).
_FIRST, _SECOND = 1_103_515_245, 1_220_703_125


def round_keys(seed: int, epoch: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{epoch}:{i}".encode()).digest()[:4], "big") & _BITS for i in range(ROUNDS)]


def bases(n: int) -> tuple[int, int]:
    """a and b: a * b is n or little more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _hash(x: np.ndarray, key: int) -> np.ndarray:
    x = ((x + key) & _BITS) * _FIRST & _BITS
    x = (x ^ x >> 15) * _SECOND & _BITS
    return x ^ x >> 13


def permuted(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """The places of ordinals below n."""
    a, b = bases(n)
    out = x.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + _hash(left, key)) % b
            else:
                left = (left + _hash(right, key)) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out


def place_of(ordinal: Column, n: int, seed: int = 0, epoch: int = 0) -> Column:
    """An ordinal's place in an epoch's order."""
    keys = round_keys(seed, epoch)

    @F.arrow_udf("long")
    def places(ordinals: pa.Array) -> pa.Array:
        return pa.array(permuted(ordinals.to_numpy(zero_copy_only=False), n, keys), pa.int64())

    return places(ordinal)


def epoch_order(df: DataFrame, *order: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """df with place (from 0) in an epoch's random order. The columns of the order should tell rows apart."""
    n = df.count()
    return with_ordinal(df, *order, to="_o").withColumn("place", place_of(F.col("_o"), n, seed, epoch)).drop("_o")


def rank_samples(df: DataFrame, world: int, *order: str, seed: int = 0, epoch: int = 0, shuffle: bool = True, drop_last: bool = False) -> DataFrame:
    """df with rank and step (both from 0): what each of `world` ranks reads of an epoch, all equally many rows.

    Ranks take every world-th place. Where rows don't divide, the first places are read again at the end (as often as it
    takes), or, with drop_last, the last places aren't read.
    """
    n = df.count()
    ranked = with_ordinal(df, *order, to="_o")
    ranked = ranked.withColumn("_place", place_of(F.col("_o"), n, seed, epoch) if shuffle else F.col("_o")).drop("_o")
    total = n // world * world if drop_last else -(-n // world) * world
    if n == 0:
        total = 0
    if total > n:
        again = F.floor((F.lit(total - 1) - F.col("_place")) / max(1, n)).cast("int")
        ranked = ranked.withColumn("_k", F.explode(F.sequence(F.lit(0), again))).withColumn("_place", F.col("_place") + F.col("_k") * n).drop("_k")
    ranked = ranked.filter(F.col("_place") < total)
    return ranked.withColumns({"rank": (F.col("_place") % world).cast("int"), "step": F.floor(F.col("_place") / world).cast("long")}).drop("_place")
