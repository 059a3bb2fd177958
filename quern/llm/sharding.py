"""Shards of near-equal bytes by Karmarkar-Karp differencing, with equal texts kept together.

A group (equal texts) is a partial partition that has its bytes in one shard and none in the others. Two partial
partitions are combined by laying the largest part of one on the smallest of the other, and so on; always the two of
largest spread (largest part less smallest). As combining is all there is, it is done in levels: groups are dealt by
hash to buckets of about BUCKET, each bucket becomes one partial partition on an executor, and these are combined on
further levels, FAN_IN at a time, until one is left. Each level is a small table that says where the parts of a bucket
went, so a group's shard is found by following it up; memory is bounded by BUCKET, and the driver holds nothing.

Defined results: a null text has size 1 and is equal to other null texts (and to no empty one); a group larger than
a shard's fair part makes its shard that much larger; repeated rows belong to one group; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, checkpointed, join_hot, running_rank

BUCKET, FAN_IN = 20_000, 1_024


def difference(partitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions (rows: the sizes of their parts, descending) to one.

    Returns its sizes, descending, and for each input row where its parts went.
    """
    n, k = partitions.shape
    if n == 1:
        return partitions[0], np.arange(k)[None, :]
    sums = {i: row.tolist() for i, row in enumerate(partitions)}
    merges: list[tuple[int, int, list[int], list[int]]] = []  # two nodes, where the parts of each go in the new one
    heap = [(row[-1] - row[0], i) for i, row in sums.items()]
    heapq.heapify(heap)
    last = n - 1
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = sums.pop(a), sums.pop(b)
        y.reverse()
        total = [p + q for p, q in zip(x, y, strict=True)]
        order = sorted(range(k), key=total.__getitem__, reverse=True)
        place = [0] * k
        for to, at in enumerate(order):
            place[at] = to
        sums[node] = [total[at] for at in order]
        merges.append((a, b, place, place[::-1]))
        heapq.heappush(heap, (sums[node][-1] - sums[node][0], node))
        last = node
    went = np.zeros((2 * n - 1, k), np.int32)
    went[last] = np.arange(k)
    for node in range(last, n - 1, -1):
        a, b, of_a, of_b = merges[node - n]
        went[a] = went[node][of_a]
        went[b] = went[node][of_b]
    return np.array(sums[last]), went[:n]


def _level(parts: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """parts (bucket, item, sizes): combined by bucket. Returns (bucket, sizes) and (item, went)."""

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", ignore_index=True)
        rows = np.zeros((len(group), shards), np.int64)
        for i, row in enumerate(group["sizes"]):
            rows[i, : len(row)] = row
        total, went = difference(rows)
        bucket = group["bucket"].iloc[0]
        items = pd.DataFrame({"bucket": bucket, "item": group["item"], "sizes": None, "went": [row.tolist() for row in went]})
        return pd.concat([items, pd.DataFrame({"bucket": [bucket], "item": [None], "sizes": [total.tolist()], "went": [None]})])

    found = checkpointed(parts.groupBy("bucket").applyInPandas(combine, "bucket long, item binary, sizes array<long>, went array<int>"))
    return found.filter("item IS NULL").select("bucket", "sizes"), found.filter("item IS NOT NULL").select("bucket", "item", "went")


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(item, shard) for groups (item binary, weight long): each group whole in one shard, weights near equal."""
    n = groups.count()
    bits = bits_for(n, BUCKET, 40)
    hashed = F.xxhash64("item", F.lit(bits))
    level = groups.select((F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0)).cast("long").alias("bucket"), "item", F.array("weight").alias("sizes"))
    sums, went = _level(level, shards)
    placed = went.select("item", "bucket", F.col("went")[0].alias("shard"))
    while bits:
        # the next level: this one's buckets are its items
        step = min(bits, FAN_IN.bit_length() - 1)
        bits -= step
        as_item = lambda c: F.encode(F.lpad(F.col(c).cast("string"), 19, "0"), "UTF-8")
        up = sums.select(F.shiftrightunsigned(F.col("bucket"), step).cast("long").alias("up"), as_item("bucket").alias("item"), "sizes")
        sums, went = _level(up.select(F.col("up").alias("bucket"), "item", "sizes"), shards)
        steps = went.select(F.col("item").cast("string").cast("long").alias("_from"), F.col("bucket").alias("_to"), "went")
        rows = steps.count()
        steps = F.broadcast(steps) if rows <= 100_000 else steps  # under 10 MB at 16 shards
        placed = placed.join(steps, F.col("bucket") == F.col("_from")).select("item", F.col("_to").alias("bucket"), F.element_at("went", F.col("shard") + 1).alias("shard"))
    return placed.select("item", F.col("shard").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each document; slot is its gapless place in its shard."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = checkpointed(
        docs.select(
            F.col(doc_id),
            (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(content).alias("text_crc32"),
            F.unhex(F.when(F.col(text).isNull(), F.lit("00")).otherwise(F.sha2(content, 256))).alias("item"),
        )
    )
    groups = checkpointed(base.groupBy("item").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("weight")))
    placed = shard_groups(groups.select("item", "weight"), shards)
    keyed = placed.join(groups.select("item", "rows"), "item")
    spread = join_hot(base, keyed, "item", "rows").withColumn("_key", F.xxhash64(F.col(doc_id), F.col("text_crc32")))
    n = base.count()
    return running_rank(spread, "shard", "_key", [doc_id, "size", "text_crc32"], bits_for(n // shards), "slot").select(doc_id, "size", "text_crc32", "shard", "slot")
