"""Near-duplicates by SimHash fingerprints, found through Golay-code keys.

A 64-bit fingerprint is the majority, bit by bit, of the XXH64 hashes of a text's word shingles. It is cut into segments
of 22, 21 and 21 bits, each padded to a 23-bit word. If two fingerprints differ in at most 4 bits, the two segments
with fewest errors have at most 2 between them: either at most one each, or none in one and two in each other segment.

* At most one each, segments i and j: the first fingerprint emits (codewords near i, codeword of j), the second (codeword
  of i, codewords near j); "near" holds the decodings of the word and of all words one bit away (1 or 6 of them). Both
  contain the pair (codeword of the second's i, codeword of the first's j), so they meet.
* None in i and two in j: both emit (i itself, codewords near j); the decoding of a word between is in both.

Pairs that meet under a key are verified by their exact distance. Equal fingerprints are one class from the start.
A key's fingerprints are compared in place, without emitting pairs; only links that hold the group together come out.
Groups over DEFER rows are dealt by pairs of blocks to many tasks. All of this is exact: no cap, no sampling.

Defined results: null and wordless texts have fingerprint zero; a null id never becomes a component's id unless all its
ids are null; repeated rows come out as often as they go in; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import checkpointed, join_hot, set_aside
from .components import connected_components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints under one key that a task compares at once; BLOCK of them in a task of a larger group.
DEFER, BLOCK = 8_192, 4_096
_CHUNK = 65_536


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The unsigned hashes of a whole text's shingles, repeats included, in bounded pieces; none for a wordless text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    hashed, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    for lo in range(0, n, _CHUNK):
        spans = zip(starts[lo : min(lo + _CHUNK, n)], ends[lo + shingle - 1 :], strict=False)
        yield np.array([hashed(joined[s:e], seed) for s, e in spans], "<u8")


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes: their majority, bit by bit; zero for none."""
    counts, n = np.zeros(64, np.int64), 0
    for h in pieces:
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of a whole text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprint_of(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))

    return of(text)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the signed fingerprint of each document."""
    return docs.select(F.col(doc_id), fingerprint_of(F.col(text), shingle).alias("fp"))


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for low, bits in SEGMENTS]


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, side, fp): side 1 and 2 meet each other, side 3 meets itself."""
    for whole in batches:
        for lo in range(0, len(whole), 20_000):
            fp = whole["fp"].to_numpy(np.int64)[lo : lo + 20_000]
            parts = _segments(fp)
            single = [golay.decode(p).astype(np.int64) for p in parts]
            many = [golay.distinct(golay.near(p, bits)) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
            out = []
            for tag, (i, j) in enumerate(PAIRS):
                at, near = many[i]
                out.append((tag << 48 | near.astype(np.int64) << 12 | single[j][at], 1, fp[at]))
                at, near = many[j]
                out.append((tag << 48 | single[i][at] << 12 | near.astype(np.int64), 2, fp[at]))
            for i in range(3):
                at, near = many[(i + 1) % 3]
                out.append(((3 + i) << 48 | parts[i].astype(np.int64)[at] << 12 | near.astype(np.int64), 3, fp[at]))
            yield pd.DataFrame({"key": np.concatenate([k for k, _, _ in out]), "side": np.concatenate([np.full(len(k), s, np.int8) for k, s, _ in out]), "fp": np.concatenate([f for _, _, f in out])})


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links a-b, with a link to its smallest node for each other node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= most


def _block_links(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of fingerprints, reduced to stars strip by strip."""
    found_a, found_b = [], []
    for lo in range(0, len(a), 512):
        x, y = np.nonzero(_close(a[lo : lo + 512, None], b[None, :], most))
        if len(x):
            s, t = _stars(a[lo : lo + 512][x], b[y])
            found_a.append(s)
            found_b.append(t)
    if not found_a:
        return a[:0], a[:0]
    return _stars(np.concatenate(found_a), np.concatenate(found_b))


def _linked(most: int):
    """Links from rows sorted by key: kind 0 links a to b; kind 1 sets row b of the large group with key a aside."""

    def group_links(key: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(edges, len(key)))
        size_at = np.repeat(sizes, sizes)
        place = np.arange(len(key)) - np.repeat(edges, sizes)
        small = size_at <= 16
        a, b = [], []
        for step in range(1, 16):
            x = np.flatnonzero(small & (place + step < size_at))
            if not len(x):
                break
            x = x[_close(fp[x], fp[x + step], most)]
            a.append(fp[x])
            b.append(fp[x + step])
        for g in np.flatnonzero(sizes > 16):
            own = np.unique(fp[edges[g] : edges[g] + sizes[g]])
            s, t = _block_links(own, own, most)
            a.append(s)
            b.append(t)
        a, b = np.concatenate([*a, fp[:0]]), np.concatenate([*b, fp[:0]])
        off = a != b
        if off.any():
            s, t = _stars(a[off], b[off])
            yield pd.DataFrame({"kind": np.zeros(len(s), np.int8), "a": s, "b": t})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held_fp, aside = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key = np.concatenate([held_key, batch["key"].to_numpy(np.int64)])
            fp = np.concatenate([held_fp, batch["fp"].to_numpy(np.int64)])
            if aside is not None:  # the rest of a large group
                n = int(np.searchsorted(key, aside, "right"))
                if n:
                    yield pd.DataFrame({"kind": np.ones(n, np.int8), "a": key[:n], "b": fp[:n]})
                if n == len(key):
                    held_key, held_fp = key[:0], fp[:0]
                    continue
                key, fp, aside = key[n:], fp[n:], None
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from group_links(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
            if len(held_key) > DEFER:
                aside = held_key[0]
                yield pd.DataFrame({"kind": np.ones(len(held_key), np.int8), "a": held_key, "b": held_fp})
                held_key, held_fp = held_key[:0], held_fp[:0]
        if len(held_key):
            yield from group_links(held_key, held_fp)

    return link


def fingerprint_links(classes: DataFrame, most: int = 4) -> DataFrame:
    """(a, b) links that join exactly those distinct fingerprints (column fp) that chains of at most `most` bits join.

    most is 4 or less: the segments' errors are bounded for that.
    """
    assert 0 <= most <= 4
    keyed = classes.select("fp").mapInPandas(_keys, "key long, side tinyint, fp long").select("key", "fp")
    found = checkpointed(keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_linked(most), "kind tinyint, a long, b long"))
    links = found.filter("kind = 0").select("a", "b")
    aside = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if aside.isEmpty():
        return links
    aside = aside.distinct()
    blocks = aside.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = join_hot(aside, blocks.withColumn("rows", F.col("n").cast("long")), "key", "rows").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, left = group["fp"].to_numpy(np.int64), group["left"].to_numpy(bool)
        a, b = (fp, fp) if group["i"].iloc[0] == group["j"].iloc[0] else (fp[left], fp[~left])
        s, t = _block_links(a, b, most)
        return pd.DataFrame({"a": s, "b": t})

    return links.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(id, fp, component_id) for each document: component_id is the smallest id that links reach, its own included."""
    marked = checkpointed(fingerprints(docs, doc_id, text, shingle))
    return components_of(marked, doc_id, most)


def components_of(marked: DataFrame, doc_id: str = "doc_id", most: int = 4) -> DataFrame:
    """marked (id, fp and any other columns, written before) with component_id."""
    classes = checkpointed(marked.groupBy("fp").agg(F.min(doc_id).alias("first"), F.count(F.lit(1)).alias("rows")))
    parts = connected_components(fingerprint_links(classes, most))
    rooted = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "first", "rows", "component")
    alone = rooted.filter("component IS NULL").select("fp", F.col("first").alias("component_id"), "rows")
    linked = rooted.filter("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    keyed = alone.unionByName(join_hot(linked, least.join(linked.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component"), "component", "n").select("fp", "component_id", "rows"))
    return join_hot(marked, keyed, "fp", "rows")


def hex_of(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """The documents with one of each group of near-duplicates left: that of the smallest id (ties: of a text hash).

    Extra columns of any names pass through. Texts are not shuffled: the rows that go, at most LOSERS of them, are broadcast; more are joined by a shuffle.
    """
    docs, restored = set_aside(docs, doc_id, text)
    tie = F.xxhash64(text)
    marked = checkpointed(docs.select(F.col(doc_id).alias("_id"), tie.alias("_tie"), fingerprint_of(F.col(text), shingle).alias("fp")))
    rows = components_of(marked, "_id", most)
    group = F.struct(F.col("component_id").isNull().alias("z"), F.coalesce("component_id", F.col("fp")).alias("c"))
    rows = checkpointed(rows.groupBy("_id", "_tie", group.alias("_g")).agg(F.count(F.lit(1)).alias("n")))
    return restored(best_left(docs, rows, doc_id, text))


def best_left(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with one row of each group left: that of the smallest id (ties: of a text hash).

    rows: (_id, _tie, _g, n), one for each id and text hash, with its group and its number of rows in docs.
    """
    order = F.struct(F.col("_id").isNull().alias("z"), "_id", "_tie")
    best = rows.groupBy("_g").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    judged = checkpointed(join_hot(rows, best, "_g", "_n").withColumn("_stays", order == F.col("_best")))
    gone = judged.filter(~F.col("_stays")).select("_id", "_tie")
    again = judged.filter(F.col("_stays") & (F.col("n") > 1)).select("_id", "_tie")
    same = lambda other: (F.col(doc_id).eqNullSafe(other["_id"])) & (F.col("_t") == other["_tie"])
    left = docs.withColumn("_t", F.xxhash64(text))
    left = left.join(F.broadcast(gone) if gone.count() <= LOSERS else gone, same(gone), "left_anti")
    if again.isEmpty():
        return left.drop("_t")
    held = F.broadcast(again) if again.count() <= LOSERS else again
    once = left.join(held, same(again), "left_semi").dropDuplicates([doc_id, "_t"])
    return left.join(held, same(again), "left_anti").unionByName(once).drop("_t")


#: Rows of an id and a hash: 8 MB at most.
LOSERS = 500_000
