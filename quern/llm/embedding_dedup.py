"""Near-duplicate vectors by p-stable hashing for Euclidean distance, verified by exact cosines.

Normalised vectors are projected on random Gaussian directions, shifted and cut into cells of WIDTH; `depth` cells make a
table's key, and there are as many tables as the wanted recall at the threshold itself needs (closer pairs are found with
more certainty). Equal vectors are one class from the start. Only keys, class numbers and sketches of SKETCH bits (signs of
further projections) travel to the buckets; there, a class that differs from all others by more bits than a pair at the
threshold does, but for one in a million, has nothing to compare. The vectors of the other classes follow, and cosines in
double precision decide, by matrix products; a pair counts in the first table that both share, so that a vector's links
are counted without listing pairs, and only links that hold the bucket together come out for the components. Buckets over
DEFER rows are dealt by pairs of blocks to many tasks. Depth grows with the logarithm of the input, which keeps buckets
small.

Defined results: vectors that are null, zero, or have null or non-finite components, and rows with a null label, link
with nothing; vectors of different lengths don't link; rows of one id are one node of the components, but each row counts
the links of its own vector; a null id is no node; repeated rows count as vectors of their own; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot
from .components import connected_components
from .simhash import _stars
from .vectors import as_bytes, class_of, kind_of, matrix, takes_part

WIDTH = 2.0
DEFER, BLOCK = 8_192, 2_048
#: Members of a bucket of unrelated vectors to aim at.
BUCKET = 512
#: Bits of a sketch, and how often it may part a pair at the threshold.
SKETCH, MISSED = 128, 1e-6


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one projection puts two vectors at that distance into one cell."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def depth_and_tables(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """depth: unrelated (orthogonal) vectors share a bucket about BUCKET/n often; tables: for the recall at cosine."""
    depth = max(4, math.ceil(math.log(max(1, n) / BUCKET) / -math.log(collision(math.sqrt(2)))) if n > BUCKET else 4)
    near = collision(math.sqrt(2 - 2 * cosine)) ** depth
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - near))


def _hashes(unit: np.ndarray, depth: int, tables: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], tables * depth))
    shift = rng.uniform(0, WIDTH, tables * depth)
    odd = rng.integers(1 << 62, size=(tables, depth), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, depth)
    with np.errstate(over="ignore"):
        mixed = (cells * odd[None]).sum(axis=2, dtype=np.uint64)
        return mixed ^ (mixed >> np.uint64(29))


def most_bits(cosine: float) -> int:
    """The bits in which the sketches of a pair at that cosine differ at most, but for MISSED of such pairs."""
    p = math.acos(min(1.0, cosine)) / math.pi
    seen = 0.0
    for bits in range(SKETCH + 1):
        seen += math.comb(SKETCH, bits) * p**bits * (1 - p) ** (SKETCH - bits)
        if 1 - seen <= MISSED:
            return bits
    return SKETCH


def _sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    directions = np.random.default_rng([seed, unit.shape[1], SKETCH]).standard_normal((unit.shape[1], SKETCH))
    return np.packbits(unit @ directions >= 0, axis=1).view(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _with_partners(most: int):
    """Of rows (key, tab, cid, s0, s1) sorted by key: those whose sketch is near that of another row of their key, and large keys whole."""

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        key, sketch = rows["key"].to_numpy(), rows[["s0", "s1"]].to_numpy(np.int64).view(np.uint64)
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(edges, len(key)))
        size_at, place = np.repeat(sizes, sizes), np.arange(len(key)) - np.repeat(edges, sizes)
        keep = size_at > DEFER
        for step in range(1, 16):
            x = np.flatnonzero((size_at <= 16) & (place + step < size_at))
            if not len(x):
                break
            x = x[_apart(sketch[x], sketch[x + step]) <= most]
            keep[x] = keep[x + step] = True
        for g in np.flatnonzero((sizes > 16) & (sizes <= DEFER)):
            own = sketch[edges[g] : edges[g] + sizes[g]]
            for lo in range(0, len(own), 512):
                apart = np.bitwise_count(own[lo : lo + 512, None, 0] ^ own[None, :, 0]) + np.bitwise_count(own[lo : lo + 512, None, 1] ^ own[None, :, 1])
                keep[edges[g] + lo : edges[g] + min(lo + 512, len(own))] |= (apart <= most).sum(axis=1) > 1  # itself is one
        return rows.loc[keep, ["key", "tab", "cid"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, large = None, None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = None
            if large is not None:  # the rest of a key that is kept whole
                n = int(np.searchsorted(rows["key"].to_numpy(), large, "right"))
                yield rows.iloc[:n][["key", "tab", "cid"]]
                if n == len(rows):
                    continue
                rows, large = rows.iloc[n:].reset_index(drop=True), None
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1]))
            if cut:
                yield near(rows.iloc[:cut].reset_index(drop=True))
            held = rows.iloc[cut:].reset_index(drop=True)
            if len(held) > DEFER:
                large = int(held["key"].iloc[0])
                yield held[["key", "tab", "cid"]]
                held = None
        if held is not None and len(held):
            yield near(held)

    return run


OUT = "kind tinyint, a long, b long, key long, cid long, label long, n long, vec binary, sig binary"
LINK, COUNT, ASIDE = 0, 1, 2


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    none = pd.Series([None] * len(a), dtype=object)
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int8), "a": a, "b": b, "key": 0, "cid": 0, "label": 0, "n": 0, "vec": none, "sig": none})


class _Rows:
    """Rows of a bucket as arrays."""

    def __init__(self, rows: pd.DataFrame, kind: str):
        self.id, self.cid, self.n, self.label = (rows[c].to_numpy(np.int64) for c in ("rep", "cid", "n", "label"))
        x = matrix(rows["vec"], kind)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.sig = np.frombuffer(b"".join(rows["sig"]), "<u4").reshape(len(rows), -1)


def _compare(x: _Rows, y: _Rows, table: int, cosine: float, same: bool, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adds each row's links, first seen in this table, to counts; returns links that hold the rows together."""
    out_a, out_b = [], []
    for lo in range(0, len(x.id), 256):
        hi = min(lo + 256, len(x.id))
        linked = (x.unit[lo:hi] @ y.unit.T >= cosine) & (x.label[lo:hi, None] == y.label[None, :])
        if same:
            linked &= np.arange(lo, hi)[:, None] < np.arange(len(y.id))[None, :]
        s, t = np.nonzero(linked)
        if not len(s):
            continue
        a, b = _stars(x.id[lo:hi][s], y.id[t])
        out_a.append(a)
        out_b.append(b)
        for at in range(0, len(s), 65_536):
            i, j = s[at : at + 65_536] + lo, t[at : at + 65_536]
            first = ~(x.sig[i, :table] == y.sig[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
            np.add.at(counts[0], i[first], y.n[j[first]])
            np.add.at(counts[1], j[first], x.n[i[first]])
    if not out_a:
        return x.id[:0], x.id[:0]
    return _stars(np.concatenate(out_a), np.concatenate(out_b))


def _in_buckets(kind: str, cosine: float):
    def group(rows: pd.DataFrame, out: list) -> None:
        """Buckets of rows that are sorted by key."""
        key = rows["key"].to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            x = _Rows(rows.iloc[lo:hi], kind)
            counts = np.zeros(hi - lo, np.int64)
            a, b = _compare(x, x, int(rows["tab"].iloc[lo]), cosine, True, (counts, counts))
            if len(a):
                out.append(_found(LINK, a, b))
                out.append(_found(COUNT, x.cid[counts > 0], counts[counts > 0]))

    def aside(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(len(rows), ASIDE, np.int8), "a": rows["rep"], "b": rows["tab"].astype("int64"), "key": rows["key"], "cid": rows["cid"], "label": rows["label"], "n": rows["n"], "vec": rows["vec"], "sig": rows["sig"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, large = None, None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = None
            if large is not None:
                n = int(np.searchsorted(rows["key"].to_numpy(), large, "right"))
                yield aside(rows.iloc[:n])
                if n == len(rows):
                    continue
                rows, large = rows.iloc[n:], None
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1]))
            out: list = []
            group(rows.iloc[:cut], out)
            held = rows.iloc[cut:]
            if len(held) > DEFER:
                large = int(held["key"].iloc[0])
                out.append(aside(held))
                held = None
            if out:
                yield pd.concat(out, ignore_index=True)
        if held is not None and len(held):
            out = []
            group(held, out)
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    recall: float = 0.999,
    seed: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(id, n_links, component_id) for each row: links are pairs of one label with that cosine at least."""
    kind = kind_of(vectors, embedding)
    part = F.when(takes_part(F.col(embedding)) & F.col(label).isNotNull() & F.col(vec_id).isNotNull(), class_of(label, embedding))
    rows = checkpointed(vectors.select(F.col(vec_id).alias("_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("_v"), part.alias("_c")))
    classes = rows.filter("_c IS NOT NULL").groupBy("_c").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"), F.any_value("_v").alias("_v"))
    classes = checkpointed(as_bytes(classes, "_v", "vec").drop("_v").withColumn("cid", F.monotonically_increasing_id()))
    depth, tables = depth_and_tables(classes.count(), cosine, recall)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vec"].map(len), sort=False):
                x = matrix(part["vec"], kind)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                sig, sketch = _hashes(unit, depth, tables, seed), _sketches(unit, seed)
                salt = part["label"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(part["vec"].iloc[0]))
                keys = (sig ^ salt[:, None]) * np.uint64(0xD6E8FEB86659FD93) + np.arange(tables, dtype=np.uint64)
                yield pd.DataFrame({"cid": part["cid"], "s0": sketch[:, 0], "s1": sketch[:, 1], "sig": [x.tobytes() for x in sig.astype("<u4")], "keys": list(keys.view(np.int64))})

    signed = checkpointed(classes.select("cid", "label", "vec").mapInPandas(sign, "cid long, s0 long, s1 long, sig binary, keys array<long>"))
    dealt = signed.select("cid", "s0", "s1", F.posexplode("keys").alias("tab", "key")).select("key", F.col("tab").cast("short").alias("tab"), "cid", "s0", "s1")
    met = dealt.repartition("key").sortWithinPartitions("key").mapInPandas(_with_partners(most_bits(cosine)), "key long, tab short, cid long")
    met = checkpointed(met)
    whole = classes.select("cid", "rep", "n", "label", "vec").join(signed.select("cid", "sig"), "cid").join(met.select("cid").distinct(), "cid", "left_semi")
    found = met.join(whole, "cid").repartition("key").sortWithinPartitions("key").mapInPandas(_in_buckets(kind, cosine), OUT)
    found = checkpointed(found)
    links, counts = found.filter(F.col("kind") == LINK).select("a", "b"), found.filter(F.col("kind") == COUNT).select("a", "b")
    large = found.filter(F.col("kind") == ASIDE)
    if not large.isEmpty():
        more = checkpointed(_in_blocks(large, kind, cosine))
        links = links.unionByName(more.filter(F.col("kind") == LINK).select("a", "b"))
        counts = counts.unionByName(more.filter(F.col("kind") == COUNT).select("a", "b"))
    parts = connected_components(links)
    totals = counts.groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    known = classes.select("_c", "cid", "rep", "n").join(totals, "cid", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(
        "_c",
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
        F.col("n").alias("_n"),
    )
    linked = join_hot(rows.filter("_c IS NOT NULL").select("_id", "_c"), known, "_c", "_n").drop("_c")
    others = rows.filter("_c IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.select("_id", "n_links", "component_id").unionByName(others).withColumnRenamed("_id", vec_id)


def _in_blocks(large: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Large buckets (rows set aside: a id, b table), by pairs of blocks."""
    sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    rows = join_hot(large, sizes, "key", "rows").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), F.col("a").alias("rep"), F.col("b").alias("tab"), "cid", "label", "n", "vec", "sig")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        table = int(group["tab"].iloc[0])
        if group["i"].iloc[0] == group["j"].iloc[0]:
            x = _Rows(group, kind)
            seen = np.zeros(len(group), np.int64)
            a, b = _compare(x, x, table, cosine, True, (seen, seen))
            ids = x.cid
        else:
            left = group["left"].to_numpy(bool)
            if left.all() or not left.any():
                return _found(LINK, np.zeros(0, np.int64), np.zeros(0, np.int64))
            x, y = _Rows(group[left], kind), _Rows(group[~left], kind)
            of_x, of_y = np.zeros(len(x.id), np.int64), np.zeros(len(y.id), np.int64)
            a, b = _compare(x, y, table, cosine, False, (of_x, of_y))
            ids, seen = np.concatenate([x.cid, y.cid]), np.concatenate([of_x, of_y])
        return pd.concat([_found(LINK, a, b), _found(COUNT, ids[seen > 0], seen[seen > 0])])

    return rows.groupBy("key", "i", "j").applyInPandas(compare, OUT)
