"""Near-duplicates by the share of word shingles: SimHash groups and min-wise samples propose, exact Jaccard decides.

Two texts link if their sets of word shingles have a Jaccard similarity of at least `similarity`. At 0.8 about 10 of 64
SimHash bits differ, far beyond what keys over segments can tolerate, so fingerprints alone propose only the closest
texts; the others are proposed by min-wise samples, of which two texts of similarity 0.8 share one of the BANDS in 99.6 %
of cases (1 - (1 - 0.8^ROWS)^BANDS), closer ones more often. A proposal is never a link: texts meet in groups, and within
a group their whole sets are compared.

* Texts of equal sets are one class. A class is proposed under its bands and under the component of its fingerprint
  (Golay-code keys, up to 4 bits). All classes under one key belong to the group of the smallest of them, so a group that
  many keys propose is compared once.
* Groups are dealt by pairs of blocks of about BLOCK classes or BLOCK_BYTES of text. In a block, texts that a linked text
  resembles are reached step by step; links that hold these together come out, never all pairs.

Defined results: null and wordless texts have an empty set and link with one another only; a text of fewer words than a
shingle has one shingle, all of it; null ids are ids; repeated rows of an id and a text are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot, set_aside
from .components import connected_components
from .simhash import LOSERS, best_left, fingerprint_links, majority, shingle_hashes

BANDS, ROWS = 18, 6
#: Classes, and bytes of text, that a block of a group holds on average; a task compares two blocks.
BLOCK, BLOCK_BYTES = 1_024, 8 << 20
_STRIP = 4_096
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, ascending."""
    return distinct(shingle_hashes(text, shingle))


def distinct(pieces: Iterable[np.ndarray]) -> np.ndarray:
    parts = [np.unique(h) for h in pieces]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key a band, from the minima of ROWS multiplications of the hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), _STRIP):
        mixed = hashes[lo : lo + _STRIP] ^ (hashes[lo : lo + _STRIP] >> np.uint64(29))
        least = np.minimum(least, (mixed[None, :] * _MULTIPLIERS[:, None]).min(1))
    return [int(np.uint64(xxhash.xxh64_intdigest(row.tobytes(), n)).view(np.int64)) for n, row in enumerate(least.reshape(BANDS, ROWS))]


def _marks(shingle: int):
    @F.pandas_udf("cls long, fp long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        cls, fps, keys = [], [], []
        for text in texts:
            pieces = list(shingle_hashes(text, shingle))
            own = distinct(pieces)
            cls.append(xxhash.xxh64_intdigest(own.astype("<u8").tobytes()) if len(own) else 0)
            fps.append(majority(pieces))
            keys.append(bands(own))
        signed = [np.array(x, np.uint64).view(np.int64) for x in (cls, fps)]
        return pd.DataFrame({"cls": signed[0], "fp": signed[1], "bands": keys})

    return of


def resembling(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j), all of at least `similarity`, that join exactly the sets that chains of such links join."""
    sizes = np.array([len(s) for s in sets])
    unseen, queue, links = np.ones(len(sets), bool), [], []
    shingles, tokens = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (np.zeros(0), np.zeros(0, int))
    own = np.split(tokens, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts, listed = np.searchsorted(tokens, np.arange(len(shingles) + 1)), len(sets)
    for root in range(len(sets)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue.append(root)
        while queue and unseen.any():
            at = queue.pop()
            if 2 * np.count_nonzero(unseen) < listed:  # lists of those left only
                left = unseen[owner]
                tokens, owner, listed = tokens[left], owner[left], np.count_nonzero(unseen)
                starts = np.searchsorted(tokens, np.arange(len(shingles) + 1))
            first, many = starts[own[at]], starts[own[at] + 1] - starts[own[at]]
            places = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            shared = np.bincount(owner[places], minlength=len(sets))
            either = sizes[at] + sizes - shared
            near = np.flatnonzero(unseen & (shared > 0) & (shared >= similarity * either))
            unseen[near] = False
            links.extend((at, int(j)) for j in near)
            queue.extend(near.tolist())
        queue.clear()
    return links


def _compare(shingle: int, similarity: float):
    def links_of(cls: list[int], texts: list[str]) -> pd.DataFrame:
        found = resembling([shingle_set(t, shingle) for t in texts], similarity)
        return pd.DataFrame({"a": [cls[i] for i, _ in found], "b": [cls[j] for _, j in found]}, dtype=np.int64)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cls, texts = None, [], []
        for batch in batches:
            for leader, i, j, c, text in zip(batch["leader"], batch["i"], batch["j"], batch["cls"], batch["text"], strict=True):
                if (leader, i, j) != held:
                    if len(cls) > 1:
                        yield links_of(cls, texts)
                    held, cls, texts = (leader, i, j), [], []
                cls.append(c)
                texts.append(text)
        if len(cls) > 1:
            yield links_of(cls, texts)

    return compare


def _proposed(classes: DataFrame) -> DataFrame:
    """(cls, leader): the groups, each named by its smallest class, which is a member too; a class may be in several."""
    parts = connected_components(fingerprint_links(classes.select("fp").distinct()))
    rooted = classes.select("cls", "fp").join(parts, F.col("fp") == F.col("node"), "left")
    by_fp = rooted.select("cls", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("key"))
    rows = checkpointed(by_fp.unionByName(classes.select("cls", F.explode("bands").alias("key"))))
    keyed = rows.groupBy("key").agg(F.min("cls").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_hot(rows, keyed, "key", "n").select("cls", "leader").distinct()


def resemblance_links(docs: DataFrame, marked: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b) links between classes. marked: (_id, _tie, cls, fp, bands, _bytes) of each row of docs, written before."""
    own = F.struct(F.col("_id").isNull().alias("z"), "_id", "_tie")
    classes = checkpointed(marked.groupBy("cls").agg(F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min(own).alias("own"), F.max("_bytes").alias("bytes")))
    members = checkpointed(_proposed(classes))
    met = checkpointed(classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "bytes", F.col("own._id").alias("_id"), F.col("own._tie").alias("_tie")))
    held = F.broadcast(met) if met.count() <= LOSERS else met
    here = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("text"), F.xxhash64(text).alias("_t"))
    texts = here.join(held, F.col("_d").eqNullSafe(met["_id"]) & (F.col("_t") == met["_tie"])).select("cls", "text").dropDuplicates(["cls"])
    sized = members.join(met.select("cls", "bytes"), "cls").groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    sized = sized.select("leader", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    dealt = join_hot(members, sized, "leader", "n").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cls", "leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    together = dealt.join(texts, "cls").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return together.select("leader", "i", "j", "cls", "text").mapInPandas(_compare(shingle, similarity), "a long, b long")


def marks(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    found = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_tie"), bytes_.alias("_bytes"), _marks(shingle)(F.col(text)).alias("m"))
    return checkpointed(found.select("_id", "_tie", "_bytes", "m.*"))


def keep_one_resembling(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group that links of at least `similarity` join: that of the smallest id (ties: of a text hash).

    Extra columns of any names pass through.
    """
    docs, restored = set_aside(docs, doc_id, text)
    marked = marks(docs, doc_id, text, shingle)
    parts = connected_components(resemblance_links(docs, marked, doc_id, text, shingle, similarity))
    rows = checkpointed(marked.groupBy("_id", "_tie", "cls").agg(F.count(F.lit(1)).alias("n")))
    sizes = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("rows"))
    keyed = sizes.join(parts, F.col("cls") == F.col("node"), "left").select("cls", "rows", F.coalesce("component", "cls").alias("_g"))
    return restored(best_left(docs, join_hot(rows, keyed, "cls", "rows"), doc_id, text))
