"""Phrases of two to four words, mined by pivot partitioning.

A phrase is counted where its rarest word, its pivot, lives. Words are numbered from the most frequent one down; around
each occurrence of a word a text gives one fragment: the words before it (three at most) while they are more frequent, and
those after it while they are not rarer. Every occurrence of a phrase thus lies in exactly one fragment, that of the first
place of its rarest word. Fragments go to the bucket of their pivot; there phrases that contain the pivot are counted by
sorting. Equal fragments of a stretch of text travel once, with their number.

Bounds. The numbered words are the TABLE most frequent ones, which every worker holds (words of over LONGEST_WORD bytes are
never among them). A phrase with a rarer word has that word as its pivot; its fragments travel as strings and are counted in
the same way. A bit map of fixed size keeps words out that are too rare for any phrase; what it lets through by chance is
counted and then dropped. A pivot that occurs over BLOCK times is spread over buckets by a hash of its fragments, so that
no bucket depends on one word's frequency, and its buckets' counts are added up. Nothing is cut, capped or sampled.

Defined results: a null text is empty; a null language is `und`; empty texts, texts without words and empty tables give no
rows; repeated rows count as often as they come; all columns but language and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Words that are numbered, so that every worker holds them: 60 MB at most.
TABLE, LONGEST_WORD = 400_000, 100
#: Bits of the map of rarer words that are frequent enough: 8 MB.
MAP_BITS = 26
#: Fragments of a bucket, about; occurrences from which a pivot has several buckets.
BLOCK = 1 << 18
#: Bytes of text that are cut at a time, and counters that a task holds.
CHUNK, HELD = 2 << 20, 400_000

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if i in _PIECE_ENDS else 32 if i == 9 else i for i in range(256))
_END = re.compile(b"[" + re.escape(_PIECE_ENDS) + b"]")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of stretches of text of about CHUNK bytes; b"\\n" stands between pieces, b"" is no word."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()

    def words(lang: str) -> tuple[str, list[bytes]]:
        sizes.pop(lang)
        return lang, b"\n".join(held.pop(lang)).lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
            lang, text = lang.as_py(), text.as_py()
            at = 0
            while at < len(text):  # a long text is cut where a piece ends
                end = _END.search(text, at + CHUNK)
                to = end.start() if end else len(text)
                held.setdefault(lang, []).append(text[at:to])
                sizes[lang] += to - at
                at = to + 1
                if sizes[lang] >= CHUNK:
                    yield words(lang)
        if sizes.total() >= 8 * CHUNK:  # of many languages
            for lang in list(held):
                yield words(lang)
    for lang in list(held):
        yield words(lang)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of stretches, and under a null word all words of them."""
    counts: dict[str, Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            for no_word in (b"", b"\n"):
                own.pop(no_word, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(own) + 1), pa.string()), pa.array([*own, None], pa.binary()).cast(pa.string()), pa.array([*own.values(), own.total()], pa.int64())], names=["lang", "word", "n"]
            )
        counts.clear()

    for lang, words in _stretches(batches):
        counts.setdefault(lang, Counter()).update(words)
        if sum(map(len, counts.values())) > HELD:
            yield from told()
    yield from told()


def _fragments(ids: np.ndarray, reach: int) -> np.ndarray:
    """Rows of 2 * reach + 1 word numbers, the pivot in the middle, -1 where the fragment has ended."""
    padded = np.concatenate([np.full(reach, -1, ids.dtype), ids, np.full(reach, -1, ids.dtype)])
    n, out = len(ids), np.full((2 * reach + 1, len(ids)), -1, ids.dtype)
    out[reach] = ids
    for step in (-1, 1):
        inside = ids >= 0
        for d in range(1, reach + 1):
            other = padded[reach + step * d : reach + step * d + n]
            inside = inside & (other >= 0) & ((other < ids) if step < 0 else (other <= ids))
            out[reach + step * d][inside] = other[inside]
    return out[:, (out[reach - 1] >= 0) | (out[reach + 1] >= 0)]


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each column of numbers."""
    h = np.full(rows.shape[1], 0x9E3779B97F4A7C15, np.uint64)
    for row in rows:
        h = (h ^ row.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _packed(fragments: np.ndarray, occurrences: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, fragments with their numbers): equal ones of this stretch are one."""
    middle = fragments.shape[0] // 2
    pivot, h = fragments[middle], _mixed(fragments)
    spread = (occurrences[pivot] + BLOCK - 1) // BLOCK
    bucket = (_mixed(np.stack([pivot.astype(np.int64), (h >> np.uint64(33)).astype(np.int64) % spread])) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    fragments, bucket = fragments[:, order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (fragments[:, 1:] != fragments[:, :-1]).any(0)
    first = np.flatnonzero(new)
    rows = np.vstack([fragments[:, first], np.diff(np.append(first, len(order)))[None, :].astype(np.int32)])
    bucket = bucket[first]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
        own = np.ascontiguousarray(rows[:, lo:hi], "<i4")
        yield int(bucket[lo]), own.nbytes.to_bytes(8, "little") + pa.compress(own.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, rows: int) -> np.ndarray:
    content = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(content, "<i4").reshape(rows, -1)


def _counted(columns: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of word numbers and the sum of n over each."""
    key = np.zeros(columns.shape[1], np.int64)
    used = 0
    for row in columns:
        if used + bits > 62:
            _, key = np.unique(key, return_inverse=True)
            used = int(key.max(initial=0)).bit_length()
        key, used = key << bits | row, used + bits
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return columns[:, order[first]], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _mined(fragments: np.ndarray, n: np.ndarray, longest: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the phrases around the pivots of fragments (as columns) with their counts."""
    middle = fragments.shape[0] // 2
    for length in range(2, longest + 1):
        parts = []
        for before in range(length):
            lo, hi = middle - before, middle - before + length
            there = (fragments[lo] >= 0) & (fragments[hi - 1] >= 0)
            parts.append((fragments[lo:hi, there], n[there]))
        yield _counted(np.hstack([p for p, _ in parts]), np.concatenate([c for _, c in parts]), bits)


def _rare_words(vocabulary: DataFrame, table: list) -> np.ndarray | None:
    """A bit map of the hashes of the words that the table lacks; None if it has all."""
    in_table = F.lit(False)
    if table:
        last = table[-1]
        after = (F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.struct("lang", "word") > F.struct(F.lit(last["lang"]), F.lit(last["word"])))
        in_table = (F.octet_length("word") <= LONGEST_WORD) & ~after
    place = F.xxhash64("word").bitwiseAND((1 << MAP_BITS) - 1)
    bits = vocabulary.filter(~in_table).groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits"))
    parts = bits.collect()  # 2 ** (MAP_BITS - 15) rows of 4 kB at most
    if not parts:
        return None
    out = np.zeros((1 << MAP_BITS - 15, 4096), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _numbers(table: list) -> dict[str, dict[bytes, int]]:
    known: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(table):
        known.setdefault(lang, {b"": -2, b"\n": -1})[word] = i
    return known


def _numbered_phrases(texts: DataFrame, table: list, least: int, longest: int) -> DataFrame:
    """(lang, phrase, n) of phrases of the table's words; those of a pivot that has several buckets come in parts."""
    spark = texts.sparkSession
    occurrences = np.array([r["n"] for r in table], np.int64)
    buckets = int(max(1, -(-int(occurrences.sum()) // BLOCK)))
    shared = spark.sparkContext.broadcast(([(r["lang"], r["word"].encode()) for r in table], occurrences))  # TABLE words at most
    spread, bits, reach = int((occurrences > BLOCK).sum()), max(1, len(table).bit_length()), longest - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, times = shared.value
        known = _numbers(words_of)
        for lang, words in _stretches(batches):
            if lang in known:
                ids = np.fromiter(map(known[lang].get, words, repeat(-1)), np.int32, len(words))
                found = list(_packed(_fragments(ids[ids != -2], reach), times, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "raw"])

    def mine(part: pa.Table) -> pa.Table:
        words_of, _ = shared.value
        rows = np.hstack([_unpacked(x.as_py(), 2 * reach + 2) for x in part.column("raw")])
        langs, phrases, counts = [], [], []
        for ids, n in _mined(rows[:-1], rows[-1].astype(np.int64), longest, bits):
            kept = (n >= least) | (ids.max(0, initial=-1) < spread)  # the most frequent words come first
            for one in ids[:, kept].T.tolist():
                langs.append(words_of[one[0]][0])
                phrases.append(b" ".join([words_of[i][1] for i in one]))
            counts.append(n[kept])
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "n": pa.array(np.concatenate(counts), pa.int64())})

    return texts.mapInArrow(cut, "bucket long, raw binary").groupBy("bucket").applyInArrow(mine, "lang string, phrase string, n long")


def _rare_phrases(texts: DataFrame, table: list, rare: np.ndarray, longest: int) -> DataFrame:
    """(lang, phrase, n) in parts: phrases whose pivot is none of the table's words.

    Such words are ordered by a hash, and all of them after the table's.
    """
    shared = texts.sparkSession.sparkContext.broadcast(([(r["lang"], r["word"].encode()) for r in table], rare))
    reach = longest - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words_of, bits = shared.value
        numbers = _numbers(words_of)
        for lang, words in _stretches(batches):
            known = numbers.get(lang, {b"": -2, b"\n": -1})
            words = [w for w in words if w]
            rank = [known.get(w) for w in words]
            unknown = [i for i, r in enumerate(rank) if r is None]
            for i in unknown:
                h = xxhash.xxh64_intdigest(words[i], seed=42)
                place = h & (1 << MAP_BITS) - 1
                rank[i] = (1 << 40) + (h >> 2) if bits[place >> 3] >> (place & 7) & 1 else -1
            found: Counter = Counter()
            for i in unknown:
                own = rank[i]
                if own < 0:
                    continue
                lo, hi = i, i + 1
                while i - lo < reach and lo and 0 <= rank[lo - 1] < own:
                    lo -= 1
                while hi - i <= reach and hi < len(words) and 0 <= rank[hi] <= own:
                    hi += 1
                if hi - lo > 1:
                    found[b" ".join(words[lo:hi]), i - lo] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([f for f, _ in found], pa.binary()).cast(pa.string()), pa.array([a for _, a in found], pa.int32()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "fragment", "at", "n"],
            )

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "phrase", "n"])
            counts.clear()
            return out

        for batch in batches:
            for lang, fragment, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = fragment.split(" ")
                for lo in range(at + 1):
                    for hi in range(max(at + 1, lo + 2), min(len(words), lo + longest) + 1):
                        counts[lang, " ".join(words[lo:hi])] += n
            if len(counts) > HELD:
                yield told()
        yield told()

    cuts = texts.mapInArrow(cut, "lang string, fragment string, at int, n long")
    pivot = F.element_at(F.split("fragment", " "), F.col("at") + 1)
    dealt = cuts.repartition(F.xxhash64("lang", pivot), F.pmod(F.xxhash64("fragment"), F.lit(64)))  # a pivot may be any share of the words
    return dealt.mapInArrow(mine, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n) and phrases (lang, phrase, n) that occur `least` times or more in a language.

    Under a null word, words have the number of all word occurrences of the language. Both frames are written once.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("length(text) > 0")
    words = checkpointed(texts.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("word").isNull()))
    vocabulary = words.filter("word IS NOT NULL")
    table = vocabulary.filter(F.octet_length("word") <= LONGEST_WORD).orderBy(F.desc("n"), "lang", "word").limit(TABLE).collect()
    found = _numbered_phrases(texts, table, least, longest)
    rare = _rare_words(vocabulary, table)
    if rare is not None:
        found = found.unionByName(_rare_phrases(texts, table, rare, longest))
    phrases = checkpointed(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    return words, phrases


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by the score of their weakest cut.

    A phrase of frequency a, cut into parts of frequencies l and r, scores floor(2000000 a / (l + r)); the lowest cut
    counts. A phrase goes if a longer one that holds it has four fifths of its occurrences or more.
    """
    words, phrases = phrase_counts(docs, least, longest, lang, text)
    known = words.filter("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), "n").unionByName(phrases)
    parts = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), parts.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " "))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("CAST(a AS DECIMAL(20,0)) * 2000000 DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")  # products may pass 64 bits
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    size = F.size("w")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inner = phrases.select("lang", "n", parts.alias("w")).filter(size > 2).select("lang", "n", F.explode(spans).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * 80")

    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    totals = words.filter("word IS NULL").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
