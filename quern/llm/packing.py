"""Best-fit packing planned on a histogram of lengths.

A document's tokens are cut into pieces only where they exceed a sequence; the first piece takes the odd length, the
others are full. Best-fit decreasing then runs over counts: lengths from the longest to the shortest, each into the
open sequences with the least sufficient room, as many at a time as there are alike. The plan says, for each length,
which ranks go to which sequences at which offset. Documents take their slots by their rank within their length.

Size of the plan: a length opens at most two kinds of sequences and splits at most one, so there are under 3 * context
kinds; a kind takes at most sqrt(2 * context) different lengths. For 1024 that is under 140,000 rows of 40 bytes,
whatever the input, which is why it is broadcast. A length may hold any share of the pieces: ranks come from ranges of
a hash within it.

Defined results: a null text is an empty one, which still has its end token; repeated rows are packed as often as they
come; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bits_for, checkpointed, running_rank

#: The only special token of byte_bpe_50k.json, which the ranks file does not have.
END_OF_TEXT = ("<|endoftext|>", 50_256)
#: A run of white space that is not for the fast library.
BLANKS = 10_000
_BLANK_RUN = re.compile(rf"\s{{{BLANKS}}}")
Slots = tuple[int, int, int, int, int, int]  # length, first rank, ranks, first sequence, pieces in each, offset


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The byte-level BPE of a ranks file, without special tokens: all text is ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def public_bpe() -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts as byte_bpe_50k.json does, without special tokens around them.

    It runs the same vocabulary and merges from byte_bpe_50k.tiktoken, whose library is about six times as fast;
    tests hold the ids against the tokenizers library. A special token's string in a text is that token, and the text
    on either side of it is encoded by itself. That library's pattern recurses over a run of white space, and its stack
    ends at about a million: texts with a run of BLANKS or more go through the tokenizers library itself.
    """
    import public_tokenizers

    own = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    string, special = END_OF_TEXT

    def encode(text: str) -> list[int]:
        if len(text) >= BLANKS and _BLANK_RUN.search(text):
            return _library(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
        first, *others = text.split(string)
        ids = own.encode_ordinary(first)
        for part in others:
            ids.append(special)
            ids.extend(own.encode_ordinary(part))
        return ids

    return lambda texts: [encode(x) for x in texts]


def pieces_of(total: int, context: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of total tokens: only longer ones are cut, first piece odd."""
    if total <= context:
        return [(0, total)]
    odd = total % context
    return ([(0, odd)] if odd else []) + [(at, context) for at in range(odd, total, context)]


def crc32(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


#: What a piece may carry: the token ids themselves, or a digest of them.
PAYLOADS = {"ids": (T.ArrayType(T.IntegerType()), lambda ids: ids.astype(np.int32)), "ids_crc32": (T.LongType(), crc32), "none": (None, None)}


def token_pieces(docs: DataFrame, encoder: Callable[[], Callable], context: int, end: int, doc_id: str, text: str, payload: str) -> DataFrame:
    """(id, piece, start, length and the payload) of each document's pieces, from one pass over the texts."""
    kind, make = PAYLOADS[payload]
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, id_type), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType())))])
    if kind:
        schema = schema.add(payload, kind)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for batch in batches:
            rows = []
            for key, words in zip(batch[doc_id].astype(object), batch[text], strict=True):
                ids = np.array([*encode([words or ""])[0], end], np.int64)
                key = None if pd.isna(key) else key
                for n, (start, length) in enumerate(pieces_of(len(ids), context)):
                    rows.append((key, n, start, length, *([make(ids[start : start + length])] if kind else [])))
            yield pd.DataFrame(rows, columns=schema.names).astype({"piece": "int32"})

    return docs.select(doc_id, text).mapInPandas(cut, schema)


def plan(histogram: dict[int, int], context: int) -> list[Slots]:
    """Best-fit decreasing over counts of lengths, as slots for ranges of ranks. Sequences are numbered from 0."""
    rooms: list[int] = []  # the rooms that open sequences have, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # room: [first sequence, sequences]
    slots, made = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
                open_[room] = []
            open_[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, n: int, room: int) -> int:
            """Puts what is left into n sequences of that room; the number of pieces put."""
            nonlocal slots
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, context - room))
                leave(room - each * length, first, full)
            put = full * each
            odd = min(left - put, each) if full < n else 0
            if odd:
                slots.append((length, rank + put, odd, first + full, odd, context - room))
                leave(room - odd * length, first + full, 1)
            leave(room, first + full + bool(odd), n - full - bool(odd))
            return put + odd

        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                n = -(-left // (context // length))
                first, made = made, made + n
                put = fill(first, n, context)
            else:
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
                put = fill(first, n, room)
            left -= put
            rank += put
    return slots


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable] = public_bpe,
    context: int = 1024,
    end: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    payload: str = "ids",
) -> DataFrame:
    """(id, piece, start, length, payload, sequence_id, offset): where each piece of each document goes.

    encoder makes, on a worker, a function from texts to their ids; end is added to each document.
    """
    pieces = checkpointed(token_pieces(docs, encoder, context, end, doc_id, text, payload))
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most context rows
    slots = plan(counts, context)
    names = ("_length", "_first", "_ranks", "_sequence", "_each", "_offset")
    planned = docs.sparkSession.createDataFrame(slots, ", ".join(f"{n} long" for n in names))
    keyed = pieces.withColumn("_key", F.xxhash64(doc_id, "piece", "start"))
    ranked = running_rank(keyed, "length", "_key", [doc_id, "piece"], bits_for(sum(counts.values())), "_rank")
    within = F.col("_rank").between(F.col("_first"), F.col("_first") + F.col("_ranks") - 1)
    at = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(planned), (F.col("length") == F.col("_length")) & within)
    return placed.select(
        doc_id,
        "piece",
        "start",
        "length",
        *([payload] if PAYLOADS[payload][0] else []),
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from pieces with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
