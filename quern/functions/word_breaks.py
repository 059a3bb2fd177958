"""Word tokens by Unicode's word boundary rules (UAX #29), as a standard analyzer makes them.

Every character has a class; whether there is a boundary between two depends on their classes and those around them, where
marks and joiners count with the character they follow. Runs between boundaries are tokens if they hold a letter, number,
ideograph, kana or emoji. Ideographs and hiragana stand alone, katakana and the scripts without spaces (Thai and the
like) in runs. Tokens over LONGEST characters are cut into pieces of that length. Offsets are code points.

Many texts are cut at once: their characters lie end to end in one array, with line feeds between texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest token, and characters that are cut at a time; a column's tokens come back in batches of such runs of texts.
LONGEST, RUN = 255, 1 << 18

_CLASSES = (
    "Other", "CR", "LF", "Newline", "Extend", "Format", "ZWJ", "Regional_Indicator", "Katakana", "Hebrew_Letter", "ALetter", "Single_Quote", "Double_Quote",
    "MidNumLet", "MidLetter", "MidNum", "Numeric", "ExtendNumLet", "WSegSpace",
)
_NUMBER = {name: i for i, name in enumerate((*_CLASSES, "Complex"))}
#: Bits beside the class: part of a token by itself; pictograph.
_WORD, _PICTURE = 64, 128


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """The class and bits of every code point, from the properties that the regex library knows."""
    import regex

    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    out = np.zeros(0x110000, np.uint8)

    def mark(pattern: str, value: int, add: bool) -> None:
        for m in regex.finditer(f"(?:{pattern})+", every):
            if add:
                out[m.start() : m.end()] |= value
            else:
                out[m.start() : m.end()] = value

    for name in _CLASSES[1:]:
        mark(rf"\p{{WB={name}}}", _NUMBER[name], False)
    mark(r"(?!\p{WB=Extend}|\p{WB=Format})\p{LB=SA}", _NUMBER["Complex"], False)
    out[0xD800:0xE000] = 0
    for pattern in (r"\p{WB=ALetter}", r"\p{WB=Hebrew_Letter}", r"\p{WB=Numeric}", r"\p{WB=Katakana}", r"\p{LB=SA}", r"\p{Script=Han}", r"\p{Script=Hiragana}", r"\p{WB=Regional_Indicator}"):
        mark(pattern, _WORD, True)
    mark(r"(?=\p{Extended_Pictographic})[^\x00-\xFF]", _WORD | _PICTURE, True)
    return out


def boundaries(code: np.ndarray) -> np.ndarray:
    """Whether a boundary lies before each of the code points, and (last) behind all of them."""
    n = len(code)
    out = np.ones(n + 1, bool)
    if n < 2:
        return out
    marks = _table()[code]
    kind = marks & 63
    k = _NUMBER
    line = (kind == k["CR"]) | (kind == k["LF"]) | (kind == k["Newline"])
    attached = (kind == k["Extend"]) | (kind == k["Format"]) | (kind == k["ZWJ"])
    after_line = np.append(True, line[:-1])
    own = ~attached | after_line  # what others are attached to
    at = np.flatnonzero(own)
    q = kind[at].copy()
    q[attached[at]] = k["Other"]

    def is_(*names: str) -> np.ndarray:
        found = np.zeros(len(q) + 3, bool)  # two before, one behind
        for name in names:
            found[2:-1] |= q == k[name]
        return found

    letter, number, kana, joiner = is_("ALetter", "Hebrew_Letter"), is_("Numeric"), is_("Katakana"), is_("ExtendNumLet")
    hebrew, single, double = is_("Hebrew_Letter"), is_("Single_Quote"), is_("Double_Quote")
    in_word, in_number = is_("MidLetter", "MidNumLet", "Single_Quote"), is_("MidNum", "MidNumLet", "Single_Quote")
    flag, complex_ = is_("Regional_Indicator"), is_("Complex")
    pp, p, c, nx = slice(0, -3), slice(1, -2), slice(2, -1), slice(3, None)
    joined = (letter[p] & (letter[c] | number[c])) | (number[p] & (number[c] | letter[c]))
    joined |= letter[p] & in_word[c] & letter[nx] | letter[pp] & in_word[p] & letter[c]
    joined |= hebrew[p] & (single[c] | double[c] & hebrew[nx]) | hebrew[pp] & double[p] & hebrew[c]
    joined |= number[pp] & in_number[p] & number[c] | number[p] & in_number[c] & number[nx]
    joined |= kana[p] & kana[c] | (letter[p] | number[p] | kana[p] | joiner[p]) & joiner[c] | joiner[p] & (letter[c] | number[c] | kana[c])
    joined |= complex_[p] & complex_[c]
    if flag.any():  # flags are pairs
        f = flag[c]
        start = np.flatnonzero(f & ~flag[p])
        place = np.arange(len(q)) - start[np.maximum(np.searchsorted(start, np.arange(len(q)), "right") - 1, 0)]
        joined |= f & flag[p] & (place % 2 == 1)
    out[at] = ~joined
    out[:-1][attached & ~after_line] = False
    out[1:-1] &= ~((kind[:-1] == k["WSegSpace"]) & (kind[1:] == k["WSegSpace"]))
    out[1:-1] &= ~((kind[:-1] == k["ZWJ"]) & ((marks[1:] & _PICTURE) > 0))
    out[1:-1] |= line[:-1] | line[1:]
    out[1:-1] &= ~((kind[:-1] == k["CR"]) & (kind[1:] == k["LF"]))
    out[0] = True
    return out


def token_spans(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the tokens of code points."""
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(boundaries(code))
    starts, ends = edges[:-1], edges[1:]
    words = np.maximum.reduceat((_table()[code] & _WORD) > 0, starts)
    starts, ends = starts[words], ends[words]
    pieces = -(-(ends - starts) // LONGEST)
    if (pieces > 1).any():
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + piece * LONGEST
        ends = np.minimum(starts + LONGEST, np.repeat(ends, pieces))
    return starts, ends


def runs_of(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of about RUN characters: (place of its first text, starts and ends of its tokens in their texts, the edges of texts among them)."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < RUN):
            size += len(texts[hi] or "") + 1
            hi += 1
        run = [t or "" for t in texts[lo:hi]]
        starts, ends = token_spans(np.frombuffer("\n".join(run).encode("utf-32-le", "surrogatepass"), "<u4"))
        first = np.cumsum([0, *(len(t) + 1 for t in run)])
        cut = np.searchsorted(starts, first)
        before = np.repeat(first[:-1], np.diff(cut))
        yield lo, starts - before, ends - before, cut
        lo = hi


def spans_of(texts: Sequence[str | None]) -> list[list[tuple[int, int]]]:
    """The token spans of each text."""
    out: list[list[tuple[int, int]]] = []
    for _, starts, ends, cut in runs_of(texts):
        edges = cut.tolist()
        out.extend(list(zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)) for a, b in zip(edges[:-1], edges[1:], strict=True))
    return out


def _tokens_of(batches: Iterator[pa.Array], lower: bool, placed: bool) -> Iterator[pa.Array]:
    """Each text's tokens, with their offsets where placed: a run of texts is held at a time, whatever the batch."""
    for batch in batches:
        texts = batch.to_pylist()
        for lo, starts, ends, cut in runs_of(texts):
            own = np.repeat(np.arange(lo, lo + len(cut) - 1), np.diff(cut))
            found = (texts[i][a:b] for i, a, b in zip(own, starts, ends, strict=True))
            values = pa.array((t.lower() for t in found) if lower else found, pa.string())
            if placed:
                values = pa.StructArray.from_arrays([values, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["token", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values)
        if not texts:
            yield pa.array([], pa.list_(_PLACED if placed else pa.string()))


_PLACED = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def standard_tokens(text: Column, lower: bool = True) -> Column:
    """Array of (token, start, end): (lower-case) tokens with their code-point offsets. A null text has none."""

    @F.arrow_udf("array<struct<token:string,start:int,end:int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _tokens_of(batches, lower, True)

    return cut(text)


def standard_words(text: Column, lower: bool = True) -> Column:
    """The array of (lower-case) tokens alone."""

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _tokens_of(batches, lower, False)

    return cut(text)
