"""Token counts of the sections of documents, from one encoding of each whole document.

A document is encoded once; each token's span of characters follows from the bytes it stands for. Sections are
spans of characters, in order and disjoint; tokens are joined to them by binary search on both ends of their spans. A
token that crosses a border, or lies in part in no section, is allocated by a rule:

* ``first``: to the section of its first character; ``last``: of its last character;
* ``most``: to the section that holds most of its characters (ties: the earlier one);
* ``share``: to each section by the characters it holds there (counts are then fractions).

A token that begins or ends within a character spans the whole of it. What the rule gives to no section is counted
under section -1 (characters outside all sections), so that a document's counts always add up to its tokens.

Defined results: a null or empty text has no sections and no tokens, hence no rows; repeated rows give their rows
again; a null id passes through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .packing import END_OF_TEXT, encoding, public_bpe

RULES = ("first", "last", "most", "share")
Spans = tuple[np.ndarray, np.ndarray]  # starts, ends


def line_spans(text: str) -> Spans:
    """Lines with their line feed."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    edges = np.concatenate([[0], at if not len(at) or at[-1] < len(text) else at[:-1], [len(text)]])
    return edges[:-1], edges[1:]


def token_spans(text: str, lengths: np.ndarray) -> Spans:
    """The character spans of tokens that stand for so many bytes each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return character[starts], character[ends - 1] + 1


def allocate(tokens: Spans, sections: Spans, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section, and of none."""
    (ts, te), (ss, se) = tokens, sections
    n = len(ss)
    if not n:
        return np.zeros(0), float(len(ts))

    def holds(character: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ss, character, "right") - 1
        return np.where((at >= 0) & (character < se[np.maximum(at, 0)]), at, -1)

    first, last = holds(ts), holds(te - 1)
    if rule in ("first", "last"):
        at = first if rule == "first" else last
        counts = np.bincount(at + 1, minlength=n + 1).astype(float)
        return counts[1:], counts[0]
    inside = (first == last) & (first >= 0)
    counts = np.bincount(first[inside], minlength=n).astype(float)
    none = 0.0
    for s, e in zip(ts[~inside].tolist(), te[~inside].tolist(), strict=True):  # the few that cross a border
        lo, hi = int(np.searchsorted(se, s, "right")), int(np.searchsorted(ss, e))
        held = np.minimum(se[lo:hi], e) - np.maximum(ss[lo:hi], s)
        if rule == "share":
            counts[lo:hi] += held / (e - s)
            none += 1 - held.sum() / (e - s)
        elif len(held):
            counts[lo + int(held.argmax())] += 1
        else:
            none += 1
    return counts, none


@lru_cache(maxsize=2)
def _token_lengths(ranks_path: str, pattern: str) -> np.ndarray:
    own = encoding(ranks_path, pattern)
    special = END_OF_TEXT[1]
    out = np.array([len(own.decode_single_token_bytes(i)) for i in range(own.n_vocab)], np.int64)
    return np.append(out, np.zeros(special + 1 - len(out), np.int64)) if special >= len(out) else out


def public_lengths() -> Callable[[str], np.ndarray]:
    """The byte lengths of a text's tokens in byte_bpe_50k: those of the encoder that packing uses."""
    import public_tokenizers

    string, special = END_OF_TEXT
    lengths = _token_lengths(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).copy()
    lengths[special] = len(string)
    encode = public_bpe()
    return lambda text: lengths[np.array(encode([text])[0], np.int64)]


def section_tokens(
    docs: DataFrame,
    lengths: Callable[[], Callable[[str], np.ndarray]] = public_lengths,
    sections: Callable[[str], Spans] = line_spans,
    rule: str = "first",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, section, start, end, tokens) for each section of each document; section -1 for what is in none.

    lengths makes, on a worker, a function from a text to its tokens' byte lengths; sections gives a text's spans.
    """
    assert rule in RULES
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *(T.StructField(n, t) for n, t in (("section", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("tokens", T.DoubleType())))])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lengths()
        for batch in batches:
            out = []
            for key, words in zip(batch[doc_id].astype(object), batch[text], strict=True):
                if not words:
                    continue
                spans = sections(words)
                counts, none = allocate(token_spans(words, of(words)), spans, rule)
                at = np.arange(len(counts))
                start, end = spans
                if none > 1e-9:
                    at, start, end, counts = np.append(at, -1), np.append(start, 0), np.append(end, 0), np.append(counts, none)
                out.append((key, at, start, end, counts))
            keys = pd.Series([None if pd.isna(k) else k for k, *_ in out], dtype=object)
            yield pd.DataFrame({
                doc_id: keys.repeat([len(x[1]) for x in out]).reset_index(drop=True),
                **{name: np.concatenate([x[i] for x in out]) if out else [] for i, name in ((1, "section"), (2, "start"), (3, "end"), (4, "tokens"))},
            })

    return docs.select(doc_id, text).mapInPandas(count, schema)
