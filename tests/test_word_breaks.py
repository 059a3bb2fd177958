"""Unicode word boundaries: cases of the published rules, the regex library's own boundaries, offsets, long tokens."""

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import word_breaks as W
from quern.functions.tokens import token_offsets, tokens


def segments(text):
    at = np.flatnonzero(W.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4")))
    return [text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


#: A boundary stands where the bar stands; a case for each rule (WB3 to WB16, WB999).
CASES = (
    "a|\r\n|a", "a|\n|̈|a", "a|\r|̈", "\U0001f468‍\U0001f469|x", "a|  |b", "ä‍̈b|,", "AB|:|:|b", "a:b|.", "a.b'c|'|.", "a’b|’", "1|:|a",
    "א'|.", "א\"ב|\"|.", "א|\"|a", "12a3b", "3,456.789|,", "3|,|a", "1|.|.|2", "3'4|'", "カタカナ|a", "_a_1_カ_|.", "__|,",
    "\U0001f1e9\U0001f1ea|\U0001f1eb\U0001f1f7|\U0001f1fa|a", "a|\U0001f1e9‍\U0001f1ea|\U0001f1eb", "漢|字|ひ|ら", "a­̈b|漢̈|c", "can't|,|32.3|!", "\U0001f44d\U0001f3fd|\U0001f44d",
)


@pytest.mark.parametrize("case", CASES)
def test_published_rules(case):
    assert segments(case.replace("|", "")) == case.split("|")


@settings(max_examples=400, deadline=None)
@given(st.text("bk1_.,':;\" \r\n\u30ab\u6f22\u05d0\U0001f44d-\u0663", max_size=14))
def test_as_the_regex_library(text):
    """Without marks, joiners and single flags, where the library departs from the rules."""
    assert segments(text) == [p for p in regex.split(r"(?V1)(?w)\b", text) if p]


@settings(max_examples=200, deadline=None)
@given(st.text("ab1.:' \u30ab\u05d0", max_size=10), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("\u0308\u00ad\u200d")), max_size=4))
def test_marks_change_no_boundary(text, marks):
    """WB4: what is attached to a character counts with it."""
    want, got = segments("x" + text), "x" + text
    for at, mark in sorted(marks, reverse=True):
        at = min(at, len(text)) + 1
        if got[at - 1 : at] + got[at : at + 1] != "  ":  # marks part blanks (WB3d)
            got = got[:at] + mark + got[at:]
    assert [regex.sub("[\u0308\u00ad\u200d]", "", s) for s in segments(got)] == want


def test_tokens_and_offsets():
    text = "Don't pay 3.14 für 漢字, ひらカタカナ ภาษาไทย \U0001f468‍\U0001f469 __ foo_bar \U0001f1e9\U0001f1ea"
    (spans,) = W.spans_of([text])
    assert [text[a:b] for a, b in spans] == ["Don't", "pay", "3.14", "für", "漢", "字", "ひ", "ら", "カタカナ", "ภาษาไทย", "\U0001f468‍\U0001f469", "foo_bar", "\U0001f1e9\U0001f1ea"]


def test_long_tokens_are_cut():
    (spans,) = W.spans_of(["a" * 600 + " " + "b" * 255])
    assert [b - a for a, b in spans] == [255, 255, 90, 255]


def test_texts_keep_apart(monkeypatch):
    texts = ["a", None, "", "b'", "'c", "̈d", "x" * 50, "e\r", "\nf"]
    alone = [W.spans_of([t])[0] for t in texts]
    for run in (1, 10, 1 << 20):
        monkeypatch.setattr(W, "RUN", run)
        assert W.spans_of(texts) == alone


def test_in_spark(spark):
    df = spark.createDataFrame([(1, "ÄB 漢字 c.d"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["t"] for r in df.orderBy("doc_id").select(tokens(F.col("text"), "standard").alias("t")).collect()] == [["äb", "漢", "字", "c.d"], [], []]
    assert [tuple(r) for r in token_offsets(df, mode="standard").orderBy("pos").collect()] == [(1, 0, "äb", 0, 2), (1, 1, "漢", 3, 4), (1, 2, "字", 4, 5), (1, 3, "c.d", 6, 9)]


def test_tokens_come_back_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(W, "RUN", 40)
    texts = ["Ab 漢字 cd. " * 5, None, "", "x", "Ünï-1 b"] * 3
    want = [[(t[a:b].lower(), a, b) for a, b in own] for t, own in zip(texts, W.spans_of(texts), strict=True)]
    placed = list(W._tokens_of(iter([pa.array(texts, pa.string()), pa.array([], pa.string())]), True, True))
    assert max(len(x.flatten()) for x in placed) <= 40  # the tokens of a run, not of a batch
    assert [[(x["token"], x["start"], x["end"]) for x in own] for part in placed for own in part.to_pylist()] == want
    words = [own for part in W._tokens_of(iter([pa.array(texts, pa.string())]), True, False) for own in part.to_pylist()]
    assert words == [[t for t, _, _ in own] for own in want]
