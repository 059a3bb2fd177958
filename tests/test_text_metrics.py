"""BLEU, ROUGE and JSON updates by hand-computed cases and brute force."""

import json
import math
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import json_update as J
from quern.functions import text_metrics as M


def bleu(spark, rows, **how):
    df = spark.createDataFrame(rows, "k int, p string, r array<string>")
    return M.corpus_bleu(df, ["k"], F.col("p"), F.col("r"), **how).first()


def test_bleu_by_hand(spark):
    # 6 of 7 words ("the" is clipped to 2), 3 of 6 pairs, 1 of 5 triples, 0 of 4 quadruples (smoothed: 1 / (2 * 4))
    row = bleu(spark, [(1, "the the the cat sat on it", ["the cat sat by the door on it"])])
    assert row["counts"] == [6, 3, 1, 0, 7, 6, 5, 4, 7, 8]
    want = 100 * math.exp(1 - 8 / 7) * (6 / 7 * 3 / 6 * 1 / 5 * 1 / 8) ** 0.25
    assert row["bleu"] == pytest.approx(want)


def test_bleu_of_a_corpus_is_that_of_its_sums(spark):
    rows = [(1, "a b c d e", ["a b c d e"]), (1, "f g h i", ["f g x i", "f g h"])]
    row = bleu(spark, rows)
    assert row["counts"] == [5 + 4, 4 + 2, 3 + 1, 2, 9, 7, 5, 3, 9, 9]
    assert row["bleu"] == pytest.approx(100 * (9 / 9 * 6 / 7 * 4 / 5 * 2 / 3) ** 0.25)


def test_bleu_of_odd_rows(spark):
    for p, r in ((None, ["a"]), ("a b c d", None), ("a b c d", []), ("", [""]), ("a b c d", ["w x y z"]), ("a b c", ["a b c"])):
        assert bleu(spark, [(1, p, r)])["bleu"] == 0
    assert bleu(spark, [(1, "a b c d", ["a b c d", None])])["bleu"] == pytest.approx(100)


def test_international_tokens():
    assert M.international("Don't pay 3.14, or $5 (now).") == ["Don", "'", "t", "pay", "3.14", ",", "or", "$", "5", "(", "now", ")", "."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_subsequences_are_longest(a, b):
    at = M.subsequence(a, b)
    found = [a[i] for i in at]
    rest = iter(b)
    assert at == sorted(set(at)) and all(x in rest for x in found)
    longest = max((k for k in range(min(len(a), len(b)) + 1) for x in combinations(a, k) if _inside(x, b)), default=0)
    assert len(at) == longest


def _inside(x, b):
    rest = iter(b)
    return all(c in rest for c in x)


def test_rouge_by_hand(spark):
    one, two, line = M.rouge_scores("police killed the gunman", "police kill the gunman")
    assert (one, two, line) == pytest.approx((75, 100 / 3, 75))
    # by lines: the union of common subsequences is "w1 w2" and "w1 w3 w5" of "w1 w2 w3 w4 w5": 4 of 5
    assert M.rouge_scores("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5")[2] == pytest.approx(200 * 4 / 15)
    rows = spark.createDataFrame([(None, "a"), ("", ""), ("a", None), ("A-b", "a b")], "p string, r string")
    assert [tuple(x["s"]) for x in rows.select(M.rouge(F.col("p"), F.col("r")).alias("s")).collect()] == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (100, 100, 100)]


def test_against_right_and_wrong_answers(spark):
    rows = [(1, "it is red and round", ["it is red and round", "red"], ["it is blue"]), (2, "no idea", [], ["no"])]
    out = {r["k"]: r for r in M.against_both(spark.createDataFrame(rows, "k int, p string, c array<string>, w array<string>"), "k", "p", "c", "w").collect()}
    first = out[1]
    assert first["bleu_max"] == pytest.approx(100) and first["rouge1_diff"] == pytest.approx(100 - 50) and first["rougeL_acc"] == 1
    assert all(out[2][f"{m}_{x}"] is None for m in M.METRICS for x in ("max", "diff", "acc"))


CASES = [
    ('{"a":1}', "$.a", "2", '{"a":2}'),
    ('{"a":1}', "b.c", '"x"', '{"a":1,"b":{"c":"x"}}'),
    ('{"a":null}', "$.a.b", "true", '{"a":{"b":true}}'),
    ('{"a":[1,2,3]}', "$.a[1]", "9", '{"a":[1,9,3]}'),
    ('{"a":[1]}', "$.a[3].k", "9", '{"a":[1,{},{},{"k":9}]}'),
    ("{}", '$["x.y"][0]', "[1,{\"z\":2}]", '{"x.y":[[1,{"z":2}]]}'),
    ('{"a":[{"k":1},{"k":2},5]}', "$.a[*].k", "0", '{"a":[{"k":0},{"k":0},5]}'),
    ('{"a":5}', "$.a.b", "1", '{"a":5}'),
    ('{"a":{"b":1}}', "$.a[0]", "1", '{"a":{"b":1}}'),
    ('{"é":1}', "$", '"ü"', '"ü"'),
    ("null", "$.a", None, '{"a":null}'),
    (None, "$.a", "1", None),
    ("not json", "$.a", "1", "not json"),
]


def test_json_updates(spark):
    for i, (text, path, value, want) in enumerate(CASES):
        df = spark.createDataFrame([(text, value)], "t string, v string")
        if i % 4 == 0:  # a few through Spark
            assert df.select(J.set_path(F.col("t"), path, F.col("v"))).first()[0] == want
        elif text is not None and text != "not json":
            assert json.dumps(J.updated(json.loads(text), J.steps_of(path), None if value is None else json.loads(value)), separators=(",", ":"), ensure_ascii=False) == want
    with pytest.raises(ValueError):
        J.steps_of("$.a[")


def test_counts_match_brute_force():
    words, refs = "a b a b c a".split(), ["a b c".split(), "b a b a".split()]
    counts = M.bleu_counts(" ".join(words), [" ".join(r) for r in refs], str.split)
    for n in (1, 2, 3, 4):
        own = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        most = {g: max(sum(tuple(r[i : i + n]) == g for i in range(len(r) - n + 1)) for r in refs) for g in own}
        assert counts[n - 1] == sum(min(c, most[g]) for g, c in own.items()) and counts[3 + n] == own.total()
