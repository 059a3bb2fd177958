"""BLEU and ROUGE: clipped n-gram counts that add up over a corpus, and longest common subsequences.

BLEU: n-grams of a prediction count as often as the reference that has most of them; orders without a match get half the weight
of the one before (exponential smoothing), a prediction shorter than its nearest reference a brevity penalty. What a row gives
are counts, so that a corpus's score is that of their sums. ROUGE: F-measures of unigrams, bigrams and, line by line,
of the union of longest common subsequences with every line of the prediction. Scores run from 0 to 100.

Defined results: null texts are empty ones; without words or references all counts and scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = 4
_SIMPLE, _ROUGE = re.compile(r"\w+"), re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=1)
def _marks():
    """Punctuation keeps to numbers only; symbols stand alone (the international tokeniser's rules)."""
    import regex

    return [(regex.compile(r"(\P{N})(\p{P})"), r"\1 \2 "), (regex.compile(r"(\p{P})(\P{N})"), r" \1 \2"), (regex.compile(r"(\p{S})"), r" \1 ")]


def international(text: str) -> list[str]:
    for pattern, to in _marks():
        text = pattern.sub(to, text)
    return text.split()


def simple(text: str) -> list[str]:
    """Lower-case words."""
    return _SIMPLE.findall(text.lower())


TOKENISERS: dict[str, Callable[[str], list[str]]] = {"international": international, "simple": simple}


def _grams(words: Sequence[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu_counts(prediction: str, references: Sequence[str], tokens: Callable[[str], list[str]], orders: int = ORDERS) -> list[int]:
    """Matches of each order, n-grams of each order, words, and words of the nearest reference (the shorter of two)."""
    words, others = tokens(prediction), [tokens(r) for r in references]
    matches, totals = [], []
    for n in range(1, orders + 1):
        own, most = _grams(words, n), Counter()
        for r in others:
            most |= _grams(r, n)
        matches.append(sum(min(c, most[g]) for g, c in own.items()))
        totals.append(max(0, len(words) - n + 1))
    nearest = min((len(r) for r in others), key=lambda x: (abs(x - len(words)), x), default=0)
    return [*matches, *totals, len(words), nearest]


def bleu_of(counts: Column, orders: int = ORDERS) -> Column:
    """The score of (summed) counts."""
    matches = [F.element_at(counts, n + 1).cast("double") for n in range(orders)]
    totals = [F.element_at(counts, orders + n + 1).cast("double") for n in range(orders)]
    words, nearest = F.element_at(counts, 2 * orders + 1).cast("double"), F.element_at(counts, 2 * orders + 2).cast("double")
    logs, missed = F.lit(0.0), F.lit(0)
    for match, total in zip(matches, totals, strict=True):
        missed = missed + F.when(match == 0, 1).otherwise(0)
        logs = logs + F.log(F.when(match > 0, match / total).otherwise(1.0 / (F.pow(F.lit(2.0), missed) * total)))
    some = sum(matches[1:], matches[0]) > 0
    penalty = F.when(words < nearest, F.exp(1 - nearest / words)).otherwise(1.0)
    return F.when(some & (totals[-1] > 0), 100 * penalty * F.exp(logs / orders)).otherwise(0.0)


def bleu_stats(prediction: Column, references: Column, tokeniser: str = "international", orders: int = ORDERS) -> Column:
    """Array of counts, to be summed element by element. references: an array of texts."""

    @F.arrow_udf("array<long>")
    def counts(predictions: pa.Array, others: pa.Array) -> pa.Array:
        tokens = TOKENISERS[tokeniser]
        rows = zip(predictions.to_pylist(), others.to_pylist(), strict=True)
        return pa.array([bleu_counts(p or "", [r or "" for r in refs or []], tokens, orders) for p, refs in rows], pa.list_(pa.int64()))

    return counts(prediction, references)


def corpus_bleu(df: DataFrame, by: Sequence[str], prediction: Column, references: Column, tokeniser: str = "international", orders: int = ORDERS) -> DataFrame:
    """(by, counts, bleu) of each group: the score of its rows' summed counts."""
    rows = df.select(*by, bleu_stats(prediction, references, tokeniser, orders).alias("_c"))
    sums = rows.groupBy(*by).agg(F.array(*[F.sum(F.element_at("_c", i + 1)) for i in range(2 * orders + 2)]).alias("counts"))
    return sums.withColumn("bleu", bleu_of(F.col("counts"), orders))


def _f(matches: int, predicted: int, wanted: int) -> float:
    return 200.0 * matches / (predicted + wanted) if predicted and wanted else 0.0


def subsequence(wanted: Sequence[str], predicted: Sequence[str]) -> list[int]:
    """The places in `wanted` of a longest common subsequence: the last one, where several are as long."""
    number = {w: i for i, w in enumerate(dict.fromkeys([*wanted, *predicted]))}
    a, b = (np.array([number[w] for w in words], np.int64) for words in (wanted, predicted))
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == x)))
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif table[i, j - 1] > table[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def rouge_scores(prediction: str, reference: str) -> tuple[float, float, float]:
    """F-measures of unigrams, bigrams and common subsequences line by line."""
    lines = [[_ROUGE.findall(x.lower()) for x in text.replace(" . ", ".\n").split("\n")] for text in (prediction, reference)]
    predicted, wanted = ([w for line in own for w in line] for own in lines)
    counted = [_f((_grams(predicted, n) & _grams(wanted, n)).total(), max(0, len(predicted) - n + 1), max(0, len(wanted) - n + 1)) for n in (1, 2)]
    left, open_ = Counter(predicted), Counter(wanted)
    hits = 0
    for line in lines[1]:
        for at in sorted({k for other in lines[0] for k in subsequence(line, other)}):
            word = line[at]
            if left[word] > 0 and open_[word] > 0:
                left[word] -= 1
                open_[word] -= 1
                hits += 1
    return (*counted, _f(hits, len(predicted), len(wanted)))


def rouge(prediction: Column, reference: Column) -> Column:
    """Struct of rouge1, rouge2 and rougeL."""

    @F.arrow_udf("struct<rouge1:double,rouge2:double,rougeL:double>")
    def scores(predictions: pa.Array, references: pa.Array) -> pa.Array:
        rows = [rouge_scores(p or "", r or "") for p, r in zip(predictions.to_pylist(), references.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(3)], names=["rouge1", "rouge2", "rougeL"])

    return scores(prediction, reference)


def against_both(df: DataFrame, key: str, prediction: str, correct: str, incorrect: str, tokeniser: str = "international") -> DataFrame:
    """(key, and for bleu, rouge1, rouge2, rougeL: _max, _diff, _acc): the best score against right answers, by how much it is
    above that against wrong ones, and whether it is. Without right or wrong answers all three are null.
    """
    sides = []
    for side, answers in (("right", correct), ("wrong", incorrect)):
        rows = df.select(key, F.col(prediction).alias("_p"), F.explode(answers).alias("_r"))
        bleu = bleu_of(bleu_stats(F.col("_p"), F.array("_r"), tokeniser))
        scored = rows.select(key, bleu.alias("bleu"), rouge(F.col("_p"), F.col("_r")).alias("s")).select(key, "bleu", "s.*")
        sides.append(scored.groupBy(key).agg(*[F.max(m).alias(f"_{side}_{m}") for m in METRICS]))
    both = sides[0].join(sides[1], key, "full")
    return both.select(
        key, *[c for m in METRICS for right, wrong in [(F.col(f"_right_{m}"), F.col(f"_wrong_{m}"))] for c in (F.when(wrong.isNotNull(), right).alias(f"{m}_max"), (right - wrong).alias(f"{m}_diff"), (right > wrong).cast("int").alias(f"{m}_acc"))]
    )


METRICS = ("bleu", "rouge1", "rouge2", "rougeL")
