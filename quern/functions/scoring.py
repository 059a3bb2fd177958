"""Scores of answers and models."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.cleaning import as_number, number_aware
from quern.operators.staging import light, null_safe_join, staged


def rounded(value: Column, places: int) -> Column:
    """A double to so many decimals as SQL engines in C do it: the scaled double is rounded, half away from zero.

    F.round rounds the shortest decimal that stands for the double, which differs where the scaled double isn't the half
    that the decimal is: 20,485 / 5,120 = 4.0009765625 becomes 4.000976563 there and 4.000976562 here.
    """
    scaled = F.abs(value) * F.lit(10.0**places)
    whole = F.floor(scaled)
    nearest = F.signum(value) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / F.lit(10.0**places)
    return F.when(scaled < 2.0**52, nearest).otherwise(value)


def bag_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two token sets; an empty prediction has precision 1, an empty gold recall 1."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g)).cast("double")
    precision = F.when(F.size(p) == 0, 1.0).otherwise(both / F.size(p))
    recall = F.when(F.size(g) == 0, 1.0).otherwise(both / F.size(g))
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def set_f1(predicted: set[str], gold: set[str]) -> float:
    both = len(predicted & gold)
    precision = both / len(predicted) if predicted else 1.0
    recall = both / len(gold) if gold else 1.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of a one-to-one assignment of greatest total gain (shortest augmenting paths)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, last, low = row, -1, 0.0
        while i >= 0:
            step = low + cost[i] - u[i] - v
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], last
            last = int(np.where(done, np.inf, dist).argmin())
            low, done[last] = dist[last], True
            i = int(owner[last])
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                u[owner[j]] += low - dist[j]
            v[j] += dist[j] - low
        u[row] += low
        while last >= 0:
            before = int(via[last])
            owner[last] = owner[before] if before >= 0 else row
            last = before
    return [(j, int(owner[j])) if flip else (int(owner[j]), j) for j in range(m) if owner[j] >= 0]


def _without(bags: list[frozenset[str]], counts: dict[frozenset[str], int]) -> list[frozenset[str]]:
    """bags less so many of each."""
    return list((Counter(bags) - Counter(counts)).elements())


def spans_score(predicted: Sequence[str], gold: Sequence[str]) -> tuple[float, float]:
    """(exact match, F1) of answers that consist of spans, aligned one to one; numbers must agree."""
    p, g = [number_aware(x) for x in predicted], [number_aware(x) for x in gold]
    exact = float(set(p) == set(g) and len(p) == len(g))
    if not p or not g:
        return exact, exact
    numbers = lambda bag: {w for w in bag if as_number(w) is not None}
    golds, bags = ([frozenset(x.split()) for x in spans] for spans in (g, p))
    # Equal bags of one word or none gain 1, and no other pairing of the four bags involved gains more.
    alike = {b: n for b, n in (Counter(golds) & Counter(bags)).items() if len(b) < 2}
    total = float(sum(alike.values()))
    golds, bags = _without(golds, alike), _without(bags, alike)
    holding: dict[str, list[int]] = {}
    for j, b in enumerate(bags):
        for w in b:
            holding.setdefault(w, []).append(j)
    gain = np.zeros((len(golds), len(bags)))
    for i, a in enumerate(golds):
        needed = numbers(a)
        for j in {j for w in a for j in holding.get(w, ())}:  # others share no word, and gain nothing
            if not needed or needed & bags[j]:
                gain[i, j] = set_f1(bags[j], a)
    gain = gain[gain.any(axis=1)][:, gain.any(axis=0)]
    if gain.size:
        total += sum(gain[i, j] for i, j in best_assignment(gain))
    return exact, round(total / max(len(g), len(p)), 2)


@F.arrow_udf(T.StructType().add("exact", T.DoubleType()).add("f1", T.DoubleType()))
def spans_match(predicted: pa.Array, golds: pa.Array) -> pa.Array:
    """The best scores of predicted spans over several gold answers (arrays of arrays of spans); a row's spans are held at a time."""
    best = np.zeros((2, len(predicted)))
    for i, (p, gs) in enumerate(zip(predicted, golds, strict=True)):
        own = p.as_py()
        scores = [spans_score(own, g) for g in gs.as_py()]
        best[:, i] = np.max(scores, axis=0) if scores else 0.0
    return pa.StructArray.from_arrays([pa.array(best[0]), pa.array(best[1])], names=["exact", "f1"])


def gold_answers(answers: Column) -> Column:
    """Distinct answers as spans from (number, spans, day, month, year): a number before spans before a date."""
    date = lambda a: F.array(F.trim(F.concat_ws(" ", a["day"], a["month"], a["year"])))
    spans = lambda a: F.when(a["number"] != "", F.array(a["number"])).when(F.size(a["spans"]) > 0, a["spans"]).otherwise(date(a))
    return F.array_distinct(F.transform(answers, spans))


def true_mass(log_likelihoods: Column, labels: Column) -> Column:
    """The share of exp(log-likelihood) that the choices before the first label 0 have."""
    mass = lambda keep: F.aggregate(F.filter(F.transform(log_likelihoods, lambda x, i: F.when(keep(i), F.exp(x))), lambda e: e.isNotNull()), F.lit(0.0), lambda a, e: a + e)
    cut = F.array_position(labels, 0).cast("int") - 1
    return mass(lambda i: i < cut) / mass(lambda i: i >= 0)


def threshold_class(score: Column, threshold: float) -> Column:
    """(label, success): whether the score reaches the threshold; a missing score is no success."""
    return F.struct((score >= threshold).cast("int").alias("label"), score.isNotNull().alias("success"))


def choice_scores(log_likelihoods: Column, gold: Column, texts: Column) -> Column:
    """(acc, acc_norm, nll_per_char) of a question: whether the likeliest choice is the gold one (from 0), whether the likeliest by
    character is, and the gold one's negative log-likelihood by character. The first of equal choices counts.

    Null for a question whose gold choice is absent or has no likelihood; an empty choice counts as one character.
    """
    sizes = F.transform(texts, lambda x: F.greatest(F.length(x), F.lit(1)))
    by_size = F.zip_with(log_likelihoods, sizes, lambda x, n: x / n)
    first = lambda values: F.array_position(values, F.array_max(values)) - 1
    there = (gold >= 0) & (gold < F.size(log_likelihoods)) & F.try_element_at(by_size, gold + 1).isNotNull()
    hit = lambda values: (first(values) == gold).cast("double")
    return F.when(there, F.struct(hit(log_likelihoods).alias("acc"), hit(by_size).alias("acc_norm"), (-F.try_element_at(by_size, gold + 1)).alias("nll_per_char")))


def task_means(rows: DataFrame, *by: str, scores: str = "scores") -> DataFrame:
    """(by, acc, acc_norm, nll_per_char, questions): means over the questions that have scores."""
    names = ("acc", "acc_norm", "nll_per_char")
    return rows.groupBy(*by).agg(*[F.avg(f"{scores}.{n}").alias(n) for n in names], F.count(scores).alias("questions"))


def perplexities(rows: DataFrame, *by: str, log_likelihood: str = "log_likelihood", text: str = "text") -> DataFrame:
    """(by, word_perplexity, byte_perplexity, bits_per_byte) from sums of log-likelihoods, words and UTF-8 bytes of texts."""
    total, some = F.sum(log_likelihood), F.col(log_likelihood).isNotNull()
    words = F.sum(F.when(some, F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))))
    size = F.sum(F.when(some, F.octet_length(text)))
    return rows.groupBy(*by).agg(
        F.exp(-F.try_divide(total, words)).alias("word_perplexity"), F.exp(-F.try_divide(total, size)).alias("byte_perplexity"), (-F.try_divide(total, size) / math.log(2)).alias("bits_per_byte")
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def masked_accuracy(predicted: Column, label: Column, ignore: int = -100) -> Column:
    return F.avg(F.when(label != ignore, (predicted == label).cast("double")))


def mean_scores(judged: DataFrame, missing: float = -1) -> DataFrame:
    """(model, turn, score, n): means by model and turn, and by model (turn null); scores that are missing don't count."""
    rows = judged.filter(F.col("score") != missing)
    return rows.groupingSets([["model", "turn"], ["model"]], "model", "turn").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def judge_pairs(answers: DataFrame, questions: DataFrame, references: DataFrame | None = None, baseline: str | None = None) -> DataFrame:
    """(question_id, model_1, model_2, answer_1, answer_2, question, reference): what a judge compares, question by question.

    Every two models that answered a question, by name; with a baseline, each other model (first) against it. answers:
    (question_id, model, answer); questions: (question_id, question); references: (question_id, reference), may lack some.
    """
    one, two = (answers.select("question_id", F.col("model").alias(f"model_{i}"), F.col("answer").alias(f"answer_{i}")) for i in (1, 2))
    if baseline is None:
        pairs = one.join(two, "question_id").filter(F.col("model_1") < F.col("model_2"))
    else:
        pairs = one.filter(F.col("model_1") != baseline).join(two.filter(F.col("model_2") == baseline), "question_id")
    return _with_question(pairs, questions, references)


def judge_single(answers: DataFrame, questions: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(question_id, model, answer, question, reference): each answer to be graded by itself."""
    return _with_question(answers.select("question_id", "model", "answer"), questions, references)


def _with_question(rows: DataFrame, questions: DataFrame, references: DataFrame | None) -> DataFrame:
    rows = rows.join(questions.select("question_id", "question"), "question_id")
    if references is None:
        return rows.withColumn("reference", F.lit(None).cast("string"))
    return rows.join(references.select("question_id", "reference"), "question_id", "left")


def later_wins(results: DataFrame, order: str, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value): the union of result dictionaries, given as rows; of one key the value of the largest order."""
    return results.groupBy(key).agg(F.max_by(value, order).alias(value))


def mean_of_rates(*rates: Column) -> Column:
    """The mean of several aggregated rates, as of strict and loose accuracies by prompt and by instruction."""
    total = rates[0]
    for rate in rates[1:]:
        total = total + rate
    return total / len(rates)


def latest(df: DataFrame, order: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """The row of the largest order (of each group)."""
    return df.groupBy(*per).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def best(df: DataFrame, value: str, ties: Sequence[str], per: Sequence[str] = (), lower: bool = True) -> DataFrame:
    """The row of the least (or largest) value of each group; of several, the first in the order of ties."""
    place = F.struct((F.col(value) if lower else -F.col(value)).alias("v"), *ties)
    return df.filter(F.col(value).isNotNull()).groupBy(*per).agg(F.min_by(F.struct(*df.columns), place).alias("r")).select("r.*")


def best_threshold(rows: DataFrame, doubt: str = "doubt", score: str = "score", has_answer: str = "has_answer") -> DataFrame:
    """One row (best, threshold): the percentage reached if questions of a doubt above the threshold are left unanswered.

    Answering gains a question's score if it has an answer, and loses one point if it has none. Doubts are dealt by
    ranges, which are summed on their own and offset by the sums before them; of equal gains the least doubt counts.
    """
    gain = F.when(F.col(has_answer), F.col(score).cast("double")).otherwise(F.lit(-1.0))
    at = rows.groupBy(F.col(doubt).alias("d")).agg(F.sum(gain).alias("g"), F.count_if(~F.col(has_answer)).alias("none"), F.count(F.lit(1)).alias("n"))
    at = staged(at.repartitionByRange("d").withColumn("_r", F.spark_partition_id()))
    before = F.sum("s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sums = at.groupBy("_r").agg(F.sum("g").alias("s")).select("_r", F.coalesce(before, F.lit(0.0)).alias("b"))  # a row for each range
    reached = at.join(F.broadcast(sums), "_r").withColumn("x", F.col("b") + F.sum("g").over(Window.partitionBy("_r").orderBy("d")))
    whole = at.agg(F.sum("none").alias("none"), F.sum("n").alias("n"))
    top = reached.groupBy().agg(F.max(F.struct("x", (-F.col("d")).alias("d"))).alias("t"))
    both = top.join(whole, F.lit(True))
    use = F.col("t.x") > 0
    return both.select((100.0 * (F.col("none") + F.when(use, F.col("t.x")).otherwise(0.0)) / F.col("n")).alias("best"), F.when(use, -F.col("t.d")).otherwise(0.0).alias("threshold"))


def win_rates(judged: DataFrame) -> DataFrame:
    """Per model: wins, losses, ties and rates, from (model_1, model_2, g1_winner, g2_winner).

    Games that disagree, or that both name a tie, are ties; rows in which either is "error" don't count.
    """
    rows = judged.filter((F.col("g1_winner") != "error") & (F.col("g2_winner") != "error"))
    agreed = (F.col("g1_winner") == F.col("g2_winner")) & (F.col("g1_winner") != "tie")
    one = F.when(~agreed, "tie").when(F.col("g1_winner") == "model_1", "win").otherwise("loss")
    two = F.when(one == "win", "loss").when(one == "loss", "win").otherwise("tie")
    both = rows.select(F.explode(F.array(F.struct(F.col("model_1").alias("model"), one.alias("r")), F.struct(F.col("model_2").alias("model"), two.alias("r")))).alias("x")).select("x.*")
    sums = both.groupBy("model").agg(*[F.count_if(F.col("r") == r).alias(r) for r in ("win", "loss", "tie")])
    n = F.col("win") + F.col("loss") + F.col("tie")
    return sums.select("model", "win", "loss", "tie", (F.col("win") / n).alias("win_rate"), (F.col("loss") / n).alias("loss_rate"), ((F.col("win") + 0.5 * F.col("tie")) / n).alias("win_rate_adjusted"))


def running_best(df: DataFrame, value: str, order: str, per: Sequence[str] = (), patience: int | None = None, lower: bool = True) -> DataFrame:
    """df with best (so far), since_best (rows since it was reached) and, with patience, whether to stop.

    Rows are dealt by ranges of groups and order, and each range is followed on its own; what the ranges of a group before it
    have reached (one small row each) goes in at its start. So a group of any size has many tasks. While a group has
    had no value its best is null, and every row counts as the latest. The order should tell a group's rows apart.
    """
    least = F.min if lower else F.max
    better = F.least if lower else F.greatest  # both pass nulls over
    ranged = staged(df.repartitionByRange(*per, order).withColumn("_range", F.spark_partition_id()))
    parts, own = [*per, "_range"], Window.partitionBy(*per, "_range").orderBy(order)
    before = Window.partitionBy(*per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*parts).agg(least(value).alias("_best"), F.count(F.lit(1)).alias("_n"))
    starts = ends.select(*parts, least("_best").over(before).alias("_best"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"))
    rows = null_safe_join(ranged, light(starts), parts)
    rows = rows.withColumn("best", better(least(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_best")).withColumn("_row", F.row_number().over(own) + F.col("_rows"))
    prior = F.lag("best").over(own)
    prior = F.when(F.row_number().over(own) == 1, F.col("_best")).otherwise(prior)
    rows = staged(rows.withColumn("_at", F.when(prior.isNull() | (F.col("best") != prior), F.col("_row"))))
    reached = rows.groupBy(*parts).agg(F.max("_at").alias("_at"))
    reached = reached.select(*parts, F.max("_at").over(before).alias("_reached"))
    rows = null_safe_join(rows, light(reached), parts)
    last = F.greatest(F.max("_at").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_reached")
    rows = rows.withColumn("since_best", (F.col("_row") - last).cast("int"))
    if patience is not None:
        rows = rows.withColumn("stop", F.col("since_best") >= patience)
    return rows.drop("_row", "_at", "_range", "_best", "_rows", "_reached")


def preference_metrics(rows: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Mean rewards, accuracy and margin of preference pairs."""
    c, r = F.col(chosen), F.col(rejected)
    return rows.agg(F.avg(c).alias("chosen_mean"), F.avg(r).alias("rejected_mean"), F.avg((c > r).cast("double")).alias("accuracy"), F.avg(c - r).alias("margin"))


def question_scores(rows: DataFrame) -> DataFrame:
    """Exact and F1 (percent) overall, and for questions with and without answers, from (exact, f1, has_answer)."""
    part = lambda c, when: (100.0 * F.avg(F.when(when, F.col(c)))) if when is not None else 100.0 * F.avg(c)
    has, none = F.col("has_answer"), ~F.col("has_answer")
    return rows.agg(*[part(c, w).alias(f"{p}{c}") for p, w in (("", None), ("HasAns_", has), ("NoAns_", none)) for c in ("exact", "f1")])


def warmup_cosine(step: Column, warmup: int, most: int, high: float, low: float | None = None, start: float = 0.0) -> Column:
    low = high / 10 if low is None else low
    rise = F.lit(start) + (high - start) * step / F.lit(float(warmup or 1))
    fall = F.lit(low) + 0.5 * (high - low) * (1 + F.cos(F.lit(math.pi) * (step - warmup) / F.lit(float(most - warmup))))
    return F.when(step < warmup, rise).when(step < most, fall).otherwise(F.lit(float(low)))


def linear_anneal(step: Column, most: int, high: float, low: float, warmup: int = 0) -> Column:
    fall = F.lit(high) - (high - low) / (most - warmup) * (step - warmup)
    rise = high * step / F.lit(float(warmup or 1))
    return F.when(step < warmup, rise).when(step < most, fall).otherwise(F.lit(float(low)))


def parameter_count(layers: int, mlps: int, width: int, hidden: int, heads: int, kv_heads: int, vocabulary: int, experts: int = 1) -> int:
    """Parameters of a transformer with gated feed-forward parts, grouped keys and untied embeddings."""
    attention = 2 * width * width + 2 * width * kv_heads * (width // heads)
    return 2 * width * vocabulary + layers * (4 * width + attention + mlps * width * hidden * experts)


#: Peak floating-point operations a second (fixed values).
PEAK_FLOPS = {"h100_sxm_bf16": 989.4e12, "a100_bf16": 312e12}


def utilisation(tokens_per_second: Column, parameters: int, layers: int, heads: int, head_width: int, sequence: int, peak: float) -> Column:
    """The share of the peak that the average throughput makes."""
    return F.avg(tokens_per_second) * (6.0 * parameters + 12.0 * layers * heads * head_width * sequence) / peak
