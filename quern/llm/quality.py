"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character kinds, repeated words, word lengths and whether the
document repeats the line, together with those of the lines before and after it; neighbouring labels are coupled. The
field is fitted on a bounded sample of labelled documents: lines start with their document's label, and lines of bad
documents which the field finds good are relabelled before it is fitted again. A document's quality is the
length-weighted mean of its lines' marginals from the forward-backward pass, put through a logistic curve that was
fitted on the same sample.

All counts add up over parts of a text, so texts of any length are read whole in parts of PART characters.

Defined results: a null or empty text is one empty line; lines weigh their characters plus one; without labelled rows
of both classes every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import labelled_sample, logistic, sigmoid

PART = 250_000
#: Rows of each class, and characters of a text, in the sample to learn from.
PER_CLASS, LONGEST = 600, 12_000

KINDS = 13
SPACE, LOWER, UPPER, DIGIT, BAR, BANG, SYMBOL, STOP, OTHER, MARKUP, LEAD, CONTINUED, LINE = range(KINDS)
_KIND = np.full(256, OTHER, np.int64)
for _kind, _of in ((SPACE, b" \t\r\x0b\x0c"), (DIGIT, b"0123456789"), (BAR, b"|"), (BANG, b"!"), (SYMBOL, b"%#$*&@^~+"), (STOP, b".,;:?"), (MARKUP, b"<>{}=/\\_"), (LINE, b"\n")):
    _KIND[list(_of)] = _kind
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1] = LOWER, UPPER
_KIND[0x80:0xC0], _KIND[0xC0:] = CONTINUED, LEAD
_POWERS = np.random.default_rng(1).integers(1 << 62, size=64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = 14


def _count(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines of all texts: counts (kinds, words, repeated words), a hash of the words, lines per text."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    lines = np.array([e.count(b"\n") + 1 for e in encoded])
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    kind = _KIND[raw]
    n = int(lines.sum())
    breaks = kind == LINE
    line = np.cumsum(breaks) - breaks
    counts = np.zeros((n, KINDS + 2))
    counts[:, :KINDS] = np.bincount(line * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    inside = ~breaks & (kind != SPACE)
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    hashes = np.zeros(n, np.uint64)
    if len(starts):
        at = np.flatnonzero(inside)
        word = np.cumsum(np.isin(at, starts, assume_unique=True)) - 1
        with np.errstate(over="ignore"):
            part = (raw[at].astype(np.uint64) + np.uint64(7)) * _POWERS[(at - starts[word]) & 63]
            of_word = np.add.reduceat(part, np.searchsorted(at, starts))
            of_word ^= of_word >> np.uint64(31)
            own = line[starts]
            np.add.at(hashes, own, of_word * np.uint64(0x9E3779B97F4A7C15))
        again = np.concatenate([[False], (of_word[1:] == of_word[:-1]) & (own[1:] == own[:-1])])
        counts[:, KINDS] = np.bincount(own, minlength=n)
        counts[:, KINDS + 1] = np.bincount(own[again], minlength=n)
    return counts, hashes, lines


def _parts(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Runs of (text number, part) of about PART characters; a longer text is cut after white space."""
    run, held = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > PART:
                end = at + PART
                space = max(text.rfind(c, at, end) for c in " \n")
                end = space + 1 if space > at else end
            run.append((i, text[at:end]))
            held += end - at
            if held >= PART:
                yield run
                run, held = [], 0
            at = end
            if at >= len(text):
                break
    if run:
        yield run


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', weight of each line, lines of each text)."""
    all_counts, all_hashes, of_text = [], [], []
    lines, before, first = np.zeros(len(texts), np.int64), -1, 0
    for run in _parts(texts):
        counts, hashes, n = _count([p for _, p in run])
        number = np.arange(len(hashes))
        shift = 0
        ids = []
        at = 0
        for (i, _), k in zip(run, n, strict=True):
            shift += i == before  # the part goes on in the line where the last one ended
            ids.append(first + number[at : at + k] - shift)
            lines[i] += k - (i == before)
            at += k
            before = i
        of_text.append(np.concatenate(ids))
        first = int(of_text[-1][-1]) + 1
        all_counts.append(counts)
        all_hashes.append(hashes)
    if not texts:
        return np.zeros((0, 3 * FEATURES + 2)), np.zeros(0), lines
    at = np.concatenate(of_text)
    counts, hashes = np.zeros((at[-1] + 1, KINDS + 2)), np.zeros(at[-1] + 1, np.uint64)
    np.add.at(counts, at, np.concatenate(all_counts))
    with np.errstate(over="ignore"):
        np.add.at(hashes, at, np.concatenate(all_hashes))
    text = np.repeat(np.arange(len(texts)), lines)
    characters = counts[:, :CONTINUED].sum(axis=1)
    letters, words = np.maximum(1, counts[:, [LOWER, UPPER, LEAD]].sum(axis=1)), np.maximum(1, counts[:, KINDS])
    with np.errstate(over="ignore"):
        _, same, times = np.unique(hashes ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    c = np.maximum(1, characters)
    x = np.stack([
        counts[:, UPPER] / letters,
        counts[:, DIGIT] / c,
        np.minimum(2, counts[:, BAR] / words),
        np.minimum(2, counts[:, BANG] / words),
        np.minimum(3, counts[:, SYMBOL] / words),
        np.minimum(2, counts[:, STOP] / words),
        counts[:, OTHER] / c,
        counts[:, MARKUP] / c,
        counts[:, KINDS + 1] / words,
        np.minimum(3, (characters - counts[:, SPACE]) / words / 10),
        np.log1p(characters) / 8,
        (counts[:, KINDS] == 0) * 1.0,
        ((times[same] > 1) & (counts[:, KINDS] > 0)) * 1.0,
        counts[:, LEAD] / letters,
    ], axis=1)
    starts = np.cumsum(lines) - lines
    head, tail = np.zeros(len(x), bool), np.zeros(len(x), bool)
    head[starts], tail[starts + lines - 1] = True, True
    above, below = np.vstack([x[:1] * 0, x[:-1]]), np.vstack([x[1:], x[:1] * 0])
    above[head], below[tail] = 0, 0
    return np.hstack([x, above, below, head[:, None], tail[:, None]]), characters + 1, lines


def _by_step(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts from the longest to the shortest, where each begins, and how many have a t-th line."""
    order = np.argsort(-lines, kind="stable")
    starts = (np.cumsum(lines) - lines)[order]
    live = len(lines) - np.searchsorted(np.sort(lines), np.arange(1, lines.max(initial=0) + 1))
    return order, starts, live


def forward_backward(score: np.ndarray, lines: np.ndarray, start: float, couple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of bad, line by line: (forward, backward), and for pairs of neighbours the forward and backward parts.

    score: log odds of bad of each line on its own; couple[i, j]: log weight of label i before label j.
    """
    _, starts, live = _by_step(lines)
    f, b = np.zeros(len(score)), np.zeros(len(score))
    into = lambda r: np.logaddexp(couple[0, 1], couple[1, 1] + r) - np.logaddexp(couple[0, 0], couple[1, 0] + r)
    back = lambda r: np.logaddexp(couple[1, 0], couple[1, 1] + r) - np.logaddexp(couple[0, 0], couple[0, 1] + r)
    for t, n in enumerate(live):
        at = starts[:n] + t
        f[at] = score[at] + (start if t == 0 else into(f[at - 1]))
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        b[at] = back(score[at + 1] + b[at + 1])
    return f, b, into, back


class LineField:
    """The fitted field and the curve from its aggregate to a score."""

    def __init__(self) -> None:
        self.mean = np.zeros(3 * FEATURES + 2)
        self.scale = np.ones(3 * FEATURES + 2)
        self.w = np.zeros(3 * FEATURES + 3)
        self.start, self.couple = 0.0, np.zeros((2, 2))
        self.curve = np.zeros(2)

    def _on_their_own(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def bad_lines(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Each line's marginal probability of being bad."""
        f, b, _, _ = forward_backward(self._on_their_own(x), lines, self.start, self.couple)
        return sigmoid(f + b)

    def _fit_field(self, x: np.ndarray, lines: np.ndarray, bad: np.ndarray, weight: np.ndarray, rounds: int = 70) -> None:
        """Adam on the weighted conditional log-likelihood of the lines' labels."""
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        starts = np.cumsum(lines) - lines
        follows = np.ones(len(x), bool)
        follows[starts] = False
        j = np.flatnonzero(follows)
        i = j - 1
        of = np.repeat(weight / weight.sum(), lines)
        params = np.concatenate([self.w, [self.start], self.couple.ravel()])
        m, v = np.zeros_like(params), np.zeros_like(params)
        pairs_seen = np.array([[(of[j] * (bad[i] == a) * (bad[j] == c)).sum() for c in (0, 1)] for a in (0, 1)])
        for t in range(1, rounds + 1):
            w, start, couple = params[:-5], params[-5], params[-4:].reshape(2, 2)
            score = z @ w
            f, b, _, _ = forward_backward(score, lines, start, couple)
            p = sigmoid(f + b)
            left, right = f[i], score[j] + b[j]
            logs = np.stack([couple[a, c] + a * left + c * right for a in (0, 1) for c in (0, 1)])
            logs -= logs.max(axis=0)
            pair = np.exp(logs)
            pair /= pair.sum(axis=0)
            slope = np.concatenate([
                z.T @ (of * (p - bad)) + 1e-4 * w,
                [(of[starts] * (p[starts] - bad[starts])).sum() + 1e-4 * start],
                ((pair * of[j]).sum(axis=1) - pairs_seen.ravel()) + 1e-4 * couple.ravel(),
            ])
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            params = params - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w, self.start, self.couple = params[:-5], float(params[-5]), params[-4:].reshape(2, 2)

    def fit(self, texts: list[str], good: np.ndarray, relabel: int = 2) -> LineField:
        if len(set(good.tolist())) < 2:
            return self
        x, weight, lines = line_features(texts)
        self.mean, self.scale = x.mean(axis=0), np.maximum(0.05, x.std(axis=0))
        of_text = np.repeat(np.arange(len(texts)), lines)
        bad_text = good[of_text] == 0
        bad = bad_text.astype(float)
        classes = np.where(good > 0, 0.5 / (good > 0).sum(), 0.5 / (good <= 0).sum())
        self._fit_field(x, lines, bad, classes)
        for _ in range(relabel):
            p = self.bad_lines(x, lines)
            worst = np.zeros(len(texts))
            np.maximum.at(worst, of_text, p)
            bad = (bad_text & ((p >= 0.5) | (p >= worst[of_text]))).astype(float)
            self._fit_field(x, lines, bad, classes)
        self.curve = logistic(self._share(x, weight, lines)[:, None], good)
        return self

    def _share(self, x: np.ndarray, weight: np.ndarray, lines: np.ndarray) -> np.ndarray:
        starts = np.cumsum(lines) - lines
        fine = 1 - self.bad_lines(x, lines)
        return np.add.reduceat(fine * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        texts = [t or "" for t in texts]
        out, run, held = [], [], 0
        for t in [*texts, None]:
            if run and (t is None or held + len(t) > 2 * PART):
                x, weight, lines = line_features(run)
                out.append(sigmoid(self._share(x, weight, lines) * self.curve[0] + self.curve[1]))
                run, held = [], 0
            if t is not None:
                run.append(t)
                held += len(t)
        return np.concatenate(out) if out else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, longest: int = LONGEST) -> LineField:
    sample = labelled_sample(docs, labels, label, per_class, longest)
    return LineField().fit(sample["text"].tolist(), sample["y"].to_numpy(np.int64))


def score_quality(docs: DataFrame, field: LineField, text: str = "text", to: str = "score") -> DataFrame:
    """docs with each whole text's quality, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(field.score(texts))

    return docs.withColumn(to, score(F.col(text)))
