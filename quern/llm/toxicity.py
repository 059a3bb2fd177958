"""Toxicity from a support vector machine with a string kernel on subsequences, through Nyström landmarks.

The kernel of two words sums, over all sequences of three characters that both hold in order, gaps allowed, a decay for
the length that each occurrence spans: insults with inserted or missing characters keep most of their sequences.
Punctuation within a word is skipped, and letters set apart by spaces are read as one word. The machine is fitted on
labelled sentences of a bounded sample, as one learns from instances in bags: a toxic sentence is represented by its most
toxic word, chosen again between rounds, and clean sentences by all their words. The choice begins with words that, as
they stand or by their beginning, are surely commoner in toxic documents; toxic documents' sentences without one are
left out, since a label is a document's and most of its sentences are clean. (Without that beginning, from all words of
toxic documents, cross-validation flagged 6 to 9% of clean documents instead of 1.7 and 0.8%.) Words are mapped by the Nyström method on landmark words of both kinds; since
the machine is linear there, its value for a word is a sum of one weight for each sequence, so scoring costs no kernel
evaluations. A sentence's margin is that of its most toxic word; a document's score is a logistic curve of its three largest
margins of different words, of how many sentences are on the toxic side and of the number of words, fitted on a third
of the sample that the machine hasn't seen.

Defined results: null, empty and wordless texts have the margin of no sequence at all; whole texts are read, of any
length; words over WINDOW characters are read in overlapping windows; without labelled rows of both classes every
score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import labelled_sample, logistic, sigmoid

#: Rows of each class, and characters of a text, in the sample to learn from.
PER_CLASS, LONGEST = 1_000, 12_000
#: CLEAN_WORDS: different words of clean documents, by a hash, that the fit learns from; documents are bounded above.
DECAY, SPAN, WINDOW, FULL, LANDMARKS, CLEAN_WORDS = 0.7, 8, 38, 9, 96, 20_000
SYMBOLS = 128
#: Least contrast, in standard errors, of a word or stem that marks a sentence as toxic.
SURE = 4.0
#: How many times as common in toxic documents a word, and a stem, must be: stems begin clean words too.
WORD_RATIO, STEM_RATIO = 12, 80
_CACHE = 150_000
#: Windows of words whose sequences are held at a time.
HELD_WINDOWS = 4_096
#: Words whose kernel values, or whose part of a Newton step, are made at a time.
ROWS = 2_048

#: Letters and separators share no character, so that a run of either is read in one way only.
_SPACED = re.compile(r"(?<!\w)(?:[^\W_][\s.\-_*]++){3,}[^\W_](?!\w)")
_SENTENCE = re.compile(r"[.!?\n]+\s*")
_NOT_WORD = re.compile(r"[\W_]+")


def _code(c: str) -> int:
    """1 to 26 for a to z, then digits, then other letters by their place in runs of 89; 0 and 127 mark a word's ends."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 48 <= o <= 57:
        return 27 + o - 48
    return 37 + o % 89


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation; single characters with blanks between count as one word too."""
    text = text.lower()
    found = [_NOT_WORD.sub("", w) for w in text.split()]
    if " " in text or "\n" in text:
        found += [_NOT_WORD.sub("", m) for m in _SPACED.findall(text)]
    return found


@lru_cache(maxsize=64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of the sequences of a word of that length, their weights and the weights' norm.

    The norm stops growing at FULL characters, so that a long word which holds an insult is not the less like it.
    """
    at = [(a, b, c) for a in range(length) for c in range(a + 2, min(length, a + SPAN)) for b in range(a + 1, c)]
    places = np.array(at, np.int64).reshape(-1, 3)
    weights = DECAY ** (places[:, 2] - places[:, 0] + 1.0)
    within = weights[(places < FULL).all(axis=1)]
    return places, weights, float(np.sqrt((within**2).sum())) or 1.0


def windows_of(word: str) -> Iterator[str]:
    """A word, or overlapping parts of a long one."""
    for lo in range(0, max(1, len(word)), WINDOW - SPAN):
        yield word[lo : lo + WINDOW]
        if lo + WINDOW >= len(word):
            break


def sequences(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of word: (numbers of the words, codes of their sequences, weights with norm 1)."""
    by_length: dict[int, tuple[list[int], list[list[int]]]] = {}
    for i, w in enumerate(words):
        for part in windows_of(w):
            codes = [0, *map(_code, part), SYMBOLS - 1]
            number, rows = by_length.setdefault(len(codes), ([], []))
            number.append(i)
            rows.append(codes)
    out = []
    for length, (number, rows) in by_length.items():
        places, weights, norm = _triples(length)
        c = np.array(rows, np.int64)
        codes = (c[:, places[:, 0]] * SYMBOLS + c[:, places[:, 1]]) * SYMBOLS + c[:, places[:, 2]]
        out.append((np.array(number), codes, weights / norm))
    return out


def stems_of(word: str) -> list[str]:
    """Beginnings of a word, marked as such: 5 to 9 characters of longer words."""
    return [word[:k] + "*" for k in range(5, min(10, len(word)))]


class Landmarks:
    """Kernel values of words against fixed words, and the Nyström map."""

    def __init__(self, words: list[str]):
        self.words = words
        parts = sequences(words)
        self.codes = np.unique(np.concatenate([c.ravel() for _, c, _ in parts]))
        self.table = np.zeros((len(self.codes) + 1, len(words)))
        for number, codes, weights in parts:
            at = np.searchsorted(self.codes, codes)
            for j in range(codes.shape[1]):
                np.add.at(self.table, (at[:, j], number), weights[j])
        values, vectors = np.linalg.eigh(self.kernel(words) + 1e-6 * np.eye(len(words)))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)))
        for lo in range(0, len(words), ROWS):
            out[lo : lo + ROWS] = self._kernel(words[lo : lo + ROWS])
        return out

    def _kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)))
        for number, codes, weights in sequences(words):
            at = np.searchsorted(self.codes, codes)
            at[at == len(self.codes)] = 0
            known = self.codes[at] == codes
            part = np.zeros((len(number), len(self.words)))
            for j in range(codes.shape[1]):
                hit = np.flatnonzero(known[:, j])
                part[hit] += weights[j] * self.table[at[hit, j]]
            np.maximum.at(out, number, part)
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a linear machine with squared hinge loss, by Newton's method; x is never copied whole."""
    w, penalty = np.zeros(x.shape[1] + 1), ridge * np.eye(x.shape[1] + 1)
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        curved, slope = penalty.copy(), np.zeros(len(w))
        for lo in range(0, len(x), ROWS):
            a = np.hstack([x[lo : lo + ROWS], np.ones((len(x[lo : lo + ROWS]), 1))])
            active = y[lo : lo + ROWS] * (a @ w) < 1
            a, k = a[active], weight[lo : lo + ROWS][active]
            curved += (a * k[:, None]).T @ a
            slope += a.T @ (k * y[lo : lo + ROWS][active])
        new = np.linalg.solve(curved, slope)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


class SequenceMachine:
    """The fitted machine: a weight for each sequence, an intercept, and the curve for documents."""

    def __init__(self) -> None:
        self.weights = np.zeros(SYMBOLS**3)
        self.intercept, self.curve = -1.0, np.zeros(6)
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.weights)
        return {"used": used, "values": self.weights[used], "intercept": self.intercept, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.__init__()
        self.weights[state["used"]] = state["values"]
        self.intercept, self.curve = state["intercept"], state["curve"]

    def margins(self, words: list[str]) -> np.ndarray:
        """The largest margin of each word's windows; so many windows are held at a time, whatever a word's length."""
        out = np.full(len(words), -np.inf)
        windows = ((i, part) for i, w in enumerate(words) for part in windows_of(w))
        while run := list(islice(windows, HELD_WINDOWS)):
            owner = np.array([i for i, _ in run])
            for number, codes, weights in sequences([part for _, part in run]):
                np.maximum.at(out, owner[number], self.weights[codes] @ weights + self.intercept)
        return out

    def _look_up(self, words: set[str]) -> dict[str, float]:
        if len(self._known) > _CACHE:
            self._known = {}
        new = sorted(words - self._known.keys())
        found = dict(zip(new, self.margins(new).tolist(), strict=True))
        self._known.update((w, m) for w, m in found.items() if len(w) <= WINDOW)
        return {**self._known, **found} if any(len(w) > WINDOW for w in new) else self._known

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        """Per document: the largest word margin, the second and third where positive, toxic sentences and words (logs).

        The number of words matters where a margin is positive: a long text has more words that look like an insult.
        """
        texts = [t or "" for t in texts]
        out = np.tile([0.0, -1.0, -1.0, 0.0, 1.0], (len(texts), 1))
        at = 0
        while at < len(texts):
            run, size = [], 0
            while at + len(run) < len(texts) and (not run or size < 1_500_000):
                run.append(words_of(texts[at + len(run)]))
                size += len(texts[at + len(run) - 1])
            known = self._look_up(set().union(*run))
            for i, words in enumerate(run):
                out[at + i, 0] = max(map(known.__getitem__, words), default=self.intercept)
                if out[at + i, 0] > 0:
                    hits = sorted({w for w in words if known[w] > 0}, key=known.__getitem__, reverse=True)
                    out[at + i, 1 : len(hits[:3])] = [known[w] for w in hits[1:3]]
                    out[at + i, 3] = np.log1p(sum(any(known.get(w, -1.0) > 0 for w in words_of(s)) for s in _SENTENCE.split(texts[at + i]) if s))
                    out[at + i, 4] = np.log1p(len(words)) / 5
            at += len(run)
        return np.clip(out, -3, 3)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = self.features(texts)
        return sigmoid(x @ self.curve[:-1] + self.curve[-1])

    def fit(self, texts: list[str], toxic: np.ndarray, share: float = 0.15, rounds: int = 2) -> SequenceMachine:
        toxic = np.asarray(toxic)
        apart = np.arange(len(texts)) % 3 == 0  # the curve is fitted on documents whose words the machine hasn't seen
        if min((toxic[~apart] > 0).sum(), (toxic[~apart] <= 0).sum(), (toxic[apart] > 0).sum(), (toxic[apart] <= 0).sum()) == 0:
            return self
        self._fit_words([t for t, a in zip(texts, apart, strict=True) if not a], toxic[~apart], rounds)
        self.curve = logistic(self.features([t for t, a in zip(texts, apart, strict=True) if a]), toxic[apart], share)
        return self

    def _fit_words(self, texts: list[str], toxic: np.ndarray, rounds: int) -> None:
        one: dict[str, str] = {}  # a word is held once, and sentences of toxic documents alone
        documents, sentences = [], []
        for t, y in zip(texts, toxic, strict=True):
            found = [{one.setdefault(w, w) for w in words_of(s)} for s in _SENTENCE.split(t) if s]
            documents.append(set().union(*found))
            sentences.extend(found if y else [])
        df = {0: Counter(), 1: Counter()}
        for found, y in zip(documents, toxic, strict=True):
            df[int(y)].update(found)
        n1, n0 = (toxic > 0).sum(), (toxic <= 0).sum()
        stems = {0: Counter(), 1: Counter()}  # documents by stem; only stems of toxic documents matter
        for kind in (1, 0):
            for found, y in zip(documents, toxic, strict=True):
                if int(y) == kind:
                    stems[kind].update({x for w in found for x in stems_of(w) if kind or x in stems[1]})
            if kind:
                stems[1] = Counter({x: a for x, a in stems[1].items() if a > 2})

        def contrast(a: int, b: int, ratio: float) -> float:
            """How surely what a toxic and b clean documents hold is commoner in toxic ones; 0 where it isn't `ratio` times as common."""
            p = (a + b + 1) / (n1 + n0 + 2)
            return float((a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))) if a / n1 > ratio * (b + 0.5) / n0 else 0.0

        sure = {x: contrast(a, stems[0][x], STEM_RATIO) for x, a in stems[1].items()}

        def sign(w: str) -> float:
            """The contrast of the word or, if larger, that of a stem, which forms of a rare insult share."""
            return max(contrast(df[1][w], df[0][w], WORD_RATIO), max((sure.get(x, 0.0) for x in stems_of(w)), default=0.0))

        signs = sorted(((sign(w), w) for w in df[1] if len(w) > 2), reverse=True)
        signs = [(z, w) for z, w in signs if z > SURE] or signs[:20]
        clean = sorted(df[0], key=lambda w: (-df[0][w], w))[: CLEAN_WORDS // 2]
        rare = sorted((w for w in df[0] if len(w) > 2), key=lambda w: (hash_of(w), w))[: CLEAN_WORDS // 2]
        clean = sorted({w for w in (*clean, *rare) if w})
        marks = [w for _, w in signs[: LANDMARKS * 3]]
        chosen = _spread(marks, LANDMARKS)
        near = Landmarks(chosen).kernel(clean).max(axis=1)
        hard = [clean[i] for i in np.argsort(-near, kind="stable")[: LANDMARKS * 2]]
        self.landmarks = Landmarks([*chosen, *_spread(hard, LANDMARKS // 2), *clean[:: max(1, len(clean) // (LANDMARKS // 2))][: LANDMARKS // 2]])
        z_clean = self.landmarks.kernel(clean) @ self.landmarks.root
        rank = {w: z for z, w in signs}
        positive = [s for s in sentences if s & rank.keys()]
        witness = [max(s & rank.keys(), key=lambda w: (rank[w], w)) for s in positive]
        for _ in range(rounds):
            kinds = Counter(witness)
            words = sorted(kinds)
            z = np.vstack([self.landmarks.kernel(words) @ self.landmarks.root, z_clean])
            y = np.concatenate([np.ones(len(words)), -np.ones(len(clean))])
            k = np.concatenate([np.sqrt([kinds[w] for w in words]), np.ones(len(clean))])
            k = np.where(y > 0, k / k[: len(words)].sum(), k / len(clean))
            w = squared_hinge(z, y, k)
            for _ in range(2):  # clean words near the border weigh as much as all toxic ones
                close = z @ w[:-1] + w[-1] > -1
                k = np.where(y > 0, k, np.where(close, 1 / max(1, (close & (y < 0)).sum()), 0.1 / len(clean)))
                w = squared_hinge(z, y, k)
            beta = self.landmarks.root @ w[:-1]
            self.weights = np.zeros(SYMBOLS**3)
            self.weights[self.landmarks.codes] = self.landmarks.table[:-1] @ beta
            self.intercept, self._known = float(w[-1]), {}
            known = self._look_up(set().union(*positive)) if positive else {}
            witness = [max((x for x in s if x in rank or known[x] > 0), key=lambda x: (known[x], x)) for s in positive]
        del self.landmarks
        self._known = {}


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _spread(words: list[str], n: int) -> list[str]:
    """Up to n of the words, in their order, leaving out those that are much like one taken before."""
    if not words:
        return []
    kernel = Landmarks(words).kernel(words)
    scale = np.sqrt(np.diag(kernel))
    alike = kernel / np.outer(scale, scale)
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) < n and (not taken or alike[i, taken].max() < 0.9):
            taken.append(i)
    return [words[i] for i in taken]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, longest: int = LONGEST) -> SequenceMachine:
    sample = labelled_sample(docs, labels, label, per_class, longest)
    n = sample.attrs["of_class"]
    share = n.get(1, 0) / max(1, sum(n.values()))  # the sample is balanced, the documents are not; a quarter at least
    return SequenceMachine().fit(sample["text"].tolist(), sample["y"].to_numpy(np.int64), min(0.5, max(0.25, share)))


def score_toxicity(docs: DataFrame, machine: SequenceMachine, text: str = "text", to: str = "score") -> DataFrame:
    """docs with each whole text's toxicity, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score(texts))

    return docs.withColumn(to, score(F.col(text)))
