"""Secrets in texts: fixed patterns, and a character convolutional network over every other candidate.

Patterns (KINDS but the last) decide by themselves. Everything else that could be a secret - a run of 16 or more characters
of tokens, or a shorter value behind a colon or equals sign that holds a digit - is a candidate: a small network in numpy
reads its characters and those around it, and gives a calibrated probability. A candidate over the threshold of its form is
a finding of kind `model`; one that a pattern's match overlaps is not asked again.

The network: characters become vectors; one convolution over five of them, rectified; the maximum and mean over the
candidate and the maxima over the text on its left and right go to a logistic unit. A candidate of any length is read whole, in
blocks. It learns from labelled findings (left, value, right, y): those that the patterns mark in a bounded sample of
documents, shown half the time without the name in front of them, so that the value's own shape counts; the other
candidates of these documents; and findings made by rule for shapes that the documents lack. A fifth of them is set
aside for calibration (Platt's) and for the thresholds: for each form the highest that still finds RECALL of the secrets.

Defined results: a null text is empty; an empty text has no findings; repeated rows are rows; a null id passes through; an
empty table gives no rows (and the network learns from made findings alone); extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import held_out, logistic, sigmoid

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Forms of candidates: a long run anywhere, or a value behind a sign.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_VALUE = re.compile(r"""[:=]\x20*["']?(?=[A-Za-z0-9+/_.=!@#$%^&*-]*[0-9])([A-Za-z0-9+/_.=!@#$%^&*-]{8,})""")
FORMS = ("run", "value")

#: Characters read on each side of a candidate; those of a long candidate that are read at a time.
LEFT, RIGHT, BLOCK = 24, 8, 4_096
WIDTH, VECTOR, FILTERS = 5, 10, 24
#: Documents that are searched for labelled findings, findings of each class, and the longest of them.
DOCUMENTS, PER_CLASS, LONGEST = 20_000, 1_500, 120
RECALL = 0.98

Found = tuple[str, int, int]  # kind, start, end
Candidate = tuple[str, int, int]  # form, start, end


def pattern_spans(text: str) -> list[Found]:
    """The matches of the patterns, by start and then in the order of KINDS; each kind's don't overlap."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def candidates(text: str) -> list[Candidate]:
    """Every candidate, in order; a value that is a long run as well is a run."""
    runs = [("run", m.start(), m.end()) for m in _RUN.finditer(text)]
    values = [("value", *m.span(1)) for m in _VALUE.finditer(text)] if ":" in text or "=" in text else []
    starts = {s for _, s, _ in runs}
    return sorted(runs + [v for v in values if v[1] not in starts], key=lambda c: c[1:])


def apart_from(spans: Sequence[Candidate], others: Sequence[Found]) -> list[Candidate]:
    """The spans (in order) that none of the others (in order of their starts) overlaps."""
    out, at, reach = [], 0, 0
    for span in spans:
        while at < len(others) and others[at][1] < span[2]:
            reach = max(reach, others[at][2])
            at += 1
        if reach <= span[1]:
            out.append(span)
    return out


def symbols(text: str) -> np.ndarray:
    """0 beyond the text, 1 to 95 for printable ASCII, 96 for other ASCII, 97 for the rest."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((code >= 32) & (code < 127), code - 31, np.where(code < 128, 96, 97))


@dataclass
class Network:
    vectors: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(FORMS, 0.5))

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        inputs = WIDTH * (VECTOR + 3)
        return cls(rng.normal(0, 0.5, (98, VECTOR)), rng.normal(0, inputs**-0.5, (inputs, FILTERS)), np.zeros(FILTERS), np.zeros(4 * FILTERS + 2))

    def windows(self, sym: np.ndarray, part: np.ndarray) -> np.ndarray:
        """(rows * positions, inputs of the convolution); part: 0 left, 1 candidate, 2 right, 3 nothing."""
        x = np.concatenate([self.vectors[sym], np.eye(4)[part][..., :3]], axis=2)
        x[part == 3] = 0
        x = np.pad(x, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).reshape(sym.size, -1)

    def pooled(self, h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of rows: maximum and sum over the candidate, maxima on its left and right."""
        inside = h * (part == 1)[..., None]
        return inside.max(1), inside.sum(1), (h * (part == 0)[..., None]).max(1), (h * (part == 2)[..., None]).max(1)

    def features(self, sym: np.ndarray, part: np.ndarray) -> np.ndarray:
        h = np.maximum(self.windows(sym, part) @ self.kernel + self.bias, 0).reshape(*sym.shape, -1)
        return self.joined(*self.pooled(h, part), (part == 1).sum(1))

    @staticmethod
    def joined(most: np.ndarray, total: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        size = np.maximum(length, 1)[:, None]
        return np.hstack([most, total / size, left, right, np.log(size) / 4, np.ones_like(size, float)])

    def long_features(self, sym: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The same of one row of any length, by blocks."""
        sums = None
        pad = WIDTH // 2
        for lo in range(0, len(sym), BLOCK):
            a, b = max(0, lo - pad), min(len(sym), lo + BLOCK + pad)
            h = np.maximum(self.windows(sym[None, a:b], part[None, a:b]) @ self.kernel + self.bias, 0)[lo - a : lo - a + BLOCK]
            own = self.pooled(h[None], part[None, lo : lo + len(h)])
            sums = own if sums is None else tuple(np.maximum(s, o) if i != 1 else s + o for i, (s, o) in enumerate(zip(sums, own, strict=True)))
        return self.joined(*sums, np.array([(part == 1).sum()]))

    def logits(self, shown: Sequence[tuple[str, str, str]]) -> np.ndarray:
        """Of (left, value, right): before calibration."""
        out = np.zeros(len(shown))
        order = sorted(range(len(shown)), key=lambda i: len(shown[i][1]))
        at = 0
        while at < len(order):
            if len(shown[order[at]][1]) > BLOCK:
                out[order[at]] = self.long_features(*(x[0] for x in padded([shown[order[at]]])))[0] @ self.weights
                at += 1
                continue
            to = at + 1
            while to < len(order) and to - at < 256 and (to - at + 1) * len(shown[order[to]][1]) <= 4 * BLOCK:
                to += 1
            rows = order[at:to]
            out[rows] = self.features(*padded([shown[i] for i in rows])) @ self.weights
            at = to
        return out

    def probabilities(self, shown: Sequence[tuple[str, str, str]]) -> np.ndarray:
        return sigmoid(self.scale[0] * self.logits(shown) + self.scale[1])


def padded(shown: Sequence[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and parts of rows of one length."""
    longest = max(len(v) for _, v, _ in shown)
    sym = np.zeros((len(shown), LEFT + longest + RIGHT), np.int64)
    part = np.full(sym.shape, 3)
    for i, (left, value, right) in enumerate(shown):
        left, right = left[-LEFT:], right[:RIGHT]
        edges = (LEFT - len(left), LEFT, LEFT + len(value), LEFT + len(value) + len(right))
        for k, text in enumerate((left, value, right)):
            sym[i, edges[k] : edges[k + 1]] = symbols(text)
            part[i, edges[k] : edges[k + 1]] = k
    return sym, part


def _gradients(net: Network, sym: np.ndarray, part: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted logistic loss, for vectors, kernel, bias and weights."""
    rows, n = sym.shape
    win = net.windows(sym, part)
    h = np.maximum(win @ net.kernel + net.bias, 0).reshape(rows, n, -1)
    length = (part == 1).sum(1)
    x = net.joined(*net.pooled(h, part), length)
    d = weight * (sigmoid(x @ net.weights) - y)
    back = d[:, None] * net.weights[None, :]
    grad_h = (part == 1)[..., None] * (back[:, None, FILTERS : 2 * FILTERS] / np.maximum(length, 1)[:, None, None])
    for k, at in ((1, 0), (0, 2), (2, 3)):
        top = (h * (part == k)[..., None]).argmax(1)
        np.add.at(grad_h, (np.arange(rows)[:, None], top, np.arange(FILTERS)[None, :]), back[:, at * FILTERS : (at + 1) * FILTERS])
    grad_h = (grad_h * (h > 0)).reshape(rows * n, -1)
    to_window = (grad_h @ net.kernel.T).reshape(rows, n, VECTOR + 3, WIDTH)
    grad_x = np.zeros((rows, n + WIDTH - 1, VECTOR + 3))
    for w in range(WIDTH):
        grad_x[:, w : w + n] += to_window[..., w]
    inner = (grad_x[:, WIDTH // 2 : WIDTH // 2 + n, :VECTOR] * (part < 3)[..., None]).reshape(-1, VECTOR)
    vectors = np.stack([np.bincount(sym.ravel(), inner[:, j], 98) for j in range(VECTOR)], axis=1)
    return [vectors, win.T @ grad_h, grad_h.sum(0), x.T @ d]


def trained(shown: Sequence[tuple[str, str, str]], y: np.ndarray, rounds: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """A network fitted by Adam; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    held = [net.vectors, net.kernel, net.bias, net.weights]
    mean, square = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    step = 0
    for epoch in range(rounds):
        mixed = rng.permutation(len(y))
        mixed = mixed[np.argsort([len(shown[i][1]) // 16 for i in mixed], kind="stable")]  # rows of a batch have like lengths
        batches = [mixed[i : i + batch] for i in range(0, len(y), batch)]
        for k in rng.permutation(len(batches)):
            own = batches[k]
            grads = _gradients(net, *padded([shown[i] for i in own]), y[own], share[own] / len(own))
            step += 1
            for p, m, s, g in zip(held, mean, square, grads, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * 0.5 ** (epoch // 5) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + 1e-5 * p
    return net


def fitted(findings: pd.DataFrame, recall: float = RECALL, seed: int = 5) -> Network:
    """A network from labelled findings (form, left, value, right, y), with its calibration and thresholds."""
    order = np.random.default_rng(seed).permutation(len(findings))
    findings = findings.iloc[order].reset_index(drop=True)
    shown, y = list(zip(findings["left"], findings["value"], findings["right"], strict=True)), findings["y"].to_numpy()
    aside = np.arange(len(findings)) % 5 == 0
    net = trained([s for s, a in zip(shown, aside, strict=True) if not a], y[~aside], seed=seed)
    logits, truth = net.logits([s for s, a in zip(shown, aside, strict=True) if a]), y[aside]
    slope, shift = logistic(logits[:, None] / 4, truth, share=0.5)
    net.scale = (float(slope) / 4, float(shift))
    p, form = sigmoid(net.scale[0] * logits + net.scale[1]), findings["form"].to_numpy()[aside]
    for name in FORMS:
        known = np.sort(p[(form == name) & (truth > 0)])
        if len(known):
            net.thresholds[name] = float(known[int((1 - recall) * len(known))])
    return net


#: Shapes of secrets and of what resembles them: a prefix, the characters and the lengths of what follows it.
_ALNUM, _LOWER = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
SECRET_SHAPES = (
    ("", "0123456789abcdef", 24, 64), ("", "0123456789ABCDEF", 24, 64), ("", _ALNUM, 20, 60), ("", _ALNUM + "+/", 32, 88), ("", _LOWER, 20, 50),
    ("ghp_", _ALNUM, 36, 36), ("sk_live_", _ALNUM, 24, 32), ("xoxb-", _LOWER + "-", 30, 50), ("eyJ", _ALNUM + "_-", 40, 100), ("AIza", _ALNUM + "_-", 35, 35), ("", string.ascii_uppercase + "234567", 24, 52),
)
PLAIN_SHAPES = (("", string.digits, 16, 20), ("", "-", 16, 80), ("", "=", 16, 80), ("", "_", 16, 60), ("20", "0123456789-", 14, 20))
NAMES = ("key = ", 'auth: "', "pwd=", "credentials: ", "access_key='", "private ", "", "", "", "", "")


def made_findings(words: Sequence[str], n: int, seed: int = 11) -> pd.DataFrame:
    """n findings of each class by rule: shapes of secrets, and numbers, rules of signs and joined words."""
    rng = random.Random(seed)
    known = list(words)

    def word() -> str:
        if known and rng.random() < 0.5:
            return rng.choice(known)
        return "".join(rng.choice("bcdfghjklmnprstvwz") * (rng.random() < 0.9) + rng.choice("aeiou") + rng.choice("lnrst") * (rng.random() < 0.4) for _ in range(rng.randint(1, 4)))

    def some(k: int) -> list[str]:
        return [word() for _ in range(k)]

    def around() -> str:
        return " ".join(some(4))

    def drawn(shapes: Sequence[tuple[str, str, int, int]]) -> str:
        prefix, chars, least, most = rng.choice(shapes)
        return prefix + "".join(rng.choices(chars, k=rng.randint(least, most)))

    rows = []
    for _ in range(n):
        short = rng.random() < 0.25
        value = "".join(rng.choices(_ALNUM + "!@#$%", k=rng.randint(8, 14))) + rng.choice(string.digits) if short else drawn(SECRET_SHAPES)
        rows.append(("value" if short else "run", f"{around()} {rng.choice(NAMES[:5] if short else NAMES)}", value, f"{rng.choice(['', '', chr(34), ',', '###'])} {around()}", 1))
        if short:
            value = rng.choice([f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", f"{word()}{rng.randint(1, 99)}{word()}{word()}", f"{rng.randint(10**7, 10**11)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}", f"{rng.randint(1, 23)}-{rng.randint(10, 59)}-{rng.randint(100, 599)}"])
        else:
            value = drawn(PLAIN_SHAPES) if rng.random() < 0.4 else rng.choice("_-/").join(some(5)) if rng.random() < 0.4 else "".join(w.capitalize() for w in some(5)) if rng.random() < 0.6 else "".join(some(6))
        rows.append(("value" if short else "run", f"{around()} {rng.choice([*NAMES, 'see: ', 'date: '])}", value, f" {around()}", 0))
    return pd.DataFrame(rows, columns=["form", "left", "value", "right", "y"])


def document_findings(docs: DataFrame, documents: int = DOCUMENTS, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """(form, left, value, right, y) on the driver: candidates of a bounded sample of documents, y = 1 where a pattern matches.

    Documents that are held out give none. The sample is the first `documents` ids by a hash, and of their candidates
    of at most LONGEST characters the first per_class of each class.
    """
    ids = docs.select(doc_id).filter(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull()).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(documents)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for words in batch["text"]:
                spans = pattern_spans(words)
                every = candidates(words)
                plain = set(apart_from(every, spans))
                rows += [(form, words[max(0, a - LEFT) : a], words[a:b], words[b : b + RIGHT], int((form, a, b) not in plain)) for form, a, b in every if b - a <= LONGEST]
            yield pd.DataFrame(rows, columns=["form", "left", "value", "right", "y"])

    texts = docs.select(doc_id, F.col(text).alias("text")).filter("length(text) > 0").join(F.broadcast(ids), doc_id, "left_semi").select("text")
    rows = texts.mapInPandas(found, "form string, left string, value string, right string, y int").distinct()
    order = [F.xxhash64("form", "left", "value", "right"), "form", "left", "value", "right"]
    return pd.concat([rows.filter(F.col("y") == y).orderBy(*order).limit(per_class).toPandas() for y in (0, 1)], ignore_index=True)


def unnamed(findings: pd.DataFrame, seed: int = 3) -> pd.DataFrame:
    """findings and, for each that is a secret, the same with the text before another candidate: the value alone must tell."""
    rng = random.Random(seed)
    lefts = findings.loc[findings["y"] == 0, "left"].tolist() or [""]
    secrets = findings[findings["y"] == 1]
    return pd.concat([findings, secrets.assign(left=[rng.choice(lefts) for _ in range(len(secrets))], form=np.where(secrets["value"].str.len() >= 16, "run", secrets["form"]))], ignore_index=True)


def fit_scanner(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, per_class: int = PER_CLASS) -> Network:
    """A network from the findings of a bounded sample of documents and from made ones."""
    known = unnamed(document_findings(docs, documents, per_class, doc_id, text))
    words = sorted({w for left in known.loc[known["y"] == 0, "left"] for w in re.findall(r"[^\W\d_]{2,12}", left)})
    return fitted(pd.concat([known, made_findings(words, per_class)], ignore_index=True))


def scanned(texts: Sequence[str], net: Network) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, probability) of each text's findings, by start and then in the order of KINDS."""
    out, asked, owners = [], [], []
    for i, text in enumerate(texts):
        spans = pattern_spans(text)
        out.append([(*s, 1.0) for s in spans])
        for c in apart_from(candidates(text), spans):
            asked.append((text[max(0, c[1] - LEFT) : c[1]], text[c[1] : c[2]], text[c[2] : c[2] + RIGHT]))
            owners.append((i, c))
    for (i, (form, a, b)), p in zip(owners, net.probabilities(asked) if asked else (), strict=True):
        if p >= net.thresholds[form]:
            out[i].append(("model", a, b, float(p)))
    return [sorted(found, key=lambda f: (f[1], KINDS.index(f[0]))) for found in out]


SPANS = "array<struct<kind:string,start:int,end:int,probability:double>>"


def secret_spans(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with `findings`: array of (kind, start, end, probability), in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = []
            for lo in range(0, len(batch), 64):
                parts += scanned([t or "" for t in batch.iloc[lo : lo + 64]], shared.value)
            yield pd.Series([[{"kind": k, "start": a, "end": b, "probability": p} for k, a, b, p in found] for found in parts], dtype=object)

    return docs.withColumn("findings", spans(F.coalesce(F.col(text), F.lit(""))))


def listed(findings: Column) -> Column:
    """Findings as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
