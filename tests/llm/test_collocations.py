"""Mined phrases against counting every n-gram, for small tables and bit maps too."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.llm import collocations as C

SCHEMA = "lang string, text string"


def brute(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = [w for w in re.split(rb"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + longest) + 1):
                    counts[lang, tuple(words[i:j])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    held[lang, p[i:j]] = max(held[lang, p[i:j]], a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * held[lang, p] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, b" ".join(p), a, left, right, totals[lang], score))
    return sorted((lang, i + 1, p.decode(), a, left, right, n, score) for lang, own in out.items() for i, (_, _, p, a, left, right, n, score) in enumerate(sorted(own)[:top]))


def texts(n=400):
    rng = np.random.default_rng(3)
    words = ["The", "of", "a", "new", "york", "city", "hall", "ÄPFEL", "äpfel", "x" * 130, "don't", "\x1fq", "é", "rain"]
    p = np.array([30, 20, 12, 6, 5, 4, 3, 3, 3, 2, 2, 1, 1, 1], float)
    rows = []
    for i in range(n):
        own = [str(w) for w in rng.choice(words, rng.integers(0, 40), p=p / p.sum())]
        for at in range(0, len(own) - 3, 7):
            own[at : at + 3] = ["new", "york", "city"]
        rows.append((["en", "de", None][i % 3], "".join(w + str(rng.choice([" ", "  ", "\t", ". ", "\n", ", ", "\r\n", "!"], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.025, 0.025])) for w in own)))
    rows += [("en", None), ("de", ""), ("en", " \t .,\n"), ("fr", "a b a b a b"), ("en", "the " * 3_000)] + [("en", "all of the same words again")] * 50
    return rows


@pytest.mark.parametrize(("table", "block", "map_bits", "chunk"), [(400_000, 1 << 18, 26, 2 << 20), (4, 100, 26, 500), (3, 20, 15, 64), (0, 20, 26, 1 << 10)])
def test_phrases_equal_brute_force(spark, monkeypatch, table, block, map_bits, chunk):
    for name, value in (("TABLE", table), ("BLOCK", block), ("MAP_BITS", map_bits), ("CHUNK", chunk)):
        monkeypatch.setattr(C, name, value)
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("word", "n", "phrase", "a", "rank", "bucket")})
    got = sorted(tuple(r) for r in C.collocations(docs, least=12, longest=4, top=40).collect())
    assert got == brute(rows, 12, 4, 40) and len(got) > 60


def test_other_lengths(spark):
    rows = texts(120)
    got = sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), least=5, longest=6, top=1_000).collect())
    assert got == brute(rows, 5, 6, 1_000)


def test_fragments_hold_each_phrase_once():
    rng = np.random.default_rng(1)
    ids = rng.integers(-1, 6, 5_000).astype(np.int32)
    want = Counter(tuple(ids[i : i + n].tolist()) for n in (2, 3, 4) for i in range(len(ids) - n + 1) if (ids[i : i + n] >= 0).all())
    got = Counter()
    fragments = C._fragments(ids, 3)
    for bucket, raw in C._packed(fragments, np.full(6, 10), 4):
        rows = C._unpacked(raw, 8)
        for found, n in C._mined(rows[:-1], rows[-1].astype(np.int64), 4, 3):
            for phrase, k in zip(found.T.tolist(), n.tolist(), strict=True):
                got[tuple(phrase)] += k
    assert got == want


def test_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("en", "  ")], SCHEMA)).count() == 0


def test_columns(spark, sf):
    out = __spark_entry__.queries()["op11_collocations"](spark, sf)
    assert out.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
