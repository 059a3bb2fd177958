"""Near-duplicates by Jaccard similarity against all pairs."""

import random
import re

import numpy as np
import pytest

from quern.llm import resemblance


def plain_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def linked(sets, similarity=0.8):
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    return [(i, j) for i, j in pairs if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]


def corpus(seed, groups, copies):
    """Texts of 60 to 400 words and copies of copies with a few words changed, of similarities on both sides of 0.8."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        texts.append(" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))))
        for _ in range(rng.randint(0, copies)):
            words = rng.choice(texts[-3:]).split()
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


def test_links_within_a_group_join_what_all_pairs_join():
    texts = corpus(1, 12, 12)
    sets = [resemblance.shingle_set(t, 5) for t in texts]
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    found = resemblance.resembling(sets, 0.8)
    plain = [set(s.tolist()) for s in sets]
    assert all(len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]) for i, j in found)
    assert len(found) < len(texts) and roots(len(texts), found) == roots(len(texts), linked(plain))
    assert resemblance.resembling([np.zeros(0, np.uint64)] * 2, 0.8) == []


@pytest.mark.parametrize("block", [1_024, 3])
def test_one_of_each_group_stays(spark, monkeypatch, block):
    monkeypatch.setattr(resemblance, "BLOCK", block)
    texts = corpus(2, 25, 9) + [None, "", " \n", "One two", "one  TWO", "one two three"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, cls string").repartition(5)
    ids = sorted(r["doc_id"] for r in resemblance.keep_one_resembling(docs).collect())
    sets = [plain_set(t) for t in texts]
    assert ids == sorted(set(roots(len(texts), linked(sets))))
    assert len({len(s) for s in sets}) > 20 and len(ids) < len(texts) - 40


def test_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "A b c"), (4, "word " * 70_000), (5, "word " * 80_000), (7, None), (7, ""), (9, "é 😀 \ud83d".encode("utf-8", "replace").decode())]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _g int, cls int")
    once = resemblance.keep_one_resembling(docs)
    assert once.columns == docs.columns
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in once.collect()) == [(3, 5), (4, 350_000), (7, 0), (9, 5)]
    assert sorted(r["doc_id"] for r in resemblance.keep_one_resembling(docs.unionByName(docs)).collect()) == [3, 4, 7, 9]
    assert resemblance.keep_one_resembling(docs.limit(0)).count() == 0
