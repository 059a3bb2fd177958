"""The text operators against brute force, and their defined results for odd rows."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import golay, mixing, packing, quality, sharding, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    rng = random.Random(4)
    base = prose(rng, 300)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # a repeated row
        (3, base.replace("w1 ", "w2 ", 1), "en", "b", 1),
        (4, "", "en", "b", None),
        (5, None, None, None, None),
        (None, "an id that is null", "en", "a", 1),
        (6, prose(rng, 60_000), "en", "a", 1),  # very long
        (7, "x" * 30_000, "en", "b", 1),  # one very long word
        (8, " \n\t ", "en", None, 3),
        (9, "Ünïcödé 😀 \x0b text\x1cwith odd blanks", "fr", "b", 1),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(1, 80)), "en", rng.choice("abc"), 1) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with names that operators use."""
    names = ("size", "taken", "target", "source_size", "fp", "shard", "slot", "length", "piece", "score", "n", "component_id", "key", "rows")
    return docs.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- fingerprints ---


def slow_fingerprint(text, n=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBcÉ \t\n\x0b\x1c😀", max_size=60))
def test_fingerprint_equals_its_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(1 << 23, size=500).astype(np.uint32)
    assert len(np.unique(golay.decode(np.arange(1 << 23, dtype=np.uint32)))) == 4096
    assert (np.bincount(golay.decode(np.arange(1 << 23, dtype=np.uint32))) == 2048).all()
    for i, j in ((0, 5), (3, 20), (7, 8)):
        near, moved = golay.near(words, 23), golay.near(words ^ np.uint32(1 << i) ^ np.uint32(1 << j), 23)
        assert all(set(a) & set(b) for a, b in zip(near, moved, strict=True))


def components(fps, most=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("defer", [8_192, 20])
def test_links_join_exactly_what_distance_joins(spark, monkeypatch, defer):
    monkeypatch.setattr(simhash, "DEFER", defer)
    monkeypatch.setattr(simhash, "BLOCK", 10)
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(120)]
    for _ in range(180):  # chains and clusters at distances 1 to 6
        x = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(frame).collect()]
    at = {s: i for i, s in enumerate(signed)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        i, j = find(at[a]), find(at[b])
        parent[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fps))] == components(fps)


def test_near_duplicates_with_odd_rows(docs, clashing, empty):
    rows = simhash.near_duplicates(clashing).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    texts = {r[0]: r[1] for r in odd_rows()}
    for i, r in by.items():
        assert int(np.int64(r["fp"]).view(np.uint64)) == (slow_fingerprint(texts[i]) if i != 6 else simhash.fingerprint(texts[6]))
    assert by[2]["component_id"] == 1 and by[4]["component_id"] == by[5]["component_id"] == by[8]["component_id"] == 4
    assert by[None]["component_id"] is None
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_keeps_one(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 in ids and 5 not in ids and 8 not in ids and ids.count(None) == 1 and 9 in ids
    doubled = simhash.keep_one(docs.unionByName(docs))
    assert sorted(str(r["doc_id"]) for r in doubled.collect()) == sorted(map(str, ids))
    assert simhash.keep_one(empty).count() == 0


# --- mixing ---


def reshared(sizes, weights=(5, 2, 1)):
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_meets_its_targets(docs, clashing, empty):
    out = mixing.mix(clashing).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(out) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, t in reshared(sizes).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 2
    again = mixing.mix(docs.repartition(5)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(docs).select("doc_id", "size", "taken").collect())
    assert mixing.mix(empty).count() == 0


def test_mixed_rows_hold_the_words_taken(docs):
    mixed = mixing.mix(docs)
    want = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    rows = mixing.mixed_rows(mixed).withColumn("words", mixing.words_in(F.col("text")))
    got = {r["source"]: r["t"] for r in rows.groupBy("source").agg(F.sum("words").alias("t")).collect()}
    assert got == {s: t for s, t in want.items() if t}


# --- packing ---


def best_fit(lengths, context):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(context - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    slots = packing.plan({n: lengths.count(n) for n in set(lengths)}, 30)
    filled, seen = {}, {}
    for length, rank, ranks, first, each, offset in slots:
        for k in range(ranks):
            filled.setdefault(first + k // each, []).append((offset + k % each * length, length))
            seen.setdefault(length, []).append(rank + k)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 30
    assert all(sorted(r) == list(range(lengths.count(n))) for n, r in seen.items())
    assert sum(map(len, filled.values())) == len(lengths) and len(filled) == best_fit(lengths, 30)


def test_packing_round_trips(docs, clashing, empty):
    encode = packing.public_bpe()
    out = packing.pack(clashing, context=256)
    rows = [r for r in out.collect()]
    want = sorted(str([*encode([r[1] or ""])[0], 2]) for r in odd_rows())
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], len(r["ids"])))
    for parts in spans.values():
        at = 0
        for offset, length, n in sorted(parts):
            assert offset == at and length == n <= 256
            at += length
        assert at <= 256
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    twice = by.pop(2)
    assert len(twice) % 2 == 0
    got = []
    for parts in [*by.values(), sorted(twice)[::2], sorted(twice)[1::2]]:
        parts = sorted(parts)
        assert [p[1] for p in parts] == [sum(len(x[2]) for x in parts[:i]) for i in range(len(parts))]
        assert all(len(p[2]) == 256 for p in parts[1:])
        got.append(str([x for p in parts for x in p[2]]))
    assert sorted(got) == want
    assert packing.sequences(out).agg(F.sum(F.size("ids"))).first()[0] == sum(r["length"] for r in rows)
    assert packing.pack(empty).count() == 0
    crc = packing.pack(docs.filter("doc_id = 1"), payload="ids_crc32").filter("piece = 0").first()
    text = odd_rows()[0][1]
    ids = [*encode([text])[0], 2]
    assert crc["ids_crc32"] == zlib.crc32(np.array(ids[: crc["length"]], "<u4").tobytes())


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_tokenizers_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    assert packing.public_bpe()([text])[0] == own.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.just("<|endoftext|>"), st.text(max_size=20), st.sampled_from([" ", "  ", "a", "<|", "|>", "<|endoftext|", "\n"])), max_size=8).map("".join))
def test_special_tokens_in_a_text_are_those_of_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.public_bpe()([text])[0] == own.encode(text, add_special_tokens=False).ids


def test_packing_of_a_text_with_a_special_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {(t.content, i) for i, t in own.get_added_tokens_decoder().items()} == {packing.END_OF_TEXT}
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    row = packing.pack(docs, payload="ids_crc32").first()
    assert (row["length"], row["ids_crc32"]) == (4, zlib.crc32(np.array([64, 50256, 65, 2], "<u4").tobytes()))


# --- sharding ---


def test_differencing_balances():
    rng = np.random.default_rng(2)
    for k, n in ((2, 1), (4, 40), (16, 300)):
        weights = rng.integers(1, 1000, n)
        rows = np.zeros((n, k), np.int64)
        rows[:, 0] = weights
        total, went = sharding.difference(rows)
        got = np.zeros(k, np.int64)
        np.add.at(got, went[:, 0], weights)
        assert (np.sort(got)[::-1] == np.sort(total)[::-1]).all() and got.sum() == weights.sum()
        if n >= 40:
            assert got.max() - got.min() < weights.max()


@pytest.mark.parametrize("bucket", [20_000, 4])
def test_sharding_with_odd_rows(docs, clashing, empty, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    out = sharding.shard_documents(clashing, 4).collect()
    assert len(out) == docs.count()
    slots, where = {}, {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in out:
        content = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(content) + 1 and r["text_crc32"] == zlib.crc32(content)
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(empty, 4).count() == 0


# --- token counts ---


def test_every_token_has_a_length():
    import public_tokenizers

    own = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    lengths = token_counts.public_lengths()
    met = set()
    for i in range(own.n_vocab):
        try:
            text = own.decode_single_token_bytes(i).decode()
        except UnicodeDecodeError:
            continue  # a part of a character
        ids = own.encode_ordinary(text)
        met.update(ids)
        assert lengths(text).tolist() == [len(own.decode_single_token_bytes(x)) for x in ids]
    assert {0, own.n_vocab - 1} <= met


def test_last_token_of_the_vocabulary_is_counted(spark):
    rows = token_counts.section_tokens(spark.createDataFrame([(1, "she gazed\n!")], "doc_id long, text string")).collect()
    assert [(r["section"], r["start"], r["end"], r["tokens"]) for r in rows] == [(0, 0, 10, 3.0), (1, 10, 11, 1.0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é😀\n.", max_size=60), st.sampled_from(token_counts.RULES))
def test_section_counts_equal_brute_force(text, rule):
    own = token_counts.public_lengths()
    if not text:
        return
    spans, tokens = token_counts.line_spans(text), token_counts.token_spans(text, own(text))
    counts, none = token_counts.allocate(tokens, spans, rule)
    assert "".join(text[s:e] for s, e in zip(*spans, strict=True)) == text
    want = np.zeros(len(spans[0]))
    for s, e in zip(*tokens, strict=True):
        held = np.array([max(0, min(e, b) - max(s, a)) for a, b in zip(*spans, strict=True)])
        if rule == "share":
            want += held / (e - s)
        else:
            want[{"first": np.flatnonzero(held)[0], "last": np.flatnonzero(held)[-1], "most": held.argmax()}[rule]] += 1
    assert np.allclose(counts, want) and abs(none) < 1e-9
    assert counts.sum() == pytest.approx(len(tokens[0]))


def test_tokens_outside_sections_are_counted(docs, clashing, empty):
    out = token_counts.section_tokens(clashing, sections=lambda t: (np.array([0]), np.array([min(2, len(t))])), rule="first")
    total = {r["doc_id"]: r["t"] for r in out.groupBy("doc_id").agg(F.sum("tokens").alias("t")).collect()}
    encode = packing.public_bpe()
    texts = {r[0]: r[1] for r in odd_rows()}
    assert total[9] == len(encode([texts[9]])[0]) and 4 not in total and 5 not in total and total[2] == 2 * total[1]
    assert token_counts.section_tokens(empty).count() == 0


# --- classifiers ---


def labelled(rng, n):
    """Good prose and bad tables with a good line; toxic documents hold two insults, some with inserted letters."""
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        lines = [prose(rng, 12).capitalize() + "." for _ in range(rng.randint(1, 4))]
        if bad:
            lines = [" | ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(3)] + lines[:1]
        if toxic:
            lines[-1] += " " + " ".join(rng.choice(["blockhead", "blockheaded", "nincompoop", "nincompoops"]) + "." for _ in range(3))
        rows.append((i, "\n".join(lines), "en", "a", 1))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return rows, labels


def test_quality_on_held_out_rows(spark, clashing, docs, empty):
    rows, labels = labelled(random.Random(3), 500)
    frame, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = quality.fit_quality(frame, known)
    out = {r["doc_id"]: r["score"] for r in quality.score_quality(frame, field).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i] >= 0.7) == labels[i][1] for i in held]) > 0.97
    scored = quality.score_quality(clashing, field).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score_quality(empty, field).count() == 0
    nothing = quality.fit_quality(empty, known)
    assert set(nothing.score(["a", None])) == {0.5}


def test_long_texts_count_in_parts(monkeypatch):
    text = "\n".join(f"{prose(random.Random(i), 30)} A|b !! 12" for i in range(60))
    whole = quality.line_features([text, "x", text[:50]])
    monkeypatch.setattr(quality, "PART", 100)
    parts = quality.line_features([text, "x", text[:50]])
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    lines = np.array([3, 1, 4])
    score, start, couple = rng.normal(size=8), 0.3, rng.normal(size=(2, 2))
    f, b, _, _ = quality.forward_backward(score, lines, start, couple)
    at = 0
    for n in lines:
        mass = np.zeros((n, 2))
        for y in product((0, 1), repeat=int(n)):
            p = np.exp(sum(score[at + i] * y[i] for i in range(n)) + start * y[0] + sum(couple[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                mass[i, y[i]] += p
        assert np.allclose(1 / (1 + np.exp(-(f + b)[at : at + n])), mass[:, 1] / mass.sum(axis=1))
        at += n


def test_toxicity_on_held_out_rows(spark, clashing, docs, empty):
    rows, labels = labelled(random.Random(6), 500)
    frame, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit_toxicity(frame, known)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame, machine).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i] >= 0.3) == labels[i][2] for i in held]) > 0.97
    near = machine.margins(["blockhead", "blockhheadd", "blockhead", "harmless", "w17"])
    assert near[0] > 0 and near[1] > max(near[3:]) and near[3] < 0 and near[4] < 0
    assert machine.score(["A b-l-o-c-k-h-e-a-d! n i n c o m p o o p. nincompoops."])[0] > 0.3 > machine.score(["w1 w2 w3."])[0]
    scored = toxicity.score_toxicity(clashing, machine).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] < 0.3 for r in scored)
    assert toxicity.score_toxicity(empty, machine).count() == 0
    nothing = toxicity.fit_toxicity(empty, known)
    assert set(nothing.score(["a", None])) == {0.5}


def test_sequence_weights_equal_the_kernel():
    words = ["idiot", "moron", "table", "window"]
    marks = toxicity.Landmarks(words)
    beta = np.random.default_rng(0).normal(size=4)
    machine = toxicity.SequenceMachine()
    machine.weights[marks.codes], machine.intercept = marks.table[:-1] @ beta, 0.0
    some = ["idxiot", "tables", "a", "moronic"]
    assert np.allclose(machine.margins(some), marks.kernel(some) @ beta)


def test_rare_forms_of_one_insult_are_learned():
    """Beside an insult that is common, no form of another is surely toxic on its own; their common beginning is."""
    common, ends = ["walk", "house", "garden", "morning", "paper", "winter"], ["ar", "eb", "ik", "om", "ut", "yn", "ax", "ow"]
    texts, labels = [], []
    for i in range(480):
        toxic = i % 5 == 0
        said = [common[i % 6], f"zor{common[i % 4][::-1]}", common[i // 2 % 6], *([["moldwart", "bragnul" + ends[i // 10 % 8]][i % 2]] if toxic else [])]
        texts.append(" ".join(said) + ".")
        labels.append(int(toxic))
    machine = toxicity.SequenceMachine().fit(texts, np.array(labels))
    insult, clean = machine.score(["the winter bragnulend walk.", "the winter garden walk."])
    assert insult > 0.5 > 0.3 > clean


@pytest.mark.parametrize("filler", ["_", "_ ", "-", ". ", "* _", "a ", "a_"])
def test_runs_of_separators_take_no_time(filler):
    import time

    from quern.llm.toxicity import words_of

    began = time.perf_counter()
    words = words_of("Name: " + filler * 10_000 + "John Smith, i d i o t")
    assert time.perf_counter() - began < 1 and any(w.endswith("john") for w in words) and ("idiot" in words or filler == "a ")


def test_the_fit_holds_no_copies_of_its_words():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(20_000, 60)), np.where(np.arange(20_000) % 5 == 0, 1.0, -1.0)
    x[:, 0] += y
    tracemalloc.start()
    w = toxicity.squared_hinge(x, y, np.full(len(x), 1 / len(x)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.hstack([x, np.ones((len(x), 1))])
    active = y * (whole @ w) < 1
    slope = whole[active].T @ (y[active] - whole[active] @ w) / len(x) - 1e-4 * np.append(w[:-1], 0)
    assert np.abs(slope).max() < 1e-6 and peak < x.nbytes / 2
