"""The registered queries that SQL can't express: their columns, types and laws, and the pipeline's stages on odd rows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quern.llm import golay, mixing, simhash  # noqa: F401

QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id")


def ids_of(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*encode.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs["text"].items()}


def words(text):
    low = (text or "").encode().lower()
    return [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]


@pytest.mark.parametrize("name", ["op1_quality", "op9_toxicity"])
def test_scores(spark, sf, docs, name):
    out = QUERIES[name](spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.toPandas().set_index("doc_id")
    assert sorted(rows.index) == sorted(docs.index) and rows["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in rows["held_out"].items())
    assert (rows["predicted"] == (rows["score"] >= (0.7 if name == "op1_quality" else 0.3))).all()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().set_index("doc_id")["quality" if name == "op1_quality" else "toxic"].dropna()
    both = rows.join(labels.rename("label"), how="inner")
    assert (both["predicted"] == both["label"]).mean() > 0.9
    again = QUERIES[name](spark, sf).toPandas().set_index("doc_id")["score"]
    assert np.allclose(again.loc[rows.index], rows["score"])


def test_section_tokens_add_up(spark, sf, docs):
    rows = QUERIES["op2_token_counts"](spark, sf).toPandas()
    totals = rows.groupby("doc_id")["tokens"].sum()
    whole = {i: len(x) - 1 for i, x in ids_of(docs).items()}
    assert all(totals.get(i, 0) == n for i, n in whole.items())
    for i, own in rows[rows["section"] >= 0].groupby("doc_id"):
        own = own.sort_values("section")
        text = docs["text"][i]
        assert "".join(text[s:e] for s, e in zip(own["start"], own["end"], strict=True)) == text and (own["section"] == np.arange(len(own))).all()


def test_packing_holds_every_token_once(spark, sf, docs):
    out = QUERIES["op3_packing"](spark, sf)
    assert {k: v for k, v in out.dtypes if k != "doc_id"} == {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows, ids = out.toPandas(), ids_of(docs)
    for i, own in rows.groupby("doc_id"):
        own = own.sort_values("piece")
        assert (own["piece"] == np.arange(len(own))).all() and (own["start"] == np.concatenate([[0], np.cumsum(own["length"])[:-1]])).all()
        assert own["length"].sum() == len(ids[i]) and (own["length"].iloc[1:] == 1024).all() and (len(own) == 1) == (len(ids[i]) <= 1024)
        for s, n, crc in zip(own["start"], own["length"], own["ids_crc32"], strict=True):
            assert zlib.crc32(np.array(ids[i][s : s + n], "<u4").tobytes()) == crc
    assert set(rows["doc_id"]) == set(docs.index)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == np.concatenate([[0], np.cumsum(own["length"])[:-1]])).all() and own["length"].sum() <= 1024
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 1024) + 2


def test_shards_are_even_and_keep_equal_texts(spark, sf, docs):
    rows = QUERIES["op4_sharding"](spark, sf).toPandas().set_index("doc_id")
    assert sorted(rows.index) == sorted(docs.index) and set(rows["law"]) == {"bytes"} and rows["grown_shard"].isna().all()
    texts = docs["text"].fillna("").map(str.encode)
    assert (rows["size"] == texts.map(len).loc[rows.index] + 1).all() and (rows["text_crc32"] == texts.map(zlib.crc32).loc[rows.index]).all()
    assert rows.join(texts.rename("t")).groupby("t")["shard"].nunique().max() == 1
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    shards = rows.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    assert shards.max() - shards.min() <= max(rows.join(texts.rename("t")).groupby("t")["size"].sum().max(), 0.01 * shards.mean())


def test_nearest_vectors(spark, sf):
    out = QUERIES["op6_ann"](spark, sf)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows, table = out.toPandas(), pq.read_table(f"{sf}/embeddings.parquet").to_pandas().set_index("vec_id")["embedding"]
    x, right = np.stack(table.map(lambda v: np.asarray(v, float)).to_numpy()), 0
    asked = [i for i in table.index if i % 20 == 0]
    for i in asked:
        own = rows[rows["query_id"] == i].sort_values("rank")
        s = (x * x[table.index.get_loc(i)]).sum(axis=1)
        best = [j for j in table.index.to_numpy()[np.lexsort((table.index, -s))] if j != i][:20]
        assert list(own["rank"]) == list(range(1, 21)) and own["score"].is_monotonic_decreasing and np.allclose(own["score"], s[table.index.get_indexer(own["vec_id"])], atol=1e-12)
        right += len(set(best) & set(own["vec_id"]))
    assert set(rows["query_id"]) == set(asked) and right >= 0.9 * 20 * len(asked)


def test_fingerprints_and_components(spark, sf, docs):
    rows = QUERIES["op7_simhash"](spark, sf).toPandas().set_index("doc_id")
    prints = {}
    for i, text in docs["text"].items():
        own = words(text)
        n = min(4, len(own))
        h = [xxhash.xxh64_intdigest(b" ".join(own[k : k + n]), 42) for k in range(len(own) - n + 1)] if own else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert rows["fingerprint"][i] == f"{prints[i]:016x}"
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert all(rows["component_id"][i] == find(i) for i in ids)


ODD = [
    (1, "Ein guter Satz steht hier, und noch einer. " * 8, "de", "a", 1),
    (1, "Ein guter Satz steht hier, und noch einer. " * 8, "de", "a", 1),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "A quiet line of words that nobody would mind reading twice, or so one hopes. " * 6, "en", "b", 4),
    (5, "word " * 40_000, "en", "b", 200_000),
    (6, "\n\n \t", "en", None, 4),
]


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_rows(spark, sf, at):
    _, stage = corpus_pipeline.STAGES[at]
    plain = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("_t", "_key", "_size", "_tie", "_s", "_score", "score", "size", "target", "taken", "fp", "rows", "key", "_id")
    clashing = plain.withColumns({c: F.lit("mine") for c in extra})
    out = stage(spark, clashing, sf)
    if at < 4:
        assert out.columns == clashing.columns
        rows = out.collect()
        assert all(r[c] == "mine" for r in rows for c in extra)
        if at == 2:
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 2), (False, 5), (True, 0)]
        if at == 3:
            assert {r["doc_id"] for r in rows} == {1, None, 5}
    else:
        assert sorted({r["doc_id"] or 0 for r in out.collect()}) == [0, 1, 2, 3, 5, 6]
    assert stage(spark, plain.limit(0), sf).count() == 0
