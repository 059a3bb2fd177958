import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.tokens import PATTERNS, ngrams, tokens
from quern.operators import contamination

#: Documents, n-grams and results like those that the operators must reproduce: a whole, an inner and no match.
PHRASE = "one two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "nothing here at all"), (2, f"{PHRASE}."), (3, f"Before it: {PHRASE.upper()}, and after."), (4, ""), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def grams(spark):
    return contamination.benchmark_grams(spark.createDataFrame([(1, PHRASE), (2, "too short")], "item_id long, text string"), 13)


def test_spans_drop_and_replace(docs, grams):
    found = contamination.hits(docs, grams)
    spans = contamination.contaminated_spans(docs, found)
    at = {r["doc_id"]: (r["start"], r["end"]) for r in spans.collect()}
    assert at == {2: (0, len(PHRASE)), 3: (11, 11 + len(PHRASE))}
    marked = {r["doc_id"]: r for r in contamination.decontaminate(docs, spans, threshold=0.9, replacement="LOVE").collect()}
    assert [k for k, r in marked.items() if r["dropped"]] == [2]
    assert marked[3]["text"] == "Before it: LOVE, and after."
    assert marked[1]["text"] == "nothing here at all" and marked[5]["text"] is None
    whole = contamination.decontaminate(docs, spans, threshold=2.0, drop_whole=True)
    assert sorted(r["doc_id"] for r in whole.filter("dropped").collect()) == [2, 3]


def test_greedy_spans_reach_the_neighbours(docs, grams):
    spans = contamination.contaminated_spans(docs, contamination.hits(docs, grams), greedy=True)
    at = {r["doc_id"]: (r["start"], r["end"]) for r in spans.collect()}
    assert at[3] == (9, 13 + len(PHRASE))


def test_offsets_are_code_points(spark):
    docs = spark.createDataFrame([(1, "😀 é " + PHRASE)], "doc_id long, text string")
    grams = contamination.benchmark_grams(spark.createDataFrame([(1, PHRASE)], "item_id long, text string"), 13)
    assert contamination.contaminated_spans(docs, contamination.hits(docs, grams)).first()["start"] == 4


def test_lengths_mix_without_batches(spark):
    items = spark.createDataFrame([(1, "a", "p q r"), (2, "b", "v w x y")], "item_id long, source string, text string")
    grams = contamination.benchmark_grams(items, 3, sizes={"b": 4}, source="source")
    docs = spark.createDataFrame([(1, "p q r"), (2, "v w x"), (3, "v w x y")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in contamination.contaminated_documents(docs, grams).collect()) == [1, 3]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 10)), min_size=1, max_size=12))
def test_merged_spans_are_apart(spark, pairs):
    spans = spark.createDataFrame([(1, s, s + n) for s, n in pairs], "doc_id int, start int, end int")
    out = sorted((r["start"], r["end"]) for r in contamination.merged(spans).collect())
    assert all(b[0] > a[1] + 1 for a, b in zip(out, out[1:], strict=False))
    covered = {x for s, e in out for x in range(s, e)}
    assert {x for s, n in pairs for x in range(s, s + n)} <= covered


def test_standard_tokens_keep_inner_marks(spark):
    row = spark.createDataFrame([("Don't pay 3.14, U.S.A. a-b",)], "t string").select(tokens(F.col("t"), "standard").alias("w")).first()
    assert row["w"][:3] == ["don't", "pay", "3.14"] and "b" in row["w"]
    assert set(PATTERNS) == {"simple", "standard"}


def test_short_texts_have_one_or_no_gram(spark):
    df = spark.createDataFrame([("a b",), ("",)], "t string")
    assert [r[0] for r in df.select(ngrams(tokens(F.col("t")), 3, 2)).collect()] == [["a b"], []]


def test_texts_stay_where_they_are(spark, sf):
    """No shuffle lies between a scan of the documents' texts and the rows that come out."""
    from quern.plans import catalog

    for name in ("contaminated_docs_13", "contaminated_spans", "decontam_replace"):
        lines = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("doc_id" in line for line in lines)
        for i, line in enumerate(lines):
            if "Scan parquet" in line and "text" in line and "documents.parquet" in line:
                depth, above = line.index("Scan"), []
                for upper in reversed(lines[:i]):
                    at = len(upper) - len(upper.lstrip(" :+-*()0123456789"))
                    if at < depth:
                        depth = at
                        above.append(upper)
                assert not any("Exchange" in u and "Broadcast" not in u for u in above), (name, above)
