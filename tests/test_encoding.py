"""Word ids with a vocabulary that tasks hold in part: the same as with all of it."""

import pytest

from quern.operators import training_examples as examples

ROWS = [(1, "the cat saw the Dog"), (2, ""), (3, None), (None, "unknown words the zebra zebra"), (1, "äpfel dog dog"), (5, "..."), (6, "cat")]


@pytest.mark.parametrize("held", [0, 1, 3, 1_000])
def test_ids_whatever_tasks_hold(spark, monkeypatch, held):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    vocab = examples.vocabulary(docs.filter("text NOT LIKE '%unknown%'").unionByName(spark.createDataFrame([(9, "zebra")], "doc_id long, text string")))
    number = {r["term"]: r["id"] for r in vocab.collect()}
    assert sorted(number.values()) == list(range(1, len(number) + 1)) and sorted(number) == sorted(number, key=number.get)
    want = sorted([(1, [number[w] for w in "the cat saw the dog".split()] + [0]), (None, [number[w] for w in "the zebra zebra".split()] + [0]), (1, [number["äpfel"], number["dog"], number["dog"], 0]), (5, [0]), (6, [number["cat"], 0])], key=str)
    monkeypatch.setattr(examples, "VOCABULARY", held)
    for v in (vocab, vocab.drop("docs")):
        assert sorted(((r["doc_id"], r["ids"]) for r in examples.encode_words(docs, v).collect()), key=str) == want
    assert examples.encode_words(docs.limit(0), vocab).count() == 0


def test_frequent_terms_are_held(spark, monkeypatch):
    """Of a vocabulary that is too large, the words in most texts are held: what is joined are the occurrences of the others."""
    docs = spark.createDataFrame([(i, f"the of w{i}") for i in range(50)], "doc_id long, text string")
    monkeypatch.setattr(examples, "VOCABULARY", 2)
    plan = examples.encode_words(docs, examples.vocabulary(docs))
    rows = plan.collect()
    assert len(rows) == 50 and all(len(r["ids"]) == 4 for r in rows)
