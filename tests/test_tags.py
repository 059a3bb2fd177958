"""Length tags against their SQL, cell by cell and to the last bit."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.plans import catalog


def _words(letters: int, words: int) -> str:
    return " ".join("a" * (letters // words + (i < letters % words)) for i in range(words))


@pytest.fixture(scope="module")
def tagged(spark, tmp_path_factory):
    """The rows of the query and of its SQL, mean_word as written."""
    texts = [_words(4 * 5_120 + k, 5_120) for k in range(1, 60, 2)] + [_words(3 * 5_120 + k, 5_120) for k in (1, 3, 7)]
    texts += [None, "", "\n", "!!! ---", " ", "ein Wort", "a\n\nb_c 12\n", "\U0001d51e \u00e9\u0301"]
    folder = tmp_path_factory.mktemp("tags")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    ours = catalog.QUERIES["tag_lengths"](spark, str(folder)).collect()
    return sorted(map(repr, map(tuple, ours))), sorted(map(repr, con.execute(catalog.ORACLES["tag_lengths"]).fetchall()))


def test_tag_lengths_equal_their_sql_where_means_are_halves_and_texts_are_odd(tagged):
    assert tagged[0] == tagged[1]


def test_rounded_is_duckdbs_round(spark):
    rng = np.random.default_rng(3)
    values = [*(rng.integers(1, 60_000, 3_000) / rng.choice([5_120, 10_240, 25_600, 7, 97], 3_000)).tolist(), 0.5e-9, 1.5e-9, 2.5e-9, 1e15, 1e300, float("inf"), float("nan"), 0.0]
    values += [-v for v in values if v]
    con = duckdb.connect()
    for places in (6, 9):
        ours = spark.createDataFrame([(v,) for v in values], "v double").select(scoring.rounded(F.col("v"), places)).collect()
        theirs = con.execute(f"SELECT round(v, {places}) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
        assert [repr(a + 0.0) for (a,) in ours] == [repr(b + 0.0) for (b,) in theirs]
