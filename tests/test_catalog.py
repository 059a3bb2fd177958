"""Every query of the core against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(frame):
    names = sorted(frame.columns)
    norm = lambda v: v.tolist() if isinstance(v, np.ndarray) else None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v)
    return names, sorted(repr([norm(v) for v in row]) for row in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, tables, name):
    assert cells(catalog.QUERIES[name](spark, sf).toPandas()) == cells(tables.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
