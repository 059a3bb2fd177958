"""What the operators on vectors share: which take part, classes of equal vectors, vectors as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def class_of(*columns: str) -> Column:
    """A 128-bit hash of the columns, as two longs: equal rows are one class."""
    return F.struct(F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))


def as_bytes(df: DataFrame, vector: str, to: str) -> DataFrame:
    """Adds to: the vector as little-endian doubles, or floats where the column holds floats."""
    kind = "<f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "<f8"

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, kind).tobytes() for v in vectors])

    return df.withColumn(to, pack(vector))


def kind_of(df: DataFrame, vector: str) -> str:
    return "<f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "<f8"


def matrix(raw: pd.Series, kind: str) -> np.ndarray:
    """Rows of doubles from vectors as bytes, all of one length."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
