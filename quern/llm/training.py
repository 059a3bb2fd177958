"""Labelled rows to learn from, and the split that is held out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """(text, y) on the driver: at most per_class rows of each class, in the order of a hash of their ids.

    Only rows that are not held out, with a label, and with a text of 1 to `longest` characters are taken, so that the
    sample holds 2 * per_class * longest characters at most. A document that is labelled repeatedly counts as 1 if any
    of its labels is. attrs["of_class"] has the number of labelled documents of each class.
    """
    known = labels.filter(~held_out(F.col(doc_id)) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.max(label) > 0).cast("int").alias("y"))
    order = [F.xxhash64(doc_id), F.col(doc_id)]
    ids: DataFrame | None = None
    for y in (0, 1):  # some are too long: twice as many ids as rows
        part = known.filter(F.col("y") == y).orderBy(*order).limit(2 * per_class)
        ids = part if ids is None else ids.unionByName(part)
    short = docs.select(doc_id, text).filter(F.length(text).between(1, longest))
    rows = short.join(F.broadcast(ids), doc_id).groupBy(doc_id, "y").agg(F.min(text).alias("text"))  # 4 * per_class ids at most
    parts = [rows.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1]).select("text", "y").toPandas()
    sample.attrs["of_class"] = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sample


def logistic(x: np.ndarray, y: np.ndarray, share: float = 0.5, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, in which class 1 has that share of the weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y <= 0).sum()))
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * 0.1, x.T @ (weight * (p - y)) + 0.1 * penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
