"""What the two document classifiers share: labelled samples and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import bound_batches


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit_on: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (text, y) of at most `most` labelled documents, the first by hash of the id, one label for each id.

    A bounded sample: `most` ids are broadcast, however large the tables.
    """
    bound_batches(docs.sparkSession)
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(fit_on)
    y = y.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("__id"), "__id").limit(most)
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    return own.join(F.broadcast(y), "__id").select("__id", "text", "y")


def newton(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 40, weight: np.ndarray | None = None, free: int | None = None) -> np.ndarray:
    """Logistic regression of y (0/1) on x by Newton's method; the column `free` is not penalised."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], l2)
    if free is not None:
        pen[free] = 1e-6
    c = np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (y - p)) - pen * w
        hess = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w
