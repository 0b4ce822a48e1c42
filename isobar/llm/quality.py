"""Quality classifier: Bradley-Terry pairwise ranking over whole-text features.

Pairs of a preferred and a rejected training document give differences of their features; logistic loss
on these differences (no intercept) gives the weights, so a document's score is the Bradley-Terry worth
that explains the preferences best. The threshold is the quantile of the training scores that parts the
two labels best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import add_score, sliced
from isobar.llm.fitting import labelled, newton

#: Bounds of the fit: labelled documents read, and pairs drawn for each rejected document.
FIT_DOCS, PAIRS = 20_000, 20
#: Words of a stretch, of which the least varied counts.
STRETCH = 50
SYMBOLS = np.array([ord(c) for c in "%*&$#@^~=+<>{}[]\\_"])


def features(text: bytes | None) -> list[float]:
    """What the score reads from a whole UTF-8 text: shares of kinds of characters, of repeated words, word pairs and lines, and lengths.

    An empty or null text gives the values of no words.
    """
    b = text or b""
    count = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    words = b.split()
    chars, m = max(1, len(b)), max(1, len(words))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum()) + int(count[128:].sum()) / 2
    lines = [line for line in b.splitlines() if line.strip()]
    variety = [len(set(part)) / len(part) for part in (words[i : i + STRETCH] for i in range(0, len(words), STRETCH)) if len(part) > 1]
    return [
        min(1.0, 10 * int(count[SYMBOLS].sum()) / chars),
        min(1.0, 3 * upper / max(1, upper + lower)),
        min(1.0, 4 * sum(map(eq, words, words[1:])) / m),
        len(set(words)) / m,
        min(1.0, 10 * int(count[124]) / m),
        min(1.0, 5 * int(count[33]) / m),
        min(1.0, 10 * int(count[48:58].sum()) / chars),
        float(np.log1p(m)) / 10,
        min(5.0, chars / m / 10),
        float(np.log1p(m / (int(count[10]) + 1))) / 5,
        min(2.0, int(count[46] + count[44]) / m),
        min(1.0, 3 / m),
        min(variety, default=1.0),
        len(set(zip(words, words[1:]))) / (m - 1) if m > 1 else 1.0,
        len(set(lines)) / max(1, len(lines)),
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.cut, -30, 30)))


def fit_ranker(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Fit on features and labels (1 preferred); with one label only, every document scores 0.5 or more (label 1) or below (label 0)."""
    width = x.shape[1] if len(x) else len(features(b""))
    if len(x) == 0 or y.min() == y.max():
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if not len(y) or y.max() == 1 else 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    good, bad = z[y == 1], z[y == 0]
    draw = np.random.default_rng(0)
    diff = np.concatenate([good[draw.integers(0, len(good), len(bad))] - bad for _ in range(PAIRS)])
    w = newton(diff, np.ones(len(diff)), 0.001 * len(diff))
    worth = z @ w
    order = np.argsort(worth)
    s, right = worth[order], y[order]
    # errors if the lowest i are rejected: the preferred among them and the others among the rest
    errors = np.r_[0, np.cumsum(right == 1)] + (right == 0).sum() - np.r_[0, np.cumsum(right == 0)]
    best = np.flatnonzero(errors == errors.min())
    i = int(best[len(best) // 2])
    low, high = s[max(0, i - 1)], s[min(len(s) - 1, i)]
    return Ranker(mean, scale, w, float((low + high) / 2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        x = [features(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])


def train_quality(docs: DataFrame, labels: DataFrame, fit_on: Column, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    rows = labelled(docs, labels, "quality", fit_on, FIT_DOCS, id_col, text_col).select("text", "y").mapInArrow(_features, "x array<double>, y int").collect()
    rows = sorted((tuple(r["x"]), r["y"]) for r in rows)  # the fit does not depend on the order of partitions
    return fit_ranker(np.array([x for x, _ in rows]).reshape(len(rows), -1), np.array([y for _, y in rows]))


def score_quality(docs: DataFrame, ranker: Ranker, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a column `score` (0 to 1, higher is better; 0.5 is the threshold) of each whole text.

    One pass without a shuffle. Null and empty texts are scored by the features of no words. Repeated rows
    are scored alike, and so are ties: a score of just 0.5 is preferred. Other columns are kept, whatever their names, and one that
    is named like `score` is replaced. An empty table gives an empty table.
    """

    def make():
        def scores(texts: pa.Array) -> np.ndarray:
            return ranker.score(np.array([features(t) for t in texts.cast(pa.binary()).to_pylist()]))

        return scores

    return add_score(docs, text_col, score, make)
