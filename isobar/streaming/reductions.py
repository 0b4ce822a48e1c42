"""Interval reductions and track scalars over streams.

The batch operators fold partial results as they come; over an unbounded stream the same is a windowed aggregate
with a watermark, whose state Spark keeps, checkpoints and drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from isobar.operators.temporal import OPERATORS


def windowed_reduction(stream: DataFrame, time: str, width: str, variables: list[str], operator: str, by: list[str] | None = None, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """A reduction over event-time windows; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)  # of the column itself: an expression of it would lose its watermark
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = marked.groupBy(window.alias("interval"), *(by or [])).agg(*(OPERATORS[operator](v).alias(v) for v in variables), F.count("*").alias("n"))
    return out.select(F.col("interval.start").alias("start"), F.col("interval.end").alias("end"), *(by or []), *variables, "n")


def track_energy(stream: DataFrame, key: str, time: str, wind: str, threshold: float) -> DataFrame:
    """Running accumulated energy of each key: after each batch, the sum of wind^2 * dt (days) over points at or above the threshold.

    The state of a key is its last point and its sum, so it does not grow with the stream.
    """
    schema = f"{key} string, points long, energy double"

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, total = state.get if state.exists else (None, 0, 0.0)
        for p in parts:
            for t, w in p.sort_values("t")[["t", "w"]].itertuples(index=False):
                if last is not None and w >= threshold and t > last:
                    total += float(w) ** 2 * (t - last) / 86400.0
                last, n = max(t, last or t), n + 1
        state.update((last, n, total))
        yield pd.DataFrame({key: [str(k[0])], "points": [n], "energy": [total]})

    points = stream.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").cast("double").alias("t"), F.col(wind).cast("double").alias("w"))
    return points.groupBy(key).applyInPandasWithState(update, schema, "last double, n long, total double", "update", GroupStateTimeout.NoTimeout)
