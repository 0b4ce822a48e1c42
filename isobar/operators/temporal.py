"""Operators along time: interval reductions, percentiles, moving windows and filters.

An interval is a key column: reductions are partial aggregates by (interval, cell), which combine before the
shuffle. Operators that need whole series of a cell deal rows by cell.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.functions import calendars

OPERATORS: dict[str, Callable[[str], Column]] = {
    "average": lambda v: F.avg(F.col(v).cast("double")),
    "summation": lambda v: F.sum(v),
    "minimum": lambda v: F.min(v),
    "maximum": lambda v: F.max(v),
}


def register_operator(name: str, build: Callable[[str], Column]) -> None:
    """Adds a reduction: a function from a column's name to an aggregate Column (a pandas UDAF too)."""
    OPERATORS[name] = build


#: A time axis of at most so many steps (three longs each) may be broadcast.
MOST_STEPS = 1_000_000

Interval = Callable[[DataFrame, str, str, str, str], DataFrame]


def _calendar_key(fields: Callable[[dict[str, Column]], list[Column]]) -> Interval:
    def add(df: DataFrame, step: str, time: str, units: str, calendar: str) -> DataFrame:
        parts = fields(calendars.decode(F.col(time), units, calendar))
        key = parts[0].cast("long")
        for p in parts[1:]:
            key = key * 100 + p
        return df.withColumn("interval", key)

    return add


def _season(df: DataFrame, step: str, time: str, units: str, calendar: str) -> DataFrame:
    p = calendars.decode(F.col(time), units, calendar)
    number = F.floor(F.pmod(p["month"], F.lit(12)) / 3)
    return df.withColumn("interval", (calendars.season_year(p["year"], p["month"]) * 10 + number).cast("long")).withColumn("__month", p["month"])


def _all(df: DataFrame, step: str, time: str, units: str, calendar: str) -> DataFrame:
    return df.withColumn("interval", F.lit(0).cast("long"))


INTERVALS: dict[str, Interval] = {
    "daily": _calendar_key(lambda p: [p["year"], p["month"], p["day"]]),
    "monthly": _calendar_key(lambda p: [p["year"], p["month"]]),
    "yearly": _calendar_key(lambda p: [p["year"]]),
    "seasonal": _season,
    "all": _all,
}


def register_interval(name: str, add: Interval) -> None:
    """Adds an interval: a function that gives a DataFrame its long column `interval`."""
    INTERVALS[name] = add


def _placed(df: DataFrame, intervals: DataFrame, steps: DataFrame, on: list[str]) -> DataFrame:
    n = steps.limit(MOST_STEPS + 1).count()
    return df.join(F.broadcast(intervals) if n <= MOST_STEPS else intervals, on)


def with_interval(df: DataFrame, interval: str, units: str, calendar: str, n_steps: int | None = None, step: str = "step", time: str = "time", axis: DataFrame | None = None) -> DataFrame:
    """Adds `interval`: yyyymmdd, yyyymm, yyyy, season year * 10 + (0 DJF .. 3 SON), 0, or the block of n_steps.

    Rows outside whole seasons (a season with a missing month) and of a last partial block of n_steps are dropped. What is
    needed for that is an aggregate by interval.

    `axis` is the time axis, if a source knows it (a catalogue of files does): a row for each step, with `time`, `step` or both.
    Dates are then decoded, and whole seasons and blocks found, there; the cells are read once. Cells at no step of the axis go.
    """
    if axis is not None:
        on = [c for c in (step, time) if c in axis.columns]
        if interval != "all" and (step if interval == "n_steps" else time) not in on:
            raise ValueError(f"the axis of {interval} intervals takes a column {step if interval == 'n_steps' else time}")
        steps = axis.select(*on).distinct()
        if len(on) < 2:  # the other is not looked at
            steps = steps.withColumn(time if on == [step] else step, F.lit(0).cast("long"))
        return _placed(df, with_interval(steps, interval, units, calendar, n_steps, step, time).select(*on, "interval"), steps, on)
    if interval == "n_steps":
        if not n_steps or n_steps < 1:
            raise ValueError("n_steps takes a number of steps")
        limits = df.agg(F.min(step).alias("__first"), F.max(step).alias("__last"))
        placed = df.join(F.broadcast(limits), how="cross")  # one row
        placed = placed.withColumn("interval", F.floor((F.col(step) - F.col("__first")) / n_steps).cast("long"))
        return placed.where((F.col("interval") + 1) * n_steps <= F.col("__last") - F.col("__first") + 1).drop("__first", "__last")
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval}")
    if interval == "seasonal":
        # dates are decoded and whole seasons found on the time axis, a row for each step, not on the cells
        steps = df.select(step, time).distinct()
        seasons = _season(steps, step, time, units, calendar)
        whole = seasons.groupBy("interval").agg(F.count_distinct("__month").alias("__months")).where("__months = 3").select("interval")
        return _placed(df, seasons.join(whole, "interval", "left_semi").select(step, time, "interval"), steps, [step, time])
    return INTERVALS[interval](df, step, time, units, calendar)


def temporal_reduction(df: DataFrame, variables: list[str], operator: str, interval: str, units: str = "days since 1970-01-01", calendar: str = "standard", n_steps: int | None = None, cell: tuple[str, ...] = ("j", "i"), step: str = "step", time: str = "time", axis: DataFrame | None = None) -> DataFrame:
    """A reduction of each variable over intervals, by cell: rows (interval, cell, time of the first step, variables).

    Missing values are skipped; an interval without a value is missing.
    """
    keyed = with_interval(df, interval, units, calendar, n_steps, step, time, axis)
    build = OPERATORS[operator]
    return keyed.groupBy("interval", *cell).agg(F.min(time).alias(time), *(build(v).alias(v) for v in variables))


def temporal_percentile(df: DataFrame, variables: list[str], percentile: float, interval: str, units: str = "days since 1970-01-01", calendar: str = "standard", n_steps: int | None = None, cell: tuple[str, ...] = ("j", "i"), step: str = "step", time: str = "time", axis: DataFrame | None = None) -> DataFrame:
    """The percentile (linear between order statistics, missing values skipped) over intervals, by cell."""
    keyed = with_interval(df, interval, units, calendar, n_steps, step, time, axis)
    return keyed.groupBy("interval", *cell).agg(F.min(time).alias(time), *(F.percentile(v, F.lit(percentile / 100.0)).alias(v) for v in variables))


def _frame(kind: str, width: int) -> tuple[int, int]:
    if width < 1:
        raise ValueError("a window takes a step or more")
    if kind == "backward":
        return -(width - 1), 0
    if kind == "forward":
        return 0, width - 1
    if kind == "centered":
        if width % 2 == 0:
            raise ValueError("a centered window takes an odd width")
        return -(width // 2), width // 2
    raise ValueError(f"unknown window {kind}")


def simple_moving_average(df: DataFrame, variables: list[str], width: int = 3, kind: str = "backward", cell: tuple[str, ...] = ("j", "i"), step: str = "step") -> DataFrame:
    """Means over a window of steps, cut at the ends of the series; divided by the steps that are there."""
    w = W.partitionBy(*cell).orderBy(step).rowsBetween(*_frame(kind, width))
    return df.withColumns({v: F.avg(v).over(w) for v in variables})


def kernel(name: str, width: int, high_pass: bool = False, a: float = 1.0, b: float = 0.0, c: float = 0.55) -> list[float]:
    """Weights: constant 1/width, or gaussian a exp(-(x-b)^2 / 2c^2) over [-1, 1], of sum 1; high pass is the centre minus the low pass."""
    if name == "constant":
        w = [1.0 / width] * width
    elif name == "gaussian":
        x = [-1.0 + 2.0 * n / (width - 1) for n in range(width)] if width > 1 else [0.0]
        w = [a * exp(-((v - b) ** 2) / (2.0 * c * c)) for v in x]
        total = sum(w)
        w = [v / total for v in w]
    else:
        raise ValueError(f"unknown kernel {name}")
    return high_passed(w) if high_pass else w


def high_passed(weights: list[float]) -> list[float]:
    out = [-v for v in weights]
    out[len(out) // 2] += 1.0
    return out


def time_axis_convolution(df: DataFrame, variables: list[str], weights: list[float], kind: str = "centered", postfix: str = "", cell: tuple[str, ...] = ("j", "i"), step: str = "step") -> DataFrame:
    """Weighted sums over a window of steps; steps without a whole window go."""
    low, high = _frame(kind, len(weights))
    w = W.partitionBy(*cell).orderBy(step)
    at = lambda v, n: F.lag(v, -n).over(w) if n < 0 else F.lead(v, n).over(w) if n else F.col(v)
    value = lambda v: sum((F.lit(q) * at(v, low + n) for n, q in enumerate(weights[1:], 1)), F.lit(weights[0]) * at(v, low))
    whole = F.count("*").over(w.rowsBetween(low, high)) == len(weights)
    out = df.withColumns({**{f"__c_{v}": value(v) for v in variables}, "__whole": whole}).where("__whole").drop("__whole")
    return out.withColumns({v + postfix: F.col(f"__c_{v}") for v in variables}).drop(*(f"__c_{v}" for v in variables))


def response(n: int, spacing: float, kind: str, critical: float, order: float | None) -> np.ndarray:
    """Butterworth response on n frequencies from -fs/2 to fs/2 (order None: ideal); critical is a frequency in Hz, spacing in seconds."""
    f = np.abs(np.linspace(-0.5 / spacing, 0.5 / spacing, n))
    if kind not in ("low_pass", "high_pass"):
        raise ValueError(f"unknown filter {kind}")
    if order is None:
        return ((f <= critical) if kind == "low_pass" else (f >= critical)).astype(float)
    with np.errstate(divide="ignore"):
        return 1.0 / np.sqrt(1.0 + (f / critical) ** ((2 if kind == "low_pass" else -2) * order))


def spectral_filter(df: DataFrame, variables: list[str], kind: str, critical_frequency: float, spacing_seconds: float, order: float | None = None, cell: tuple[str, ...] = ("j", "i"), step: str = "step") -> DataFrame:
    """Low- or high-pass filters along time: columns <variable>_<kind>.

    A group is the whole series of a cell. Missing values make the series' result NaN.
    """
    added = [f"{v}_{kind}" for v in variables]
    schema = df.withColumns({n: F.lit(0.0) for n in added}).schema

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by(step)
        h = response(t.num_rows, spacing_seconds, kind, critical_frequency, order)
        for v, n in zip(variables, added, strict=True):
            x = t.column(v).to_numpy(zero_copy_only=False).astype(float)
            spectrum = np.fft.fftshift(np.fft.fft(x)) * h
            t = t.append_column(n, pa.array(np.real(np.fft.ifft(np.fft.ifftshift(spectrum)))))
        return t

    return df.groupBy(*cell).applyInArrow(one, schema)
