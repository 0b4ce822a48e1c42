"""Comparisons with tolerance, positions on axes and consecutive groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOAT_EPS, DOUBLE_EPS = 1.1920928955078125e-07, 2.220446049250313e-16


def equal(a: Column, b: Column, relative: float = 10 * FLOAT_EPS, absolute: float = FLOAT_EPS) -> Column:
    """Equal up to an absolute or a relative tolerance."""
    diff = F.abs(a - b)
    return (diff <= absolute) | (diff <= relative * F.greatest(F.abs(a), F.abs(b)))


def less_or_equal(a: Column, b: Column, **kw: float) -> Column:
    return (a < b) | equal(a, b, **kw)


def greater_or_equal(a: Column, b: Column, **kw: float) -> Column:
    return (a > b) | equal(a, b, **kw)


def index_of(axis: list[float], value: float, lower: bool = True) -> int:
    """On a sorted axis (either direction), the index at or below a value, or at or above it."""
    down = len(axis) > 1 and axis[0] > axis[-1]
    a = [-v for v in axis] if down else axis
    v = -value if down else value
    i = bisect_right(a, v) - 1 if lower else bisect_left(a, v)
    if not a or not a[0] <= v <= a[-1]:
        raise ValueError(f"{value} is outside the axis")
    return i


def bounds_to_extent(axis: list[float], low: float, high: float, cover: bool = False) -> tuple[int, int]:
    """Indices of the points within [low, high]; with cover, also the neighbours that reach around it."""
    inside = [i for i, v in enumerate(axis) if low <= v <= high]
    if not inside and not cover:
        raise ValueError("no points within the bounds")
    down = len(axis) > 1 and axis[0] > axis[-1]
    first, last = (inside[0], inside[-1]) if inside else (None, None)
    if cover:
        a, b = (high, low) if down else (low, high)
        reach = lambda v, lo: index_of(axis, v, lo) if min(axis) <= v <= max(axis) else (0 if lo else len(axis) - 1)
        first, last = reach(a, True), reach(b, False)
    return first, last


def time_step_of(axis: DataFrame, date: str, units: str, calendar: str, lower: bool = True, clamp: bool = False, time_col: str = "time", step_col: str = "step") -> DataFrame:
    """One row (step) with the step at or after (lower: at or before) a date "YYYY-mm-dd[ HH:MM:SS]"."""
    from isobar.functions.calendars import encode

    day, _, clock = date.strip().partition(" ")
    y, m, d = (int(x) for x in day.split("-"))
    h, mi, s = ([int(x) for x in clock.split(":")] + [0, 0, 0])[:3] if clock else (0, 0, 0)
    at = encode(F.lit(y), F.lit(m), F.lit(d), units, calendar, h, mi, s)
    t = F.col(time_col)
    best = F.max_by(step_col, F.when(t <= at, t)) if lower else F.min_by(step_col, F.when(t >= at, t))
    if clamp:
        best = F.coalesce(best, F.min(step_col) if lower else F.max(step_col))
    return axis.agg(best.alias("step"))


def consecutive_groups(df: DataFrame, key: str, order: list[str], partition: list[str] | None = None, name: str = "group") -> DataFrame:
    """Numbers runs of equal consecutive keys. Without a partition the whole table is one ordered run of rows."""
    w = W.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)
    change = F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"), F.lit(1))
    return df.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).otherwise(change)).withColumn(name, F.sum("__new").over(w)).drop("__new")


def nearest_index(axis: list[float], value: float) -> int:
    """The nearest point; the lower neighbour on ties."""
    i = index_of(axis, value)
    if i + 1 < len(axis) and abs(axis[i + 1] - value) < abs(value - axis[i]):
        return i + 1
    return i


def block_of(step: Column, size: int) -> Column:
    """The temporal block of a step."""
    return F.floor(step / size).cast("long")
