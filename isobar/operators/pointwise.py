"""Operators on each cell of a mesh: projections without a shuffle, unless a statistic of the step is needed."""

from __future__ import annotations

from collections.abc import Callable
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.model import attributes


def mask(df: DataFrame, variables: list[str], low: float = float("-inf"), high: float = float("inf"), value: float | None = None) -> DataFrame:
    """Values within [low, high] become `value` (by default missing)."""
    return df.withColumns({v: F.when(F.col(v).between(low, high), F.lit(value).cast(df.schema[v].dataType)).otherwise(F.col(v)) for v in variables})


def apply_binary_mask(df: DataFrame, mask_variable: str, variables: list[str], prefix: str = "masked_") -> DataFrame:
    return df.withColumns({prefix + v: F.col(mask_variable) * F.col(v) for v in variables})


def l2_norm(df: DataFrame, components: list[str], result: str = "l2_norm") -> DataFrame:
    """Root of the sum of squares of one to three components."""
    if not 1 <= len(components) <= 3:
        raise ValueError("one to three components")
    total = sum((F.col(c) * F.col(c) for c in components[1:]), F.col(components[0]) * F.col(components[0]))
    return df.withColumn(result, F.sqrt(total))


def rename_variables(df: DataFrame, names: dict[str, str]) -> DataFrame:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    return df.withColumnsRenamed(names)


def unpack(df: DataFrame, packing: dict[str, tuple[float, float]] | None = None, to: str = "double", fill: float | None = None) -> DataFrame:
    """scale * value + offset, from the argument or the columns' attributes scale_factor and add_offset; missing values stay missing, or become `fill`."""
    if packing is None:
        packing = {}
        for c in df.columns:
            held = attributes(df, c)
            if "scale_factor" in held or "add_offset" in held:
                packing[c] = (float(held.get("scale_factor", 1.0)), float(held.get("add_offset", 0.0)))
    unpacked = {v: (F.col(v).cast(to) * F.lit(scale).cast(to) + F.lit(offset).cast(to)).cast(to) for v, (scale, offset) in packing.items()}
    return df.withColumns({v: F.coalesce(c, F.lit(fill).cast(to)) if fill is not None else c for v, c in unpacked.items()})


def valid(df: DataFrame, variable: str, fill: float | None = None, valid_range: tuple[float | None, float | None] | None = None) -> Column:
    """Whether a value is present: not null, not NaN, not the fill value (up to float tolerance), and within the valid range.

    Without arguments the attributes decide: _FillValue, then missing_value; a range only if it is given.
    """
    held = attributes(df, variable)
    if fill is None:
        fill = held.get("_FillValue", held.get("missing_value"))
    c = F.col(variable).cast("double")
    ok = c.isNotNull() & ~F.isnan(c)
    if fill is not None:
        tolerance = 1.1920929e-06 * abs(float(fill))
        ok = ok & (F.abs(c - float(fill)) > F.lit(max(tolerance, 1.1920929e-07)))
    if valid_range is not None:
        low, high = valid_range
        if low is not None:
            ok = ok & (c >= low)
        if high is not None:
            ok = ok & (c <= high)
    return F.coalesce(ok, F.lit(False))


def valid_value_mask(df: DataFrame, variables: list[str], fill: float | None = None, valid_range: tuple[float | None, float | None] | None = None) -> DataFrame:
    """A byte column <name>_valid for each variable."""
    return df.withColumns({f"{v}_valid": valid(df, v, fill, valid_range).cast("tinyint") for v in variables})


def missing_to_null(df: DataFrame, variables: list[str], fill: float | None = None, valid_range: tuple[float | None, float | None] | None = None) -> DataFrame:
    """At the scan: values that are not valid become NULL."""
    return df.withColumns({v: F.when(valid(df, v, fill, valid_range), F.col(v)) for v in variables})


def elevation_mask(mesh: DataFrame, surface: DataFrame, height: str, elevation: str, result: str = "elevation_valid", keys: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """1 where the mesh's height reaches the surface elevation of its column of cells; the 2-D side joins on its keys."""
    return mesh.join(surface.select(*keys, elevation), list(keys), "left").withColumn(result, F.coalesce((F.col(height) >= F.col(elevation)), F.lit(False)).cast("tinyint"))


def damping(y: Column, half_width: Column | float, center: Column | float = 0.0) -> Column:
    """1 - exp(-(y - center)^2 / (2 sigma^2)), sigma from the half width at half maximum."""
    w = half_width if isinstance(half_width, Column) else F.lit(float(half_width))
    sigma = w / F.lit(sqrt(2.0 * log(2.0)))
    d = y - center
    return F.lit(1.0) - F.exp(-(d * d) / (F.lit(2.0) * sigma * sigma))


def latitude_damper(df: DataFrame, variables: list[str], half_width: float, center: float = 0.0, postfix: str = "_damped", y: str = "y") -> DataFrame:
    return df.withColumns({v + postfix: F.col(v) * damping(F.col(y), half_width, center) for v in variables})


def binary_segmentation(df: DataFrame, variable: str, low: float | None = None, high: float | None = None, by_percentile: bool = False, result: str = "segments", step: str = "step") -> DataFrame:
    """1 where low <= value <= high, else 0 (also for missing values).

    By percentile, low and high are percentiles of the step's values, linear between order statistics. They
    come from an aggregate by step, joined back: one small row a step.
    """
    if not by_percentile:
        c = F.col(variable)
        inside = (c >= (F.lit(low) if low is not None else F.lit(float("-inf")))) & (c <= (F.lit(high) if high is not None else F.lit(float("inf"))))
        return df.withColumn(result, F.coalesce(inside, F.lit(False)).cast("tinyint"))
    cut = lambda q: F.percentile(variable, F.lit(q / 100.0))
    limits = df.groupBy(step).agg((cut(low) if low is not None else F.lit(float("-inf"))).alias("__low"), (cut(high) if high is not None else F.lit(float("inf"))).alias("__high"))
    c = F.col(variable)
    return df.join(limits, step).withColumn(result, F.coalesce((c >= F.col("__low")) & (c <= F.col("__high")), F.lit(False)).cast("tinyint")).drop("__low", "__high")


def derived_quantity(df: DataFrame, dependent: list[str], result: str | list[str], function: Callable[..., Column | list[Column]]) -> DataFrame:
    """New columns from a function of Columns (or a pandas UDF) of the dependent columns."""
    got = function(*(F.col(c) for c in dependent))
    names, values = ([result], [got]) if isinstance(result, str) else (result, got)
    return df.withColumns(dict(zip(names, values, strict=True)))


def average(a: Column, b: Column) -> Column:
    return (a + b) / 2


def difference(a: Column, b: Column) -> Column:
    return b - a


def temporal_index_select(df: DataFrame, indices: list[int], step: str = "step", renumber: bool = True) -> DataFrame:
    """The listed time steps, numbered anew in the order of the list."""
    out = df.where(F.col(step).isin(indices))
    if renumber:
        place = F.create_map(*(x for n, s in enumerate(indices) for x in (F.lit(s).cast("long"), F.lit(n).cast("long"))))
        out = out.withColumn(step, place[F.col(step).cast("long")])
    return out
