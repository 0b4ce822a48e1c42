"""Vertical reductions and surface integrals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.model import AXES, Axes, by_step

GRAVITY = 9.80665
#: Square of the Earth's radius (m2) in surface integrals (fixed value).
R2 = 4.068015961e13
#: Radius (m) in the moisture flux (fixed value).
FLUX_RADIUS = 6.3781e6


def vertical_reduction(df: DataFrame, aggregates: dict[str, Column], axes: Axes = AXES) -> DataFrame:
    """One row for each column of cells: aggregates over its levels."""
    keys = [c for c in (axes.step, axes.time, axes.j, axes.i, axes.y, axes.x) if c in df.columns]
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def pressure_integral(df: DataFrame, integrands: dict[str, Column], axes: Axes = AXES, trapezoid: bool = True, surface: float = 101325.0, top: float = 0.0) -> DataFrame:
    """(1/g) times the integral over pressure (the z axis, in Pa) of each integrand, by columns of cells.

    Trapezoid: a pair of levels adds half its pressure difference times the sum of its values, and nothing if
    either is missing. First order: a level's value counts for the layer between the midpoints around it, bounded by the surface and
    top pressures. The result is the same for either direction of the axis. One shuffle, by column of cells.
    """
    keys = [c for c in (axes.step, axes.time, axes.j, axes.i, axes.y, axes.x) if c in df.columns]
    own = [axes.step, axes.j, axes.i]
    w = W.partitionBy(*own).orderBy(axes.z)
    out = df.select(*keys, axes.z, *(c.cast("double").alias(f"__f_{n}") for n, c in integrands.items()))
    if trapezoid:
        out = out.withColumn("__dp", F.lead(axes.z).over(w) - F.col(axes.z))
        out = out.withColumns({f"__t_{n}": F.coalesce(0.5 * F.col("__dp") * (F.col(f"__f_{n}") + F.lead(f"__f_{n}").over(w)), F.lit(0.0)) for n in integrands})
    else:
        low = F.coalesce((F.lag(axes.z).over(w) + F.col(axes.z)) / 2, F.lit(top))
        high = F.coalesce((F.lead(axes.z).over(w) + F.col(axes.z)) / 2, F.lit(surface))
        out = out.withColumn("__dp", high - low)
        out = out.withColumns({f"__t_{n}": F.coalesce(F.col("__dp") * F.col(f"__f_{n}"), F.lit(0.0)) for n in integrands})
    rest = [F.first(c).alias(c) for c in keys if c not in own]
    return out.groupBy(*own).agg(*rest, *((F.sum(f"__t_{n}") / GRAVITY).alias(n) for n in integrands)).select(*keys, *integrands)


def integrated_vapor_transport(df: DataFrame, u: str, v: str, q: str, axes: Axes = AXES, trapezoid: bool = True, surface_pressure: float = 101325.0, top_pressure: float = 0.0, magnitude: str | None = None) -> DataFrame:
    """ivt_u and ivt_v (and the magnitude): the integrals of q u and q v over pressure."""
    out = pressure_integral(df, {"ivt_u": F.col(q) * F.col(u), "ivt_v": F.col(q) * F.col(v)}, axes, trapezoid, surface_pressure, top_pressure)
    return out.withColumn(magnitude, F.sqrt(F.col("ivt_u") ** 2 + F.col("ivt_v") ** 2)) if magnitude else out


def integrated_water_vapor(df: DataFrame, q: str, axes: Axes = AXES, result: str = "iwv") -> DataFrame:
    return pressure_integral(df, {result: F.col(q)}, axes)


def lapse_rate(df: DataFrame, t: str, z: str, surface: str, z_max: float = 9000.0, geopotential: bool = False, result: str = "lapse_rate", axes: Axes = AXES) -> DataFrame:
    """Mean of dT/dz over adjacent levels that both lie in [surface height, z_max), by columns of cells."""
    keys = [c for c in (axes.step, axes.time, axes.j, axes.i, axes.y, axes.x) if c in df.columns]
    own = [axes.step, axes.j, axes.i]
    height = F.col(z) / GRAVITY if geopotential else F.col(z)
    ground = F.col(surface) / GRAVITY if geopotential else F.col(surface)
    w = W.partitionBy(*own).orderBy(axes.k)
    inside = (F.col("__h") >= F.col("__s")) & (F.col("__h") < z_max)
    out = df.select(*keys, axes.k, F.col(t).cast("double").alias("__t0"), height.cast("double").alias("__h"), ground.cast("double").alias("__s"))
    out = out.withColumns({"__t": F.when(inside, F.col("__t0")), "__z": F.when(inside, F.col("__h"))})
    out = out.withColumns({"__dt": F.lead("__t").over(w) - F.col("__t"), "__dz": F.lead("__z").over(w) - F.col("__z")})
    rest = [F.first(c).alias(c) for c in keys if c not in own]
    return out.groupBy(*own).agg(*rest, F.avg(F.try_divide(F.col("__dt"), F.col("__dz"))).alias(result)).select(*keys, result)


def _forward(df: DataFrame, variables: list[tuple[str, str]], axes: Axes) -> DataFrame:
    """Forward differences of the angles, the next values of variables, and whether a cell is off the mesh's border."""
    row = W.partitionBy(axes.step, axes.j).orderBy(axes.i)
    col = W.partitionBy(axes.step, axes.i).orderBy(axes.j)
    out = by_step(df, axes.step).withColumns({"__theta": F.radians(axes.x), "__phi": F.radians(F.lit(90.0) - F.col(axes.y))})
    out = out.withColumns({
        "__dtheta": F.lead("__theta").over(row) - F.col("__theta"), "__dphi": F.lead("__phi").over(col) - F.col("__phi"),
        "__inner": F.lag("__theta").over(row).isNotNull() & F.lead("__theta").over(row).isNotNull() & F.lag("__phi").over(col).isNotNull() & F.lead("__phi").over(col).isNotNull(),
    })
    return out.withColumns({f"__next_{v}": F.lead(v).over(row if along == "x" else col) for v, along in variables})


def _masked(value: Column, region_mask: str | None) -> Column:
    inside = F.col("__inner") & (F.col(region_mask) != 0) if region_mask else F.col("__inner")
    return F.sum(F.when(inside, value).otherwise(F.lit(0.0)))


def surface_integral(df: DataFrame, variables: list[str], region_mask: str | None = None, prefix: str = "net_regional_", axes: Axes = AXES) -> DataFrame:
    """-R^2 times the sum over inner cells of the region of F * sin(phi) * dtheta * dphi, phi the colatitude, by forward differences.

    A table (time_step, time, variables with a prefix).
    """
    out = _forward(df, [], axes)
    area = F.sin("__phi") * F.col("__dtheta") * F.col("__dphi")
    total = [(F.lit(-R2) * _masked(F.col(v) * area, region_mask)).alias(prefix + v) for v in variables]
    return out.groupBy(F.col(axes.step).alias("time_step"), axes.time).agg(*total)


def regional_moisture_flux(df: DataFrame, ivt_u: str, ivt_v: str, region_mask: str | None = None, result: str = "moisture_flux", axes: Axes = AXES) -> DataFrame:
    """-R times the sum over inner cells of the region of div(IVT) * dtheta * dphi, by forward differences.

    The divergence is d(u)/dtheta + d(v sin(phi))/dphi, phi the colatitude. A table (time_step, time, flux).
    """
    prepared = df.withColumn("__vs", F.col(ivt_v) * F.sin(F.radians(F.lit(90.0) - F.col(axes.y))))
    out = _forward(prepared, [(ivt_u, "x"), ("__vs", "y")], axes)
    div = (F.col(f"__next_{ivt_u}") - F.col(ivt_u)) / F.col("__dtheta") + (F.col("__next___vs") - F.col("__vs")) / F.col("__dphi")
    flux = F.lit(-FLUX_RADIUS) * _masked(div * F.col("__dtheta") * F.col("__dphi"), region_mask)
    return out.groupBy(F.col(axes.step).alias("time_step"), axes.time).agg(flux.alias(result))


def reduce_columns(df: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's vertical reduction, from a mesh to a mesh without levels."""
    return df.transform(function)
