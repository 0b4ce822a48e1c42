"""Finite differences, centerings and axes of meshes.

Rows are dealt by step once; the windows along i and j both have the step in their partition, so Spark
sorts them without another shuffle. A step is the unit of work, as time steps are what grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.functions.coordinates import bounds_to_extent
from isobar.functions.geometry import EQUATOR_KM, MEAN_M
from isobar.model import AXES, Axes, by_step


class Neighbours:
    """Values of neighbouring cells on a dense mesh."""

    def __init__(self, axes: Axes, periodic: bool = False):
        self.a, self.periodic = axes, periodic
        self.row = W.partitionBy(axes.step, axes.k, axes.j).orderBy(axes.i)
        self.col = W.partitionBy(axes.step, axes.k, axes.i).orderBy(axes.j)
        self.stack = W.partitionBy(axes.step, axes.j, axes.i).orderBy(axes.k)

    def west(self, c: str | Column) -> Column:
        return F.coalesce(F.lag(c).over(self.row), F.last(c).over(self.row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))) if self.periodic else F.lag(c).over(self.row)

    def east(self, c: str | Column) -> Column:
        return F.coalesce(F.lead(c).over(self.row), F.first(c).over(self.row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))) if self.periodic else F.lead(c).over(self.row)

    def south(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.col)

    def north(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.col)

    def above(self, c: str | Column) -> Column:
        return F.lead(c).over(self.stack)


def _flat(df: DataFrame, axes: Axes) -> tuple[DataFrame, bool]:
    """Meshes without levels get a level 0 for the time of an operator."""
    return (df, False) if axes.k in df.columns else (df.withColumn(axes.k, F.lit(0)), True)


def vorticity(df: DataFrame, u: str, v: str, result: str = "vorticity", periodic: bool = False, axes: Axes = AXES) -> DataFrame:
    """Curl on the sphere by central differences; the spacing is that of the axes' first intervals.

    Rows at the ends of the y axis take the value of the row next to them. Without a periodic x axis, cells at its
    ends take the value of the cell next to them.
    """
    df, added = _flat(df, axes)
    n = Neighbours(axes, periodic)
    ends = W.partitionBy(axes.step, axes.k)
    x1 = F.min(F.when(F.col(axes.i) == F.col("__i0") + 1, F.col(axes.x))).over(ends)
    y0, y1 = F.min(F.when(F.col(axes.j) == F.col("__j0"), F.col(axes.y))).over(ends), F.min(F.when(F.col(axes.j) == F.col("__j0") + 1, F.col(axes.y))).over(ends)
    out = by_step(df, axes.step).withColumns({"__i0": F.min(axes.i).over(ends), "__j0": F.min(axes.j).over(ends), "__j1": F.max(axes.j).over(ends), "__i1": F.max(axes.i).over(ends)})
    x0 = F.min(F.when(F.col(axes.i) == F.col("__i0"), F.col(axes.x))).over(ends)
    out = out.withColumns({"__dx": F.radians(x1 - x0) * MEAN_M, "__dy": F.radians(y1 - y0) * MEAN_M})
    out = out.withColumns({"__w": n.west(v), "__e": n.east(v), "__s": n.south(u), "__n": n.north(u)})
    curl = (F.col("__e") - F.col("__w")) / (2 * F.col("__dx") * F.cos(F.radians(F.col(axes.y)))) - (F.col("__n") - F.col("__s")) / (2 * F.col("__dy"))
    out = out.withColumn(result, curl)
    if not periodic:
        out = out.withColumns({"__w": F.lag(result).over(n.row), "__e": F.lead(result).over(n.row)})
        out = out.withColumn(result, F.when(F.col(axes.i) == F.col("__i0"), F.col("__e")).when(F.col(axes.i) == F.col("__i1"), F.col("__w")).otherwise(F.col(result)))
    out = out.withColumns({"__s": n.south(result), "__n": n.north(result)})
    out = out.withColumn(result, F.when(F.col(axes.j) == F.col("__j0"), F.col("__n")).when(F.col(axes.j) == F.col("__j1"), F.col("__s")).otherwise(F.col(result)))
    return out.drop("__i0", "__i1", "__j0", "__j1", "__dx", "__dy", "__w", "__e", "__s", "__n", *([axes.k] if added else []))


def laplacian(df: DataFrame, variable: str, result: str = "laplacian", periodic: bool = False, axes: Axes = AXES) -> DataFrame:
    """Spherical Laplacian by second-order central differences; cells at an end of an axis (of y, and of x if it is not periodic) have none."""
    df, added = _flat(df, axes)
    n = Neighbours(axes, periodic)
    ends = W.partitionBy(axes.step, axes.k)
    out = by_step(df, axes.step).withColumns({"__i0": F.min(axes.i).over(ends), "__j0": F.min(axes.j).over(ends)})
    first = lambda c, idx, name, d: F.min(F.when(F.col(idx) == F.col(name) + d, F.col(c))).over(ends)
    out = out.withColumns({
        "__dl": F.radians(first(axes.x, axes.i, "__i0", 1) - first(axes.x, axes.i, "__i0", 0)) * MEAN_M * F.cos(F.radians(F.col(axes.y))),
        "__dp": F.radians(first(axes.y, axes.j, "__j0", 1) - first(axes.y, axes.j, "__j0", 0)) * MEAN_M,
        "__w": n.west(variable), "__e": n.east(variable), "__s": n.south(variable), "__n": n.north(variable),
    })
    f, dl, dp = F.col(variable), F.col("__dl"), F.col("__dp")
    value = (F.col("__s") - 2 * f + F.col("__n")) / (dp * dp) - F.tan(F.radians(F.col(axes.y))) * (F.col("__n") - F.col("__s")) / (2 * dp * MEAN_M) + (F.col("__w") - 2 * f + F.col("__e")) / (dl * dl)
    return out.withColumn(result, value).drop("__i0", "__j0", "__dl", "__dp", "__w", "__e", "__s", "__n", *([axes.k] if added else []))


def cell_area(df: DataFrame, result: str = "cell_area", axes: Axes = AXES) -> DataFrame:
    """Area (km2) of each cell between the midpoints to its neighbours; cells on the border of the mesh have 0."""
    df, added = _flat(df, axes)
    n = Neighbours(axes)
    w, e, s, nn = n.west(axes.x), n.east(axes.x), n.south(axes.y), n.north(axes.y)
    y = F.col(axes.y)
    area = F.lit(EQUATOR_KM * EQUATOR_KM) * 0.5 * F.radians(e - w) * (F.sin(0.5 * F.radians(y + nn)) - F.sin(0.5 * F.radians(s + y)))
    return by_step(df, axes.step).withColumn(result, F.coalesce(F.abs(area), F.lit(0.0))).drop(*([axes.k] if added else []))


def component_area(df: DataFrame, component: str = "component", axes: Axes = AXES) -> DataFrame:
    """Area of each label of each step (the background 0 too): rows (step, time, label, area)."""
    sized = cell_area(df, "__area", axes)
    return sized.groupBy(axes.step, axes.time, F.col(component).alias("label")).agg(F.sum("__area").alias("area"))


def component_area_filter(df: DataFrame, areas: DataFrame, low: float = float("-inf"), high: float = float("inf"), component: str = "component", mask_value: int = 0, postfix: str = "", axes: Axes = AXES) -> DataFrame:
    """Labels whose area is not within [low, high] become mask_value (by default the background)."""
    kept = areas.where(F.col("area").between(low, high)).select(axes.step, F.col("label").alias(component), F.lit(True).alias("__kept"))
    joined = df.join(kept, [axes.step, component], "left")
    value = F.when(F.col("__kept"), F.col(component)).otherwise(F.lit(mask_value).cast(df.schema[component].dataType))
    return joined.withColumn(component + postfix, value).drop("__kept")


def face_to_cell(df: DataFrame, variables: list[str], direction: str, axes: Axes = AXES) -> DataFrame:
    """Means of the faces on both sides of a cell in direction x, y or z; the last face of each line goes."""
    df, added = _flat(df, axes)
    n = Neighbours(axes)
    nxt = {"x": n.east, "y": n.north, "z": n.above}[direction]
    idx = {"x": axes.i, "y": axes.j, "z": axes.k}[direction]
    out = by_step(df, axes.step).withColumns({**{f"__n_{v}": nxt(v) for v in variables}, "__last": nxt(idx).isNull()})
    out = out.where("not __last").withColumns({v: 0.5 * (F.col(v) + F.col(f"__n_{v}")) for v in variables})
    return out.drop("__last", *(f"__n_{v}" for v in variables), *([axes.k] if added else []))


def vertical_coordinate_transform(df: DataFrame, surface_pressure: str, top_pressure: float | str, eta: str = "z", result: str = "pressure") -> DataFrame:
    """Terrain-following eta to pressure: eta * (ps - pt) + pt."""
    pt = F.col(top_pressure) if isinstance(top_pressure, str) else F.lit(float(top_pressure))
    return df.withColumn(result, F.col(eta) * (F.col(surface_pressure) - pt) + pt)


def normalize_coordinates(df: DataFrame, shift_x: bool = False, ascending_y: bool = True, convert_pressure: bool = False, axes: Axes = AXES) -> DataFrame:
    """x in [0, 360) in rising order (if shift_x), y in rising order, z from hPa to Pa (if convert_pressure).

    New indices come from the distinct axis values, a table of the size of one axis.
    """
    out = df
    if shift_x:
        out = out.withColumn(axes.x, F.pmod(F.col(axes.x), F.lit(360.0)))
        out = _reindex(out, axes.x, axes.i)
    if ascending_y:
        out = _reindex(out, axes.y, axes.j)
    if convert_pressure:
        out = out.withColumn(axes.z, F.col(axes.z) * 100.0)
    return out


def _reindex(df: DataFrame, coordinate: str, index: str) -> DataFrame:
    axis = df.select(coordinate).distinct().withColumn("__new", F.row_number().over(W.orderBy(coordinate)) - 1)  # one axis
    return df.drop(index).join(F.broadcast(axis), coordinate).withColumnRenamed("__new", index)


def subset(df: DataFrame, x: tuple[float, float] | None = None, y: tuple[float, float] | None = None, z: tuple[float, float] | None = None, cover: bool = False, axes_values: dict[str, list[float]] | None = None, axes: Axes = AXES) -> DataFrame:
    """Cells within bounds; with cover, and the axes' values, also the cells around them, so that the bounds lie inside.

    Conditions on coordinates reach the Parquet scan.
    """
    out = df
    for name, index, bounds in ((axes.x, axes.i, x), (axes.y, axes.j, y), (axes.z, axes.k, z)):
        if bounds is None:
            continue
        if cover:
            first, last = bounds_to_extent((axes_values or {})[name], *bounds, cover=True)
            out = out.where(F.col(index).between(first, last))
        else:
            out = out.where(F.col(name).between(*bounds))
    return out


def coordinate_transform(df: DataFrame, bounds: dict[str, tuple[tuple[float, float], tuple[float, float]]], names: dict[str, str] | None = None) -> DataFrame:
    """Affine rescaling of axes: {axis: ((low, high), (new low, new high))}; then new names."""
    out = df
    for axis, ((a, b), (c, d)) in bounds.items():
        out = out.withColumn(axis, F.lit(c) + (F.col(axis) - a) * ((d - c) / (b - a) if b != a else 0.0))
    return out.withColumnsRenamed(names or {})


def regrid(df: DataFrame, target: DataFrame, variables: list[str], mode: str = "linear", axes: Axes = AXES, missing: str = "null") -> DataFrame:
    """Source variables on a target mesh (columns j, i, y, x), nearest or linear along each axis; targets outside the source are dropped.

    A target that also has k and z is interpolated along z as well; else each level is regridded on its own.
    Weights are made per axis: each target value is bracketed on the source axis by a join of two tables of the
    size of an axis. The values then come by equal keys (j, i, k), and one aggregate sums them.

    A target that needs a missing value (NULL, or a cell without a row) is missing; with missing="renormalise" the values that
    are there are weighed among themselves, and only a target without any is missing.
    """
    parts, indices, coordinates = [], [axes.j, axes.i], [axes.y, axes.x]
    if axes.k in target.columns and axes.z in target.columns:
        indices.append(axes.k)
        coordinates.append(axes.z)
    for index, coordinate in zip(indices, coordinates, strict=True):
        src = df.select(F.col(index).alias("s"), F.col(coordinate).alias("c")).distinct()
        src = src.withColumns({"s2": F.lead("s").over(W.orderBy("c")), "c2": F.lead("c").over(W.orderBy("c")), "last": F.lead("s").over(W.orderBy("c")).isNull()})  # one axis
        tgt = target.select(F.col(index).alias("t"), F.col(coordinate).alias("v")).distinct()
        hit = tgt.join(F.broadcast(src), (F.col("v") >= F.col("c")) & ((F.col("v") < F.col("c2")) | F.col("last") & (F.col("v") == F.col("c"))))
        f = F.when(F.col("last"), 0.0).otherwise((F.col("v") - F.col("c")) / (F.col("c2") - F.col("c")))
        if mode == "nearest":
            pairs = hit.select("t", F.when(f <= 0.5, F.col("s")).otherwise(F.col("s2")).alias("s"), F.lit(1.0).alias("w"))
        else:
            both = F.array(F.struct(F.col("s").alias("s"), (1.0 - f).alias("w")), F.struct(F.coalesce("s2", "s").alias("s"), f.alias("w")))
            pairs = hit.select("t", F.explode(both).alias("p")).select("t", "p.s", "p.w").where("w > 0")
        parts.append(pairs.select(F.col("t").alias(f"__t_{index}"), F.col("s").alias(index), F.col("w").alias(f"__w_{index}")))
    keys = [c for c in (axes.step, axes.time, axes.k, axes.z) if c in df.columns and c not in [*indices, *coordinates]]
    placed, weight = df.select(*keys, *indices, *variables), F.lit(1.0)
    for index, part in zip(indices, parts, strict=True):
        placed, weight = placed.join(F.broadcast(part), index), weight * F.col(f"__w_{index}")
    out = placed.groupBy(*keys, *(F.col(f"__t_{index}").alias(index) for index in indices)).agg(*(_weighed(v, weight, missing, F.lit(1.0)) for v in variables))
    return out.join(target.select(*indices, *coordinates).distinct(), indices)


def _weighed(v: str, weight: Column, missing: str, whole: Column) -> Column:
    """The sum of weight * v; if weights of missing values lack from the whole, NULL, or what is there carries the whole."""
    if missing not in ("null", "renormalise"):
        raise ValueError(f"missing: {missing}")
    total, there = F.sum(weight * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.abs(weight)))
    full = there >= whole * (1 - 1e-9)
    return F.when(full, total).otherwise(total * whole / there if missing == "renormalise" else F.lit(None)).alias(v)


def sparse_remap(
    df: DataFrame, weights: DataFrame, variables: list[str], cell: str = "cell", row: str = "row", col: str = "col", weight: str = "s", mask: DataFrame | None = None, missing: str = "null"
) -> DataFrame:
    """target[row] = sum of weight * source[col] for each step; rows masked out (mask: row, valid) are missing.

    A row that needs a NULL (by a weight other than 0) is missing; with missing="renormalise" the other weights of the row carry its whole weight.
    """
    joined = df.join(weights.where(F.col(weight) != 0).select(F.col(col).alias(cell), row, weight), cell)
    out = joined.groupBy("step", row).agg(*(_weighed(v, F.col(weight), missing, F.sum(F.abs(weight))) for v in variables))
    if mask is not None:
        out = out.join(mask.select(row, "valid"), row, "left").withColumns({v: F.when(F.col("valid") != 0, F.col(v)) for v in variables}).drop("valid")
    return out
