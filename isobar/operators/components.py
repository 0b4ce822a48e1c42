"""Connected components of segmented meshes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.model import AXES, Axes, shared_folder
from isobar.operators import graph


def label(mask: np.ndarray, periodic_x: bool = False, periodic_y: bool = False) -> np.ndarray:
    """Labels 1, 2, ... of a 0/1 array (k, j, i), in the order of their first cells; 8 neighbours in a level, 26 in all.

    Each cell starts as its own root; roots are lowered along links and chains are shortened until nothing changes.
    """
    root = np.where(mask.ravel() != 0, np.arange(mask.size), mask.size).reshape(mask.shape)
    links = []
    on = mask != 0
    nk, nj, ni = mask.shape
    for dk in (0, 1):
        for dj in (-1, 0, 1):
            for di in (-1, 0, 1):
                if (dk, dj, di) <= (0, 0, 0):
                    continue
                a = np.flatnonzero(on)
                k, j, i = np.unravel_index(a, mask.shape)
                k2, j2, i2 = k + dk, j + dj, i + di
                if periodic_x:
                    i2 %= ni
                if periodic_y:
                    j2 %= nj
                fine = (k2 < nk) & (j2 >= 0) & (j2 < nj) & (i2 >= 0) & (i2 < ni)
                b = np.ravel_multi_index((k2[fine], j2[fine], i2[fine]), mask.shape)
                a = a[fine]
                hit = on.ravel()[b]
                links.append((a[hit], b[hit]))
    flat = np.append(root.ravel(), mask.size)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while len(a):
        ra, rb = flat[a], flat[b]
        open_ = ra != rb
        if not open_.any():
            break
        np.minimum.at(flat, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            to = flat[flat]
            if (to == flat).all():
                break
            flat = to
    roots = flat[:-1]
    names = np.unique(roots[roots < mask.size])
    out = np.zeros(mask.size, dtype=np.int32)
    found = roots < mask.size
    out[found] = np.searchsorted(names, roots[found]) + 1
    return out.reshape(mask.shape)


def connected_components(df: DataFrame, segmentation: str = "segments", result: str = "component", periodic_x: bool = False, axes: Axes = AXES, tile: tuple[int, int] | None = None) -> DataFrame:
    """Labels the components of each step 1, 2, ... in the order of their first cells; 0 is the background.

    A step is one group, as large as one mesh of one time step; with `tile`, a group is a tile of (rows, columns) of a step
    (all levels) and the labels are the same (see `tiled_components`).
    """
    if tile:
        return tiled_components(df, tile, segmentation, result, periodic_x, axes)
    has_k = axes.k in df.columns
    schema = df.drop(result).withColumn(result, F.lit(0)).schema

    def one(t: pa.Table) -> pa.Table:
        k = t.column(axes.k).to_numpy() if has_k else np.zeros(t.num_rows, dtype=np.int64)
        j, i = t.column(axes.j).to_numpy(), t.column(axes.i).to_numpy()
        at = (k - k.min(), j - j.min(), i - i.min())
        mask = np.zeros([x.max() + 1 for x in at], dtype=np.int8)
        mask[at] = np.nan_to_num(t.column(segmentation).to_numpy(zero_copy_only=False).astype(np.float64)) != 0
        names = label(mask, periodic_x)[at]
        return t.drop_columns([result] if result in t.column_names else []).append_column(result, pa.array(names, pa.int32()))

    return df.groupBy(axes.step).applyInArrow(one, schema)


#: One of each two opposite steps to a neighbour (k, j, i).
HALF = [(k, j, i) for k in (0, 1) for j in (-1, 0, 1) for i in (-1, 0, 1) if (k, j, i) > (0, 0, 0)]


def tiled_components(df: DataFrame, tile: tuple[int, int], segmentation: str = "segments", result: str = "component", periodic_x: bool = False, axes: Axes = AXES) -> DataFrame:
    """The labels of `connected_components`, with no group larger than a tile of one step.

    Tiles are labelled apart, and a piece is named by its smallest cell. Only cells on the rim of a tile are then
    compared with their neighbours across it (an equi-join by step and cell), which links pieces; components of these links, over
    all steps at once, name each piece by the smallest cell of its whole component. Components of a step are numbered in the order of
    these cells; that window holds a row for each component, not for each cell. The tiles' labels are a table in the shared
    folder, read by the rims and by the result. Null segmentation is background; an empty mesh gives no rows.
    """
    spark = df.sparkSession
    rows, cols = tile
    if rows < 1 or cols < 1:
        raise ValueError("a tile has at least one row and one column")
    has_k = axes.k in df.columns
    kept = df.drop(result)
    level = F.col(axes.k) if has_k else F.lit(0)
    ends = [f(c).cast("long").alias(n) for c, n in ((level, "__k"), (F.col(axes.j), "__j"), (F.col(axes.i), "__i")) for f, n in ((F.min, f"{n}0"), (F.max, f"{n}1"))]
    extents = df.groupBy(F.col(axes.step).alias("__step")).agg(*ends)
    extents = extents.select("__step", "__k0", "__j0", "__i0", (F.col("__k1") - F.col("__k0") + 1).alias("__nk"), (F.col("__j1") - F.col("__j0") + 1).alias("__nj"), (F.col("__i1") - F.col("__i0") + 1).alias("__ni"))
    placed = kept.join(F.broadcast(extents), F.col(axes.step) == F.col("__step"))  # a row for each step
    placed = placed.withColumns({"__k": level - F.col("__k0"), "__j": F.col(axes.j) - F.col("__j0"), "__i": F.col(axes.i) - F.col("__i0")})
    placed = placed.withColumn("__cell", ((F.col("__k") * F.col("__nj") + F.col("__j")) * F.col("__ni") + F.col("__i")).cast("long"))
    placed = placed.withColumns({"__tj": F.expr(f"__j div {rows}"), "__ti": F.expr(f"__i div {cols}")}).drop("__k0", "__j0", "__i0")

    def one(t: pa.Table) -> pa.Table:
        at = [t.column(c).to_numpy() for c in ("__k", "__j", "__i")]
        at = tuple(a - a.min() for a in at)
        mask = np.zeros([a.max() + 1 for a in at], dtype=np.int8)
        mask[at] = np.nan_to_num(t.column(segmentation).to_numpy(zero_copy_only=False).astype(np.float64)) != 0
        names = label(mask)[at]
        cell = t.column("__cell").to_numpy()
        least = np.full(names.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, names, cell)
        return t.append_column("__root", pa.array(least[names], pa.int64(), mask=names == 0))

    labelled = placed.groupBy("__step", "__tj", "__ti").applyInArrow(one, T.StructType([*placed.schema.fields, T.StructField("__root", T.LongType())]))
    path = f"{shared_folder(spark)}/tiles"
    labelled.write.parquet(path)
    pieces = spark.read.schema(labelled.schema).parquet(path)
    active = pieces.where("__root IS NOT NULL")

    # Nodes are longs: the step's own range of numbers, then the cell.
    first, last, most = extents.agg(F.min("__step"), F.max("__step"), F.max(F.col("__nk") * F.col("__nj") * F.col("__ni"))).first()
    if first is not None and (last - first + 1) * most > 1 << 62:
        raise ValueError("steps times cells pass 64 bits; number the steps anew")
    node = lambda c: (F.col("__step") - F.lit(first or 0)) * F.lit(most or 1) + F.col(c)

    rim = f"__j % {rows} IN (0, {rows - 1}) OR __i % {cols} IN (0, {cols - 1})" + (" OR __i = __ni - 1" if periodic_x else "")
    rims = active.where(rim).select("__step", "__k", "__j", "__i", "__nk", "__nj", "__ni", "__tj", "__ti", "__cell", "__root")
    steps = F.explode(F.array(*(F.struct(*(F.lit(n).alias(c) for c, n in zip("kji", d, strict=True))) for d in HALF)))
    beside = rims.withColumn("__d", steps).select("*", *((F.col(f"__{c}") + F.col(f"__d.{c}")).alias(f"__{c}2") for c in "kji"))
    wraps = F.col("__i2").between(0, F.col("__ni") - 1) if not periodic_x else F.lit(True)
    beside = beside.where((F.col("__k2") < F.col("__nk")) & F.col("__j2").between(0, F.col("__nj") - 1) & wraps)
    beside = beside.withColumn("__w", F.pmod("__i2", "__ni"))
    beside = beside.where(f"__w <> __i2 OR __w div {cols} <> __ti OR __j2 div {rows} <> __tj")
    beside = beside.select("__step", ((F.col("__k2") * F.col("__nj") + F.col("__j2")) * F.col("__ni") + F.col("__w")).alias("__cell"), F.col("__root").alias("__other")).distinct()
    links = rims.select("__step", "__cell", "__root").join(beside, ["__step", "__cell"]).where("__root <> __other").select(node("__root").alias("a"), node("__other").alias("b")).distinct()
    joined = graph.components(links).withColumnRenamed("node", "__node")

    roots = active.select("__step", "__root").distinct().withColumn("__node", node("__root")).join(joined, "__node", "left")
    numbers = roots.withColumn(result, F.dense_rank().over(W.partitionBy("__step").orderBy(F.coalesce("component", "__node")))).select("__step", "__root", F.col(result).cast("int"))
    names = [*kept.columns, result]
    background = pieces.where("__root IS NULL").withColumn(result, F.lit(0)).select(names)
    return active.join(numbers, ["__step", "__root"]).select(names).unionByName(background)


def probability(df: DataFrame, params: pd.DataFrame, variable: str, axes: Axes, hwhm: str, percentile: str, area: str, periodic_x: bool) -> DataFrame:
    """For each step and row of parameters: damp, cut by percentile, label, filter by area; the share of rows with a kept label at each cell."""
    radius = 6378.137

    def cells(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), len(x)))
        if len(y) > 2 and len(x) > 2:
            mid = np.sin(np.radians(0.5 * (y[1:] + y[:-1])))
            out[1:-1, 1:-1] = np.abs(radius**2 * 0.5 * np.radians(x[2:] - x[:-2])[None, :] * (mid[1:] - mid[:-1])[:, None])
        return out

    rows = [tuple(r) for r in params[[hwhm, percentile, area]].itertuples(index=False)]

    def one(t: pa.Table) -> pa.Table:
        j, i = t.column(axes.j).to_numpy(), t.column(axes.i).to_numpy()
        shape = (j.max() + 1, i.max() + 1)
        v = np.full(shape, np.nan)
        v[j, i] = t.column(variable).to_numpy(zero_copy_only=False)
        y, x = np.zeros(shape[0]), np.zeros(shape[1])
        y[j], x[i] = t.column(axes.y).to_numpy(), t.column(axes.x).to_numpy()
        size = cells(y, x)
        total, counts = np.zeros(shape), []
        for width, q, least in rows:
            sigma = width / np.sqrt(2 * np.log(2))
            damped = v * (1 - np.exp(-(y**2) / (2 * sigma * sigma)))[:, None]
            fine = damped[~np.isnan(damped)]
            mask = np.zeros(shape, dtype=np.int8)
            if len(fine):
                mask = (np.nan_to_num(damped, nan=-np.inf) >= np.percentile(fine, q)).astype(np.int8)
            names = label(mask[None], periodic_x)[0]
            areas = np.bincount(names.ravel(), weights=size.ravel())
            keep = np.flatnonzero(areas >= least)
            keep = keep[keep > 0]
            total += np.isin(names, keep)
            counts.append(len(keep))
        out = {axes.step: t.column(axes.step), axes.time: t.column(axes.time), axes.j: t.column(axes.j), axes.i: t.column(axes.i), axes.y: t.column(axes.y), axes.x: t.column(axes.x), variable: t.column(variable)}
        out["probability"] = pa.array((total / max(1, len(rows)))[j, i])
        out["counts"] = pa.array([counts] + [None] * (t.num_rows - 1), pa.list_(pa.int32()))
        return pa.table(out)

    keep = df.select(axes.step, axes.time, axes.j, axes.i, axes.y, axes.x, F.col(variable).cast("double").alias(variable))
    schema = T.StructType([*keep.schema.fields, T.StructField("probability", T.DoubleType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return keep.groupBy(axes.step).applyInArrow(one, schema)


def bayesian_ar_detect(df: DataFrame, parameters: pd.DataFrame, variable: str = "ivt", hwhm: str = "hwhm_latitude", percentile: str = "min_water_vapor", area: str = "min_component_area", periodic_x: bool = True, axes: Axes = AXES) -> DataFrame:
    """ar_probability of each cell: the mean over the rows of parameters of whether the cell lies in a detected component; ar_counts: the
    components found by each row of parameters, in one cell of each step (else null).

    parameters is a small table (a posterior sample, a thousand rows or so), shipped with the task; percentile
    columns hold the lower threshold, area columns square kilometres. All rows are worked on a step while it is in
    memory, so a step's field is dealt once, not once for each row.
    """
    return probability(df, parameters, variable, axes, hwhm, percentile, area, periodic_x).withColumnsRenamed({"probability": "ar_probability", "counts": "ar_counts"})
