"""Polygons of ESRI shapefiles, and legacy VTK files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.geometry import Polygon, point_in


def parse_shapefile(raw: bytes) -> list[Polygon]:
    """The rings of all polygons (shape types 5, 15 and 25)."""
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 8 <= len(raw):
        size = struct.unpack(">i", raw[at + 4 : at + 8])[0] * 2
        body = raw[at + 8 : at + 8 + size]
        at += 8 + size
        if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            continue
        n_parts, n_points = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        points = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a >= 3:
                out.append(Polygon(points[2 * a : 2 * b : 2], points[2 * a + 1 : 2 * b : 2]))
    return out


def read_shapefile(spark: SparkSession, path: str) -> list[Polygon]:
    """A shapefile is read whole by the driver: its polygons become constants of the plan."""
    return parse_shapefile(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def shape_file_mask(df: DataFrame, polygons: list[Polygon], result: str = "mask", normalize: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """1 in any polygon, else 0; normalize takes longitudes of the polygons to 0..360."""
    return df.withColumn(result, point_in(F.col(x), F.col(y), [p.normalised() if normalize else p for p in polygons]).cast("tinyint"))


def vtk_text(p: pd.DataFrame, variables: list[str], title: str = "mesh") -> str:
    """The rows of one step, sorted by cell, as a legacy VTK rectilinear grid in ASCII."""
    axes = [p.groupby(i)[c].first().tolist() for c, i in (("x", "i"), ("y", "j"), ("z", "k"))]
    lines = ["# vtk DataFile Version 2.0", title, "ASCII", "DATASET RECTILINEAR_GRID", "DIMENSIONS " + " ".join(str(len(a)) for a in axes)]
    for name, a in zip("XYZ", axes, strict=True):
        lines += [f"{name}_COORDINATES {len(a)} double", " ".join(map(repr, a))]
    lines.append(f"POINT_DATA {len(p)}")
    for v in variables:
        lines += [f"SCALARS {v} double 1", "LOOKUP_TABLE default", " ".join(map(repr, p[v].astype(float).tolist()))]
    return "\n".join(lines) + "\n"


def to_vtk(df: DataFrame, variables: list[str], step: int, title: str = "mesh") -> str:
    """One step of a mesh as text for a viewer on the driver; `mesh_files.write_files` writes all steps from executors."""
    p = df.where(F.col("step") == step).select("k", "j", "i", "z", "y", "x", *variables).toPandas().sort_values(["k", "j", "i"])
    return vtk_text(p, variables, title)
