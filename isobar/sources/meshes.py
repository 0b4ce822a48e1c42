"""Generated meshes, in-memory datasets, federated meshes and partitioned mesh files."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import calendars
from isobar.model import AXES


def mesh_source(spark: SparkSession, nx: int, ny: int, nz: int = 1, nt: int = 1, bounds: tuple[float, ...] = (0.0, 360.0, -90.0, 90.0, 0.0, 0.0, 0.0, 0.0), fields: dict[str, Callable[[Column, Column, Column, Column], Column]] | None = None, partitions: int | None = None) -> DataFrame:
    """A mesh of given size and bounds (x, y, z, t), with fields as functions of the columns x, y, z and t.

    Everything comes from one range by division, so it is generated where it is used.
    """
    cells = nx * ny * nz
    bounds = (*bounds, *[0.0] * (8 - len(bounds)))
    at = lambda n, lo, hi, idx: F.lit(float(lo)) + idx * F.lit((hi - lo) / (n - 1) if n > 1 else 0.0)
    q = F.col("id") % cells
    df = spark.range(0, cells * nt, 1, partitions) if partitions else spark.range(0, cells * nt)
    df = df.select(F.expr(f"id div {cells}").alias("step"), (q / (nx * ny)).cast("long").alias("k"), ((q % (nx * ny)) / nx).cast("long").alias("j"), (q % nx).alias("i"))
    df = df.withColumns({"time": at(nt, *bounds[6:8], F.col("step")), "z": at(nz, *bounds[4:6], F.col("k")), "y": at(ny, *bounds[2:4], F.col("j")), "x": at(nx, *bounds[0:2], F.col("i"))})
    made = {n: f(F.col("x"), F.col("y"), F.col("z"), F.col("time")) for n, f in (fields or {}).items()}
    return df.select("step", "time", "k", "j", "i", "z", "y", "x", *(c.alias(n) for n, c in made.items()))


def dataset_source(spark: SparkSession, datasets: list, schema: str | None = None) -> DataFrame:
    """In-memory datasets (frames, Arrow tables or rows), one below the other; `dataset` numbers them."""
    out = None
    for n, data in enumerate(datasets):
        df = (spark.createDataFrame(data, schema) if schema else spark.createDataFrame(data)).withColumn("dataset", F.lit(n))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no datasets")
    return out


def read_mesh(spark: SparkSession, path: str, steps: tuple[int, int] | None = None, variables: list[str] | None = None) -> DataFrame:
    """A mesh from Parquet files; steps and variables reach the scan."""
    df = spark.read.parquet(path)
    if steps is not None:
        df = df.where(F.col(AXES.step).between(*steps))
    if variables is not None:
        index = [c for c in ("step", "time", "k", "j", "i", "z", "y", "x") if c in df.columns]
        df = df.select(*index, *variables)
    return df


@dataclass
class Member:
    """One reader of a federation."""

    key: str = ""
    regex: str = ""
    variables: list[str] = field(default_factory=list)
    provides_time: bool = False
    provides_geometry: bool = False
    options: dict[str, str] = field(default_factory=dict)


def parse_config(text: str) -> list[Member]:
    """A federation's configuration: `name = value` pairs and flags in [cf_reader] sections, and a global data_root."""
    root, members, section = "", [], None
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        if line.startswith("["):
            if line != "[cf_reader]":
                raise ValueError(f"unknown section {line}")
            section = Member(key=f"r_{len(members)}")
            members.append(section)
            continue
        name, _, value = (p.strip() for p in line.partition("="))
        if section is None:
            if name != "data_root":
                raise ValueError(f"unknown global setting {name}")
            root = value
        elif name == "regex":
            section.regex = value
        elif name == "name":
            section.key = value
        elif name == "variables":
            section.variables = [v for v in re.split(r"[\s,]+", value) if v]
        elif name in ("provides_time", "provides_geometry"):
            setattr(section, name, value.lower() not in ("0", "false", "off", "no"))
        else:
            section.options[name] = value
    for m in members:
        m.regex = m.regex.replace("%data_root%", root)
    if not any(m.provides_time for m in members) or not any(m.provides_geometry for m in members):
        raise ValueError("one section must provide the time, and one the geometry")
    return members


def federate(members: list[tuple[Member, DataFrame]], validate_time: bool = True, validate_coordinates: bool = True) -> DataFrame:
    """One mesh from several: variables from their members, time and coordinates from those that provide them.

    Members are dealt by the same keys, so the joins share their partitioning. Validation fails, when the
    plan runs, on a cell whose time or coordinates differ.
    """
    keys = [c for c in ("step", "k", "j", "i") if all(c in d.columns for _, d in members)]
    time_member = next(d for m, d in members if m.provides_time)
    geometry = next(d for m, d in members if m.provides_geometry)
    coordinates = [c for c in ("z", "y", "x") if c in geometry.columns]
    out = geometry.select(*keys, *coordinates)
    out = out.join(time_member.select(*keys, "time"), keys) if time_member is not geometry else geometry.select(*keys, "time", *coordinates)
    for n, (m, d) in enumerate(members):
        check = {c: f"__{c}_{n}" for c in (["time"] * validate_time + coordinates * validate_coordinates) if c in d.columns and d is not geometry}
        part = d.select(*keys, *m.variables, *(F.col(c).alias(a) for c, a in check.items()))
        out = out.join(part, keys)
        for c, a in check.items():
            out = out.withColumn(c, F.when(F.abs(F.col(c) - F.col(a)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col(c))), F.col(c)).otherwise(F.raise_error(F.lit(f"{m.key or n}: {c} differs")).cast("double")))
        out = out.drop(*check.values())
    return out


LAYOUTS = ("number_of_steps", "daily", "monthly", "seasonal", "yearly")


def layout_key(layout: str, steps_per_file: int = 128, first_step: int = 0, units: str = "days since 1970-01-01", calendar: str = "standard", step: str = "step", time: str = "time") -> Column:
    """The file of a step: a block of steps, or a date as text (%Y, %Y-%m, %Y-%m-%d, %Y-season)."""
    if layout == "number_of_steps":
        return F.lpad(F.floor((F.col(step) - first_step) / steps_per_file).cast("string"), 6, "0")
    if layout == "seasonal":
        p = calendars.decode(F.col(time), units, calendar)
        return F.concat(F.lpad(calendars.season_year(p["year"], p["month"]).cast("string"), 4, "0"), F.lit("-"), calendars.season(p["month"]))
    pattern = {"daily": "%Y-%m-%d", "monthly": "%Y-%m", "yearly": "%Y"}
    if layout not in pattern:
        raise ValueError(f"unknown layout {layout}")
    return calendars.time_to_string(F.col(time), units, calendar, pattern[layout])


def write_mesh(df: DataFrame, path: str, layout: str = "number_of_steps", variables: list[str] | None = None, first_step: int | None = None, last_step: int | None = None, steps_per_file: int = 128, units: str = "days since 1970-01-01", calendar: str = "standard", spatial: tuple[int, int] | None = None, compression: str = "zstd") -> None:
    """Partitioned Parquet: a folder for each file of the layout (and block of cells, if spatial gives the cells of a block in j and i).

    Rows are dealt by the layout's key and step and sorted within, so that min/max statistics prune by step and cell.
    """
    out = df
    if first_step is not None:
        out = out.where(F.col("step") >= first_step)
    if last_step is not None:
        out = out.where(F.col("step") <= last_step)
    if variables is not None:
        out = out.select(*[c for c in ("step", "time", "k", "j", "i", "z", "y", "x") if c in df.columns], *variables)
    keys = ["file"]
    out = out.withColumn("file", layout_key(layout, steps_per_file, first_step or 0, units, calendar))
    if spatial:
        out = out.withColumn("block", F.concat_ws("-", F.floor(F.col("j") / spatial[0]), F.floor(F.col("i") / spatial[1])))
        keys.append("block")
    order = [c for c in ("step", "k", "j", "i") if c in out.columns]
    out.repartition(*keys, "step").sortWithinPartitions(*keys, *order).write.mode("overwrite").option("compression", compression).partitionBy(*keys).parquet(path)


def time_axis(df: DataFrame, file: str | None = None) -> DataFrame:
    """The time axis of a mesh: (step, time), and the file each step lies in, if a column names it."""
    return df.groupBy("step").agg(F.min("time").alias("time"), *([F.min(file).alias("file")] if file else []))


def describe(df: DataFrame) -> DataFrame:
    """What a mesh holds: steps, times, extents and bounds, in one pass."""
    found = [c for c in ("step", "time", "k", "j", "i", "z", "y", "x") if c in df.columns]
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in found for n, f in (("min", F.min), ("max", F.max))), F.count_distinct("step").alias("n_steps"), F.count("*").alias("n_cells"))
