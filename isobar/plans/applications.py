"""Applications: pipelines of operators as functions of DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions.geometry import Polygon
from isobar.operators import components, cyclones, pointwise, stencil, temporal, vertical
from isobar.operators.potential_intensity import potential_intensity
from isobar.operators.table import dataset_diff, evaluate_expression, region_mask, remove_rows, sort, table_calendar


def event_filter(events: DataFrame, time_expression: str | None = None, step_column: str | None = None, step_interval: int | None = None, x: str | None = None, y: str | None = None, polygons: list[Polygon] | None = None) -> DataFrame:
    """Rows within a time range (an expression), of every step_interval-th step, and inside polygons."""
    out = events
    if time_expression:
        out = remove_rows(out, f"!({time_expression})")
    if step_column and step_interval:
        out = out.where(F.col(step_column) % step_interval == 0)
    if polygons:
        out = region_mask(out, x, y, polygons, "__in").where("__in = 1").drop("__in")
    return out


def convert_table(table: DataFrame, select: str | None = None) -> DataFrame:
    """A table, or its rows where an expression is true."""
    return evaluate_expression(table, select, "__select").where("__select <> 0").drop("__select") if select else table


def tc_detect(mesh: DataFrame, u_surface: str, v_surface: str, u_850: str, v_850: str, pressure: str, temperatures: tuple[str, str], heights: tuple[str, str], units: str, calendar: str, options: cyclones.CandidateOptions | None = None, **track: float) -> DataFrame:
    """Candidates and tracks of a mesh without levels: wind speed, vorticity, core temperature (mean of two levels), thickness (difference of two levels)."""
    m = stencil.normalize_coordinates(mesh, shift_x=True)
    m = pointwise.l2_norm(m, [u_surface, v_surface], "surface_wind")
    m = stencil.vorticity(m, u_850, v_850, "850mb_vorticity", periodic=True)
    m = pointwise.derived_quantity(m, list(temperatures), "core_temperature", pointwise.average)
    m = pointwise.derived_quantity(m, list(heights), "thickness", pointwise.difference)
    found = cyclones.tc_candidates(m, pressure=pressure, options=options)
    return tc_tracks(found, units, calendar, **track)


def tc_tracks(candidates: DataFrame, units: str, calendar: str, **track: float) -> DataFrame:
    """Candidates sorted, linked and dated."""
    return sort(table_calendar(cyclones.tc_trajectory(candidates, **track), units, calendar), "track_id", stable_by=["step"])


def tc_statistics(tracks: DataFrame, units: str, calendar: str) -> dict[str, DataFrame]:
    """Classified tracks with their summary, counts and activity."""
    c = table_calendar(cyclones.tc_classify(tracks), units, calendar, time="start_time")
    return {"classified": c, "summary": cyclones.tc_summary(c), "counts": cyclones.tc_counts(c), "activity": cyclones.tc_activity(c)}


def wind_radii_tracks(tracks: DataFrame, mesh: DataFrame, u: str, v: str, **options: float) -> DataFrame:
    """Track points with their wind radii."""
    keyed = tracks.withColumn("point", F.struct("track_id", "step"))
    return keyed.join(cyclones.wind_radii(keyed, mesh, u, v, key="point", **options), "point").drop("point")


def wind_radii_statistics(radii: DataFrame, columns: list[str], high: float = 6.0, bins: int = 30) -> DataFrame:
    """Histograms of radii: rows (column, bin, n)."""
    out = None
    for c in columns:
        h = cyclones.histogram(radii, c, 0.0, high, bins).select(F.lit(c).alias("column"), "bin", "n")
        out = h if out is None else out.unionByName(h)
    return out


def bayesian_ar(mesh: DataFrame, u: str, v: str, q: str, parameters: pd.DataFrame, low: float | None = None, threshold: float = 0.5) -> DataFrame:
    """Atmospheric river probability from winds and humidity on pressure levels, and its segmentation at a threshold."""
    m = stencil.normalize_coordinates(mesh, shift_x=True)
    ivt = vertical.integrated_vapor_transport(m, u, v, q, magnitude="ivt")
    if low is not None:
        ivt = pointwise.mask(ivt, ["ivt"], high=low)
    found = components.bayesian_ar_detect(ivt, parameters, "ivt")
    return pointwise.binary_segmentation(found, "ar_probability", low=threshold, result="ar_binary_tag")


def vapor_transport(mesh: DataFrame, u: str, v: str, q: str) -> DataFrame:
    return vertical.integrated_vapor_transport(stencil.normalize_coordinates(mesh), u, v, q, magnitude="ivt")


def water_vapor(mesh: DataFrame, q: str) -> DataFrame:
    return vertical.integrated_water_vapor(stencil.normalize_coordinates(mesh), q)


def moisture_flux(mesh: DataFrame, u: str, v: str, q: str, polygons: list[Polygon]) -> DataFrame:
    """Net moisture flux of a region."""
    ivt = vapor_transport(mesh, u, v, q)
    masked = region_mask(ivt, "x", "y", polygons, "region")
    return vertical.regional_moisture_flux(masked, "ivt_u", "ivt_v", "region")


def reduce_in_time(mesh: DataFrame, variables: list[str], operator: str, interval: str, units: str, calendar: str, packed: dict[str, tuple[float, float]] | None = None, fill: float | None = None, **kw: int) -> DataFrame:
    """Missing values, unpacking and a reduction (or percentile: operator "95th_percentile") over intervals."""
    m = pointwise.missing_to_null(mesh, variables, fill) if fill is not None else mesh
    m = pointwise.unpack(m, packed) if packed else m
    cell = tuple(c for c in ("k", "j", "i") if c in mesh.columns)
    if operator.endswith("percentile"):
        return temporal.temporal_percentile(m, variables, float(operator.split("th_")[0].split("_")[0]), interval, units, calendar, cell=cell, **kw)
    return temporal.temporal_reduction(m, variables, operator, interval, units, calendar, cell=cell, **kw)


def intensity(mesh: DataFrame, **names: str) -> DataFrame:
    return potential_intensity(mesh, **names)


def restripe(mesh: DataFrame, names: dict[str, str] | None = None, x: tuple[float, float] | None = None, y: tuple[float, float] | None = None, target: DataFrame | None = None, variables: list[str] | None = None) -> DataFrame:
    """A mesh renamed, cut and regridded, to be written in another layout."""
    out = pointwise.rename_variables(mesh, names) if names else mesh
    out = stencil.subset(out, x=x, y=y)
    return stencil.regrid(out, target, variables or []) if target is not None else out


def table_difference(left: DataFrame, right: DataFrame, keys: list[str], **kw: float) -> DataFrame:
    return dataset_diff(left, right, keys, **kw)


def profile(events: DataFrame, start: str = "start", end: str = "end", name: str = "event") -> DataFrame:
    """What a profile of timed events holds: count, total, mean and longest time of each."""
    took = F.col(end) - F.col(start)
    return events.groupBy(name).agg(F.count("*").alias("n"), F.sum(took).alias("total"), F.avg(took).alias("mean"), F.max(took).alias("longest"))
