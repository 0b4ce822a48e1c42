"""The driver's queries: one or more for each operator, over the supplied tables, and the same in DuckDB's SQL.

A mesh is made of `lineitem`: step = month of shipping, j = supplier modulo 18, i = part modulo 36, with
means of the measures; the grid is made dense, and axes run from -85 and 0 by 10 degrees. A track is the
events of a user. Floats are rounded to six digits, and 0.0 is added so that no zero has a sign.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import calendars, coordinates, geometry
from isobar.functions.geometry import Polygon
from isobar.operators import components, cyclones, pointwise, programmable, stencil, table, temporal, vertical
from isobar.operators.potential_intensity import potential_intensity
from isobar.plans import applications
from isobar.model import shared_folder
from isobar.sources import catalogue, mesh_files, meshes, netcdf3, shapes, tables
from isobar.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STEPS, NJ, NI = 84, 18, 36


#: Added before rounding in both engines: means of prices lie on a lattice whose points may be ties.
OFF_TIES = 1.7e-7


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = re.sub(r", (\d)\) \+ 0\.0", rf" + {OFF_TIES}, \1) + 0.0", sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: str | Column, n: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(OFF_TIES), n) + F.lit(0.0)


def rounded(df: DataFrame, names: list[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, n) for c in names})


# The mesh ------------------------------------------------------------------------

MESH = f"""
raw AS (SELECT (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS step, l_suppkey % {NJ} AS j, l_partkey % {NI} AS i,
  round(avg(l_extendedprice) + 1.7e-9, 6) AS v, round(avg(l_quantity) + 1.7e-9, 6) AS u, round(avg(l_tax) + 1.7e-9, 6) AS w FROM lineitem GROUP BY 1, 2, 3),
mesh AS (SELECT s.range AS step, CAST(s.range * 30 AS DOUBLE) AS time, a.range AS j, b.range AS i, CAST(-85 + 10 * a.range AS DOUBLE) AS y, CAST(10 * b.range AS DOUBLE) AS x,
  coalesce(v, 0.0) AS v, coalesce(u, 0.0) AS u, coalesce(w, 0.0) AS w, v AS v0
  FROM range({STEPS}) s, range({NJ}) a, range({NI}) b LEFT JOIN raw ON raw.step = s.range AND raw.j = a.range AND raw.i = b.range)"""


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "lineitem").groupBy(
        ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long").alias("step"), (F.col("l_suppkey") % NJ).cast("long").alias("j"), (F.col("l_partkey") % NI).cast("long").alias("i")
    ).agg(*(F.round(F.avg(c) + F.lit(1.7e-9), 6).alias(n) for c, n in (("l_extendedprice", "v0"), ("l_quantity", "u0"), ("l_tax", "w0"))))
    grid = meshes.mesh_source(spark, NI, NJ, 1, STEPS, (0.0, 350.0, -85.0, 85.0, 0.0, 0.0, 0.0, (STEPS - 1) * 30.0)).drop("k", "z")
    grid = grid.withColumns({"y": F.round("y", 9), "x": F.round("x", 9), "time": F.round("time", 9)})
    fill = {n: F.coalesce(n + "0", F.lit(0.0)) for n in "vuw"}
    return grid.join(raw, ["step", "j", "i"], "left").withColumns(fill).select("step", "time", "j", "i", "y", "x", "v", "u", "w", "v0")


LEVELS = f"""
raw AS (SELECT year(l_shipdate) - 1992 AS step, l_linenumber - 1 AS k, l_suppkey % {NJ} AS j, l_partkey % {NI} AS i,
  round(avg(l_quantity) + 1.7e-9, 6) AS q, round(avg(l_extendedprice) / 1000 + 1.7e-9, 6) AS u, round(avg(l_tax) * 100 + 1.7e-9, 6) AS w FROM lineitem GROUP BY 1, 2, 3, 4),
levels AS (SELECT s.range AS step, CAST(s.range AS DOUBLE) AS time, c.range AS k, a.range AS j, b.range AS i, CAST(100000 - 12000 * c.range AS DOUBLE) AS z, CAST(-85 + 10 * a.range AS DOUBLE) AS y, CAST(10 * b.range AS DOUBLE) AS x, q, u, w
  FROM range(7) s, range(7) c, range({NJ}) a, range({NI}) b LEFT JOIN raw ON raw.step = s.range AND raw.k = c.range AND raw.j = a.range AND raw.i = b.range)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "lineitem").groupBy(
        (F.year("l_shipdate") - 1992).cast("long").alias("step"), (F.col("l_linenumber") - 1).cast("long").alias("k"), (F.col("l_suppkey") % NJ).cast("long").alias("j"), (F.col("l_partkey") % NI).cast("long").alias("i")
    ).agg(F.round(F.avg("l_quantity") + F.lit(1.7e-9), 6).alias("q"), F.round(F.avg("l_extendedprice") / 1000 + F.lit(1.7e-9), 6).alias("u"), F.round(F.avg("l_tax") * 100 + F.lit(1.7e-9), 6).alias("w"))
    grid = meshes.mesh_source(spark, NI, NJ, 7, 7, (0.0, 350.0, -85.0, 85.0, 100000.0, 28000.0, 0.0, 6.0))
    grid = grid.withColumns({c: F.round(c, 9) for c in ("z", "y", "x", "time")})
    return grid.join(raw, ["step", "k", "j", "i"], "left")


POINTS = """points AS (SELECT event_id, user_id, ts, value, CAST(user_id % 360 AS DOUBLE) AS lon, CAST(event_id % 180 - 90 AS DOUBLE) AS lat,
  epoch_us(ts) / 86400000000.0 AS t FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", "value", (F.col("user_id") % 360).cast("double").alias("lon"), (F.col("event_id") % 180 - 90).cast("double").alias("lat"), (F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0).alias("t"))


BOX = Polygon((60.0, 60.0, 150.0, 150.0, 60.0), (-30.0, 40.0, 40.0, -30.0, -30.0))
TRIANGLE = Polygon((10.0, 200.0, 105.0, 10.0), (-60.0, -45.0, 70.0, -60.0))


def winding_sql(px: str, py: str, p: Polygon) -> str:
    parts = []
    for x0, y0, x1, y1 in zip(p.x, p.y, p.x[1:], p.y[1:], strict=False):
        side = f"(({x1 - x0}) * ({py} - ({y0})) - ({px} - ({x0})) * ({y1 - y0}))"
        if y0 < y1:
            parts.append(f"CASE WHEN {py} >= ({y0}) AND {py} < ({y1}) AND {side} >= 0 THEN 1 ELSE 0 END")
        elif y1 < y0:
            parts.append(f"CASE WHEN {py} >= ({y1}) AND {py} < ({y0}) AND {side} < 0 THEN -1 ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


# Tables ------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT event_id, user_id, lon, lat, value FROM points WHERE value > 20 AND value < 180 AND event_id % 3 = 0 AND {winding_sql('lon', 'lat', TRIANGLE)} <> 0")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = points(spark, sf_dir).select("event_id", "user_id", "lon", "lat", "value")
    return applications.event_filter(e, "(value > 20) && (value < 180)", "event_id", 3, "lon", "lat", [TRIANGLE])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + pow(l_tax, 2) - 3, 6) + 0.0 AS net, CAST(CASE WHEN l_quantity > 25 THEN l_linenumber ELSE l_linenumber * -1 END AS BIGINT) AS pick FROM lineitem")
def evaluate_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    d = table.evaluate_expression(d, "l_extendedprice * (1d - l_discount) + l_tax ** 2d - 3d", "net")
    d = table.evaluate_expression(d, "(l_quantity > 25d) ? l_linenumber (l_linenumber * -1L)", "pick")
    return d.select("l_orderkey", F.col("l_linenumber").cast("int"), r("net").alias("net"), "pick")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT (o_totalprice < 50000 OR o_totalprice >= 250000)")
def remove_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.remove_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "(o_totalprice < 50000d) || (o_totalprice >= 250000d)")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def table_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.numbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query(
    "WITH a AS (SELECT p_partkey AS key, p_retailprice AS price, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part), "
    "b AS (SELECT p_partkey AS key, p_size AS size, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS row_id FROM part) SELECT row_id, a.key, price, size FROM a JOIN b USING (row_id)"
)
def table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"))
    b = p.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("__o"))
    return table.join_by_position([a, b], [["key"], ["__o", "key"]]).drop("__o")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def table_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return table.concatenate([o.where(F.month("o_orderdate") == m).select("o_orderkey", "o_totalprice") for m in range(1, 13)])


@query(f"WITH {POINTS} SELECT event_id, CAST(CASE WHEN {winding_sql('lon', 'lat', BOX)} <> 0 OR {winding_sql('lon', 'lat', TRIANGLE)} <> 0 THEN 1 ELSE 0 END AS SMALLINT) AS mask FROM points")
def table_region_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.region_mask(points(spark, sf_dir), "lon", "lat", [BOX, TRIANGLE]).select("event_id", "mask")


def _calendar(calendar: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = read(spark, sf_dir, "orders").select("o_orderkey", (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) + (F.col("o_orderkey") % 24) / 24.0).alias("time"))
        return table.table_calendar(o, "days since 1995-01-01 00:00:00", calendar).drop("time")

    return f


_ORDER_DAYS = "d AS (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS n, CAST(o_orderkey % 24 AS INTEGER) AS hour FROM orders)"
query(f"WITH {_ORDER_DAYS} SELECT CAST(year(DATE '1995-01-01' + CAST(n AS INTEGER)) AS INTEGER) AS year, CAST(month(DATE '1995-01-01' + CAST(n AS INTEGER)) AS INTEGER) AS month, CAST(day(DATE '1995-01-01' + CAST(n AS INTEGER)) AS INTEGER) AS day, hour, CAST(0 AS INTEGER) AS minute, o_orderkey FROM d", "table_calendar_standard")(_calendar("standard"))
query(f"WITH {_ORDER_DAYS}, e AS (SELECT o_orderkey, hour, n + 1995 * 360 AS z FROM d) SELECT CAST(z // 360 AS INTEGER) AS year, CAST(z % 360 // 30 + 1 AS INTEGER) AS month, CAST(z % 30 + 1 AS INTEGER) AS day, hour, CAST(0 AS INTEGER) AS minute, o_orderkey FROM e", "table_calendar_360_day")(_calendar("360_day"))
query(
    f"WITH {_ORDER_DAYS}, e AS (SELECT o_orderkey, hour, (n + 1995 * 365) // 365 AS y, (n + 1995 * 365) % 365 AS q FROM d), c AS (SELECT unnest([0,31,59,90,120,151,181,212,243,273,304,334]) AS a, unnest([31,59,90,120,151,181,212,243,273,304,334,365]) AS b, unnest(range(1, 13)) AS m) "
    "SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(q - a + 1 AS INTEGER) AS day, hour, CAST(0 AS INTEGER) AS minute, o_orderkey FROM e JOIN c ON q >= a AND q < b",
    "table_calendar_noleap",
)(_calendar("noleap"))


@query(
    "WITH d AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS step, l_extendedprice AS p FROM lineitem) SELECT step, min(p) AS min_p, max(p) AS max_p, round(avg(p), 6) + 0.0 AS avg_p, round(var_pop(p), 3) + 0.0 AS var_p, "
    "list_sort(list(p))[count(*) // 4 + 1] AS low_q_p, list_sort(list(p))[count(*) // 2 + 1] AS med_p, list_sort(list(p))[(3 * count(*)) // 4 + 1] AS up_q_p FROM d GROUP BY step"
)
def descriptive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("step"), F.col("l_extendedprice").alias("p"))
    out = table.descriptive_statistics(d, ["p"], ["step"])
    return out.withColumns({"avg_p": r("avg_p"), "var_p": r("var_p", 3)})


@query("WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0) SELECT o_orderkey, CASE WHEN b.o_totalprice IS NULL THEN 'left only' WHEN a.o_totalprice IS NULL THEN 'right only' ELSE 'value' END AS status FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_totalprice IS NULL OR b.o_totalprice IS NULL OR abs(a.o_totalprice - b.o_totalprice) > 1e-6 AND abs(a.o_totalprice - b.o_totalprice) > 1e-9 * greatest(a.o_totalprice, b.o_totalprice)")
def dataset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    b = o.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1.0).otherwise(0.0))
    return table.dataset_diff(o.where("o_orderkey % 5 <> 0"), b, ["o_orderkey"], 1e-6, 1e-9).select("o_orderkey", "status")


# Point-wise ------------------------------------------------------------------------------


@query(f"WITH {MESH} SELECT step, j, i, v AS price, u AS quantity FROM mesh")
def rename_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.rename_variables(mesh(spark, sf_dir).select("step", "j", "i", "v", "u"), {"v": "price", "u": "quantity"})


@query(f"WITH {MESH} SELECT step, j, i, CASE WHEN v BETWEEN 20000 AND 40000 THEN -1.0 ELSE v END AS v FROM mesh")
def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.mask(mesh(spark, sf_dir), ["v"], 20000.0, 40000.0, -1.0).select("step", "j", "i", "v")


@query(f"WITH {MESH} SELECT step, j, i, round(CASE WHEN u > 20 THEN 1 ELSE 0 END * v, 6) + 0.0 AS masked_v FROM mesh")
def apply_binary_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).withColumn("m", (F.col("u") > 20).cast("int"))
    return pointwise.apply_binary_mask(m, "m", ["v"]).select("step", "j", "i", r("masked_v").alias("masked_v"))


@query(f"WITH {MESH} SELECT step, j, i, round(sqrt(v * v + u * u + w * w), 6) + 0.0 AS l2_norm FROM mesh")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pointwise.l2_norm(mesh(spark, sf_dir), ["v", "u", "w"]).select("step", "j", "i", "l2_norm"), ["l2_norm"])


@query(f"WITH {MESH} SELECT step, j, i, round(coalesce(v0 * 0.25 + 273.15, -999.0), 6) + 0.0 AS v0 FROM mesh")
def unpack_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pointwise.unpack(mesh(spark, sf_dir), {"v0": (0.25, 273.15)}, fill=-999.0).select("step", "j", "i", "v0"), ["v0"])


@query(f"WITH {MESH} SELECT step, j, i, CAST(CASE WHEN v <> 0.0 AND v >= 1000 AND v <= 60000 THEN 1 ELSE 0 END AS TINYINT) AS v_valid FROM mesh")
def valid_value_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.valid_value_mask(mesh(spark, sf_dir), ["v"], 0.0, (1000.0, 60000.0)).select("step", "j", "i", "v_valid")


@query(f"WITH {MESH}, s AS (SELECT j, i, CAST(j * 100 + i AS DOUBLE) AS zs FROM mesh WHERE step = 0) SELECT step, j, i, CAST(CASE WHEN u * 40 >= zs THEN 1 ELSE 0 END AS TINYINT) AS elevation_valid FROM mesh JOIN s USING (j, i)")
def elevation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).withColumn("height", F.col("u") * 40)
    s = m.where("step = 0").select("j", "i", (F.col("j") * 100 + F.col("i")).cast("double").alias("zs"))
    return pointwise.elevation_mask(m, s, "height", "zs").select("step", "j", "i", "elevation_valid")


DAMPED = "v * (1 - exp(-(y * y) / (2 * pow(15 / sqrt(2 * ln(2.0::DOUBLE)), 2))))"


@query(f"WITH {MESH} SELECT step, j, i, round({DAMPED}, 5) + 0.0 AS v_damped FROM mesh")
def latitude_damper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pointwise.latitude_damper(mesh(spark, sf_dir), ["v"], 15.0).select("step", "j", "i", "v_damped"), ["v_damped"], 5)


@query(f"WITH {MESH} SELECT step, j, i, CAST(CASE WHEN v BETWEEN 30000 AND 50000 THEN 1 ELSE 0 END AS TINYINT) AS segments FROM mesh")
def segmentation_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.binary_segmentation(mesh(spark, sf_dir), "v", 30000.0, 50000.0).select("step", "j", "i", "segments")


@query(f"WITH {MESH}, c AS (SELECT step, quantile_cont(v, 0.9) AS lo FROM mesh GROUP BY step) SELECT step, j, i, CAST(CASE WHEN v >= lo THEN 1 ELSE 0 END AS TINYINT) AS segments FROM mesh JOIN c USING (step)")
def segmentation_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.binary_segmentation(mesh(spark, sf_dir), "v", 90.0, by_percentile=True).select("step", "j", "i", "segments")


@query(f"WITH {MESH} SELECT step, j, i, round((v + u) / 2, 6) + 0.0 AS mean, round(u - v, 6) + 0.0 AS gap FROM mesh")
def derived_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pointwise.derived_quantity(mesh(spark, sf_dir), ["v", "u"], ["mean", "gap"], lambda a, b: [pointwise.average(a, b), pointwise.difference(a, b)])
    return rounded(m.select("step", "j", "i", "mean", "gap"), ["mean", "gap"])


@query(f"WITH {MESH} SELECT CASE step WHEN 40 THEN 0 WHEN 3 THEN 1 ELSE 2 END::BIGINT AS step, j, i, v FROM mesh WHERE step IN (40, 3, 77)")
def temporal_index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.temporal_index_select(mesh(spark, sf_dir), [40, 3, 77]).select("step", "j", "i", "v")


@query("SELECT s.range AS step, k.range AS k, j.range AS j, i.range AS i, round(i.range * 2.0 + j.range * 0.5 - k.range + s.range * 10.0, 6) + 0.0 AS f FROM range(4) s, range(3) k, range(5) j, range(6) i")
def mesh_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meshes.mesh_source(spark, 6, 5, 3, 4, (0.0, 10.0, 0.0, 2.0, 0.0, -2.0, 0.0, 30.0), {"f": lambda x, y, z, t: x + y + z + t})
    return rounded(m.select("step", "k", "j", "i", "f"), ["f"])


# Stencils ----------------------------------------------------------------------------------

RAD = "radians(10.0::DOUBLE) * 6371000.0"


@query(
    f"WITH {MESH}, n AS (SELECT *, coalesce(lag(v) OVER r, last_value(v) OVER a) AS vw, coalesce(lead(v) OVER r, first_value(v) OVER a) AS ve, lag(u) OVER c AS us, lead(u) OVER c AS un FROM mesh WINDOW r AS (PARTITION BY step, j ORDER BY i), "
    "a AS (PARTITION BY step, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), c AS (PARTITION BY step, i ORDER BY j)), "
    f"o AS (SELECT *, (ve - vw) / (2 * {RAD} * cos(radians(y))) - (un - us) / (2 * {RAD}) AS q FROM n), e AS (SELECT *, lag(q) OVER c AS qs, lead(q) OVER c AS qn FROM o WINDOW c AS (PARTITION BY step, i ORDER BY j)) "
    f"SELECT step, j, i, round(CASE WHEN j = 0 THEN qn WHEN j = {NJ - 1} THEN qs ELSE q END * 1e6, 6) + 0.0 AS vorticity FROM e"
)
def vorticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stencil.vorticity(mesh(spark, sf_dir), "u", "v", periodic=True)
    return m.select("step", "j", "i", r(F.col("vorticity") * 1e6).alias("vorticity"))


@query(
    f"WITH {MESH}, n AS (SELECT *, lag(v) OVER r AS vw, lead(v) OVER r AS ve, lag(v) OVER c AS vs, lead(v) OVER c AS vn FROM mesh WINDOW r AS (PARTITION BY step, j ORDER BY i), c AS (PARTITION BY step, i ORDER BY j)) "
    f"SELECT step, j, i, round(((vs - 2 * v + vn) / pow({RAD}, 2) - tan(radians(y)) * (vn - vs) / (2 * {RAD} * 6371000.0) + (vw - 2 * v + ve) / pow({RAD} * cos(radians(y)), 2)) * 1e9, 6) + 0.0 AS laplacian FROM n"
)
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.laplacian(mesh(spark, sf_dir), "v").select("step", "j", "i", r(F.col("laplacian") * 1e9).alias("laplacian"))


AREA = (
    f"{MESH}, l AS (SELECT step, time, j, i, y, x, CAST(floor(v / 15000) AS INTEGER) AS component FROM mesh), n AS (SELECT *, lag(x) OVER r AS xw, lead(x) OVER r AS xe, lag(y) OVER c AS ys, lead(y) OVER c AS yn FROM l WINDOW r AS (PARTITION BY step, j ORDER BY i), c AS (PARTITION BY step, i ORDER BY j)), "
    "s AS (SELECT *, coalesce(abs(6378.137 * 6378.137 * 0.5 * radians(xe - xw) * (sin(0.5 * radians(y + yn)) - sin(0.5 * radians(ys + y)))), 0.0) AS cell FROM n), "
    "a AS (SELECT step, time, component AS label, sum(cell) AS area FROM s GROUP BY 1, 2, 3)"
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh(spark, sf_dir).withColumn("component", F.floor(F.col("v") / 15000).cast("int")).select("step", "time", "j", "i", "y", "x", "component")


@query(f"WITH {AREA} SELECT step, time, label, round(area, 3) + 0.0 AS area FROM a")
def component_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.component_area(labelled(spark, sf_dir)), ["area"], 3)


@query(f"WITH {AREA} SELECT l.step, j, i, CASE WHEN round(area, 3) BETWEEN 1e7 AND 9e7 THEN component ELSE 0 END AS component FROM l JOIN a ON a.step = l.step AND a.label = l.component")
def component_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labelled(spark, sf_dir)
    areas = rounded(stencil.component_area(m), ["area"], 3)
    return stencil.component_area_filter(m, areas, 1e7, 9e7).select("step", "j", "i", "component")


@query(f"WITH {AREA} SELECT step, time, step * 1000000 + label AS global_component_ids, label AS component_ids, round(area, 3) + 0.0 AS component_area FROM a")
def component_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.component_statistics(rounded(stencil.component_area(labelled(spark, sf_dir)), ["area"], 3))


@query(f"WITH {MESH}, n AS (SELECT step, j, i, v, lead(v) OVER (PARTITION BY step, j ORDER BY i) AS e FROM mesh) SELECT step, j, i, round(0.5 * (v + e), 6) + 0.0 AS v FROM n WHERE i < {NI - 1}")
def face_to_cell_centering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.face_to_cell(mesh(spark, sf_dir), ["v"], "x").select("step", "j", "i", "v"), ["v"])


@query(f"WITH {MESH} SELECT step, j, i, round(w * (v - 5000) + 5000, 6) + 0.0 AS pressure FROM mesh")
def vertical_coordinate_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.vertical_coordinate_transform(mesh(spark, sf_dir), "v", 5000.0, "w").select("step", "j", "i", "pressure"), ["pressure"])


@query(f"WITH {MESH} SELECT step, CAST({NJ - 1} - j AS BIGINT) AS j, CAST((i + {NI // 2}) % {NI} AS BIGINT) AS i, -y AS y, (x + 180) % 360 AS x, v FROM mesh")
def normalize_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).withColumns({"y": -F.col("y"), "x": F.col("x") - 180})
    out = stencil.normalize_coordinates(m, shift_x=True)
    return out.select("step", F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), "y", "x", "v")


@query(f"WITH {MESH} SELECT step, j, i, v FROM mesh WHERE x BETWEEN 40 AND 160 AND y BETWEEN -25 AND 55")
def cartesian_mesh_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.subset(mesh(spark, sf_dir), x=(40.0, 160.0), y=(-25.0, 55.0)).select("step", "j", "i", "v")


@query(f"WITH {MESH} SELECT step, j, i, round(100 + (x - 0) * 2.0, 6) + 0.0 AS x, round(0 + (y + 85) * (10.0::DOUBLE / 170), 6) + 0.0 AS lat FROM mesh")
def coordinate_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stencil.coordinate_transform(mesh(spark, sf_dir), {"x": ((0.0, 350.0), (100.0, 800.0)), "y": ((-85.0, 85.0), (0.0, 10.0))}, {"y": "lat"})
    return rounded(out.select("step", "j", "i", "x", "lat"), ["x", "lat"])


def _target(spark: SparkSession) -> DataFrame:
    g = meshes.mesh_source(spark, 20, 12, 1, 1, (3.0, 345.0, -80.0, 79.5))
    return g.select("j", "i", F.round("y", 9).alias("y"), F.round("x", 9).alias("x"))


TARGET = "tj AS (SELECT range AS j, round(-80.0 + range * (159.5::DOUBLE / 11), 9) AS y FROM range(12)), ti AS (SELECT range AS i, round(3.0 + range * 18.0, 9) AS x FROM range(20)), pj AS (SELECT j, y, CAST(floor((y + 85) / 10) AS BIGINT) AS j0, (y + 85) / 10 - floor((y + 85) / 10) AS f FROM tj), pi AS (SELECT i, x, CAST(floor(x / 10) AS BIGINT) AS i0, x / 10 - floor(x / 10) AS g FROM ti)"


@query(
    f"WITH {MESH}, {TARGET} SELECT m.step, pj.j, pi.i, round(sum(m.v * (CASE WHEN m.j = pj.j0 THEN 1 - pj.f ELSE pj.f END) * (CASE WHEN m.i = pi.i0 THEN 1 - pi.g ELSE pi.g END)), 5) + 0.0 AS v FROM mesh m JOIN pj ON m.j = pj.j0 OR m.j = pj.j0 + 1 JOIN pi ON m.i = pi.i0 OR m.i = pi.i0 + 1 GROUP BY 1, 2, 3"
)
def regrid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.regrid(mesh(spark, sf_dir), _target(spark), ["v"]).select("step", "j", "i", "v"), ["v"], 5)


@query(f"WITH {MESH}, {TARGET} SELECT m.step, pj.j, pi.i, m.v FROM mesh m JOIN pj ON m.j = pj.j0 + CASE WHEN pj.f <= 0.5 THEN 0 ELSE 1 END JOIN pi ON m.i = pi.i0 + CASE WHEN pi.g <= 0.5 THEN 0 ELSE 1 END")
def regrid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.regrid(mesh(spark, sf_dir), _target(spark), ["v"], "nearest").select("step", "j", "i", "v")


#: Cells without a value, for the queries on missing values.
HOLES = "(step * 5 + j * 3 + i) % 11 = 0"
PART = "sum(w) FILTER (v IS NOT NULL)"


@query(
    f"WITH {MESH}, {TARGET}, p AS (SELECT m.step, pj.j, pi.i, CASE WHEN {HOLES.replace('step', 'm.step').replace('j *', 'm.j *').replace('+ i', '+ m.i')} THEN NULL ELSE m.v END AS v, (CASE WHEN m.j = pj.j0 THEN 1 - pj.f ELSE pj.f END) * (CASE WHEN m.i = pi.i0 THEN 1 - pi.g ELSE pi.g END) AS w "
    f"FROM mesh m JOIN pj ON m.j = pj.j0 OR m.j = pj.j0 + 1 JOIN pi ON m.i = pi.i0 OR m.i = pi.i0 + 1) SELECT step, j, i, round(CASE WHEN bool_and(v IS NOT NULL) THEN sum(v * w) END, 5) + 0.0 AS v, round(sum(v * w) / {PART}, 5) + 0.0 AS part FROM p WHERE w > 0 GROUP BY 1, 2, 3"
)
def regrid_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).withColumn("v", F.when(~F.expr(HOLES), F.col("v")))
    whole = stencil.regrid(m, _target(spark), ["v"]).select("step", "j", "i", "v")
    part = stencil.regrid(m, _target(spark), ["v"], missing="renormalise").select("step", "j", "i", F.col("v").alias("part"))
    return rounded(whole.join(part, ["step", "j", "i"]), ["v", "part"], 5)


@query(
    f"WITH {MESH}, c AS (SELECT step, j * {NI} + i AS cell, CASE WHEN {HOLES} THEN NULL ELSE v END AS v FROM mesh), w AS (SELECT range AS col, range % 200 AS row, (range % 7) / 10.0::DOUBLE AS w FROM range({NJ * NI})) "
    f"SELECT step, row, round(CASE WHEN bool_and(v IS NOT NULL) THEN sum(w * v) END, 5) + 0.0 AS v, round(sum(w * v) * sum(w) / {PART}, 5) + 0.0 AS part FROM c JOIN w ON c.cell = w.col WHERE w > 0 GROUP BY 1, 2"
)
def sparse_remap_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).select("step", (F.col("j") * NI + F.col("i")).alias("cell"), F.when(~F.expr(HOLES), F.col("v")).alias("v"))
    w = spark.range(NJ * NI).select(F.col("id").alias("col"), (F.col("id") % 200).alias("row"), ((F.col("id") % 7) / 10.0).alias("s"))
    part = stencil.sparse_remap(m, w, ["v"], missing="renormalise").withColumnRenamed("v", "part")
    return rounded(stencil.sparse_remap(m, w, ["v"]).join(part, ["step", "row"]), ["v", "part"], 5)


@query(f"WITH {MESH}, c AS (SELECT step, j * {NI} + i AS cell, v FROM mesh), w AS (SELECT range AS col, range % 50 AS row, (range % 7 + 1) / 10.0::DOUBLE AS s FROM range({NJ * NI})) SELECT step, row, round(sum(s * v), 5) + 0.0 AS v FROM c JOIN w ON c.cell = w.col GROUP BY 1, 2")
def sparse_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).select("step", (F.col("j") * NI + F.col("i")).alias("cell"), "v")
    w = spark.range(NJ * NI).select(F.col("id").alias("col"), (F.col("id") % 50).alias("row"), ((F.col("id") % 7 + 1) / 10.0).alias("s"))
    return rounded(stencil.sparse_remap(m, w, ["v"]), ["v"], 5)


# Integrals -----------------------------------------------------------------------------------

INNER = (
    "p AS (SELECT *, radians(x) AS th, radians(90.0::DOUBLE - y) AS ph, v * sin(radians(90.0::DOUBLE - y)) AS vs FROM mesh), f AS (SELECT *, lead(th) OVER r - th AS dth, lead(ph) OVER c - ph AS dph, lead(u) OVER r AS ue, lead(vs) OVER c AS vn FROM p WINDOW r AS (PARTITION BY step, j ORDER BY i), c AS (PARTITION BY step, i ORDER BY j)), "
    f"g AS (SELECT * FROM f WHERE i BETWEEN 1 AND {NI - 2} AND j BETWEEN 1 AND {NJ - 2} AND x < 180)"
)


@query(f"WITH {MESH}, {INNER} SELECT step AS time_step, time, round(-4.068015961e13 * sum(v * sin(ph) * dth * dph) / 1e12, 6) + 0.0 AS net_regional_v FROM g GROUP BY 1, 2")
def surface_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).withColumn("region", (F.col("x") < 180).cast("int"))
    return vertical.surface_integral(m, ["v"], "region").withColumn("net_regional_v", r(F.col("net_regional_v") / 1e12))


@query(f"WITH {MESH}, {INNER} SELECT step AS time_step, time, round(-6.3781e6 * sum(((ue - u) / dth + (vn - vs) / dph) * dth * dph) / 1e6, 5) + 0.0 AS moisture_flux FROM g GROUP BY 1, 2")
def regional_moisture_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).withColumn("region", (F.col("x") < 180).cast("int"))
    return vertical.regional_moisture_flux(m, "u", "v", "region").withColumn("moisture_flux", r(F.col("moisture_flux") / 1e6, 5))


@query(
    f"WITH {LEVELS}, n AS (SELECT step, j, i, 0.5 * (lead(z) OVER c - z) * (q * u + lead(q * u) OVER c) AS a, 0.5 * (lead(z) OVER c - z) * (q * w + lead(q * w) OVER c) AS b FROM levels WINDOW c AS (PARTITION BY step, j, i ORDER BY z)) "
    "SELECT step, j, i, round(sum(coalesce(a, 0.0)) / 9.80665, 1) + 0.0 AS ivt_u, round(sum(coalesce(b, 0.0)) / 9.80665, 1) + 0.0 AS ivt_v FROM n GROUP BY 1, 2, 3"
)
def integrated_vapor_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vertical.integrated_vapor_transport(levels(spark, sf_dir), "u", "w", "q")
    return rounded(out.select("step", "j", "i", "ivt_u", "ivt_v"), ["ivt_u", "ivt_v"], 1)


@query(f"WITH {LEVELS}, n AS (SELECT step, j, i, 0.5 * (lead(z) OVER c - z) * (q + lead(q) OVER c) AS a FROM levels WINDOW c AS (PARTITION BY step, j, i ORDER BY z)) SELECT step, j, i, round(sum(coalesce(a, 0.0)) / 9.80665, 4) + 0.0 AS iwv FROM n GROUP BY 1, 2, 3")
def integrated_water_vapor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vertical.integrated_water_vapor(levels(spark, sf_dir), "q").select("step", "j", "i", "iwv"), ["iwv"], 4)


@query(
    f"WITH {LEVELS}, h AS (SELECT *, CAST(k * 1500 AS DOUBLE) AS h, CAST(j * 100 AS DOUBLE) AS s FROM levels), m AS (SELECT step, j, i, k, CASE WHEN h >= s AND h < 9000 THEN u END AS t, CASE WHEN h >= s AND h < 9000 THEN h END AS zz FROM h), "
    "d AS (SELECT step, j, i, lead(t) OVER c - t AS dt, lead(zz) OVER c - zz AS dz FROM m WINDOW c AS (PARTITION BY step, j, i ORDER BY k)) SELECT step, j, i, round(avg(dt / dz), 6) + 0.0 AS lapse_rate FROM d GROUP BY 1, 2, 3"
)
def lapse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = levels(spark, sf_dir).withColumns({"h": (F.col("k") * 1500).cast("double"), "s": (F.col("j") * 100).cast("double")})
    return rounded(vertical.lapse_rate(m, "u", "h", "s").select("step", "j", "i", "lapse_rate"), ["lapse_rate"])


# Time ------------------------------------------------------------------------------------------

UNITS = "days since 1992-01-01"
DAYS = "d AS (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS step, CAST(o_orderdate AS DATE) AS day, o_custkey % 10 AS cell, o_totalprice AS p FROM orders)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    step = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return o.select(step.alias("step"), step.cast("double").alias("time"), (F.col("o_custkey") % 10).alias("cell"), F.col("o_totalprice").alias("p"))


_KEYS = {
    "daily": "CAST(strftime(day, '%Y%m%d') AS BIGINT)", "monthly": "CAST(strftime(day, '%Y%m') AS BIGINT)", "yearly": "CAST(year(day) AS BIGINT)", "all": "CAST(0 AS BIGINT)",
    "seasonal": "CAST((year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END) * 10 + (month(day) % 12) // 3 AS BIGINT)",
    "n_steps": "CAST((step - (SELECT min(step) FROM d)) // 30 AS BIGINT)",
}
_AGGREGATES = {"average": "avg(p)", "summation": "sum(p)", "minimum": "min(p)", "maximum": "max(p)"}


def _reduction(interval: str, operator: str) -> None:
    where = ""
    if interval == "seasonal":
        where = f"WHERE {_KEYS['seasonal']} IN (SELECT {_KEYS['seasonal']} FROM d GROUP BY 1 HAVING count(DISTINCT month(day)) = 3)"
    elif interval == "n_steps":
        where = f"WHERE ({_KEYS['n_steps']} + 1) * 30 <= (SELECT max(step) - min(step) + 1 FROM d)"
    sql = f"WITH {DAYS} SELECT {_KEYS[interval]} AS interval, cell, CAST(min(step) AS DOUBLE) AS time, round({_AGGREGATES[operator]}, 4) + 0.0 AS p FROM d {where} GROUP BY 1, 2"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(temporal.temporal_reduction(days(spark, sf_dir), ["p"], operator, interval, UNITS, "standard", n_steps=30, cell=("cell",)), ["p"], 4)

    query(sql, f"temporal_{interval}_{operator}")(f)


for _interval, _operator in (("daily", "average"), ("daily", "maximum"), ("monthly", "summation"), ("monthly", "average"), ("seasonal", "average"), ("seasonal", "minimum"), ("yearly", "maximum"), ("yearly", "summation"), ("n_steps", "average"), ("n_steps", "minimum"), ("all", "average"), ("all", "maximum")):
    _reduction(_interval, _operator)


@query(f"WITH {DAYS} SELECT {_KEYS['monthly']} AS interval, cell, CAST(min(step) AS DOUBLE) AS time, round(quantile_cont(p, 0.9), 4) + 0.0 AS p FROM d GROUP BY 1, 2")
def temporal_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.temporal_percentile(days(spark, sf_dir), ["p"], 90.0, "monthly", UNITS, cell=("cell",)), ["p"], 4)


#: The years that arrive together.
ARRIVALS = ((1992, 1993), (1994, 1995), (1996, 9999))


@query("WITH d AS (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_custkey % 10 AS cell, o_totalprice AS p FROM orders) SELECT CAST(day // 30 * 30 AS BIGINT) AS start, cell, round(avg(p), 4) + 0.0 AS p, count(*) AS n FROM d GROUP BY 1, 2")
def stream_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 30 days over orders that arrive in three lots: the stream stops after each and goes on from its checkpoint, with a watermark of a day."""
    o = read(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    arriving = o.select(F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400).alias("time"), (F.col("o_custkey") % 10).alias("cell"), F.col("o_totalprice").alias("p"), F.year("o_orderdate").alias("year"))
    base = shared_folder(spark)
    for first, last in ARRIVALS:
        arriving.where(F.col("year").between(first, last)).drop("year").write.mode("append").parquet(f"{base}/landing")
        arrivals.reduce_arrivals(spark, f"{base}/landing", arriving.drop("year").schema, f"{base}/out", f"{base}/checkpoint", "time", "30 days", ["p"], "average", ["cell"])
    got = arrivals.reduced_so_far(spark, f"{base}/out", ["cell"])
    return got.select(F.expr("unix_seconds(start) div 86400").alias("start"), "cell", r("p", 4).alias("p"), "n")


SERIES = f"{DAYS}, s AS (SELECT step, cell, round(avg(p) + 1.7e-9, 6) AS p FROM d GROUP BY 1, 2)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).groupBy("step", "cell").agg(F.round(F.avg("p") + F.lit(1.7e-9), 6).alias("p"))


@query(f"WITH {SERIES} SELECT step, cell, round(avg(p) OVER (PARTITION BY cell ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) + 0.0 AS p FROM s")
def simple_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.simple_moving_average(series(spark, sf_dir), ["p"], 5, "centered", ("cell",)), ["p"], 4)


def _convolution(name: str, weights: list[float], kind: str) -> None:
    low, _ = temporal._frame(kind, len(weights))
    at = lambda n: f"lead(p, {n}) OVER w" if n > 0 else f"lag(p, {-n}) OVER w" if n < 0 else "p"
    total = " + ".join(f"{w!r}::DOUBLE * {at(low + n)}" for n, w in enumerate(weights))
    sql = f"WITH {SERIES}, c AS (SELECT step, cell, {total} AS p FROM s WINDOW w AS (PARTITION BY cell ORDER BY step)) SELECT step, cell, round(p, 4) + 0.0 AS p FROM c WHERE p IS NOT NULL"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(temporal.time_axis_convolution(series(spark, sf_dir), ["p"], weights, kind, cell=("cell",)), ["p"], 4)

    query(sql, name)(f)


_convolution("convolution_constant", temporal.kernel("constant", 4), "backward")
_convolution("convolution_gaussian", temporal.kernel("gaussian", 5), "centered")
_convolution("convolution_high_pass", temporal.kernel("gaussian", 5, True), "centered")


# The filter as a circular convolution with the cosine transform of its response.
@query(
    f"WITH {SERIES}, o AS (SELECT step, cell, p, row_number() OVER (PARTITION BY cell ORDER BY step) - 1 AS t, count(*) OVER (PARTITION BY cell) AS n FROM s), c AS (SELECT DISTINCT cell, n FROM o), "
    "h AS (SELECT cell, n, m.range AS m, m.range - n // 2 AS k, 1 / sqrt(1 + pow(abs(-0.5::DOUBLE / 86400 + m.range * (1.0::DOUBLE / 86400) / (n - 1)) * (30 * 86400), 4)) AS h FROM c, range(4000) m WHERE m.range < n), "
    "g AS (SELECT cell, d.range AS d, sum(h * cos(2 * pi() * ((k * d.range) % n) / n)) / any_value(n) AS g FROM h, range(4000) d WHERE d.range < n GROUP BY 1, 2) "
    "SELECT a.step, a.cell, round(sum(b.p * g.g), 3) + 0.0 AS p_low_pass FROM o a JOIN o b ON a.cell = b.cell JOIN g ON g.cell = a.cell AND g.d = (a.t - b.t + a.n) % a.n GROUP BY 1, 2"
)
def spectral_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.spectral_filter(series(spark, sf_dir), ["p"], "low_pass", 1.0 / (30 * 86400.0), 86400.0, 2.0, ("cell",))
    return out.select("step", "cell", r("p_low_pass", 3).alias("p_low_pass"))


# Sources and sinks --------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS original_ids FROM customer")
def typed_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/customer.csv"
    tables.write_table(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").cast("long").alias("c_nationkey")), path)
    return tables.read_table(spark, path, index_column="c_custkey", original_ids=["c_custkey"])


@query(f"WITH {MESH} SELECT step, j, i, time, y, x, round(v, 6) + 0.0 AS v FROM mesh WHERE step BETWEEN 10 AND 40")
def mesh_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/mesh"
    meshes.write_mesh(mesh(spark, sf_dir), path, "yearly", ["v", "u"], units="days since 1992-01-01", calendar="360_day", spatial=(9, 12))
    return meshes.read_mesh(spark, path, (10, 40), ["v"]).select("step", "j", "i", "time", "y", "x", r("v").alias("v"))


def exported(spark: SparkSession, sf_dir: str) -> str:
    """The mesh in NetCDF files of twelve steps each; the folder."""
    folder = shared_folder(spark).removeprefix("file:").replace("///", "/")
    m = mesh(spark, sf_dir).withColumns({"k": F.lit(0).cast("long"), "z": F.lit(0.0), "file": F.format_string("f%03d", F.floor(F.col("step") / 12))})
    netcdf3.export(m, folder, ["v0", "u"]).collect()  # a row for each file
    netcdf3.register(spark)
    return folder


@query(f"WITH {MESH} SELECT step, j, i, time, y, x, round(v0, 6) + 0.0 AS v, round(u, 6) + 0.0 AS u FROM mesh")
def netcdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spark.read.format("netcdf3").options(path=exported(spark, sf_dir), variables="v0,u", z_axis_variable="lev").load()
    return got.select("step", "j", "i", "time", "y", "x", r("v0").alias("v"), r("u").alias("u"))


def _gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh(spark, sf_dir).withColumns({"k": F.lit(0).cast("long"), "z": F.lit(0.0)})


@query(f"WITH {MESH} SELECT strftime(DATE '1992-01-01' + CAST(time AS INTEGER), '%Y') || '.nc' AS file, step, j, i, time, y, x, round(v0, 6) + 0.0 AS v FROM mesh")
def netcdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh written as a NetCDF file a year by tasks that commit, and scanned again."""
    folder = shared_folder(spark)
    mesh_files.write_files(_gridded(spark, sf_dir), folder, ["v0"], layout="yearly", units=UNITS)
    netcdf3.register(spark)
    got = spark.read.format("netcdf3").options(path=folder.removeprefix("file:").replace("///", "/"), variables="v0", z_axis_variable="lev").load()
    year = F.date_format(F.date_add(F.lit("1992-01-01").cast("date"), F.col("time").cast("int")), "yyyy")
    return got.select(F.concat(year, F.lit(".nc")).alias("file"), "step", "j", "i", "time", "y", "x", r("v0").alias("v"))


@query(f"WITH {MESH} SELECT step, j, i, round(v, 6) + 0.0 AS v FROM mesh")
def vtk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh written as a VTK file a step by tasks that commit, and its texts read again: values in the order of cells."""
    folder = shared_folder(spark)
    mesh_files.write_files(_gridded(spark, sf_dir), folder, ["v"], "vtk", steps_per_file=1000)
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.vtk").select("value", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.vtk$", 1).cast("long").alias("step"))
    values = F.split(F.trim(F.regexp_replace(F.element_at(F.split("value", "LOOKUP_TABLE default"), 2), "\n", "")), " ")
    cells = texts.select("step", F.posexplode(values).alias("cell", "value"))
    return cells.select("step", F.expr(f"CAST(cell div {NI} AS BIGINT)").alias("j"), (F.col("cell") % NI).cast("long").alias("i"), r(F.col("value").cast("double")).alias("v"))


@query(f"WITH {MESH} SELECT 'f' || lpad(CAST(step // 12 AS VARCHAR), 3, '0') || '.nc' AS file, step % 12 AS step, min(time) AS time, 'days since 1970-01-01' AS units, 'standard' AS calendar FROM mesh GROUP BY step // 12, step % 12")
def netcdf_time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.read_time_axis(spark, exported(spark, sf_dir)).withColumn("file", F.element_at(F.split("file", "/"), -1))


@query(
    f"WITH {MESH}, m AS (SELECT *, DATE '1970-01-01' + CAST(time AS INTEGER) AS day FROM mesh), s AS (SELECT *, {_KEYS['seasonal']} AS interval FROM m), "
    "w AS (SELECT interval FROM s GROUP BY 1 HAVING count(DISTINCT month(day)) = 3) SELECT interval, j, i, min(time) AS time, round(avg(v0), 4) + 0.0 AS v FROM s WHERE interval IN (SELECT interval FROM w) GROUP BY 1, 2, 3"
)
def netcdf_seasonal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of a mesh in files, found on the time axis of the files' headers; the cells are read once."""
    folder = exported(spark, sf_dir)
    m = spark.read.format("netcdf3").options(path=folder, variables="v0", z_axis_variable="lev").load()
    axis = catalogue.read_time_axis(spark, folder).select("time")
    return temporal.temporal_reduction(m, ["v0"], "average", "seasonal", cell=("j", "i"), axis=axis).select("interval", "j", "i", "time", r("v0", 4).alias("v"))


@query(f"WITH {MESH} SELECT step, j, i, time, round(v0, 6) + 0.0 AS v FROM mesh WHERE time >= 600 AND time < 1500 AND y >= 5 AND x < 175")
def netcdf_catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan planned from a catalogue: bounds leave out blocks by their times, then rows and columns of what is read."""
    folder, kept = exported(spark, sf_dir), f"{shared_folder(spark)}/catalogue"
    catalogue.catalogue(spark, folder, kept)
    got = spark.read.format("netcdf3").options(path=folder, variables="v0", z_axis_variable="lev", catalogue=kept, bounds="time >= 600; time < 1500; y >= 5; x < 175").load()
    return got.select("step", "j", "i", "time", r("v0").alias("v"))


@query(f"WITH {MESH} SELECT step, j, i, CAST(CASE WHEN {winding_sql('x', 'y', BOX)} <> 0 OR {winding_sql('x', 'y', TRIANGLE)} <> 0 THEN 1 ELSE 0 END AS TINYINT) AS mask FROM mesh")
def shape_file_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.shape_file_mask(mesh(spark, sf_dir), [BOX, TRIANGLE]).select("step", "j", "i", "mask")


@query(f"WITH {MESH}, f AS (SELECT *, step // 12 AS file FROM mesh) SELECT step, min(time) AS time, min(file) AS file FROM f GROUP BY step")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.time_axis(mesh(spark, sf_dir).withColumn("file", F.floor(F.col("step") / 12)), "file")


@query(f"WITH {MESH} SELECT min(step) AS min_step, max(step) AS max_step, min(time) AS min_time, max(time) AS max_time, min(j) AS min_j, max(j) AS max_j, min(i) AS min_i, max(i) AS max_i, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x, count(DISTINCT step) AS n_steps, count(*) AS n_cells FROM mesh")
def describe_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.describe(mesh(spark, sf_dir))


# Components and rivers ----------------------------------------------------------------------------


def reach_sql(active: str, by: str) -> str:
    """CTEs that label the 8-connected cells q = j * NI + i of `active` (by, j, i, q), periodic in i, by their smallest cell."""
    on = " AND ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    step = " AND ".join(f"r.{c} = e.{c}" for c in by.split(", "))
    own = lambda t: ", ".join(f"{t}.{c}" for c in by.split(", "))
    return (
        f"e AS (SELECT {own('a')}, a.q AS a, b.q AS b FROM {active} a JOIN {active} b ON {on} AND abs(a.j - b.j) <= 1 AND (a.i - b.i + {NI}) % {NI} IN (0, 1, {NI - 1})), "
        # the smallest cell seen goes one neighbour further in each round, until a round changes nothing
        f"r AS (SELECT {by}, q, q AS root, 0 AS n, true AS go FROM {active} UNION ALL SELECT {by}, q, root, n, bool_or(root < old) OVER () AS go FROM "
        f"(SELECT {own('e')}, e.a AS q, min(r.root) AS root, max(CASE WHEN e.a = e.b THEN r.root END) AS old, r.n + 1 AS n FROM r JOIN e ON {step} AND r.q = e.b WHERE r.go GROUP BY {own('e')}, e.a, r.n) z), "
        f"roots AS (SELECT {by}, q, root FROM r WHERE n = (SELECT max(n) FROM r))"
    )


LABELS = (
    f"WITH RECURSIVE {MESH}, c AS (SELECT step, quantile_cont(v, 0.8) AS lo FROM mesh GROUP BY step), act AS (SELECT step, j, i, j * {NI} + i AS q FROM mesh JOIN c USING (step) WHERE v >= lo), {reach_sql('act', 'step')}, "
    f"l AS (SELECT step, q, dense_rank() OVER (PARTITION BY step ORDER BY root) AS component FROM roots) SELECT m.step, j, i, CAST(coalesce(component, 0) AS INTEGER) AS component FROM mesh m LEFT JOIN l ON l.step = m.step AND l.q = m.j * {NI} + m.i"
)


@query(LABELS)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pointwise.binary_segmentation(mesh(spark, sf_dir), "v", 80.0, by_percentile=True)
    return components.connected_components(m, periodic_x=True).select("step", "j", "i", "component")


@query(LABELS)
def connected_components_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels from tiles of 5 rows and 8 columns, of which the last are smaller."""
    m = pointwise.binary_segmentation(mesh(spark, sf_dir), "v", 80.0, by_percentile=True)
    return components.connected_components(m, periodic_x=True, tile=(5, 8)).select("step", "j", "i", "component")


PARAMETERS = pd.DataFrame([(w, q, a) for w in (5.0, 15.0) for q in (85.0, 92.0, 96.0) for a in (1e6, 5e6)], columns=["hwhm_latitude", "min_water_vapor", "min_component_area"])


@query(
    f"WITH RECURSIVE {AREA}, p(id, width, q, least) AS (VALUES {', '.join(f'({n}, {w}::DOUBLE, {q / 100}::DOUBLE, {a}::DOUBLE)' for n, (w, q, a) in enumerate(PARAMETERS.itertuples(index=False)))}), "
    "d AS (SELECT id, step, j, i, least, q AS share, v * (1 - exp(-(y * y) / (2 * pow(width / sqrt(2 * ln(2.0::DOUBLE)), 2)))) AS v FROM mesh, p), "
    f"c AS (SELECT id, step, CASE {' '.join(f'WHEN any_value(share) = {q / 100} THEN quantile_cont(v, {q / 100})' for q in PARAMETERS['min_water_vapor'].unique())} END AS lo FROM d GROUP BY 1, 2), "
    f"act AS (SELECT d.id, d.step, j, i, j * {NI} + i AS q, least FROM d JOIN c ON c.id = d.id AND c.step = d.step WHERE v >= lo), {reach_sql('act', 'id, step')}, "
    f"z AS (SELECT t.id, t.step, t.q, t.root, act.least, s.cell FROM roots t JOIN act ON act.id = t.id AND act.step = t.step AND act.q = t.q JOIN s ON s.step = t.step AND s.j * {NI} + s.i = t.q), k AS (SELECT id, step, root FROM z GROUP BY 1, 2, 3 HAVING sum(cell) >= any_value(least)), "
    f"h AS (SELECT z.step, z.q, count(*) AS n FROM z JOIN k ON k.id = z.id AND k.step = z.step AND k.root = z.root GROUP BY 1, 2) SELECT m.step, m.j, m.i, round(coalesce(n, 0) / {len(PARAMETERS)}.0::DOUBLE, 6) + 0.0 AS ar_probability FROM mesh m LEFT JOIN h ON h.step = m.step AND h.q = m.j * {NI} + m.i"
)
def bayesian_ar_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components.bayesian_ar_detect(mesh(spark, sf_dir), PARAMETERS, "v")
    return out.select(F.col("step"), F.col("j"), F.col("i"), r("ar_probability").alias("ar_probability"))


# Cyclones --------------------------------------------------------------------------------------------

TRACKS = f"{POINTS}, k AS (SELECT user_id AS track_id, t AS time, value / 3 AS w, 101000 - value * 10 AS p, lon, CAST((event_id * 7) % 120 - 60 AS DOUBLE) AS lat FROM points QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1)"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = points(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("user_id", "ts").orderBy("event_id"))).where("n = 1")
    return p.select(F.col("user_id").alias("track_id"), F.col("t").alias("time"), (F.col("value") / 3).alias("surface_wind"), (F.lit(101000) - F.col("value") * 10).alias("sea_level_pressure"), "lon", ((F.col("event_id") * 7) % 120 - 60).cast("double").alias("lat"))


def category_sql(wind: str) -> str:
    cases = " ".join(f"WHEN {wind} < {b}/3.6 THEN {c}" for c, b in enumerate(geometry.BOUNDS_KMPH, start=-1))
    return f"CASE {cases} ELSE 5 END"


def region_sql(px: str, py: str, otherwise: str, pick: int) -> str:
    return "CASE " + " ".join(f"WHEN {winding_sql(px, py, b[3])} <> 0 THEN {b[pick] if pick == 0 else repr(b[pick])}" for b in geometry.BASINS) + f" ELSE {otherwise} END"


CLASSES = (
    f"{TRACKS}, m AS (SELECT *, lead(time) OVER o - lag(time) OVER o AS dt, 6371.0 * sqrt(pow((radians(lon) - radians(lag(lon) OVER o)) * cos(radians(lag(lat) OVER o)), 2) + pow(radians(lat) - radians(lag(lat) OVER o), 2)) AS d FROM k WINDOW o AS (PARTITION BY track_id ORDER BY time)), "
    "c AS (SELECT track_id, min(time) AS start_time, arg_min(lon, time) AS start_x, arg_min(lat, time) AS start_y, max(time) - min(time) AS duration, coalesce(sum(d), 0.0) * 1000 AS length, "
    f"{category_sql('max(w)')} AS category, coalesce(sum(w * w * dt) FILTER (WHERE w >= 63.0/3.6), 0.0) * 2 * 3.778529496e-4 AS ACE, coalesce(sum(w * w * w * dt), 0.0) * 43200 AS PDI, max(w) AS max_surface_wind, min(p) AS min_sea_level_pressure FROM m GROUP BY track_id), "
    f"g AS (SELECT *, {region_sql('start_x', 'start_y', chr(39) + 'unknown' + chr(39), 1)} AS region_name, CAST(1 + track_id % 3 AS INTEGER) AS year FROM c)"
)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclones.tc_classify(tracks(spark, sf_dir)).withColumn("year", (1 + F.col("track_id") % 3).cast("int"))


@query(f"WITH {CLASSES} SELECT track_id, round(start_time, 6) + 0.0 AS start_time, start_x, start_y, round(duration, 6) + 0.0 AS duration, round(length, 0) + 0.0 AS length, CAST(category AS INTEGER) AS category, round(ACE, 6) + 0.0 AS ACE, round(PDI / 1e6, 6) + 0.0 AS PDI, round(max_surface_wind, 6) + 0.0 AS max_surface_wind, round(min_sea_level_pressure, 6) + 0.0 AS min_sea_level_pressure, region_name FROM g")
def tc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    c = c.withColumns({"PDI": F.col("PDI") / 1e6})
    c = rounded(c, ["start_time", "duration", "ACE", "PDI", "max_surface_wind", "min_sea_level_pressure"]).withColumn("length", r("length", 0))
    return c.select("track_id", "start_time", "start_x", "start_y", "duration", "length", "category", "ACE", "PDI", "max_surface_wind", "min_sea_level_pressure", "region_name")


@query(f"WITH {CLASSES} SELECT year, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE category = {c}) AS cat_{c}" for c in range(6)) + " FROM g GROUP BY year")
def tc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclones.tc_summary(classified(spark, sf_dir))


@query(f"WITH {CLASSES}, h AS (SELECT *, CASE WHEN start_y < 0 THEN 'SH' ELSE 'NH' END AS hemisphere FROM g) SELECT year, 'region' AS level, region_name AS area, count(*) AS storms, round(sum(ACE), 5) + 0.0 AS ACE, round(sum(PDI) / 1e6, 5) + 0.0 AS PDI FROM h GROUP BY 1, 3 UNION ALL SELECT year, 'hemisphere', hemisphere, count(*), round(sum(ACE), 5) + 0.0, round(sum(PDI) / 1e6, 5) + 0.0 FROM h GROUP BY 1, 3 UNION ALL SELECT year, 'global', 'all', count(*), round(sum(ACE), 5) + 0.0, round(sum(PDI) / 1e6, 5) + 0.0 FROM h GROUP BY 1")
def tc_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cyclones.tc_activity(classified(spark, sf_dir))
    return a.withColumns({"ACE": r("ACE", 5), "PDI": r(F.col("PDI") / 1e6, 5)})


@query(f"WITH {CLASSES} SELECT year, 'category' AS kind, CAST(CAST(category AS INTEGER) AS VARCHAR) AS value, count(*) AS storms FROM g GROUP BY 1, 3 UNION ALL SELECT year, 'region', region_name, count(*) FROM g GROUP BY 1, 3 UNION ALL SELECT year, 'hemisphere', CASE WHEN start_y < 0 THEN 'SH' ELSE 'NH' END, count(*) FROM g GROUP BY 1, 3 UNION ALL SELECT year, 'month', CAST(CAST(1 + track_id % 12 AS INTEGER) AS VARCHAR), count(*) FROM g GROUP BY 1, 3")
def tc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclones.tc_counts(classified(spark, sf_dir).withColumn("month", (1 + F.col("track_id") % 12).cast("int")))


@query(f"WITH {TRACKS} SELECT CAST(CASE WHEN w < 10 THEN 0 WHEN w >= 60 THEN 21 ELSE floor((w - 10) / 2.5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM k GROUP BY 1")
def wind_radii_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclones.histogram(tracks(spark, sf_dir), "surface_wind", 10.0, 60.0, 20)


@query(f"WITH {TRACKS} SELECT track_id, round(time, 6) + 0.0 AS time, CAST({category_sql('w')} AS INTEGER) AS category FROM k")
def saffir_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("track_id", r("time").alias("time"), geometry.classify_mps(F.col("surface_wind")).cast("int").alias("category"))


_BINS, _RADIUS, _CRITICAL = 8, 40.0, [17.5, 33.0]
RADII = (
    f"{MESH}, s AS (SELECT range AS storm_id, range * 5 AS step, CAST(60 + range * 17 AS DOUBLE) AS sx, CAST(-20 + range * 3 AS DOUBLE) AS sy FROM range(12)), b AS (SELECT storm_id, least(CAST(floor(sqrt(pow(x - sx, 2) + pow(y - sy, 2)) / {_RADIUS / _BINS}) AS INTEGER), {_BINS - 1}) AS bin, sqrt(pow(v / 1000, 2) + pow(u, 2)) AS w FROM s JOIN mesh USING (step) WHERE sqrt(pow(x - sx, 2) + pow(y - sy, 2)) <= {_RADIUS}), "
    f"p AS (SELECT storm_id, bin, avg(w) AS w FROM b GROUP BY 1, 2), f AS (SELECT s.storm_id, n.range AS bin, coalesce(w, 0.0) AS w FROM (SELECT DISTINCT storm_id FROM p) s CROSS JOIN range({_BINS}) n LEFT JOIN p ON p.storm_id = s.storm_id AND p.bin = n.range), "
    f"e AS (SELECT *, max(w) OVER (PARTITION BY storm_id) AS peak, lag(w) OVER (PARTITION BY storm_id ORDER BY bin) AS w1 FROM f), k AS (SELECT storm_id, max(peak) AS peak, min(bin) FILTER (WHERE w = peak) AS pb FROM e GROUP BY 1)"
)


def _radius_sql(c: float, name: str) -> str:
    width = _RADIUS / _BINS
    return f"round(coalesce((SELECT (e.bin - 0.5) * {width} + (e.w1 - {c}) / (e.w1 - e.w) * {width} FROM e WHERE e.storm_id = k.storm_id AND e.bin >= k.pb AND e.bin > 0 AND e.w < {c} AND k.peak > {c} ORDER BY e.bin LIMIT 1), 0.0), 6) + 0.0 AS {name}"


@query(f"WITH {RADII} SELECT storm_id, {_radius_sql(_CRITICAL[0], 'wind_radius_0')}, {_radius_sql(_CRITICAL[1], 'wind_radius_1')}, round((pb + 0.5) * {_RADIUS / _BINS}, 6) + 0.0 AS peak_radius, round(peak, 6) + 0.0 AS peak_wind_speed FROM k")
def tc_wind_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).withColumn("a", F.col("v") / 1000)
    s = spark.range(12).select(F.col("id").alias("storm_id"), (F.col("id") * 5).alias("step"), (F.lit(60) + F.col("id") * 17).cast("double").alias("lon"), (F.lit(-20) + F.col("id") * 3).cast("double").alias("lat"))
    out = cyclones.wind_radii(s, m, "a", "u", _RADIUS, bins=_BINS, critical=_CRITICAL)
    return rounded(out, ["wind_radius_0", "wind_radius_1", "peak_radius", "peak_wind_speed"])


@query()
def tc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir).select("step", "time", "j", "i", "y", "x", (F.col("v") / 1e8).alias("850mb_vorticity"), (F.lit(101500.0) - F.col("v") / 20).alias("sea_level_pressure"), "u", (F.col("u") + 250).alias("core_temperature"), (F.col("v") / 100).alias("thickness"))
    o = cyclones.CandidateOptions(max_core_radius=20.0, vorticity_window=50.0, max_pressure_radius=20.0, max_core_temperature_radius=20.0, max_thickness_radius=20.0)
    return cyclones.tc_candidates(m, wind="u", options=o)


def _storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select(
        F.floor(F.col("t") * 4).cast("long").alias("step"), (F.floor(F.col("t") * 4) / 4.0).alias("time"), F.col("event_id").cast("int").alias("storm_id"), "lon", "lat", (F.col("value") / 3).alias("surface_wind"), F.lit(2e-4).alias("850mb_vorticity"),
        F.lit(99000.0).alias("sea_level_pressure"), F.lit(1).alias("have_core_temp"), F.lit(1).alias("have_thickness"), F.lit(1.0).alias("core_temp"), F.lit(50.0).alias("thickness"),
    )


@query()
def tc_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclones.tc_trajectory(_storms(spark, sf_dir), max_daily_distance=20000.0, min_wind_duration=0.5)


@query()
def tc_trajectory_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default reach: few candidates of the next step are near."""
    return cyclones.tc_trajectory(_storms(spark, sf_dir), max_daily_distance=1600.0, min_wind_duration=0.5)


# Functions of dates and runs -----------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days, CAST(year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AS INTEGER) AS leap, date_diff('day', DATE '1600-03-01', CAST(o_orderdate AS DATE)) + 584388 AS number FROM orders")
def calendar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"))
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    return o.select("o_orderkey", calendars.days_in_month(y, m, "standard").alias("days"), calendars.is_leap_year(y, "standard").cast("int").alias("leap"), calendars.gregorian_number(y, m, d).alias("number"))


@query(f"WITH {POINTS}, k AS (SELECT user_id, event_id, floor(value / 50) AS level FROM points), n AS (SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM n")
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("value") / 50).alias("level"))
    return coordinates.consecutive_groups(p, "level", ["event_id"], ["user_id"], "run").drop("level")


# Python-backed operators -----------------------------------------------------------------------------------


@query()
def potential_intensity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = levels(spark, sf_dir)
    m = m.withColumns({"t": F.lit(300.0) - 0.0008 * (100000 - F.col("z")) - F.coalesce("w", F.lit(0.0)) * 0.1, "r": F.lit(0.016) * F.exp(-(100000 - F.col("z")) / 25000.0), "sst": F.lit(301.0) - F.abs("y") * 0.05, "psl": F.lit(101300.0)})
    return potential_intensity(m, "sst", "psl", "t", mixing_ratio="r")


QUERIES["potential_intensity"] = QUERIES.pop("potential_intensity_query")


@query(f"WITH {MESH} SELECT step, j, i, round(v / 2 + 1, 6) + 0.0 AS score FROM mesh")
def model_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = programmable.model_inference(mesh(spark, sf_dir), lambda: lambda x: x / 2 + 1, "v", "score")
    return rounded(out.select("step", "j", "i", "score"), ["score"])


@query("SELECT o_orderpriority AS priority, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY 1")
def programmable_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("top"), F.lit(1).cast("long").alias("n"))

    def combine(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([a, b])
        return pd.DataFrame({"priority": [both["priority"].iloc[0]], "top": [both["top"].max()], "n": [both["n"].sum()]})

    def first(p: pd.DataFrame) -> pd.DataFrame:
        return p.groupby("priority", as_index=False).agg(top=("top", "max"), n=("n", "sum"))

    return programmable.programmable_reduce(o, first, combine, "priority string, top double, n long", ["priority"])


@query(f"WITH {MESH} SELECT min(step) AS min_step, max(step) AS max_step, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x, count(DISTINCT step) AS n_steps, count(*) AS n_cells FROM mesh")
def metadata_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.describe(mesh(spark, sf_dir)).select("min_step", "max_step", "min_y", "max_y", "min_x", "max_x", "n_steps", "n_cells")


@query("WITH d AS (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS step, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT DISTINCT step, lpad(CAST(step // 128 AS VARCHAR), 6, '0') AS blocks, strftime(day, '%Y-%m') AS months, (year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END) || '-' || CASE (month(day) % 12) // 3 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END AS seasons FROM d")
def writer_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir).select("step", "time").distinct()
    key = lambda layout: meshes.layout_key(layout, 128, 0, UNITS, "standard")
    return d.select("step", key("number_of_steps").alias("blocks"), key("monthly").alias("months"), key("seasonal").alias("seasons"))

