import datetime as dt

import numpy as np
import pandas as pd
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from isobar.functions.geometry import Polygon
from isobar.plans import applications, queries
from isobar.sources import meshes
from isobar.streaming import reductions


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, sf, duck, name):
    a = queries.QUERIES[name](spark, sf).toPandas()
    b = duck.execute(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    keys = [c for c in cols if a[c].dtype.kind != "f"] + [c for c in cols if a[c].dtype.kind == "f"]
    a, b = (d[cols].sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b, check_exact=True)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert out.schema == queries.QUERIES[name](spark, sf).schema
    assert out.count() >= 0


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_detection_pipeline(spark):
    y, x = np.linspace(-20, 20, 41), np.linspace(0, 359, 360)
    parts = []
    for s in range(12):
        dx, dy = x[None, :] - 100 - 0.5 * s, y[:, None] - 12
        r2 = dx**2 + dy**2
        spin = 40 * np.exp(-r2 / 8)
        j, i = (a.ravel() for a in np.meshgrid(np.arange(41), np.arange(360), indexing="ij"))
        f = {"us": -spin * dy / 2, "vs": spin * dx / 2, "psl": 101000 - 4000 * np.exp(-r2 / 6), "t5": 280 + 5 * np.exp(-r2 / 6), "t2": 280 + 5 * np.exp(-r2 / 6), "z1": np.zeros_like(r2), "z2": 4000 + 200 * np.exp(-r2 / 6)}
        parts.append(pd.DataFrame({"step": s, "time": s * 0.25, "j": j, "i": i, "y": y[j], "x": x[i], **{k: v.ravel() for k, v in f.items()}}))
    m = spark.createDataFrame(pd.concat(parts))
    tracks = applications.tc_detect(m, "us", "vs", "us", "vs", "psl", ("t5", "t2"), ("z1", "z2"), "days since 2000-08-01", "noleap")
    rows = tracks.collect()
    assert len(rows) == 12 and {r["track_id"] for r in rows} == {0} and rows[0]["month"] == 8
    stats = applications.tc_statistics(tracks.drop("year", "month", "day", "hour", "minute"), "days since 2000-08-01", "noleap")
    assert stats["classified"].first()["region_name"] == "NWP" and stats["summary"].first()["total"] == 1 and stats["activity"].count() == 3
    radii = applications.wind_radii_tracks(tracks, m.withColumn("time", F.col("time")), "us", "vs", critical=[17.5])
    assert radii.count() == 12 and applications.wind_radii_statistics(radii, ["wind_radius_0"]).agg(F.sum("n")).first()[0] == 12


def test_river_and_reduction_pipelines(spark):
    wet = lambda x, y, z, t: F.when((x > 100) & (x < 160) & (y > 20) & (y < 40), 0.02).otherwise(0.001)
    m = meshes.mesh_source(spark, 36, 19, 3, 2, (0.0, 350.0, -90.0, 90.0, 100000.0, 80000.0, 0.0, 1.0), {"q": wet, "u": lambda x, y, z, t: F.lit(20.0), "v": lambda x, y, z, t: F.lit(5.0)})
    params = pd.DataFrame([(10.0, 99.4, 1.0), (15.0, 99.5, 1.0)], columns=["hwhm_latitude", "min_water_vapor", "min_component_area"])
    ar = applications.bayesian_ar(m, "u", "v", "q", params)
    inside = (F.col("x") > 100) & (F.col("x") < 160) & (F.col("y") > 20) & (F.col("y") < 40)
    assert ar.where(inside & (F.col("ar_binary_tag") == 1)).count() > 0 and ar.where(~inside & (F.col("ar_binary_tag") == 1)).count() == 0
    assert applications.moisture_flux(m, "u", "v", "q", [Polygon((50.0, 200.0, 200.0, 50.0), (0.0, 0.0, 60.0, 60.0))]).count() == 2
    flat = applications.vapor_transport(m, "u", "v", "q")
    assert applications.reduce_in_time(flat, ["ivt"], "50th_percentile", "all", "days since 2000-01-01", "noleap").count() == 36 * 19
    assert applications.reduce_in_time(flat, ["ivt"], "average", "daily", "days since 2000-01-01", "noleap").count() == 2 * 36 * 19
    assert applications.water_vapor(m, "q").count() == 2 * 36 * 19
    cut = applications.restripe(flat, {"ivt": "transport"}, x=(0.0, 90.0))
    assert "transport" in cut.columns and cut.agg(F.max("x")).first()[0] <= 90
    assert applications.convert_table(flat, "ivt > 100000").count() == 0
    spans = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 4.0)], "event string, start double, end double")
    assert tuple(applications.profile(spans).first())[1:] == (2, 4.0, 2.0, 3.0)


def test_streams(spark, tmp_path):
    rows = [(n, "ab"[n % 2], dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), float(n)) for n in range(72)]
    spark.createDataFrame(rows, "n int, k string, t timestamp, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, k string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = reductions.windowed_reduction(stream, "t", "1 day", ["v"], "average", ["k"]).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("windows").where("k = 'a'").orderBy("start").collect()
    assert [r["v"] for r in got] == [11.0, 35.0, 59.0] and [r["n"] for r in got] == [12] * 3
    q = reductions.track_energy(stream, "k", "t", "v", 60.0).writeStream.format("memory").queryName("energy").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("energy").where("k = 'a'").orderBy(F.desc("points")).first()
    assert last["points"] == 36 and last["energy"] == pytest.approx(sum(v * v * 2 / 24 for v in range(60, 72, 2)))


def test_trajectories_link_all_events(spark, tmp_path):
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * n), 7, "t", 90.0, "") for n in range(91, 99)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    out = queries.QUERIES["tc_trajectory"](spark, str(tmp_path)).collect()
    assert sorted(r["storm_id"] for r in out) == list(range(91, 99)) and {r["track_id"] for r in out} == {0}


def test_potential_intensity_covers_the_mesh(spark, sf):
    out = queries.QUERIES["potential_intensity"](spark, sf).select("step", "j", "i", "IFL").collect()
    assert len(out) == len({tuple(r)[:3] for r in out}) == 7 * queries.NJ * queries.NI
    assert sum(r["IFL"] == 1 for r in out) > len(out) / 2
