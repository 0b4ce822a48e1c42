"""Files that appear whole or not at all, and reductions over arrivals."""

import os

import pytest
from pyspark.sql import functions as F

from isobar.sources import mesh_files, meshes, netcdf3, shapes
from isobar.streaming import arrivals


def grid(spark, steps=6):
    m = meshes.mesh_source(spark, 4, 3, 2, steps, (0.0, 30.0, -10.0, 10.0, 0.0, 1.0, 0.0, steps - 1.0), {"v": lambda x, y, z, t: x + 100 * y + 1000 * z + t})
    return m.withColumn("v", F.when((F.col("i") == 1) & (F.col("step") == 2), None).otherwise(F.col("v")))


def held(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith(".")) if os.path.isdir(folder) else []


def scan(spark, folder):
    netcdf3.register(spark)
    got = spark.read.format("netcdf3").options(path=str(folder), variables="v", z_axis_variable="lev").load()
    return sorted((r.step, r.k, r.j, r.i, r.time, r.z, r.y, r.x, r.v) for r in got.select("step", "k", "j", "i", "time", "z", "y", "x", "v").collect())


def rows(df):
    return sorted((r.step, r.k, r.j, r.i, r.time, r.z, r.y, r.x, r.v) for r in df.collect())


def key(out):
    return [tuple(-1.0 if v is None else v for v in r) for r in out]


@pytest.mark.parametrize("uri", ["", "file://", "file:"])
def test_netcdf_files_read_equal(spark, tmp_path, uri):
    folder = tmp_path / "out"
    mesh_files.write_files(grid(spark), f"{uri}{folder}", ["v"], steps_per_file=4)
    assert held(folder) == ["000000.nc", "000001.nc", "_SUCCESS"]
    assert key(scan(spark, folder)) == key(rows(grid(spark)))


def test_vtk_files_equal_the_text_of_a_step(spark, tmp_path):
    mesh_files.write_files(grid(spark, 3), str(tmp_path / "out"), ["v"], "vtk")
    assert held(tmp_path / "out") == ["000000_000000.vtk", "000000_000001.vtk", "000000_000002.vtk", "_SUCCESS"]
    for s in range(3):
        assert (tmp_path / "out" / f"000000_{s:06d}.vtk").read_text() == shapes.to_vtk(grid(spark, 3), ["v"], s)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = grid(spark).withColumn("v", F.when(F.col("step") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        mesh_files.write_files(bad, str(tmp_path / "out"), ["v"], steps_per_file=1)
    assert held(tmp_path / "out") == []


def test_a_task_that_fails_after_files_were_staged_leaves_none(spark, tmp_path):
    # the second file of the only task fails while the first is already written
    m = grid(spark, 2).withColumn("file", F.when(F.col("step") == 0, "a")).select("file", *mesh_files.INDEX, "v")
    mesh_files.register(spark)
    with pytest.raises(Exception, match="names no file"):
        m.coalesce(1).sortWithinPartitions("step").write.format("mesh_files").options(variables="v").mode("append").save(str(tmp_path / "out"))
    assert held(tmp_path / "out") == []


def test_rows_of_a_file_in_several_tasks_are_refused(spark, tmp_path):
    m = grid(spark).withColumn("file", F.lit("a")).select("file", *mesh_files.INDEX, "v")
    mesh_files.register(spark)
    with pytest.raises(Exception, match="several tasks"):
        m.repartition(3, "step").write.format("mesh_files").options(variables="v").mode("append").save(str(tmp_path / "out"))
    assert held(tmp_path / "out") == []


def test_append_refuses_what_is_there_and_overwrite_replaces_it(spark, tmp_path):
    folder = str(tmp_path / "out")
    mesh_files.write_files(grid(spark), folder, ["v"], steps_per_file=2)
    before = scan(spark, folder)
    with pytest.raises(Exception, match="already there"):
        mesh_files.write_files(grid(spark, 2).withColumn("v", F.lit(0.0)), folder, ["v"], steps_per_file=2)
    assert key(scan(spark, folder)) == key(before)
    assert held(folder) == ["000000.nc", "000001.nc", "000002.nc", "_SUCCESS"]
    mesh_files.write_files(grid(spark, 2), folder, ["v"], steps_per_file=2, overwrite=True)
    assert held(folder) == ["000000.nc", "_SUCCESS"]
    assert key(scan(spark, folder)) == key(rows(grid(spark, 2)))


def test_an_empty_mesh_writes_no_file(spark, tmp_path):
    mesh_files.write_files(grid(spark).where("step > 99"), str(tmp_path / "out"), ["v"])
    assert held(tmp_path / "out") == ["_SUCCESS"]


def test_unknown_kinds_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="unknown kind"):
        mesh_files.write_files(grid(spark), str(tmp_path / "out"), ["v"], "hdf")


def arrive(spark, base, values):
    spark.createDataFrame(values, "t long, c string, v double").select(F.timestamp_seconds("t").alias("time"), "c", "v").coalesce(1).write.mode("append").parquet(f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    arrivals.reduce_arrivals(spark, f"{base}/landing", schema, f"{base}/out", f"{base}/checkpoint", "time", "1 day", ["v"], "summation", ["c"], "2 days")
    got = arrivals.reduced_so_far(spark, f"{base}/out", ["c"]).select(F.expr("unix_seconds(start) div 86400").alias("day"), "c", "v", "n")
    return sorted(tuple(r) for r in got.collect())


def test_arrivals_go_on_from_the_last_call(spark, tmp_path):
    day = 86400
    assert arrive(spark, tmp_path, [(0, "a", 1.0), (5, "a", 2.0), (day, "b", 4.0)]) == [(0, "a", 3.0, 2), (1, "b", 4.0, 1)]
    # an open interval of the first call is changed by the second
    assert arrive(spark, tmp_path, [(9, "a", 8.0), (9 * day, "b", None)]) == [(0, "a", 11.0, 3), (1, "b", 4.0, 1), (9, "b", None, 1)]
    # nothing new: the same; later than the watermark (day 9 less 2): left out
    assert arrive(spark, tmp_path, []) == [(0, "a", 11.0, 3), (1, "b", 4.0, 1), (9, "b", None, 1)]
    assert arrive(spark, tmp_path, [(10, "a", 100.0), (9 * day, "b", 7.0)]) == [(0, "a", 11.0, 3), (1, "b", 4.0, 1), (9, "b", 7.0, 2)]
