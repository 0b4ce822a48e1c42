import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions.geometry import Polygon
from isobar.sources import catalogue, meshes, netcdf3, shapes, tables


def test_typed_csv_round_trip(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('# a comment\n"step(8)", "lon(11)","name(13)","n(3)"\n0, 1.5,"a, b",3\n1, -2.25,"c",-4\n')
    df = tables.read_typed_csv(spark, str(folder))
    assert [f.dataType.simpleString() for f in df.schema] == ["decimal(20,0)", "float", "string", "int"]
    assert [(int(r["step"]), r["lon"], r["name"], r["n"]) for r in df.orderBy("step").collect()] == [(0, 1.5, "a, b", 3), (1, -2.25, "c", -4)]
    out = str(tmp_path / "out.csv")
    tables.write_table(df, out)
    again = tables.read_table(spark, out, original_ids=["step"])
    assert again.select(df.columns).exceptAll(df).count() == 0 and {r[0] for r in again.select("original_ids").collect()} == {0, 1}
    with pytest.raises(ValueError):
        tables.parse_header("no codes, here")
    with pytest.raises(ValueError):
        tables.parse_header('"a(99)"')
    bad = tmp_path / "bad.csv"
    bad.write_text('"n(3)"\nx\n')
    with pytest.raises(Exception):  # noqa: B017
        tables.read_typed_csv(spark, str(bad)).collect()


def test_tables_in_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(n, n * 0.5) for n in range(20)], "n int, v double")
    tables.write_database({"a": df, "b": df.limit(3)}, str(tmp_path / "db"))
    assert tables.read_table(spark, str(tmp_path / "db/a"), index_column="n").count() == 20
    p = tables.read_parameters(spark, str(tmp_path / "db/a"), 5, 3)
    assert sorted(r["n"] for r in p.collect()) == [5, 6, 7] and tables.read_parameters(spark, str(tmp_path / "db/a"), 18).count() == 2
    tables.write_table(df, str(tmp_path / "t.nc"))
    with open(tmp_path / "t.nc", "rb") as f:
        h = netcdf3.read_header(f)
        assert h.dims == {"row": 20} and netcdf3.read_slab(f, h, h.variables["v"]).tolist() == [n * 0.5 for n in range(20)]


def cube(path, t0, nt=3):
    a = np.arange(nt * 2 * 3 * 4, dtype=float).reshape(nt, 2, 3, 4) + 100 * t0
    a[0, 0, 0, 0] = 1e20
    netcdf3.write_file(
        str(path), {"time": nt, "lev": 2, "lat": 3, "lon": 4},
        {
            "time": (("time",), np.arange(t0, t0 + nt, dtype=float), {"units": "days since 2000-01-01", "calendar": "noleap"}), "lev": (("lev",), np.array([1000.0, 500.0]), {}),
            "lat": (("lat",), np.array([-10.0, 0.0, 10.0]), {}), "lon": (("lon",), np.array([0.0, 90.0, 180.0, 270.0]), {}), "T": (("time", "lev", "lat", "lon"), a, {"_FillValue": 1e20}), "ps": (("time", "lat", "lon"), a[:, 0].astype(np.float32), {}),
        },
    )
    return a


def test_netcdf_source(spark, tmp_path):
    a, b = cube(tmp_path / "f_0.nc", 0), cube(tmp_path / "f_1.nc", 3)
    netcdf3.register(spark)
    load = lambda **o: spark.read.format("netcdf3").options(path=str(tmp_path), files_regex=r"f_\d\.nc$", variables="T,ps", z_axis_variable="lev", steps_per_partition="2", **o).load()
    df = load()
    assert df.count() == 6 * 24 and df.rdd.getNumPartitions() == 4
    got = df.where("step = 4").orderBy("k", "j", "i").collect()
    assert [r["T"] for r in got] == b[1].ravel().tolist() and got[0]["time"] == 4.0 and got[23]["x"] == 270.0 and got[0]["z"] == 1000.0
    assert [r["ps"] for r in got] == pytest.approx(np.broadcast_to(b[1, 0], (2, 3, 4)).ravel().tolist())
    assert df.where("T is null").count() == 2
    assert sorted(r[0] for r in load(first_step="1", last_step="3").select("step").distinct().collect()) == [1, 2, 3]
    same = netcdf3.read_anywhere(spark, str(tmp_path / "f_0.nc"), ["T"], z="lev")
    assert [r["T"] for r in same.where("step = 1").orderBy("k", "j", "i").collect()] == a[1].ravel().tolist()
    axis = catalogue.read_time_axis(spark, f"file://{tmp_path}").orderBy("time").collect()
    assert [r["time"] for r in axis] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and axis[0]["calendar"] == "noleap"
    assert netcdf3.read_arrays(spark, str(tmp_path / "f_0.nc"), ["ps"]).where("step = 2").first()["ps"] == pytest.approx(a[2, 0].ravel().tolist())
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n")
    with pytest.raises(ValueError, match="HDF5"), open(tmp_path / "h.nc", "rb") as f:
        netcdf3.read_header(f)


class Counting:
    """A file that counts the bytes read of it."""

    def __init__(self, path):
        self.f, self.n = open(path, "rb"), 0

    def read(self, n=-1):
        out = self.f.read(n)
        self.n += len(out)
        return out

    def seek(self, *a):
        return self.f.seek(*a)

    def tell(self):
        return self.f.tell()


def test_bounds_of_coordinates(spark, tmp_path):
    cube(tmp_path / "f_0.nc", 0), cube(tmp_path / "f_1.nc", 3)
    netcdf3.register(spark)
    load = lambda text: spark.read.format("netcdf3").options(path=str(tmp_path), variables="T,ps", z_axis_variable="lev", steps_per_partition="2", bounds=text).load()
    every = load("").collect()
    plain = {"y > -5": lambda r: r["y"] > -5, "x >= 90; x < 270": lambda r: 90 <= r["x"] < 270, "z = 500": lambda r: r["z"] == 500, "step > 2": lambda r: r["step"] > 2, "time <= 4.0": lambda r: r["time"] <= 4}
    key = lambda rows: sorted(map(str, rows))
    for names in [*([n] for n in plain), ["y > -5", "x >= 90; x < 270"], ["step > 2", "z = 500"], list(plain)]:
        assert key(load("; ".join(names)).collect()) == key(r for r in every if all(plain[n](r) for n in names)), names
    assert load("step > 2").rdd.getNumPartitions() == 2 and load("y > 99").count() == 0
    for bad in ("T > 1", "y ! 3", "y > a"):
        with pytest.raises(ValueError, match="bounds"):
            netcdf3.bounds(bad)


def test_excluded_rows_levels_and_steps_are_not_read(tmp_path):
    netcdf3.write_file(
        str(tmp_path / "w.nc"), {"time": 10, "lev": 5, "lat": 50, "lon": 40},
        {"time": (("time",), np.arange(10.0), {}), "lev": (("lev",), np.arange(5.0), {}), "lat": (("lat",), np.arange(50.0), {}), "lon": (("lon",), np.arange(40.0), {}), "T": (("time", "lev", "lat", "lon"), np.random.default_rng(0).normal(size=(10, 5, 50, 40)), {})},
    )

    def taken(*tests):
        f = Counting(tmp_path / "w.nc")
        h = netcdf3.read_header(f)
        f.n = 0
        rows = sum(b.num_rows for b in netcdf3.cells(f, h, ["T"], "time", "lev", "lat", "lon", 0, range(10), tests=tests))
        return rows, f.n - 8 * (10 + 5 + 50 + 40)  # without the axes

    assert taken() == (100_000, 800_000)
    assert taken(("y", "<", 5.0)) == (10_000, 80_000)
    assert taken(("y", ">=", 10.0), ("y", "<", 20.0), ("z", "=", 3.0), ("step", "<", 2)) == (2 * 10 * 40, 2 * 10 * 40 * 8)
    assert taken(("time", ">", 8.5), ("x", "<", 4.0)) == (5 * 50 * 4, 80_000), "rows are read whole"
    assert taken(("x", "<", -1.0)) == (0, 0)


def test_catalogue_reads_headers_and_axes_once(spark, tmp_path):
    data, kept = tmp_path / "in", f"file://{tmp_path}/kept"
    data.mkdir()
    wide = {"time": (("time",), np.arange(3.0), {"units": "days since 2000-01-01"}), "big": (("time", "cell"), np.zeros((3, 200_000)), {})}
    netcdf3.write_file(str(data / "a.nc"), {"time": 3, "cell": 200_000}, wide)
    netcdf3.write_file(str(data / "b.nc"), {"time": 3, "cell": 200_000}, {**wide, "time": (("time",), np.arange(3.0, 6.0), {})})
    got = {r["file"][-4:]: r for r in catalogue.catalogue(spark, str(data), kept).collect()}
    assert [got[f]["times"] for f in ("a.nc", "b.nc")] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    assert got["a.nc"]["units"] == "days since 2000-01-01" and got["b.nc"]["units"] == "" and got["a.nc"]["variables"] == ["time", "big"]
    for r in got.values():
        assert r["size"] > 4_000_000 and r["bytes_read"] <= 3 * catalogue.READ_BYTES
    # Nothing is opened again while name, size and date are the same; a changed file is.
    count = lambda: spark.read.parquet(kept).count()
    assert catalogue.catalogue(spark, str(data), kept).count() == 2 and count() == 2
    netcdf3.write_file(str(data / "b.nc"), {"time": 1, "cell": 2}, {"time": (("time",), np.array([9.0]), {}), "big": (("time", "cell"), np.zeros((1, 2)), {})})
    again = {r["file"][-4:]: r["times"] for r in catalogue.catalogue(spark, str(data), kept).collect()}
    assert again == {"a.nc": [0.0, 1.0, 2.0], "b.nc": [9.0]} and count() == 3
    (data / "b.nc").unlink()
    assert catalogue.catalogue(spark, str(data), kept).count() == 1
    assert catalogue.catalogue(spark, str(data), kept, files_regex="none").count() == 0


def test_scans_are_planned_from_the_catalogue(spark, tmp_path, monkeypatch):
    for n in range(4):
        cube(tmp_path / f"f_{n}.nc", 3 * n)
    kept = str(tmp_path.parent / f"{tmp_path.name}-kept")
    catalogue.catalogue(spark, str(tmp_path), kept)
    own = {"path": str(tmp_path), "variables": "T", "z_axis_variable": "lev", "bounds": "time >= 4; time < 6"}
    opened = []
    monkeypatch.setattr(netcdf3, "read_header", lambda f: opened.append(f) or 1 / 0)
    blocks = netcdf3.NetCDF3Reader({**own, "catalogue": kept}).partitions()
    assert [(b.path[-6:], b.first_step, b.low, b.high) for b in blocks] == [("f_1.nc", 3, 0, 3)] and not opened
    monkeypatch.undo()
    netcdf3.register(spark)
    load = lambda **o: sorted(map(tuple, spark.read.format("netcdf3").options(**own, **o).load().collect()), key=str)
    assert load(catalogue=kept) == load() and len(load()) == 2 * 2 * 3 * 4
    cube(tmp_path / "f_4.nc", 4)  # unknown to the catalogue: its header is read
    assert len(load(catalogue=kept)) == 2 * 2 * 2 * 3 * 4


def test_record_dimensions_and_staggered_grids(spark, tmp_path):
    # a record variable: the count of records is in the header, records follow one another
    raw = bytearray(b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">2i", 10, 2))
    for name, n in (("Time", 0), ("west_east_stag", 3)):
        raw += struct.pack(">i", len(name)) + name.encode() + b"\0" * (-len(name) % 4) + struct.pack(">i", n)
    raw += struct.pack(">2i", 0, 0) + struct.pack(">2i", 11, 1) + struct.pack(">i", 1) + b"U\0\0\0" + struct.pack(">3i", 2, 0, 1) + struct.pack(">2i", 0, 0) + struct.pack(">2i", 6, 24)
    raw += struct.pack(">i", len(raw) + 4) + struct.pack(">6d", *range(6))
    (tmp_path / "u.nc").write_bytes(bytes(raw))
    u = netcdf3.read_staggered(spark, str(tmp_path / "u.nc"), ["U"])["U"].orderBy("step", "i").collect()
    assert [r["U"] for r in u] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and u[0]["centering"] == "i" and u[-1]["step"] == 1


def test_export_and_layouts(spark, tmp_path):
    m = meshes.mesh_source(spark, 4, 3, 2, 90, (0.0, 3.0, 0.0, 2.0, 0.0, 1.0, 0.0, 89.0), {"f": lambda x, y, z, t: x + t})
    keyed = m.withColumn("file", meshes.layout_key("monthly", units="days since 2000-01-01", calendar="360_day"))
    done = netcdf3.export(keyed, str(tmp_path / "nc"), ["f"])
    assert sorted(r["steps"] for r in done.collect()) == [30, 30, 30]
    netcdf3.register(spark)
    back = spark.read.format("netcdf3").options(path=str(tmp_path / "nc"), variables="f", z_axis_variable="lev").load()
    assert back.select("step", "k", "j", "i", "f").exceptAll(m.select("step", "k", "j", "i", "f")).count() == 0 and back.count() == m.count()
    meshes.write_mesh(m, str(tmp_path / "pq"), "number_of_steps", ["f"], first_step=10, last_step=49, steps_per_file=20, spatial=(2, 2))
    read = meshes.read_mesh(spark, str(tmp_path / "pq"), steps=(20, 25), variables=["f"])
    assert read.count() == 6 * 24 and {p.name for p in (tmp_path / "pq").glob("file=*")} == {"file=000000", "file=000001"}
    assert "PushedFilters: [IsNotNull(step), GreaterThanOrEqual(step,20), LessThanOrEqual(step,25)]" in read._jdf.queryExecution().toString()
    assert meshes.time_axis(m).count() == 90 and meshes.describe(m).first()["n_steps"] == 90
    with pytest.raises(ValueError):
        meshes.layout_key("hourly")


CONFIG = r"""
# a federation
data_root = /data
[cf_reader]
regex = %data_root%/hus.*\.nc$
variables = hus
provides_time
provides_geometry
[cf_reader]
name = winds
regex = %data_root%/ua.*\.nc$
variables = ua, va
"""


def test_federation(spark):
    a, b = meshes.parse_config(CONFIG)
    assert a.regex == r"/data/hus.*\.nc$" and a.provides_time and b.key == "winds" and b.variables == ["ua", "va"] and not b.provides_geometry
    with pytest.raises(ValueError):
        meshes.parse_config("[cf_reader]\nregex = x\n")
    m = meshes.mesh_source(spark, 3, 2, 1, 2, fields={"hus": lambda x, y, z, t: x, "ua": lambda x, y, z, t: y, "va": lambda x, y, z, t: t})
    out = meshes.federate([(a, m.drop("ua", "va")), (b, m.drop("hus"))])
    assert out.count() == 12 and {"hus", "ua", "va", "x", "y", "time"} <= set(out.columns)
    with pytest.raises(Exception, match="differs"):
        meshes.federate([(a, m.drop("ua", "va")), (b, m.drop("hus").withColumn("y", F.col("y") + 1))]).collect()
    assert meshes.dataset_source(spark, [[(1,)], [(2,), (3,)]], "v int").groupBy("dataset").count().count() == 2


def test_shapefiles_and_vtk(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 10, 10, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    raw = struct.pack(">i", 9994) + b"\0" * 96 + struct.pack(">2i", 1, len(body) // 2) + body
    (tmp_path / "box.shp").write_bytes(raw)
    polygons = shapes.read_shapefile(spark, str(tmp_path / "box.shp"))
    assert polygons == [Polygon(tuple(p[0] for p in ring), tuple(p[1] for p in ring))]
    m = meshes.mesh_source(spark, 5, 5, 1, 1, (-5.0, 15.0, -5.0, 15.0), {"f": lambda x, y, z, t: x})
    assert shapes.shape_file_mask(m, polygons).agg(F.sum("mask")).first()[0] == 2, "edges are half open"
    with pytest.raises(ValueError):
        shapes.parse_shapefile(b"nope")
    text = shapes.to_vtk(m, ["f"], 0)
    assert "DIMENSIONS 5 5 1" in text and len(text.splitlines()[-1].split()) == 25


def test_tables_are_never_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "NETCDF_ROWS", 5)
    with pytest.raises(ValueError, match="more than 5 rows"):
        tables.write_table(spark.range(6), str(tmp_path / "t.nc"))
    tables.write_table(spark.range(5), str(tmp_path / "t.nc"))
