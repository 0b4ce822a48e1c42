import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.functions.geometry import EQUATOR_KM, MEAN_M, Polygon
from isobar.model import attributes, block_distribute, space_time_distribute, with_attributes
from isobar.operators import components as comp
from isobar.operators import cyclones, graph, pointwise, programmable, stencil, table, temporal, vertical
from isobar.operators.potential_intensity import EPS, RD, capes, potential_intensities, potential_intensity, saturation_pressure
from isobar.sources import meshes
from plain_potential_intensity import cape, potential_intensity_of

# Tables


def test_positional_join_and_unlike_lengths(spark):
    t = [spark.createDataFrame([(v, n) for n, v in enumerate(c)], f"`{name}` {kind}, __o{q} int") for q, (name, kind, c) in enumerate([("col 1", "double", [1.0, 2.0, 3.0]), ("col 2", "int", [3, 2, 1]), ("col 3", "float", [3.1415, -3.1415, 2.718])])]
    out = table.join_by_position(t, [["__o0"], ["__o1"], ["__o2"]]).orderBy("row_id").select("col 1", "col 2").collect()
    assert [tuple(r) for r in out] == [(1.0, 3), (2.0, 2), (3.0, 1)]
    with pytest.raises(Exception, match="unlike length"):
        table.join_by_position([t[0], t[1].limit(2)], [["__o0"], ["__o1"]]).collect()


def test_numbering_sorting_and_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), F.col("id")).repartition(5)
    got = table.numbered(df, ["v", "id"]).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(1000)) and [r["v"] for r in got] == sorted(r["v"] for r in got)
    assert [r["v"] for r in table.row_range(df, ["v"], 10, 12).orderBy("v").collect()] == [10, 11, 12]
    assert table.sort(df, 0, ascending=False).first()["v"] == 999


def test_rows_columns_and_unions(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c")], "x double, s string")
    assert sorted(r["s"] for r in table.remove_rows(df, "x > 1d").collect()) == ["a", "c"]
    assert table.evaluate_expression(df, "x * 2d", "y", remove_dependent_variables=True).columns == ["s", "y"]
    with pytest.raises(ValueError):
        table.concatenate([df, df.drop("s")])
    assert table.concatenate_by_position([df, df.toDF("p", "q")]).count() == 6
    assert "x" in table.to_text(df, "head", "foot")


def test_statistics_by_hand(spark):
    values = [5.0, 1.0, 4.0, 2.0, 3.0, 9.0, 7.0]
    r = table.descriptive_statistics(spark.createDataFrame([(0, 0.5, v) for v in values] + [(0, 0.5, None)], "step int, time double, v double"), ["v"]).first()
    s = sorted(values)
    n = len(s)
    assert (r["low_q_v"], r["med_v"], r["up_q_v"]) == (s[n // 4], s[n // 2], s[3 * n // 4])
    assert r["var_v"] == pytest.approx(np.var(values)) and (r["min_v"], r["max_v"]) == (1.0, 9.0)


def test_order_statistics_without_a_sort(spark):
    """Many rows against a coarse sketch; ties, skew, nulls, null groups, groups without values, other types."""
    rng = np.random.default_rng(5)
    n = 60_000
    p = pd.DataFrame({"g": rng.integers(0, 3, n), "a": np.exp(rng.normal(0, 9, n)), "b": rng.integers(0, 5, n).astype(np.int32), "c": rng.integers(0, 1 << 60, n), "d": rng.normal(size=n).astype(np.float32)})
    df = spark.createDataFrame(p).repartition(7).withColumns({"g": F.when(F.col("g") < 2, F.col("g")), "a": F.when(F.rand(3) > 0.1, F.col("a")), "b": F.col("b").cast("int"), "d": F.col("d").cast("float"), "e": F.lit(None).cast("double")})
    df = df.unionByName(spark.createDataFrame([(9, 1.5, 2, 3, 0.5, None)], "g long, a double, b int, c long, d float, e double"))
    df.write.parquet(path := str(spark.conf.get("spark.checkpoint.dir")) + "/statistics")
    df = spark.read.parquet(path)
    held = df.toPandas()
    for accuracy in (40, table.ACCURACY):
        got = table.descriptive_statistics(df, list("abcde"), ["g"], accuracy)
        assert [f.dataType.typeName() for f in got.schema.fields if f.name.startswith("med_")] == ["double", "integer", "long", "float", "double"]
        rows = {r["g"]: r for r in got.collect()}
        assert set(rows) == {0, 1, 9, None}
        for g, r in rows.items():
            own = held[held["g"].isna() if g is None else held["g"] == g]
            for v in "abcd":
                s = sorted(own[v].dropna().tolist())
                assert [r[f"{q}_{v}"] for q in ("low_q", "med", "up_q")] == [s[len(s) * k // 4] for k in (1, 2, 3)], (g, v, accuracy)
            assert r["med_e"] is None and r["min_e"] is None


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), "y"), (3, 3.0, None)], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, float("nan"), "z"), (4, 3.0, None)], "k int, v double, s string")
    got = {(r["k"], r["column"], r["status"]) for r in table.dataset_diff(a, b, ["k"]).collect()}
    assert got == {(2, "s", "value"), (3, None, "left only"), (4, None, "right only")}
    table.assert_same(a, a, ["k"])
    with pytest.raises(AssertionError):
        table.assert_same(a, b, ["k"])


# Meshes


def grid(spark, f, nx=12, ny=9, nt=1, nz=1, bounds=(0.0, 330.0, -40.0, 40.0, 0.0, 0.0, 0.0, 0.0)):
    return meshes.mesh_source(spark, nx, ny, nz, nt, bounds, f)


def field(df, name, ny, nx, step=0):
    p = df.where(F.col("step") == step).select("j", "i", name).toPandas()
    out = np.full((ny, nx), np.nan)
    out[p["j"], p["i"]] = p[name]
    return out


def test_pointwise(spark):
    m = grid(spark, {"u": lambda x, y, z, t: x, "v": lambda x, y, z, t: y})
    assert pointwise.l2_norm(m, ["u", "v"]).where(F.abs(F.col("l2_norm") - F.hypot("u", "v")) > 1e-9).count() == 0
    assert pointwise.mask(m, ["u"], 0.0, 100.0).where("u is null").select("i").distinct().count() == 4
    half = pointwise.latitude_damper(m, ["u"], 20.0).where("y = 20 and u > 0").select(F.col("u_damped") / F.col("u"))
    assert all(r[0] == pytest.approx(0.5) for r in half.collect())
    packed = with_attributes(m, "u", scale_factor=2.0, add_offset=1.0, _FillValue=90.0)
    assert attributes(packed, "u")["scale_factor"] == 2.0
    assert pointwise.unpack(packed).where(F.col("u") != F.col("x") * 2 + 1).count() == 0
    assert pointwise.missing_to_null(packed, ["u"]).where("u is null").select("x").distinct().collect() == [(90.0,)]
    assert pointwise.valid_value_mask(packed, ["u"]).where("u_valid = 0").count() == 9
    with pytest.raises(ValueError):
        pointwise.l2_norm(m, [])
    with pytest.raises(ValueError):
        pointwise.rename_variables(m, {"nope": "x"})


def test_percentile_segmentation_matches_numpy(spark):
    m = grid(spark, {"v": lambda x, y, z, t: (x * 13 + y * 7 + t * 3) % 101}, nt=3, bounds=(0.0, 330.0, -40.0, 40.0, 0.0, 0.0, 0.0, 2.0))
    out = pointwise.binary_segmentation(m, "v", 70.0, 95.0, by_percentile=True)
    for s in range(3):
        v, g = field(out, "v", 9, 12, s), field(out, "segments", 9, 12, s)
        assert (g == ((v >= np.percentile(v, 70)) & (v <= np.percentile(v, 95)))).all()


def test_vorticity_of_solid_rotation(spark):
    m = grid(spark, {"u": lambda x, y, z, t: F.cos(F.radians(y)), "v": lambda x, y, z, t: F.lit(0.0)}, nx=36, ny=41, bounds=(0.0, 350.0, -40.0, 40.0))
    w = field(stencil.vorticity(m, "u", "v", periodic=True), "vorticity", 41, 36)
    y = np.linspace(-40, 40, 41)
    assert np.allclose(w[1:-1], (np.sin(np.radians(y)) / MEAN_M)[1:-1, None], atol=1e-10)
    assert np.allclose(w[0], w[1]) and np.allclose(w[-1], w[-2])
    flat = field(stencil.vorticity(m, "u", "v"), "vorticity", 41, 36)
    assert np.allclose(flat, w)


def test_laplacian_periodic_and_ends(spark):
    m = grid(spark, {"f": lambda x, y, z, t: F.cos(F.radians(x))}, nx=72, ny=5, bounds=(0.0, 355.0, -10.0, 10.0))
    v = field(stencil.laplacian(m, "f", periodic=True), "laplacian", 5, 72)
    x = np.radians(np.linspace(0, 355, 72))
    assert np.isnan(v[0]).all() and np.allclose(v[2], -np.cos(x) / MEAN_M**2, rtol=2e-3, atol=1e-17)


def test_cell_areas_tile_the_sphere_and_filter(spark):
    m = grid(spark, {"c": lambda x, y, z, t: F.when(x < 100, 7).when(x < 105, 9).otherwise(0)}, nx=73, ny=37, bounds=(0.0, 360.0, -90.0, 90.0))
    m = m.withColumn("c", F.col("c").cast("int"))
    a = stencil.component_area(m, "c")
    got = {r["label"]: r["area"] for r in a.collect()}
    band = 2 * np.pi * EQUATOR_KM**2 * (2 * np.sin(np.radians(87.5)))
    assert sum(got.values()) == pytest.approx(band * 71 / 72)
    kept = stencil.component_area_filter(m, a, low=got[9] * 1.5, component="c")
    assert {r[0] for r in kept.select("c").distinct().collect()} == {0, 7}


def test_faces_levels_subset_and_axes(spark):
    m = grid(spark, {"f": lambda x, y, z, t: x + 10 * y + 100 * z}, nx=4, ny=3, nz=2, bounds=(0.0, 3.0, 0.0, 2.0, 0.0, 1.0))
    for way, add, n in (("x", 0.5, 18), ("y", 5.0, 16), ("z", 50.0, 12)):
        out = stencil.face_to_cell(m.withColumn("g", F.col("f")), ["f"], way)
        assert out.count() == n and out.where(F.abs(F.col("f") - F.col("g") - add) > 1e-9).count() == 0
    assert stencil.subset(m, x=(1.0, 2.0), z=(1.0, 1.0)).count() == 6
    assert stencil.subset(m, x=(1.2, 1.8), cover=True, axes_values={"x": [0.0, 1.0, 2.0, 3.0]}).select("i").distinct().count() == 2
    n = stencil.normalize_coordinates(m.withColumn("x", F.col("x") - 2).withColumn("y", -F.col("y")), shift_x=True, convert_pressure=True)
    assert [r["x"] for r in n.select("i", "x").distinct().orderBy("i").collect()] == [0.0, 1.0, 358.0, 359.0]
    assert [r["y"] for r in n.select("j", "y").distinct().orderBy("j").collect()] == [-2.0, -1.0, 0.0]
    assert stencil.coordinate_transform(m, {"x": ((0.0, 3.0), (10.0, 40.0))}, {"x": "lon"}).agg(F.max("lon")).first()[0] == 40.0


def test_regrid_is_exact_for_bilinear_fields(spark):
    m = grid(spark, {"f": lambda x, y, z, t: 2 * x + 3 * y + 1 + x * y}, nx=11, ny=9, bounds=(0.0, 10.0, -4.0, 4.0))
    t = grid(spark, None, nx=7, ny=5, bounds=(0.3, 10.0, -4.0, 3.7)).select("j", "i", "y", "x")
    out = stencil.regrid(m, t, ["f"])
    assert out.count() == 35 and out.where(F.abs(F.col("f") - (2 * F.col("x") + 3 * F.col("y") + 1 + F.col("x") * F.col("y"))) > 1e-9).count() == 0
    deep = grid(spark, {"f": lambda x, y, z, t: x + 2 * y + 3 * z + x * z}, nx=5, ny=4, nz=3, bounds=(0.0, 4.0, 0.0, 3.0, 0.0, 20.0))
    levels = grid(spark, None, nx=3, ny=3, nz=4, bounds=(0.5, 4.0, 0.0, 2.5, 1.0, 20.0)).select("k", "j", "i", "z", "y", "x")
    own = stencil.regrid(deep, levels, ["f"])
    assert own.count() == 36 and own.where(F.abs(F.col("f") - (F.col("x") + 2 * F.col("y") + 3 * F.col("z") + F.col("x") * F.col("z"))) > 1e-9).count() == 0
    near = stencil.regrid(m, t, ["f"], "nearest").where("x = 10").select("y", "f").orderBy("y").first()
    assert near["f"] == 2 * 10 + 3 * -4 + 1 - 40
    w = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 2, 2.0)], "row int, col int, s double")
    src = spark.createDataFrame([(0, c, float(c)) for c in range(3)], "step int, cell int, v double")
    assert {r["row"]: r["v"] for r in stencil.sparse_remap(src, w, ["v"], mask=spark.createDataFrame([(0, 1), (1, 0)], "row int, valid int")).collect()} == {0: 0.5, 1: None}


# Components


def flood(mask, periodic):
    """Labels by flood fill in raster order."""
    out = np.zeros(mask.shape, int)
    n = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            k, j, i = todo.pop()
            for dk in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    for di in (-1, 0, 1):
                        q = (k + dk, j + dj, (i + di) % mask.shape[2] if periodic else i + di)
                        if all(0 <= a < b for a, b in zip(q, mask.shape, strict=True)) and mask[q] and not out[q]:
                            out[q] = n
                            todo.append(q)
    return out


@pytest.mark.parametrize("periodic", [False, True])
def test_labels_equal_flood_fill(periodic):
    rng = np.random.default_rng(4)
    for density in (0.1, 0.3, 0.5):
        for shape in ((1, 12, 17), (3, 8, 9)):
            mask = (rng.random(shape) < density).astype(np.int8)
            assert (comp.label(mask, periodic) == flood(mask, periodic)).all()
    assert comp.label(np.zeros((1, 3, 3), np.int8)).max() == 0


def test_components_and_probability(spark):
    m = grid(spark, {"v": lambda x, y, z, t: F.when((x > 150) & (x < 220) & (F.abs(y) < 25), 10.0 + t).otherwise(F.lit(1.0))}, nx=36, ny=17, nt=2, bounds=(0.0, 350.0, -40.0, 40.0, 0.0, 0.0, 0.0, 1.0))
    seg = pointwise.binary_segmentation(m, "v", 5.0)
    out = comp.connected_components(seg)
    assert out.where("(component = 1) <> (v > 5)").count() == 0
    params = pd.DataFrame([(2.0, 80.0, 1.0), (2.0, 80.0, 1e12)], columns=["hwhm_latitude", "min_water_vapor", "min_component_area"])
    p = comp.bayesian_ar_detect(m, params, "v")
    assert set(r[0] for r in p.select("ar_probability").distinct().collect()) == {0.0, 0.5}
    assert [r["ar_counts"] for r in p.where("ar_counts is not null").collect()] == [[2, 0]] * 2, "damping parts the block at the equator"


# Integrals


@pytest.mark.parametrize("down", [False, True])
def test_vapor_transport_of_a_linear_profile(spark, down):
    b = (0.0, 10.0, 0.0, 10.0, *((100000.0, 0.0) if down else (0.0, 100000.0)))
    m = grid(spark, {"q": lambda x, y, z, t: F.lit(0.01), "u": lambda x, y, z, t: z / 1000, "v": lambda x, y, z, t: F.lit(2.0)}, nx=2, ny=2, nz=101, bounds=b)
    r = vertical.integrated_vapor_transport(m, "u", "v", "q", magnitude="ivt").first()
    assert r["ivt_u"] == pytest.approx(0.01 * 100000**2 / 2000 / 9.80665) and r["ivt_v"] == pytest.approx(2000 / 9.80665) and r["ivt"] == pytest.approx(np.hypot(r["ivt_u"], r["ivt_v"]))
    first = vertical.integrated_vapor_transport(m, "u", "v", "q", trapezoid=False, surface_pressure=100000.0).first()
    assert first["ivt_v"] == pytest.approx(2000 / 9.80665)
    holes = m.withColumn("q", F.when(F.col("k") != 50, F.col("q")))
    assert vertical.integrated_water_vapor(holes, "q").first()["iwv"] == pytest.approx(0.01 * 98000 / 9.80665)


def test_lapse_rate_and_surface_integrals(spark):
    m = grid(spark, {"t": lambda x, y, z, t: 300 - 0.0065 * z, "h": lambda x, y, z, t: z, "s": lambda x, y, z, t: F.lit(1500.0)}, nx=2, ny=2, nz=12, bounds=(0.0, 1.0, 0.0, 1.0, 0.0, 11000.0))
    assert vertical.lapse_rate(m, "t", "h", "s").first()["lapse_rate"] == pytest.approx(-0.0065)
    g = grid(spark, {"f": lambda x, y, z, t: F.lit(1.0), "zero": lambda x, y, z, t: F.lit(0.0), "r": lambda x, y, z, t: (x < 180).cast("int")}, nx=361, ny=181, bounds=(0.0, 360.0, -90.0, 90.0))
    half = vertical.surface_integral(g, ["f"], "r").first()
    assert half["net_regional_f"] == pytest.approx(2 * np.pi * 4.068015961e13, rel=0.02)
    assert vertical.regional_moisture_flux(g, "f", "zero", "r").first()["moisture_flux"] == pytest.approx(0.0, abs=1e-6)
    assert vertical.vertical_reduction(m, {"top": F.max("z")}).count() == 4


# Time


def test_reductions_of_sines_in_a_360_day_calendar(spark):
    m = grid(spark, {"f": lambda x, y, z, t: 3 + F.sin(2 * np.pi * t / 30) + x}, nx=2, ny=1, nt=720, bounds=(0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 719.0))
    units, kind = "days since 1980-01-01", "360_day"
    out = temporal.temporal_reduction(m, ["f"], "average", "monthly", units, kind)
    assert out.count() == 48 and out.where(F.abs(F.col("f") - 3 - F.col("i")) > 1e-9).count() == 0
    assert temporal.temporal_reduction(m, ["f"], "summation", "yearly", units, kind).where("i = 0").select(F.round("f", 6)).distinct().collect() == [(1080.0,)]
    seasons = temporal.temporal_reduction(m, ["f"], "maximum", "seasonal", units, kind)
    assert sorted(r[0] for r in seasons.select("interval").distinct().collect()) == [19801, 19802, 19803, 19810, 19811, 19812, 19813]
    blocks = temporal.temporal_reduction(m, ["f"], "minimum", "n_steps", n_steps=100)
    assert sorted(r[0] for r in blocks.select("interval").distinct().collect()) == list(range(7))
    holes = m.withColumn("f", F.when(F.col("step") % 2 == 0, F.col("f")))
    assert temporal.temporal_reduction(holes, ["f"], "average", "all").count() == 2
    temporal.register_operator("spread", lambda v: F.max(v) - F.min(v))
    assert temporal.temporal_reduction(m, ["f"], "spread", "all").first()["f"] == pytest.approx(2 * np.sin(np.radians(84)), abs=1e-9)
    p = temporal.temporal_percentile(m, ["f"], 90.0, "all").where("i = 0").first()["f"]
    assert p == pytest.approx(np.percentile(3 + np.sin(2 * np.pi * np.arange(720) / 30), 90))
    with pytest.raises(ValueError):
        temporal.with_interval(m, "weekly", units, kind)


def test_windows_match_numpy(spark):
    v = np.random.default_rng(5).normal(size=30)
    df = spark.createDataFrame([(0, 0, s, float(x)) for s, x in enumerate(v)], "j int, i int, step int, v double")
    series = lambda d: [r["v"] for r in d.orderBy("step").collect()]
    assert np.allclose(series(temporal.simple_moving_average(df, ["v"], 3)), [v[max(0, n - 2) : n + 1].mean() for n in range(30)])
    w = temporal.kernel("gaussian", 5)
    assert sum(w) == pytest.approx(1) and w[0] == w[4] and sum(temporal.kernel("constant", 5, True)) == pytest.approx(0)
    assert np.allclose(series(temporal.time_axis_convolution(df, ["v"], w)), np.convolve(v, w[::-1], "valid"))
    back = temporal.time_axis_convolution(df, ["v"], [0.2, 0.3, 0.5], "backward")
    assert [r["step"] for r in back.orderBy("step").collect()] == list(range(2, 30)) and series(back)[0] == pytest.approx(0.2 * v[0] + 0.3 * v[1] + 0.5 * v[2])
    with pytest.raises(ValueError):
        temporal.simple_moving_average(df, ["v"], 4, "centered")


def test_spectral_filter_parts_two_waves(spark):
    n = 256
    t = np.arange(n)
    slow, fast = np.sin(2 * np.pi * t * 4 / n), np.sin(2 * np.pi * t * 64 / n)
    df = spark.createDataFrame([(0, 0, int(s), float(a)) for s, a in zip(t, slow + fast, strict=True)], "j int, i int, step int, v double")
    got = [r[0] for r in temporal.spectral_filter(df, ["v"], "low_pass", 16 / n / 3600, 3600.0).orderBy("step").select("v_low_pass").collect()]
    assert np.abs(np.array(got) - slow).max() < 0.05
    high = [r[0] for r in temporal.spectral_filter(df, ["v"], "high_pass", 16 / n / 3600, 3600.0, 8.0).orderBy("step").select("v_high_pass").collect()]
    assert np.abs(np.array(high) - fast).max() < 0.1


# Cyclones

CANDIDATES = "step long, time double, storm_id int, lon double, lat double, surface_wind double, `850mb_vorticity` double, sea_level_pressure double, have_core_temp int, have_thickness int, core_temp double, thickness double"


def candidates(points):
    return [(s, s * 0.25, n, float(x), float(y), float(w), 2e-4, 99000.0, 1, 1, 1.0, 60.0) for s, n, x, y, w in points]


def test_trajectories(spark):
    a = [(s, s * 10, 100 + s, 10.0, 30.0) for s in range(12)]
    b = [(s, s * 10 + 1, 200.0, 20.0 + 0.5 * s, 30.0) for s in range(12)]
    weak = [(s, s * 10 + 2, 300.0, -20.0, 5.0) for s in range(12)]
    after = [(s, s * 10, 50.0 + s, 5.0, 30.0) for s in range(20, 32)]
    df = spark.createDataFrame(candidates(a + b + weak + after), CANDIDATES)
    out = cyclones.tc_trajectory(df).toPandas()
    assert sorted(out["track_id"].unique()) == [0, 1, 2] and (out.groupby("track_id").size() == 12).all()
    assert (out[out["track_id"] == 2]["step"] >= 20).all()
    assert out[out["track_id"] == 2]["duration"].iloc[0] == pytest.approx(2.75)
    assert out[out["track_id"] == 0]["duration"].iloc[0] == pytest.approx(5.0), "the walk looks at the step after the gap"
    one = cyclones.link(df.orderBy("step", "storm_id").toPandas(), 1600.0, 17.0, 2.0, 1)
    assert sorted(one["storm_id"]) == sorted(out["storm_id"]) and one.groupby("track_id").size().tolist() == [12, 12, 12]
    assert cyclones.tc_trajectory(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 32])
@pytest.mark.parametrize("seed", [1, 2])
def test_trajectories_equal_one_walk_over_the_whole_series(spark, monkeypatch, most, seed):
    """By components of near candidates (most 32) and by series without gaps (most 0), against the walk over all rows."""
    monkeypatch.setattr(cyclones, "MOST_NEAR", most)
    rng = np.random.default_rng(seed)
    points = []
    for s in [*range(60), *range(63, 90), 95]:
        n = int(rng.integers(0, 9))
        points += [(s, k, round(float(rng.uniform(0, 60)), 1), round(float(rng.choice([rng.uniform(-40, 40), 80.0])), 1), float(rng.uniform(10, 40))) for k in range(n)]
    df = spark.createDataFrame(candidates(points), CANDIDATES).withColumn("time", F.col("time") + F.col("storm_id") / 100)
    args = (2400.0, 17.0, 0.3, 1)
    want = cyclones.link(df.orderBy("step", "storm_id").toPandas(), *args)
    got = cyclones.tc_trajectory(df, *args).toPandas().sort_values(["track_id", "step"]).reset_index(drop=True)
    want = want.sort_values(["track_id", "step"])[list(got.columns)].reset_index(drop=True)
    assert want["track_id"].nunique() > 20
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_trajectories_of_a_year_without_a_gap(spark):
    """1460 steps in one series: chains of near candidates, dealt in many groups."""
    rows = [(s, n, (40 * n + s * 0.4) % 360, 10.0, 30.0) for s in range(1460) for n in range(8) if (s // 50 + n) % 3]
    df = spark.createDataFrame(candidates(rows), CANDIDATES)
    want = cyclones.link(df.orderBy("step", "storm_id").toPandas(), 1600.0, 17.0, 2.0, 1)
    got = cyclones.tc_trajectory(df).toPandas()
    assert want["track_id"].nunique() > 50
    key = lambda t: sorted(zip(t["track_id"], t["step"], t["storm_id"]))
    assert key(got) == key(want)


@pytest.mark.parametrize("most", [0, 3, 32])
def test_trajectories_walked_in_blocks(spark, monkeypatch, most):
    """Dense steps of candidates at few places, many at one place or equally far, some without a coordinate, a wind or a flag, walked in blocks of a step or two."""
    monkeypatch.setattr(cyclones, "MOST_NEAR", most)
    monkeypatch.setattr(cyclones, "WALKED", 100)
    rng = np.random.default_rng(3)
    points = [(s, k, float(rng.integers(0, 12) * 3), float(rng.choice([rng.integers(-8, 9) * 5.0, 90.0])), float(rng.uniform(5, 40))) for s in [*range(12), *range(14, 20)] for k in range(int(rng.integers(30, 90)))]
    rows = [(*r[:3], None if k % 31 == 7 else r[3], r[4], None if k % 29 == 5 else r[5], *r[6:8], None if k % 23 == 3 else int(k % 7 > 0), *r[9:]) for k, r in enumerate(candidates(points))]
    df = spark.createDataFrame(rows, CANDIDATES).withColumn("time", F.col("time") + F.col("storm_id") / 1000)
    args = (4000.0, 17.0, 0.3, 1)
    want = cyclones.link(df.orderBy("step", "storm_id").toPandas(), *args)
    got = cyclones.tc_trajectory(df, *args).toPandas().sort_values(["track_id", "step"]).reset_index(drop=True)
    want = want.sort_values(["track_id", "step"])[list(got.columns)].reset_index(drop=True)
    assert want["track_id"].nunique() > 50
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_trajectories_compare_few_candidates(monkeypatch):
    """Two steps of 3,000 candidates, all in reach of each other: lists and walk look at few of the 9,000,000 pairs and take what a walk over all does."""
    rng, looked, n = np.random.default_rng(4), [], 3000
    rows = [(s, s * 0.25, k, float(rng.uniform(0, 360)), float(rng.uniform(-90, 90)), 30.0, 2e-4, 99000.0, 1, 1, 1.0, 60.0) for s in range(2) for k in range(n)]
    both = pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in CANDIDATES.split(", ")])
    want = cyclones.link(both, 200000.0, 17.0, 0.25, 1).groupby("track_id")["storm_id"].agg(list)
    plain = cyclones._distance
    monkeypatch.setattr(cyclones, "_distance", lambda *a: looked.append(d := plain(*a)) or d)
    steps = [pa.Table.from_pandas(both[both["step"] == s].assign(next_step=1.0 if s == 0 else np.nan, next_time=0.25 if s == 0 else np.nan), preserve_index=False) for s in range(2)]
    others = [steps[1].select(["lon", "lat"]).rename_columns(["to_lon", "to_lat"]), pa.table({"to_lon": pa.array([], pa.float64()), "to_lat": pa.array([], pa.float64())})]
    out = cyclones._walk(pa.concat_tables([cyclones._near(a, b, 200000.0, 1, 32) for a, b in zip(steps, others, strict=True)]), 17.0, 1, 200000.0).to_pandas()
    tracks = out.sort_values("step").groupby(["first_step", "first_at"])["storm_id"].agg(list).loc[0]
    assert tracks.tolist() == want.tolist()
    assert sum(d.size for d in looked) < n * n / 10


@pytest.fixture
def partitions_as_they_are(spark):
    """As where tables are large: small partitions are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_near_trajectories_in_many_partitions(spark, partitions_as_they_are):
    """Candidates that have a few others in reach each, nearly all of them linked: the rounds that looked for components did not settle."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(candidates([(s, k, float(rng.uniform(0, 40)), float(rng.uniform(-20, 20)), 30.0) for s in range(20) for k in range(60)]), CANDIDATES)
    want = cyclones.link(df.orderBy("step", "storm_id").toPandas(), 1600.0, 17.0, 0.5, 1)
    got = cyclones.tc_trajectory(df, min_wind_duration=0.5).toPandas()
    key = lambda t: sorted(zip(t["track_id"], t["step"], t["storm_id"], t["storm_speed"]))
    assert want["track_id"].nunique() > 50 and key(got) == key(want)


def test_components_settle_in_many_partitions(spark, partitions_as_they_are):
    path = np.random.default_rng(1).permutation(200).tolist()
    links = [(a, b) for n, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True)) if n % 50 != 49]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(4), rounds=12).collect()}
    assert got == dict(zip(*(x.tolist() for x in graph.roots(*np.array(links).T)), strict=True)) and len(set(got.values())) == 4


@pytest.mark.parametrize("kind", ["even", "lattice", "crowded", "pole", "meridian"])
def test_nearest_places(kind):
    """Lists against all distances; reaches of nothing, of some and of everything."""
    rng = np.random.default_rng(7)
    for n, m, most in [(40, 150, 8), (40, 150, 0), (30, 20, 32), (5, 1, 3), (5, 0, 3), (60, 400, 1)]:
        sides = []
        for k in (n, m):
            lon, lat = rng.uniform(0, 360, k), rng.uniform(-90, 90, k)
            if kind == "lattice":
                lon, lat = np.floor(lon / 30) * 30, np.round(lat / 10) * 10
            elif kind == "crowded":
                lon, lat = np.where(rng.random(k) < 0.9, 100 + lon * 1e-7, lon), np.where(rng.random(k) < 0.9, lat * 1e-7, lat)
            elif kind == "pole":
                lat = np.where(rng.random(k) < 0.5, 90.0, lat)
            elif kind == "meridian":
                lon[:] = 7.0
            sides.append((np.radians(lon), np.radians(lat)))
        (x, y), (to_x, to_y, _) = sides[0], cyclones._places(*sides[1])
        reach = rng.choice([-1.0, 0.0, 100.0, 3000.0, 1e9], n)
        dist, place, more = cyclones._nearest(x, y, reach, to_x, to_y, most)
        for i in range(n):
            d = cyclones._distance(x[i], y[i], to_x, to_y)
            near = np.flatnonzero(d <= reach[i])
            near = near[np.argsort(d[near], kind="stable")]
            want = near[d[near] < d[near[most]]] if len(near) > most else near
            got = place[i][dist[i] < np.inf]
            assert sorted(got) == sorted(want) and (d[got] == d[want]).all() and more[i] == (len(near) > most)


@pytest.mark.parametrize("tile, periodic", [((1, 1), True), ((3, 4), True), ((3, 4), False), ((5, 100), True), ((100, 2), False)])
def test_labels_do_not_depend_on_tiles(spark, tile, periodic):
    rng = np.random.default_rng(hash(tile) % 1000)
    rows = [
        (s, float(s), k, j + 2, i + s, None if v < 0.05 else int(v > 0.82), "kept")
        for s, share in ((-3, 0.0), (0, 0.0), (7, 1.0), (8, -1.0))
        for k in range(1 + (s == 0))
        for j in range(7)
        for i in range(9)
        for v in [np.clip(rng.random() + share, 0, 1)]
    ]
    df = spark.createDataFrame(rows, "step long, time double, k long, j long, i long, segments int, extra string").repartition(3)
    whole = sorted(map(tuple, comp.connected_components(df, periodic_x=periodic).collect()), key=str)
    tiled = comp.connected_components(df, periodic_x=periodic, tile=tile)
    assert sorted(map(tuple, tiled.collect()), key=str) == whole and tiled.schema["component"].dataType.typeName() == "integer"
    assert len({r[-1] for r in whole if r[0] == 0}) > 2 and {r[-1] for r in whole if r[0] == 7} == {1}
    flat = df.where("step = 7").drop("k")
    assert comp.connected_components(flat, tile=tile).agg(F.max("component"), F.count("*")).first() == (1, 63)


def test_tiles_of_an_empty_mesh(spark):
    df = spark.createDataFrame([], "step long, j long, i long, segments int")
    assert comp.connected_components(df, tile=(2, 2)).collect() == []
    with pytest.raises(ValueError, match="at least one"):
        comp.connected_components(df, tile=(0, 2))


def test_a_snake_through_all_tiles_is_one_component(spark):
    n = 24
    on = {(j, i) for j in range(0, n, 2) for i in range(n)} | {(j, (n - 1) * (j % 4 == 1)) for j in range(1, n - 1, 2)}
    df = spark.createDataFrame([(0, j, i, int((j, i) in on)) for j in range(n) for i in range(n)], "step long, j long, i long, segments int")
    got = comp.connected_components(df, tile=(3, 3))
    assert got.where("segments = 1").agg(F.min("component"), F.max("component"), F.count("*")).first() == (1, 1, len(on))


def test_components_of_links(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in rng.permutation(300).tolist()]
    links = [*chain, (1000, 2000), (2000, 1000), (3000, 3000), (None, 1), (1500, 1000), *((5000, 5000 + i) for i in range(1, 50))]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1500] == got[2000] == 1000 and 3000 not in got and all(got[5000 + i] == 5000 for i in range(50))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ties_take_the_later_storm():
    rows = candidates([(0, 0, 100, 0, 30), (1, 1, 101, 0, 30), (1, 2, 99, 0, 30)])
    t = pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in CANDIDATES.split(", ")])
    assert cyclones.link(t, 16000.0, 17.0, 0.1, 1)["storm_id"].tolist() == [0, 2]


def test_classification_and_statistics(spark):
    rows = [(1, t / 4, 20.0 + 5 * t, 100000.0 - 100 * t, 300.0 + t, 15.0) for t in range(9)]
    c = cyclones.tc_classify(spark.createDataFrame(rows, "track_id int, time double, surface_wind double, sea_level_pressure double, lon double, lat double")).first()
    w = np.array([r[2] for r in rows])
    assert c["category"] == 4 and c["duration"] == 2.0 and c["region_name"] == "NA" and c["max_surface_wind_x"] == 308.0 and c["min_sea_level_pressure_t"] == 2.0
    assert c["ACE"] == pytest.approx((w[1:-1] ** 2 * 0.5).sum() * 2 * 3.778529496e-4) and c["PDI"] == pytest.approx((w[1:-1] ** 3 * 0.5).sum() * 43200)
    assert c["length"] == pytest.approx(8 * 6371e3 * np.radians(1) * np.cos(np.radians(15)))
    many = spark.createDataFrame([(2000, 1, -1, 5.0, "NA", 1.0, 2.0), (2000, 2, 3, -5.0, "SI", 3.0, 4.0), (2001, 2, 3, -5.0, "SI", 5.0, 6.0)], "year int, month int, category int, start_y double, region_name string, ACE double, PDI double")
    assert [tuple(r)[:2] + (r["cat_3"],) for r in cyclones.tc_summary(many).orderBy("year").collect()] == [(2000, 2, 1), (2001, 1, 1)]
    act = {(r["year"], r["level"], r["area"]): r["ACE"] for r in cyclones.tc_activity(many).collect()}
    assert act[2000, "global", "all"] == 4.0 and act[2000, "hemisphere", "SH"] == 3.0 and act[2001, "region", "SI"] == 5.0 and len(act) == 8
    assert cyclones.tc_counts(many).where("kind = 'region' and value = 'SI'").agg(F.sum("storms")).first()[0] == 2


def test_candidates_find_a_vortex(spark):
    y, x = np.linspace(-30, 30, 61), np.linspace(0, 359, 360)
    r2 = (x[None, :] - 120.4) ** 2 + (y[:, None] - 15.3) ** 2
    bump = np.exp(-r2 / 4)
    f = {"850mb_vorticity": 5e-4 * bump, "sea_level_pressure": 101000 - 4000 * np.exp(-r2 / 6), "surface_wind": 40 * bump, "core_temperature": 280 + 5 * np.exp(-r2 / 6), "thickness": 4000 + 200 * np.exp(-r2 / 6)}
    j, i = (a.ravel() for a in np.meshgrid(np.arange(61), np.arange(360), indexing="ij"))
    p = pd.DataFrame({"step": 3, "time": 0.75, "j": j, "i": i, "y": y[j], "x": x[i], **{k: v.ravel() for k, v in f.items()}})
    out = cyclones.tc_candidates(spark.createDataFrame(p)).collect()
    assert len(out) == 1
    c = out[0]
    assert abs(c["lon"] - 120.4) < 0.1 and abs(c["lat"] - 15.3) < 0.1 and abs(c["sea_level_pressure"] - 97000) < 30
    assert c["have_core_temp"] == c["have_thickness"] == 1 and c["storm_id"] == 30000 and c["surface_wind"] > 35


def test_wind_radii_of_a_cone(spark):
    m = grid(spark, {"u": lambda x, y, z, t: F.greatest(F.lit(0.0), 60 - 8 * F.hypot(x - 100, y)), "v": lambda x, y, z, t: F.lit(0.0)}, nx=401, ny=161, bounds=(80.0, 120.0, -8.0, 8.0))
    s = spark.createDataFrame([(5, 0, 100.0, 0.0)], "storm_id int, step int, lon double, lat double")
    r = cyclones.wind_radii(s, m, "u", "v", critical=[20.0, 99.0]).first()
    assert r["wind_radius_0"] == pytest.approx(5.0, abs=0.15) and r["wind_radius_1"] == 0.0 and r["peak_radius"] < 0.2
    assert cyclones.wind_radii(s, m, "u", "v", core_radius=0.01).first()["peak_radius"] is None
    h = cyclones.histogram(spark.createDataFrame([(0.5,), (1.5,), (1.6,), (9.0,)], "w double"), "w", 0.0, 2.0, 2)
    assert {x["bin"]: x["n"] for x in h.collect()} == {1: 1, 2: 2, 3: 1}


def test_potential_intensity_is_sensible():
    p = np.array([1000, 950, 900, 850, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 70.0])
    t = 27 - 80 * (1 - (p / 1000) ** 0.9) - np.where(p < 300, 0, 0)
    r = 0.8 * 622 * saturation_pressure(t) / (p - saturation_pressure(t))
    v, low, flag, to, otl = potential_intensity_of(29.0, 1010.0, p, t, r)
    assert flag == 1 and 30 < v < 130 and 850 < low < 1010 and 180 < to < 280 and otl < 400
    warmer = potential_intensity_of(30.5, 1010.0, p, t, r)
    assert warmer[0] > v and warmer[1] < low
    assert np.isnan(potential_intensity_of(2.0, 1010.0, p, t, r)[0])


def test_potential_intensity_equals_a_scan_of_pressures():
    p = np.array([1000, 880, 760, 640, 520, 400, 280.0])
    for sst, psl in ((27.85, 1013.0), (26.0, 1013.0), (29.0, 1008.0)):
        tk, r = 300.0 - 0.08 * (1000 - p), 0.016 * np.exp(-(1000 - p) / 250)
        ts = sst + 273.15
        env = cape(tk[0], r[0], p[0], tk, r, p)[0]

        def at(pm):
            pp = min(pm, 1000.0)
            r_sat = EPS * saturation_pressure(sst) / (pp - saturation_pressure(sst))
            wind = cape(tk[0], EPS * r[0] * psl / (pp * (EPS + r[0]) - r[0] * psl), pp, tk, r, p)[0]
            sea, out, _, _ = cape(ts, r_sat, pp, tk, r, p)
            tv = 0.5 * (tk[0] * (1 + r[0] / EPS) / (1 + r[0]) + ts * (1 + r_sat / EPS) / (1 + r_sat))
            gain = 0.9 * ts / out * (sea - wind)
            central = psl * np.exp(-max(wind - env + 0.5 * gain, 0.0) / (RD * tv))
            return central - pm, 0.8 * np.sqrt(max(gain, 0.0)), central

        scan = [at(pm) for pm in np.arange(850.0, psl, 0.25)]
        _, v, low = min(scan, key=lambda x: abs(x[0]))
        got = potential_intensity_of(sst, psl, p, tk - 273.15, r * 1e3)
        assert got[2] == 1 and got[0] == pytest.approx(v, rel=0.01, abs=0.1) and got[1] == pytest.approx(low, abs=1.0)


def soundings(n):
    """Random soundings of 12 levels, some with missing levels, cold seas, dry air or a top that is too warm."""
    rng = np.random.default_rng(3)
    p = np.tile(np.array([1000, 950, 900, 850, 700, 600, 500, 400, 300, 200, 100, 60.0]), (n, 1)) + rng.uniform(-5, 5, (n, 12))
    t = 27 - 85 * (1 - (p / 1000) ** rng.uniform(0.6, 1.1, (n, 1))) + rng.normal(0, 1.0, p.shape)
    r = rng.uniform(0.2, 0.9, (n, 1)) * 622 * saturation_pressure(t) / (p - saturation_pressure(t))
    r[::17] = 0.0
    t[rng.random(p.shape) < 0.03] = np.nan
    r[::23, 2:] = np.nan
    return rng.uniform(3, 31, n), rng.uniform(995, 1020, n), p, t, r


def test_soundings_together_equal_each_alone():
    sst, psl, p, t, r = soundings(400)
    sst[5], psl[9] = np.nan, np.nan
    for options in ({}, {"ascent": 1.0, "dissipative": False}):
        got = potential_intensities(sst, psl, p, t, r, **options)
        with np.errstate(all="ignore"):
            want = [potential_intensity_of(*(a[n] for a in (sst, psl, p, t, r)), **options) for n in range(400)]
        assert [int(f) for f in got[2]] == [w[2] for w in want] and sum(w[2] == 1 for w in want) > 150 and sum(w[2] != 1 for w in want) > 30
        for q in (0, 1, 3, 4):
            np.testing.assert_allclose(got[q], [w[q] for w in want], rtol=1e-9, atol=1e-9)
    assert [len(a) for a in potential_intensities(*(a[:0] for a in (sst, psl, p, t, r)))] == [0] * 5


def test_potential_intensity_of_columns(spark):
    sst, psl, p, t, r = soundings(60)
    rows = [(n, float(k), float(p[n, k] * 100), None if np.isnan(t[n, k]) else float(t[n, k] + 273.15), None if np.isnan(r[n, k]) else float(r[n, k] / 1e3), float(sst[n] + 273.15), float(psl[n] * 100), None if n == 3 else int(n == 4)) for n in range(60) for k in range(12)]
    df = spark.createDataFrame(rows, "i long, k double, z double, t double, r double, sst double, psl double, land int").withColumns({"step": F.lit(0), "j": F.lit(1)})
    got = {x["i"]: x for x in potential_intensity(df, "sst", "psl", "t", mixing_ratio="r", land="land").collect()}
    with np.errstate(all="ignore"):
        want = potential_intensities(sst, psl, p, t, r)
    assert len(got) == 60 and all(got[n]["IFL"] == 0 and got[n]["V_max"] is None for n in (3, 4))
    for n in set(range(60)) - {3, 4}:
        assert got[n]["IFL"] == want[2][n] and (got[n]["V_max"] is None) == np.isnan(want[0][n])
        assert got[n]["V_max"] is None or got[n]["V_max"] == pytest.approx(want[0][n], rel=1e-6)
    assert potential_intensity(df.limit(0), "sst", "psl", "t", mixing_ratio="r").count() == 0


# User operators


def test_user_operators(spark):
    class Double(programmable.Operator):
        def transform(self, df):
            return df.withColumn("v", F.col("v") * 2)

    df = spark.range(100).select((F.col("id") % 4).alias("k"), F.col("id").cast("double").alias("v")).repartition(6)
    assert programmable.Pipeline(Double(), Double())(df).agg(F.sum("v")).first()[0] == 4950 * 4
    one = lambda p: pd.DataFrame({"k": [int(p["k"].iloc[0])], "v": [p["v"].sum()]})
    add = lambda a, b: pd.DataFrame({"k": a["k"], "v": a["v"] + b["v"]})
    by = programmable.programmable_reduce(df, one, add, "k long, v double", ["k"], finalize=lambda p: p.assign(v=p["v"] / 25))
    assert {r["k"]: r["v"] for r in by.collect()} == {k: 48 + k for k in range(4)}
    total = programmable.programmable_reduce(df, one, add, "k long, v double", fan=2).collect()
    assert len(total) == 1 and total[0]["v"] == 4950
    assert programmable.programmable(df, one, "k long, v double", ["k"]).count() == 4
    m = grid(spark, {"v": lambda x, y, z, t: x})
    out = programmable.model_inference(m, lambda: lambda a: a.T, "v", "s", postprocess=lambda a: a.T)
    assert out.where("s <> v").count() == 0
    assert programmable.pad_to_multiple(np.ones((5, 7)), 4).shape == (8, 8)
    with pytest.raises(ValueError):
        programmable.capture(df, 10)
    assert block_distribute(spark.range(20).withColumnRenamed("id", "step"), "step", 2, 10, 3).count() == 3
    assert space_time_distribute(m, 4, 3, 1).count() == m.count()


def test_results_do_not_depend_on_partitions(spark):
    m = grid(spark, {"u": lambda x, y, z, t: x + t, "v": lambda x, y, z, t: y * t}, nt=3, bounds=(0.0, 330.0, -40.0, 40.0, 0.0, 0.0, 0.0, 2.0))
    a = stencil.vorticity(m, "u", "v").toPandas().sort_values(["step", "j", "i"])["vorticity"].to_numpy()
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    b = stencil.vorticity(m.repartition(7), "u", "v").toPandas().sort_values(["step", "j", "i"])["vorticity"].to_numpy()
    spark.conf.set("spark.sql.shuffle.partitions", held)
    assert np.array_equal(a, b, equal_nan=True)
    assert table.region_mask(m, "x", "y", [Polygon((0, 100, 100, 0), (-10, -10, 10, 10))], invert=True).agg(F.sum("mask")).first()[0] < m.count()


def test_a_plateau_of_vorticity_is_one_candidate():
    lat, lon = np.arange(-40.0, 41.0, 4.0), np.arange(0.0, 360.0, 4.0)
    bump = np.exp(-((lat[:, None] - lat[10]) ** 2 + (lon[None, :] - lon[20]) ** 2) / 72)
    o = cyclones.CandidateOptions(max_core_radius=30.0, vorticity_window=30.0, max_pressure_radius=20.0, max_core_temperature_radius=20.0, max_thickness_radius=20.0)
    found = []
    for cells in ([(10, 20)], [(10, 20), (10, 21), (11, 19), (11, 20)]):
        spin = np.full((21, 90), 1e-6)
        for c in cells:
            spin[c] = 1e-2
        found.append(cyclones.detect(lat, lon, 20 * bump, spin, 101500 - 3000 * bump, 250 + 10 * bump, 50 + 100 * bump, o))
    assert len(found[0]) == len(found[1]) == 1


def test_seasons_are_found_on_the_time_axis(spark):
    m = grid(spark, {"v": lambda x, y, z, t: t}, nx=2, ny=2, nt=14, bounds=(0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 390.0))  # days since 2000-01-01
    got = temporal.temporal_reduction(m, ["v"], "average", "seasonal", "days since 2000-01-01", "360_day").select("interval", "v").distinct().collect()
    assert {r["interval"]: r["v"] for r in got} == {20001: 90.0, 20002: 180.0, 20003: 270.0, 20010: 360.0}


@pytest.mark.parametrize("interval", ["daily", "monthly", "seasonal", "yearly", "n_steps", "all"])
def test_intervals_on_a_given_time_axis_equal_those_of_the_cells(spark, interval):
    m = meshes.mesh_source(spark, 2, 2, 1, 400, (0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 20.0, 419.0), {"v": lambda x, y, z, t: x + t})
    args = (["v"], "average", interval, "days since 2001-01-01", "noleap", 30)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    expected = key(temporal.temporal_reduction(m, *args))
    axis = m.select("step", "time").distinct()
    assert key(temporal.temporal_reduction(m, *args, axis=axis)) == expected
    only = "step" if interval == "n_steps" else "time"
    assert key(temporal.temporal_reduction(m, *args, axis=axis.select(only).unionByName(axis.select(only)))) == expected
    assert key(temporal.temporal_reduction(m, *args, axis=axis.limit(0))) == []
    if interval != "all":
        with pytest.raises(ValueError, match="takes a column"):
            temporal.temporal_reduction(m, *args, axis=axis.drop(only))


def test_a_time_axis_spares_the_scan_of_the_cells(spark):
    m = meshes.mesh_source(spark, 2, 2, 1, 400, (0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 399.0), {"v": lambda x, y, z, t: x + t})
    scans = lambda **kw: temporal.temporal_reduction(m, ["v"], "average", "seasonal", "days since 2001-01-01", "noleap", **kw)._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1600")
    axis = spark.createDataFrame([(float(d),) for d in range(400)], "time double")
    assert scans() == 3 and scans(axis=axis) == 1
