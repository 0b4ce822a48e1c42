import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isobar.functions import calendars as cal
from isobar.functions import coordinates as co
from isobar.functions import geometry as geo
from isobar.functions.expressions import ExpressionError, postfix, to_column, variables


def value(spark, text, **columns):
    df = spark.createDataFrame([tuple(columns.values()) or (0,)], list(columns) or ["none"])
    return df.select(to_column(text, df.schema)[0].alias("v")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ** 3 ** 2", 64), ("1 || 0 && 1", 1), ("1i / 2i", 0), ("7i % 3i", 1), ("-7i / 2i", -3), ("1 < 2 && 3 < 2", 1), ("!0 + 1", 2), ("!(1 == 1)", 0),
        ("1 > 2 ? 10 20", 20), ("2 > 1 ? 10 20", 10), ("-1.5e1 + 5", -10), ("4 - -2", 6), ("1 != 2", 1), ("5 >= 5 && 5 <= 5", 1), ("2d ** 0.5d", 2**0.5),
    ],
)
def test_expressions(spark, text, want):
    assert value(spark, text) == pytest.approx(want)


def test_expression_types_nulls_and_ieee(spark):
    assert value(spark, "a / b", a=1.0, b=0.0) == float("inf") and value(spark, "a / b", a=-1.0, b=0.0) == float("-inf")
    assert np.isnan(value(spark, "a / b", a=0.0, b=0.0))
    df = spark.createDataFrame([(1, None)], "a int, b double")
    assert df.select(to_column("a + b", df.schema)[0]).first()[0] is None
    assert to_column("a + 1i", df.schema)[1] == "int" and to_column("a + 1", df.schema)[1] == "float" and to_column("a + 1d", df.schema)[1] == "double"
    assert variables("x * (y - x) > 2") == ["x", "y"]
    assert [t.text for t in postfix("a && b || c")] == ["a", "b", "&&", "c", "||"]


@pytest.mark.parametrize("bad", ["1 +", "(1", "1)", "~1", "a b", "1 ? 2", "@", "- a"])
def test_bad_expressions(bad):
    with pytest.raises(ExpressionError):
        postfix(bad)


CALENDARS = ["standard", "proleptic_gregorian", "gregorian_y0", "julian", "noleap", "360_day"]


@pytest.mark.parametrize("calendar", CALENDARS)
def test_calendars_round_trip(spark, calendar):
    n = spark.range(-400_000, 400_000, 97).select((F.col("id") + 0.25).alias("t"))
    units = "days since 1600-03-01 06:00:00"
    p = cal.decode(F.col("t"), units, calendar)
    back = n.select("t", *(c.alias(k) for k, c in p.items())).withColumn("b", cal.encode(F.col("year"), F.col("month"), F.col("day"), units, calendar, F.col("hour"), F.col("minute"), F.col("second")))
    assert back.where(F.abs(F.col("b") - F.col("t")) > 1e-9).count() == 0
    assert back.where("month not between 1 and 12 or day not between 1 and 31 or hour <> 12 or minute <> 0").count() == 0
    assert back.where(F.col("day") > cal.days_in_month(F.col("year"), F.col("month"), calendar)).where("not (year = 1582 and month = 10)").count() == 0


def test_known_dates(spark):
    def date(offset, units, calendar):
        p = cal.decode(F.lit(float(offset)), units, calendar)
        return tuple(spark.range(1).select(*(p[k] for k in ("year", "month", "day"))).first())

    assert date(0, "days since 1582-10-15", "standard") == (1582, 10, 15)
    assert date(-1, "days since 1582-10-15", "standard") == (1582, 10, 4)
    assert date(-1, "days since 1582-10-15", "proleptic_gregorian") == (1582, 10, 14)
    assert date(59, "days since 2000-01-01", "noleap") == (2000, 3, 1)
    assert date(59, "days since 2000-01-01", "standard") == (2000, 2, 29)
    assert date(59, "days since 2000-01-01", "360_day") == (2000, 2, 30)
    assert date(365, "days since 1900-01-01", "julian") == (1900, 12, 31)
    assert date(-1, "days since 0001-01-01", "proleptic_gregorian")[0] == -1
    assert date(24 * 40, "hours since 1999-12-31 12:00:00", "noleap") == (2000, 2, 9)
    with pytest.raises(ValueError):
        cal.parse_units("fortnights since 2000-01-01")
    with pytest.raises(ValueError):
        cal.canonical("mayan")


@settings(max_examples=30, deadline=None)
@given(st.dates(dt.date(1, 1, 1), dt.date(9999, 12, 31)))
def test_gregorian_number_is_the_ordinal(day):
    # pure arithmetic, held against Python's ordinals through the same formula without Spark
    y, m, d = day.year, day.month, day.day
    y2, mp = y - (m <= 2), (m + 9) % 12
    assert 365 * y2 + y2 // 4 - y2 // 100 + y2 // 400 + (153 * mp + 2) // 5 + d - 1 == day.toordinal() + 305


def test_gregorian_numbers(spark):
    rows = [(1, 1, 1), (1582, 10, 15), (1970, 1, 1), (2000, 2, 29), (2023, 12, 31)]
    df = spark.createDataFrame(rows, "y int, m int, d int").withColumn("n", cal.gregorian_number(F.col("y"), F.col("m"), F.col("d")))
    for r in df.collect():
        assert r["n"] == dt.date(r["y"], r["m"], r["d"]).toordinal() + 305
    ok = spark.createDataFrame([(2001, 2, 29), (2000, 2, 29), (2000, 13, 1)], "y int, m int, d int").select(cal.is_valid_gregorian_date(F.col("y"), F.col("m"), F.col("d")))
    assert [r[0] for r in ok.collect()] == [False, True, False]


def test_seasons_and_strings(spark):
    df = spark.range(1, 13).select("id", cal.season(F.col("id")).alias("s"), cal.season_year(F.lit(2000), F.col("id")).alias("y"))
    got = {r["id"]: (r["s"], r["y"]) for r in df.collect()}
    assert got[12] == ("DJF", 2001) and got[1] == ("DJF", 2000) and got[5][0] == "MAM" and got[8][0] == "JJA" and got[11][0] == "SON"
    text = spark.range(1).select(cal.time_to_string(F.lit(31.5), "days since 2001-01-01", "noleap", "%Y/%m/%d %H:%M:%S")).first()[0]
    assert text == "2001/02/01 12:00:00"


def test_winding_number_against_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = [(float(a), float(b)) for a, b in rng.uniform(-2, 12, (300, 2))]
    star = geo.Polygon((0, 10, 2, 8, 5, 0), (0, 4, 9, -1, 10, 0))

    def wind(px, py):
        total = 0
        for x0, y0, x1, y1 in zip(star.x, star.y, star.x[1:], star.y[1:], strict=False):
            side = (x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)
            total += (y0 <= py < y1 and side >= 0) - (y1 <= py < y0 and side < 0)
        return total

    df = spark.createDataFrame(pts, "x double, y double").withColumn("w", geo.winding_number(F.col("x"), F.col("y"), star))
    assert all(r["w"] == wind(r["x"], r["y"]) for r in df.collect())
    assert geo.Polygon((0, 1, 1), (0, 0, 1)).closed().x == (0, 1, 1, 0)
    assert geo.basin("N Atlantic") == geo.basin("NA") and len(geo.basin("NA")) == 2
    with pytest.raises(ValueError):
        geo.basin("Lake")


def test_categories_and_distance(spark):
    df = spark.createDataFrame([(10.0,), (17.49,), (17.5,), (33.0,), (33.1,), (60.0,), (70.1,), (None,)], "w double")
    assert [r[0] for r in df.select(geo.classify_mps(F.col("w"))).collect()] == [-1, -1, 0, 0, 1, 4, 5, None]
    d = spark.range(1).select(geo.distance_km(F.lit(0.0), F.lit(60.0), F.lit(1.0), F.lit(60.0))).first()[0]
    assert d == pytest.approx(6371 * np.radians(1) * 0.5)
    assert geo.upper_bound_mps(5) == float("inf") and geo.lower_bound_mps(-1) == 0.0 and geo.lower_bound_mps(0) == 17.5


def test_axes(spark):
    axis = [0.0, 1.0, 2.5, 4.0]
    assert co.index_of(axis, 2.6) == 2 and co.index_of(axis, 2.6, lower=False) == 3 and co.index_of(axis[::-1], 2.6) in (0, 1)
    assert co.bounds_to_extent(axis, 0.5, 2.6) == (1, 2) and co.bounds_to_extent(axis, 0.5, 2.6, cover=True) == (0, 3)
    assert co.nearest_index(axis, 0.5) == 0 and co.nearest_index(axis, 0.51) == 1
    with pytest.raises(ValueError):
        co.index_of(axis, 9.0)
    t = spark.createDataFrame([(s, s * 0.5) for s in range(10)], "step long, time double")
    assert co.time_step_of(t, "2000-01-03 06:00:00", "days since 2000-01-01", "standard").first()[0] == 4
    assert co.time_step_of(t, "2000-01-03 06:00:00", "days since 2000-01-01", "standard", lower=False).first()[0] == 5
    assert co.time_step_of(t, "2001-01-01", "days since 2000-01-01", "standard", lower=False, clamp=True).first()[0] == 9
    g = co.consecutive_groups(spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a")], "n int, k string"), "k", ["n"])
    assert [r["group"] for r in g.orderBy("n").collect()] == [0, 0, 1, 2]
    assert spark.range(1).select(co.equal(F.lit(1.0), F.lit(1.0 + 1e-7)), co.equal(F.lit(1.0), F.lit(1.1))).first()[0:2] == (True, False)


@pytest.mark.parametrize("calendar", ["standard", "proleptic_gregorian", "gregorian_y0", "julian", "noleap", "360_day"])
def test_day_numbers_of_known_dates_equal_those_of_columns(spark, calendar):
    dates = [(y, m, d) for y in (1, 4, 100, 1581, 1582, 1583, 1900, 2000, 2024) for m in (1, 2, 3, 10, 12) for d in (1, 4, 15, 28)]
    got = spark.createDataFrame(dates, "y int, m int, d int").select("y", "m", "d", cal.day_number(F.col("y"), F.col("m"), F.col("d"), calendar).alias("n")).collect()
    assert all(r["n"] == cal.day_number_of(r["y"], r["m"], r["d"], calendar) for r in got)
