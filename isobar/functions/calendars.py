"""CF calendars as integer arithmetic on Columns.

A calendar turns an offset in some units ("days since 1979-01-01 00:00:00") into year, month, day, hour,
minute and second, and back. Calendars: standard (gregorian; Julian before 1582-10-15), proleptic_gregorian,
gregorian_y0, julian, noleap (365_day) and 360_day. There is no year 0 but in gregorian_y0; day numbers
count from 0 at 1 January of the calendar's astronomical year 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {
    "standard": "standard", "gregorian": "standard",
    "proleptic_gregorian": "proleptic_gregorian", "gregorian_y0": "gregorian_y0", "proleptic_gregorian_y0": "gregorian_y0",
    "julian": "julian", "proleptic_julian": "julian",
    "noleap": "noleap", "no_leap": "noleap", "365_day": "noleap", "360_day": "360_day",
}
SECONDS = {"second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400}
#: First day of the Gregorian calendar in `standard`.
CUT = (1582, 10, 15)


def canonical(calendar: str) -> str:
    try:
        return NAMES[calendar.lower()]
    except KeyError:
        raise ValueError(f"unknown calendar {calendar}") from None


@dataclass(frozen=True)
class Units:
    seconds: int  # in a unit
    year: int
    month: int
    day: int
    second_of_day: int


def parse_units(units: str) -> Units:
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[T\s]+(\d+)(?::(\d+))?(?::(\d+)(?:\.\d*)?)?)?\s*(?:UTC|Z)?\s*", units)
    if not m or m[1].lower() not in SECONDS:
        raise ValueError(f"cannot read time units {units!r}")
    h, mi, s = (int(x or 0) for x in m.groups()[4:])
    return Units(SECONDS[m[1].lower()], int(m[2]), int(m[3]), int(m[4]), h * 3600 + mi * 60 + s)


def _int(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: Keeps dividends positive: `div` truncates, and a dividend written once keeps nested expressions small.
SHIFT = 4_000_000


def _div(a: Column, b: int) -> Column:
    """Floor division of whole numbers from -SHIFT * b on."""
    return F.call_function("div", a + F.lit(SHIFT * b), F.lit(b)) - SHIFT


def _civil(y: Column, m: Column, d: Column, gregorian: bool) -> Column:
    """Days from 1 March of year 0 (a year that starts in March), by the rule of 153 days in five months."""
    y2 = y - (m <= 2).cast("long")
    mp = F.pmod(m + 9, F.lit(12))
    doy = _div(153 * mp + 2, 5) + d - 1
    days = 365 * y2 + _div(y2, 4) + doy
    return days - _div(y2, 100) + _div(y2, 400) if gregorian else days


def _civil_number(y: int, m: int, d: int, gregorian: bool) -> int:
    """_civil of a date that is known when the plan is made."""
    y2 = y - (m <= 2)
    days = 365 * y2 + y2 // 4 + (153 * ((m + 9) % 12) + 2) // 5 + d - 1
    return days - y2 // 100 + y2 // 400 if gregorian else days


#: 1970-01-01, in days from 1 March of year 0.
EPOCH = 719468


def _from_civil(z: Column, gregorian: bool) -> tuple[Column, Column, Column]:
    if gregorian:  # Spark's dates are proleptic Gregorian
        date = F.date_from_unix_date((z - EPOCH).cast("int"))
        return F.year(date).cast("long"), F.month(date).cast("long"), F.day(date).cast("long")
    era = _div(z, 1461)
    doe = F.pmod(z, F.lit(1461))
    yoe = _div(doe - _div(doe, 1460), 365)
    doy = doe - 365 * yoe
    mp = _div(5 * doy + 2, 153)
    m = F.when(mp < 10, mp + 3).otherwise(mp - 9)
    return yoe + era * 4 + (m <= 2).cast("long"), m, doy - _div(153 * mp + 2, 5) + 1


CUMULATIVE = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


def _astronomical(y: Column, calendar: str) -> Column:
    """Year numbers without a year 0 as numbers with one."""
    return y if calendar in ("gregorian_y0", "noleap", "360_day") else F.when(y < 0, y + 1).otherwise(y)


def _historical(y: Column, calendar: str) -> Column:
    return y if calendar in ("gregorian_y0", "noleap", "360_day") else F.when(y <= 0, y - 1).otherwise(y)


#: The Julian count runs two days ahead of the Gregorian one at 1 March of year 0.
JULIAN_SHIFT = 2


def day_number_of(year: int, month: int, day: int, calendar: str) -> int:
    """day_number of a date that is known when the plan is made."""
    calendar = canonical(calendar)
    if calendar not in ("gregorian_y0", "noleap", "360_day") and year < 0:
        year += 1
    if calendar == "360_day":
        return 360 * year + 30 * (month - 1) + day - 1
    if calendar == "noleap":
        return 365 * year + CUMULATIVE[month - 1] + day - 1
    if calendar == "julian" or calendar == "standard" and (year, month, day) < tuple(CUT):
        return _civil_number(year, month, day, False) - JULIAN_SHIFT
    return _civil_number(year, month, day, True)


def day_number(year: int | Column, month: int | Column, day: int | Column, calendar: str) -> Column:
    calendar = canonical(calendar)
    y, m, d = (_int(x).cast("long") for x in (year, month, day))
    y = _astronomical(y, calendar)
    if calendar == "360_day":
        return 360 * y + 30 * (m - 1) + d - 1
    if calendar == "noleap":
        return 365 * y + F.element_at(F.array(*(F.lit(c).cast("long") for c in CUMULATIVE)), m.cast("int")) + d - 1
    if calendar == "julian":
        return _civil(y, m, d, False) - JULIAN_SHIFT
    if calendar == "standard":
        late = (y > CUT[0]) | (y == CUT[0]) & ((m > CUT[1]) | (m == CUT[1]) & (d >= CUT[2]))
        return F.when(late, _civil(y, m, d, True)).otherwise(_civil(y, m, d, False) - JULIAN_SHIFT)
    return _civil(y, m, d, True)


def date_of(days: Column, calendar: str) -> tuple[Column, Column, Column]:
    """Year, month and day of a day number."""
    calendar = canonical(calendar)
    z = days.cast("long")
    if calendar == "360_day":
        y = _div(z, 360)
        r = z - 360 * y
        return y, _div(r, 30) + 1, F.pmod(r, F.lit(30)) + 1
    if calendar == "noleap":
        y = _div(z, 365)
        r = z - 365 * y
        month = sum(((r >= c).cast("long") for c in CUMULATIVE[1:]), F.lit(1).cast("long"))
        return y, month, r - F.element_at(F.array(*(F.lit(c).cast("long") for c in CUMULATIVE)), month.cast("int")) + 1
    if calendar == "julian":
        y, m, d = _from_civil(z + JULIAN_SHIFT, False)
    elif calendar == "standard":
        g, j = _from_civil(z, True), _from_civil(z + JULIAN_SHIFT, False)
        cut = _first_gregorian()
        y, m, d = (F.when(z >= cut, a).otherwise(b) for a, b in zip(g, j, strict=True))
    else:
        y, m, d = _from_civil(z, True)
    return _historical(y, calendar), m, d


def _first_gregorian() -> Column:
    return F.lit(_civil_number(*CUT, True)).cast("long")


def decode(offset: Column, units: str, calendar: str) -> dict[str, Column]:
    """year, month, day, hour, minute (int) and second (double) of a CF time offset.

    Offsets are rounded to the microsecond, so that 0.1 days is 2 h 24 min and not a second before.
    """
    u = parse_units(units)
    micro = F.round(offset.cast("double") * (u.seconds * 1_000_000.0)).cast("long") + u.second_of_day * 1_000_000
    days = _div(micro, 86_400_000_000)
    rest = micro - days * 86_400_000_000
    y, m, d = date_of(days + day_number_of(u.year, u.month, u.day, calendar), calendar)
    seconds = _div(rest, 1_000_000)
    return {
        "year": y.cast("int"), "month": m.cast("int"), "day": d.cast("int"), "hour": _div(seconds, 3600).cast("int"),
        "minute": F.pmod(_div(seconds, 60), F.lit(60)).cast("int"), "second": (F.pmod(rest, F.lit(60_000_000)) / 1_000_000).cast("double"),
    }


def encode(year: Column, month: Column, day: Column, units: str, calendar: str, hour: Column | int = 0, minute: Column | int = 0, second: Column | float = 0) -> Column:
    """The CF offset (double) of a date and time."""
    u = parse_units(units)
    days = day_number(year, month, day, calendar) - day_number_of(u.year, u.month, u.day, calendar)
    seconds = days * 86400 + _int(hour) * 3600 + _int(minute) * 60 + _int(second) - u.second_of_day
    return seconds.cast("double") / u.seconds


def is_leap_year(year: Column, calendar: str) -> Column:
    calendar = canonical(calendar)
    if calendar in ("noleap", "360_day"):
        return F.lit(False)
    y = _astronomical(year.cast("long"), calendar)
    julian = F.pmod(y, F.lit(4)) == 0
    gregorian = julian & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
    if calendar == "julian":
        return julian
    return F.when(y >= CUT[0], gregorian).otherwise(julian) if calendar == "standard" else gregorian


def days_in_month(year: Column, month: Column, calendar: str) -> Column:
    if canonical(calendar) == "360_day":
        return F.lit(30)
    usual = F.element_at(F.array(*(F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), month.cast("int"))
    days = usual + ((month == 2) & is_leap_year(year, calendar)).cast("int")
    return F.when((year == CUT[0]) & (month == CUT[1]), 21).otherwise(days) if canonical(calendar) == "standard" else days


def gregorian_number(year: Column, month: Column, day: Column) -> Column:
    """Days from 1 March of year 0 in the proleptic Gregorian calendar."""
    return _civil(year.cast("long"), month.cast("long"), day.cast("long"), True)


def date_from_gregorian_number(days: Column) -> tuple[Column, Column, Column]:
    return _from_civil(days.cast("long"), True)


def is_valid_gregorian_date(year: Column, month: Column, day: Column) -> Column:
    y, m, d = date_from_gregorian_number(gregorian_number(year, month, day))
    return month.between(1, 12) & (y == year) & (m == month) & (d == day)


def season(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("DJF", "DJF", "MAM", "MAM", "MAM", "JJA", "JJA", "JJA", "SON", "SON", "SON", "DJF"))), month.cast("int"))


def season_year(year: Column, month: Column) -> Column:
    """The year of a season: December belongs to the next year's DJF."""
    return year + (month == 12).cast("int")


def time_to_string(offset: Column, units: str, calendar: str, pattern: str = "%Y-%m-%d %H:%M:%S") -> Column:
    p = decode(offset, units, calendar)
    part = {"%Y": F.lpad(p["year"].cast("string"), 4, "0"), "%m": F.lpad(p["month"].cast("string"), 2, "0"), "%d": F.lpad(p["day"].cast("string"), 2, "0"), "%H": F.lpad(p["hour"].cast("string"), 2, "0"), "%M": F.lpad(p["minute"].cast("string"), 2, "0"), "%S": F.lpad(F.floor(p["second"]).cast("string"), 2, "0")}
    return F.concat(*(part.get(x, F.lit(x)) for x in re.findall(r"%.|[^%]+", pattern)))
