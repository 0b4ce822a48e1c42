"""Distances, point-in-polygon tests, storm categories and cyclone basins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii used by the operators: mean (km), equatorial (km) and mean (m).
MEAN_KM, EQUATOR_KM, MEAN_M, EQUATOR_M = 6371.0, 6378.137, 6371.0e3, 6378.137e3


def distance_km(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Equirectangular distance of two points in degrees; longitudes are not wrapped."""
    dx = (F.radians(lon1) - F.radians(lon0)) * F.cos(F.radians(lat0))
    dy = F.radians(lat1) - F.radians(lat0)
    return F.lit(MEAN_KM) * F.sqrt(dx * dx + dy * dy)


@dataclass(frozen=True)
class Polygon:
    """A closed ring: x and y of its vertices; the last repeats the first, else the ring is closed."""

    x: tuple[float, ...]
    y: tuple[float, ...]

    def closed(self) -> Polygon:
        if len(self.x) != len(self.y) or len(self.x) < 3:
            raise ValueError("a polygon takes three vertices or more")
        if (self.x[0], self.y[0]) == (self.x[-1], self.y[-1]):
            return self
        return Polygon((*self.x, self.x[0]), (*self.y, self.y[0]))

    def normalised(self) -> Polygon:
        """With longitudes from 0 to 360."""
        return Polygon(tuple(v + 360.0 if v < 0 else v for v in self.x), self.y)


def winding_number(px: Column, py: Column, polygon: Polygon) -> Column:
    """Sum over edges: +1 for an upward edge y0 <= py < y1 with the point on it or left of it, -1 for a downward edge y1 <= py < y0 with the point strictly right.

    The edges are constants of one whole-stage expression; no join is needed.
    """
    ring = polygon.closed()
    total: Column = F.lit(0)
    for x0, y0, x1, y1 in zip(ring.x, ring.y, ring.x[1:], ring.y[1:], strict=False):
        side = F.lit(x1 - x0) * (py - F.lit(y0)) - (px - F.lit(x0)) * F.lit(y1 - y0)
        if y0 < y1:
            total = total + ((py >= y0) & (py < y1) & (side >= 0)).cast("int")
        elif y1 < y0:
            total = total - ((py >= y1) & (py < y0) & (side < 0)).cast("int")
    return total


def point_in(px: Column, py: Column, polygons: list[Polygon]) -> Column:
    """Whether the point is in any polygon; false for null coordinates."""
    hit: Column = F.lit(False)
    for p in polygons:
        hit = hit | (winding_number(px.cast("double"), py.cast("double"), p) != 0)
    return F.coalesce(hit, F.lit(False))


def first_polygon(px: Column, py: Column, polygons: list[tuple[Column, Polygon]], otherwise: Column | None = None) -> Column:
    """The value of the first polygon that holds the point."""
    out = F.lit(None) if otherwise is None else otherwise
    for value, p in reversed(polygons):
        out = F.when(winding_number(px.cast("double"), py.cast("double"), p) != 0, value).otherwise(out)
    return out


# Saffir-Simpson bounds between categories -1|0, 0|1, ... 4|5, in km/h (fixed values).
BOUNDS_KMPH = [63.0, 119.0, 154.0, 178.0, 209.0, 252.0]
KMPH_PER_MPS = 3.6


def classify_kmph(wind: Column) -> Column:
    """Category -1 to 5: the first whose upper bound is above the wind."""
    out: Column = F.lit(5)
    for category, bound in reversed(list(enumerate(BOUNDS_KMPH, start=-1))):
        out = F.when(wind < bound, category).otherwise(out)
    return F.when(wind.isNotNull(), out)


def classify_mps(wind: Column) -> Column:
    return classify_kmph(wind * KMPH_PER_MPS)


def upper_bound_mps(category: int) -> float:
    return BOUNDS_KMPH[category + 1] / KMPH_PER_MPS if category < 5 else float("inf")


def lower_bound_mps(category: int) -> float:
    return BOUNDS_KMPH[category] / KMPH_PER_MPS if category > -1 else 0.0


# Cyclone basins (fixed values): id, short and long name, and polygons in degrees. A basin that crosses the
# prime meridian has two. The order is that in which points are looked up.
BASINS: list[tuple[int, str, str, Polygon]] = [
    (0, "SI", "S Indian", Polygon((136, 136, 20, 20, 136), (0, -90, -90, 0, 0))),
    (1, "SWP", "SW Pacific", Polygon((136, 216, 216, 136, 136), (-90, -90, 0, 0, -90))),
    (2, "NWP", "NW Pacific", Polygon((104, 180, 180, 98.75, 98.75, 104), (0, 0, 90, 90, 9, 0))),
    (3, "NI", "N Indian", Polygon((20, 104, 98.75, 98.75, 20, 20), (0, 0, 9, 90, 90, 0))),
    (4, "NA", "N Atlantic", Polygon((282, 284, 284, 278, 268, 263, 237, 237, 224, 200, 200, 360.1, 360.1, 282), (0, 3, 8.5, 8.5, 17, 17, 43, 50, 62, 62, 90, 90, 0, 0))),
    (5, "NEP", "NE Pacific", Polygon((200, 180, 180, 282, 284, 284, 278, 268, 263, 237, 237, 224, 200, 200), (90, 90, 0, 0, 3, 8.5, 8.5, 17, 17, 43, 50, 62, 62, 90))),
    (6, "SEP", "SE Pacific", Polygon((216, 216, 289, 289, 298, 298, 216), (0, -90, -90, -52, -19.5, 0, 0))),
    (7, "SA", "S Atlantic", Polygon((-0.1, 20, 20, -0.1, -0.1), (0, 0, -90, -90, 0))),
    (7, "SA", "S Atlantic", Polygon((298, 298, 289, 289, 360.1, 360.1, 298), (0, -19.5, -52, -90, -90, 0, 0))),
    (4, "NA", "N Atlantic", Polygon((20, 20, -0.1, -0.1, 20), (90, 0, 0, 90, 90))),
]


def basin(name: str) -> list[Polygon]:
    found = [p for _, short, long, p in BASINS if name in (short, long)]
    if not found:
        raise ValueError(f"no basin {name}")
    return found
