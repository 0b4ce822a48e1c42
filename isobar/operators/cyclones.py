"""Tropical cyclones: candidates, tracks, classification, wind radii, statistics and activity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isobar.functions import geometry as geo
from isobar.model import AXES, Axes, shared_folder

# Candidates -----------------------------------------------------------------


@dataclass(frozen=True)
class CandidateOptions:
    """Limits of the detector: angles in degrees, pressures in Pa, temperatures in K, thicknesses in m."""

    max_core_radius: float = 2.0
    min_vorticity: float = 1.6e-4
    vorticity_window: float = 7.75
    max_pressure_delta: float = 400.0
    max_pressure_radius: float = 5.0
    max_core_temperature_delta: float = 0.8
    max_core_temperature_radius: float = 5.0
    max_thickness_delta: float = 50.0
    max_thickness_radius: float = 4.0
    low_search_latitude: float = -90.0
    high_search_latitude: float = 90.0
    minimizer_iterations: int = 50
    lowest_pressure: float = 500e2


def _moment_operator(t: np.ndarray) -> np.ndarray:
    """The matrix that takes values at t to the second derivatives of their natural cubic spline."""
    n = len(t)
    out = np.zeros((n, n))
    if n < 3:
        return out
    h = np.diff(t)
    a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    slope = np.zeros((n - 1, n))
    slope[np.arange(n - 1), np.arange(n - 1)], slope[np.arange(n - 1), np.arange(1, n)] = -1 / h, 1 / h
    out[1:-1] = np.linalg.solve(a, 6 * np.diff(slope, axis=0))
    return out


class Spline:
    """A natural bicubic spline over a patch of a mesh. A spline is linear in its values, so points are weighted sums of the patch."""

    def __init__(self, y: np.ndarray, x: np.ndarray, f: np.ndarray):
        self.y, self.x, self.f = y, x, f
        self.ky, self.kx = _moment_operator(y), _moment_operator(x)

    @staticmethod
    def _weights(t: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(t, at) - 1, 0, len(t) - 2)
        h = t[i + 1] - t[i]
        a, b = (t[i + 1] - at) / h, (at - t[i]) / h
        w = ((a**3 - a) * h * h / 6)[:, None] * k[i] + ((b**3 - b) * h * h / 6)[:, None] * k[i + 1]
        rows = np.arange(len(at))
        w[rows, i] += a
        w[rows, i + 1] += b
        return w

    def at(self, p: np.ndarray) -> np.ndarray:
        """Values at points (x, y), moved onto the patch."""
        wx = self._weights(self.x, self.kx, np.clip(p[:, 0], self.x[0], self.x[-1]))
        wy = self._weights(self.y, self.ky, np.clip(p[:, 1], self.y[0], self.y[-1]))
        return ((wy @ self.f) * wx).sum(axis=1)

    def gradient(self, p: np.ndarray, h: float = 1e-4) -> np.ndarray:
        v = self.at(p + np.array([[h, 0], [-h, 0], [0, h], [0, -h]]))
        return np.array([v[0] - v[1], v[2] - v[3]]) / (2 * h)


def minimise(f: Spline, start: np.ndarray, iterations: int) -> tuple[np.ndarray, float]:
    """Polak-Ribiere conjugate gradients; the line search narrows a grid of points around the lowest, five times over."""
    p, g = start.astype(float), f.gradient(start)
    d, best = -g, float(f.at(start[None])[0])
    reach = 0.5 * min(f.x[-1] - f.x[0], f.y[-1] - f.y[0])
    low, high = np.array([f.x[0], f.y[0]]), np.array([f.x[-1], f.y[-1]])
    for _ in range(iterations):
        size = np.linalg.norm(d)
        if size < 1e-10:
            break
        a, b = 0.0, reach / size
        for _ in range(5):
            s = np.linspace(a, b, 17)
            n = int(np.argmin(f.at(p + s[:, None] * d)))
            a, b = s[max(0, n - 1)], s[min(16, n + 1)]
        new = np.clip(p + 0.5 * (a + b) * d, low, high)
        value = float(f.at(new[None])[0])
        if value >= best - 1e-9:
            break
        g_new = f.gradient(new)
        beta = max(0.0, float(g_new @ (g_new - g)) / max(1e-300, float(g @ g)))
        p, d, g, best = new, -g_new + beta * d, g_new, value
    return p, best


#: The eight directions of the shape test, and how finely a walk along one is sampled.
WAYS = np.stack([np.cos(np.arange(8) * np.pi / 4), np.sin(np.arange(8) * np.pi / 4)], axis=1)
WALK = 32


def _steep(f: Spline, centre: np.ndarray, change: float, radius: float) -> bool:
    """Whether the field changes by `change` in all eight directions within `radius`."""
    r = radius * np.arange(1, WALK + 1) / WALK
    points = centre + WAYS[:, None, :] * r[None, :, None]
    moved = np.abs(f.at(points.reshape(-1, 2)) - f.at(centre[None])).reshape(8, WALK)
    return bool((moved.max(axis=1) >= change).all())


CANDIDATE_DDL = "step long, time double, storm_id int, lon double, lat double, surface_wind double, `850mb_vorticity` double, sea_level_pressure double, have_core_temp int, have_thickness int, core_temp double, thickness double"


def detect(lat: np.ndarray, lon: np.ndarray, wind: np.ndarray, vort: np.ndarray, psl: np.ndarray, temp: np.ndarray, thick: np.ndarray, o: CandidateOptions) -> list[tuple]:
    """Candidates of one step: (lon, lat, wind, vorticity, pressure, have core, have thickness, core, thickness)."""
    dlat, dlon = abs(lat[1] - lat[0]), abs(lon[1] - lon[0])
    ny, nx = max(1, int((o.vorticity_window / dlat - 1) / 2)), max(1, int((o.vorticity_window / dlon - 1) / 2))
    spin = np.where(lat[:, None] < 0, -vort, vort)
    pad = lambda f: np.pad(np.pad(f, ((0, 0), (nx, nx)), mode="wrap"), ((ny, ny), (0, 0)), mode="edge")
    fields = {n: pad(f) for n, f in (("spin", spin), ("wind", wind), ("psl", psl), ("temp", temp), ("thick", thick))}
    step = lon[1] - lon[0]
    lon_p = np.concatenate([lon[0] + step * np.arange(-nx, 0), lon, lon[-1] + step * np.arange(1, nx + 1)])
    lat_p = np.concatenate([lat[0] + (lat[1] - lat[0]) * np.arange(-ny, 0), lat, lat[-1] + (lat[1] - lat[0]) * np.arange(1, ny + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(fields["spin"], (2 * ny + 1, 2 * nx + 1))
    high = windows.max(axis=(2, 3))
    # of equal maxima of a window, the first in its order of rows is the one
    row = windows[:, :, ny, :nx].max(axis=2)
    earlier = np.maximum(row, windows[:, :, :ny].max(axis=(2, 3)))
    in_band = ((lat >= o.low_search_latitude) & (lat <= o.high_search_latitude))[:, None]
    out = []
    for j, i in zip(*np.nonzero((spin >= high) & (spin > earlier) & (spin >= o.min_vorticity) & in_band), strict=True):
        box = np.s_[j : j + 2 * ny + 1, i : i + 2 * nx + 1]
        y, x = lat_p[box[0]], lon_p[box[1]]
        flip = y[0] > y[-1]
        yy = y[::-1] if flip else y
        patch = {n: (f[box][::-1] if flip else f[box]) for n, f in fields.items()}
        cj, ci = np.unravel_index(np.argmin(patch["psl"]), patch["psl"].shape)
        surface = Spline(yy, x, patch["psl"])
        at, low = minimise(surface, np.array([x[ci], yy[cj]]), o.minimizer_iterations)
        if low < o.lowest_pressure or np.hypot(at[0] - lon[i], at[1] - lat[j]) >= o.max_core_radius:
            continue
        if not _steep(surface, at, o.max_pressure_delta, o.max_pressure_radius):
            continue
        found = []
        for name, change, radius in (("temp", o.max_core_temperature_delta, o.max_core_temperature_radius), ("thick", o.max_thickness_delta, o.max_thickness_radius)):
            field = Spline(yy, x, -patch[name])
            tj, ti = np.unravel_index(np.argmax(patch[name]), patch[name].shape)
            peak, top = minimise(field, np.array([x[ti], yy[tj]]), o.minimizer_iterations)
            have = np.hypot(peak[0] - at[0], peak[1] - at[1]) < o.max_core_radius and _steep(field, peak, change, radius)
            found.append((int(have), -top))
        (have_t, core), (have_h, depth) = found
        out.append((float(at[0]), float(at[1]), float(patch["wind"].max()), float(spin[j, i]), float(low), have_t, have_h, float(core), float(depth)))
    return out


def tc_candidates(df: DataFrame, wind: str = "surface_wind", vorticity: str = "850mb_vorticity", pressure: str = "sea_level_pressure", core_temperature: str = "core_temperature", thickness: str = "thickness", options: CandidateOptions | None = None, axes: Axes = AXES) -> DataFrame:
    """Cyclone candidates of each step: a vorticity maximum of its window, with a pressure minimum near it and steep sides, and tests for a warm core and for thickness. A step is a group."""
    o = options or CandidateOptions()
    names = [wind, vorticity, pressure, core_temperature, thickness]

    def one(t: pa.Table) -> pa.Table:
        j, i = t.column(axes.j).to_numpy(), t.column(axes.i).to_numpy()
        lat, lon = np.zeros(j.max() + 1), np.zeros(i.max() + 1)
        lat[j], lon[i] = t.column(axes.y).to_numpy(), t.column(axes.x).to_numpy()
        fields = []
        for n in names:
            f = np.zeros((len(lat), len(lon)))
            f[j, i] = t.column(n).to_numpy(zero_copy_only=False)
            fields.append(f)
        step, time = t.column(axes.step)[0].as_py(), float(t.column(axes.time)[0].as_py())
        rows = [(step, time, int(step * 10000 + n), *r) for n, r in enumerate(detect(lat, lon, *fields, o))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 12
        kinds = [pa.int64(), pa.float64(), pa.int32(), *[pa.float64()] * 5, pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        head = ["step", "time", "storm_id", "lon", "lat", "surface_wind", "850mb_vorticity", "sea_level_pressure", "have_core_temp", "have_thickness", "core_temp", "thickness"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=head)

    return df.select(axes.step, axes.time, axes.j, axes.i, axes.y, axes.x, *names).groupBy(axes.step).applyInArrow(one, CANDIDATE_DDL)


# Tracks -------------------------------------------------------------------------


def link(t: pd.DataFrame, max_daily_distance: float, min_wind: float, min_duration: float, interval: int) -> pd.DataFrame:
    """Greedy tracks over candidates in row order, the plain form: each start takes the nearest free candidate of the next step until none is near enough."""
    t = t.reset_index(drop=True)
    step, time = t["step"].to_numpy(), t["time"].to_numpy()
    lon, lat = np.radians(t["lon"].to_numpy()), np.radians(t["lat"].to_numpy())
    strong = ((t["surface_wind"] >= min_wind) & (t["have_core_temp"] != 0) & (t["have_thickness"] != 0)).to_numpy()
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(t) else np.zeros(0, int)
    where = {int(step[a]): (a, b) for a, b in zip(starts, np.r_[starts[1:], len(t)], strict=True)}
    after = np.searchsorted(starts, np.arange(len(t)), side="right")
    then, then_time = (np.r_[x[starts].astype(float), np.nan][after] for x in (step, time))
    free = np.ones(len(t), dtype=bool)
    parts, track_id = [], 0
    for first in range(len(t)):
        if not free[first]:
            continue
        free[first] = False
        track, speed, duration, windy = [first], [0.0], 0.0, 0.0
        while not np.isnan(then[track[-1]]):
            tip = track[-1]
            dt = then_time[tip] - time[tip]
            duration += dt
            if then[tip] - step[tip] != interval:
                break
            if strong[tip]:
                windy += dt
            a, b = where.get(int(then[tip]), (0, 0))
            near = a + np.flatnonzero(free[a:b])
            dist = _distance(lon[tip], lat[tip], lon[near], lat[near])
            fine = dist <= max_daily_distance * dt
            if not fine.any():
                break
            best = np.flatnonzero(fine & (dist == dist[fine].min()))[-1]  # the later of equals
            track.append(int(near[best]))
            free[near[best]] = False
            speed.append(float(dist[best] / dt))
        if windy >= min_duration:
            own = t.iloc[track].copy()
            own.insert(0, "track_id", track_id)
            own.insert(6, "duration", duration)
            own.insert(7, "wind_duration", windy)
            own["storm_speed"] = speed
            parts.append(own)
            track_id += 1
    return pd.concat(parts) if parts else t.iloc[:0].assign(track_id=0, duration=0.0, wind_duration=0.0, storm_speed=0.0)


TRACK_COLUMNS = ["track_id", "storm_id", "step", "time", "lon", "lat", "duration", "wind_duration", "surface_wind", "850mb_vorticity", "sea_level_pressure", "have_core_temp", "have_thickness", "core_temp", "thickness", "storm_speed"]
#: A candidate, its place in its series, the places of the next step near it, and its track so far (missing before the walk).
WALK_DDL = f"{CANDIDATE_DDL}, shard long, at int, next_step long, next_time double, near binary, more boolean, first_step long, first_at int, duration double, wind_duration double, storm_speed double"
#: Places of the next step that are listed for each candidate at most; a tip that finds all of them taken looks among all places that are free.
MOST_NEAR = 32
#: Candidates of a series that a task walks at once (a step at least); the next task goes on from its tips.
WALKED = 1 << 19
#: Candidates whose lists a task makes at once (a step at least).
LISTED = 1 << 14
#: Entries of a matrix of distances.
AT_ONCE = 1 << 21


def _distance(lon: np.ndarray, lat: np.ndarray, to_lon: np.ndarray, to_lat: np.ndarray) -> np.ndarray:
    """Kilometres from tips to candidates (radians), by the tips' latitude."""
    return geo.MEAN_KM * np.hypot((to_lon - lon) * np.cos(lat), to_lat - lat)


def _places(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitudes and latitudes of the distinct places, in order of latitude, and each row's place (-1 where a coordinate is missing)."""
    rows = np.flatnonzero(np.isfinite(lon) & np.isfinite(lat))
    rows = rows[np.lexsort((lon[rows], lat[rows]))]
    x, y = lon[rows], lat[rows]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(rows)]
    place = np.full(len(lon), -1)
    place[rows] = np.cumsum(new) - 1
    return x[new], y[new], place


def _nearest(lon: np.ndarray, lat: np.ndarray, reach: np.ndarray, to_lon: np.ndarray, to_lat: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the nearest places within its reach, `most` at most: distances in order (inf: no more), places, and whether others may be in reach.

    Of places at one distance all are listed or none. A point looks around itself as far as it takes to see enough places; points that look
    equally far share a grid of bands of latitude, sorted by longitude.
    """
    n, m = len(lon), len(to_lon)
    dist, place, more = np.full((n, most), np.inf), np.zeros((n, most), np.int32), np.zeros(n, bool)
    if not m:
        return dist, place, more
    cos, far, x0, span, tall = np.abs(np.cos(lat)), reach / geo.MEAN_KM, to_lon.min(), np.ptp(to_lon), np.ptp(to_lat)
    want = 1.5 * most + 8
    guess = np.maximum(np.sqrt(want * span * tall * cos / (np.pi * m)), want / (2 * m) * np.maximum(tall, span * cos)) if m > 8 * want else np.inf
    levels = lambda r: np.ceil(2 * np.log2(np.clip(r, 1e-12, 1e18))).astype(int)  # noqa: E731  of radii, by factors of the root of 2
    level, few = np.minimum(levels(guess), levels(far)), np.full(n, -1000)
    todo = np.flatnonzero(reach >= 0)
    while len(todo):
        now = level[todo[0]]
        group, r = todo[level[todo] == now], 2.0 ** (now / 2)
        side = r * (1 + 1e-9)
        band = np.floor(to_lat / r)
        order = np.lexsort((to_lon, band))
        band, slot = band[order], span + 1
        key = (band - band[0]) * slot + (to_lon[order] - x0)
        slack = 4 * np.spacing(key[-1])
        low, wide = np.floor((lat[group] - side) / r), side / np.maximum(cos[group], 1e-30)
        west, east = np.clip(lon[group] - wide - x0, 0, slot), np.clip(lon[group] + wide - x0, -0.5, span)
        start, size = np.zeros((2, len(group), 4), int)
        for k in range(4):
            own = low + k
            a, b = np.searchsorted(band, own), np.searchsorted(band, own, side="right")
            start[:, k] = np.clip(np.searchsorted(key, (own - band[0]) * slot + west - slack), a, b)
            size[:, k] = np.clip(np.searchsorted(key, (own - band[0]) * slot + east + slack, side="right"), start[:, k], b) - start[:, k]
        total = size.sum(axis=1)
        many = (total > 8 * want) & (few[group] < now - 1) & (now > -80)
        level[group[many]] -= 1
        found = np.zeros(len(group), bool)
        rest = np.flatnonzero(~many)
        rest = rest[np.argsort(total[rest], kind="stable")]
        while len(rest):
            # rows of like counts, as many as fit
            fit = max(1, int(np.count_nonzero((np.arange(len(rest)) + 1) * np.maximum(total[rest], 1) <= AT_ONCE)))
            part, rest = rest[:fit], rest[fit:]
            g, width = group[part], max(int(total[part].max()), 1)
            pos, ends = np.arange(width), np.cumsum(size[part], axis=1)
            shift = start[part] - ends + size[part]
            at = pos + shift[:, :1]
            for k in range(1, 4):
                at += (pos >= ends[:, k - 1 : k]) * (shift[:, k] - shift[:, k - 1])[:, None]
            out = pos >= ends[:, 3:]
            at[out] = 0
            at = order[at]
            d = _distance(lon[g, None], lat[g, None], to_lon[at], to_lat[at])
            whole = (r >= far[g]) | (total[part] == m)
            d[out | (d > np.where(whole, reach[g], r * geo.MEAN_KM)[:, None])] = np.inf
            done = whole | (np.count_nonzero(d < np.inf, axis=1) > most)
            found[part] = done
            few[g[~done]] = now
            level[g[~done]] += 1
            g, d, at = g[done], d[done], at[done]
            if width > most + 1:
                first = np.argpartition(d, most, axis=1)[:, : most + 1]
                d, at = np.take_along_axis(d, first, 1), np.take_along_axis(at, first, 1)
            first = np.argsort(d, axis=1, kind="stable")
            d, at = np.take_along_axis(d, first, 1), np.take_along_axis(at, first, 1)
            if width > most:
                more[g] = d[:, most] < np.inf
                d = np.where(d[:, :most] < d[:, most:], d[:, :most], np.inf)
            dist[g, : d.shape[1]], place[g, : d.shape[1]] = d, at[:, : d.shape[1]]
        todo = np.setdiff1d(todo, group[found], assume_unique=True)
    return dist, place, more


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _near(tips: pa.Table, others: pa.Table, max_daily_distance: float, interval: int, most: int) -> pa.Table:
    """The candidates of a step in their order, each with the places of the next step within its reach (a place tied with the one before it: inverted)."""
    tips = tips.sort_by("storm_id")
    lon, lat, to_lon, to_lat = (np.radians(_numbers(t, c)) for t, c in ((tips, "lon"), (tips, "lat"), (others, "to_lon"), (others, "to_lat")))
    reach = max_daily_distance * (_numbers(tips, "next_time") - _numbers(tips, "time"))
    reach[~((_numbers(tips, "next_step") - _numbers(tips, "step") == interval) & np.isfinite(lon) & np.isfinite(lat) & (reach >= 0))] = -1.0
    x, y, own = _places(lon, lat)
    farthest = np.full(len(x), -1.0)
    np.maximum.at(farthest, own[own >= 0], reach[own >= 0])
    dist, place, more = _nearest(x, y, farthest, *_places(to_lon, to_lat)[:2], most)
    place[:, 1:] ^= -(dist[:, 1:] == dist[:, :-1]).astype(np.int32)
    held = dist[own] <= reach[:, None]
    near = np.ascontiguousarray(place[own][held])
    ends = np.r_[0, np.cumsum(4 * held.sum(axis=1))].astype(np.int32)
    ended = ((dist[own] < np.inf) & ~held).any(axis=1) | (reach < 0)
    n = len(tips)
    made = {
        "at": pa.array(np.arange(n, dtype=np.int32)), "near": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(near)]), "more": pa.array(more[own] & ~ended),
        "first_step": pa.nulls(n, pa.int64()), "first_at": pa.nulls(n, pa.int32()), **{c: pa.nulls(n, pa.float64()) for c in ("duration", "wind_duration", "storm_speed")},
    }
    for name, values in made.items():
        tips = tips.append_column(name, values)
    return tips


def _near_steps(tips: pa.Table, others: pa.Table, *args) -> pa.Table:
    """_near() for each of some steps; others name the step before theirs."""
    tips, others = tips.sort_by("step"), others.sort_by("last_step")
    step, last = tips.column("step").to_numpy(), others.column("last_step").to_numpy()
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    ends, low, high = np.r_[starts[1:], len(step)], *(np.searchsorted(last, step[starts], side=s) for s in ("left", "right"))
    each = zip(*(x.tolist() for x in (starts, ends, low, high)), strict=True)
    return pa.concat_tables([_near(tips.slice(a, b - a), others.slice(c, d - c), *args) for a, b, c, d in each]).combine_chunks()


def _taken(lon: np.ndarray, lat: np.ndarray, reach: np.ndarray, near: tuple[list[int], list[int], list[int]], more: list[bool], to_lon: np.ndarray, to_lat: np.ndarray) -> np.ndarray:
    """The candidate that each tip takes, in the order of the tips: of the nearest that are free the last (-1: none is within reach). near: all lists in one, and where each begins and ends."""
    x, y, place = _places(to_lon, to_lat)
    rows = np.flatnonzero(place >= 0)
    rows = rows[np.argsort(place[rows], kind="stable")]
    same = np.r_[False, place[rows[1:]] == place[rows[:-1]]][: len(rows)]
    below = np.full(len(place), -1)  # the row before it at its place
    below[rows[same]] = rows[np.flatnonzero(same) - 1]
    last = rows[np.r_[~same[1:], True][: len(rows)]].tolist()  # of each place, the last row that is free
    place, below, free = place.tolist(), below.tolist(), np.ones(len(x), bool)
    left, heights, closed = np.arange(len(x)), y, 0  # places that were free a while ago, their latitudes, and how many were taken since

    def search(n: int) -> int:
        nonlocal left, heights, closed
        if closed > 16 + len(left) // 8:
            left, closed = np.flatnonzero(free), 0
            heights = y[left]
        middle, width = int(np.searchsorted(heights, lat[n])), 64
        while True:
            a, b = max(0, middle - width), min(len(left), middle + width)
            at = left[a:b]
            at = at[free[at]]
            d = _distance(lon[n], lat[n], x[at], y[at])
            nearest = d.min(initial=np.inf)
            beyond = min(lat[n] - heights[a - 1] if a else np.inf, heights[b] - lat[n] if b < len(left) else np.inf)
            if geo.MEAN_KM * beyond * (1 - 1e-9) > min(nearest, reach[n]) or b - a == len(left):
                return max((last[p] for p in at[d == nearest].tolist()), default=-1) if nearest <= reach[n] else -1
            width *= 4

    taken, (listed, starts, ends) = [], near
    for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
        best = -1
        for p in listed[a:b]:
            if p < 0:
                p = ~p
            elif best >= 0:
                break
            if last[p] > best:
                best = last[p]
        if best < 0 and more[n]:
            best = search(n)
        taken.append(best)
        if best >= 0:
            p = place[best]
            last[p] = below[best]
            if last[p] < 0:
                free[p] = False
                closed += 1
    return np.array(taken, dtype=int)


def _walk(t: pa.Table, min_wind: float, interval: int, max_daily_distance: float) -> pa.Table:
    """Some steps of a series: every candidate with its track's start, its speed, and the track's durations when it has looked at the next step. Rows that have a start are tips of an earlier walk.

    All tracks are led on together, a step at a time, in the order of their starts: a track only ever meets candidates that an earlier start has left.
    """
    t = t.take(np.lexsort((t.column("at").to_numpy(), t.column("step").to_numpy()))).combine_chunks()
    step, at, time, then_time, then = (t.column(c).to_numpy(zero_copy_only=False) for c in ("step", "at", "time", "next_time", "next_step"))
    time, then_time, then = (x.astype(float) for x in (time, then_time, then))
    lon, lat = np.radians(_numbers(t, "lon")), np.radians(_numbers(t, "lat"))
    strong = (_numbers(t, "surface_wind") >= min_wind) & (_numbers(t, "have_core_temp") != 0) & (_numbers(t, "have_thickness") != 0)
    more, near = t.column("more").to_numpy(zero_copy_only=False), t.column("near").chunk(0) if t.num_rows else None
    ends, values = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(t) + 1] // 4, np.frombuffer(near.buffers()[2] or b"", np.int32)
    first_step, first_at, duration, windy = (t.column(c).fill_null(0).to_numpy().copy() for c in ("first_step", "first_at", "duration", "wind_duration"))
    old, speed, dt = t.column("first_step").is_valid().to_numpy(zero_copy_only=False), np.zeros(len(t)), then_time - time
    adjacent = then - step == interval
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    tips = np.zeros(0, int)
    for a, b in zip(starts, np.r_[starts[1:], len(t)], strict=True):
        if not old[a]:
            first_step[a:b], first_at[a:b] = step[a:b], at[a:b]
            if len(tips):
                listed, low = values[ends[tips[0]] : ends[tips[-1] + 1]].tolist(), ends[tips[0]]
                tips = tips[np.lexsort((first_at[tips], first_step[tips]))]
                lists = listed, (ends[tips] - low).tolist(), (ends[tips + 1] - low).tolist()
                taken = _taken(lon[tips], lat[tips], max_daily_distance * dt[tips], lists, more[tips].tolist(), lon[a:b], lat[a:b])
                tips, rows = tips[taken >= 0], a + taken[taken >= 0]
                for x in (first_step, first_at, duration, windy):
                    x[rows] = x[tips]
                with np.errstate(divide="ignore", invalid="ignore"):
                    speed[rows] = _distance(lon[tips], lat[tips], lon[rows], lat[rows]) / dt[tips]
            duration[a:b] += np.where(np.isnan(then[a:b]), 0.0, dt[a:b])
            windy[a:b] += np.where(adjacent[a:b] & strong[a:b], dt[a:b], 0.0)
        tips = a + np.flatnonzero((ends[a + 1 : b + 1] > ends[a:b]) | more[a:b])
    made = {"first_step": first_step, "first_at": first_at, "duration": duration, "wind_duration": windy, "storm_speed": speed}
    kept = pc.if_else(pa.array(step == step[-1]), near, pa.scalar(None, pa.binary()))  # of the last step alone, for the next walk
    for name, x in [("near", kept), *((c, pa.array(v)) for c, v in made.items())]:
        t = t.set_column(t.column_names.index(name), name, x)
    return t.filter(pa.array(~old))


def tc_trajectory(candidates: DataFrame, max_daily_distance: float = 1600.0, min_wind_speed: float = 17.0, min_wind_duration: float = 2.0, step_interval: int = 1) -> DataFrame:
    """Tracks of candidates; track ids number the kept tracks in order of their start. A storm_id is taken to be unique within its step.

    First, each step meets the next one, and every candidate gets a list of the nearest places there (a group is a step, or several short ones). What is
    sequential is then short: tips take, in the order of their starts, the first on their lists that is free. Series are cut where steps are missing,
    and each is walked in blocks of whole steps, WALKED candidates or so to a task; the tips of a block's last step are handed to the next by a table in the
    shared folder. A track's duration includes the time to the next step that had candidates, as when the walk ended.
    """
    spark, held, most = candidates.sparkSession, shared_folder(candidates.sparkSession), MOST_NEAR
    names = [f.name for f in StructType.fromDDL(WALK_DDL).fields]
    own = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(CANDIDATE_DDL).fields]
    candidates = candidates.select(*own)
    # the windows over the steps see the time axis, a row for each step, not the candidates
    order = W.orderBy("step")
    steps = candidates.where("step IS NOT NULL").groupBy("step").agg(F.min_by("time", "storm_id").alias("first_time"), F.count("*").alias("n"))
    axis = steps.select("step", "n", F.lag("step").over(order).alias("last_step"), F.lead("step").over(order).alias("next_step"), F.lead("first_time").over(order).alias("next_time"))
    new = F.coalesce((F.col("step") - F.col("last_step") != step_interval).cast("long"), F.lit(0).cast("long"))
    axis = axis.withColumn("shard", F.sum(new).over(order.rowsBetween(W.unboundedPreceding, 0)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    axis = axis.withColumns({"block": F.floor(before / WALKED).cast("int"), "lot": F.floor(before / LISTED)})
    axis.withColumn("last_lot", F.lag("lot").over(order)).write.parquet(f"{held}/axis")
    axis = spark.read.parquet(f"{held}/axis")
    tips = candidates.join(F.broadcast(axis.select("step", "shard", "lot", "next_step", "next_time", "block")), "step")
    others = candidates.select("step", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat")).join(F.broadcast(axis.where(F.col("step") - F.col("last_step") == step_interval).select("step", "last_step", F.col("shard").alias("last_shard"), "last_lot")), "step").drop("step")

    def near(t: pa.Table, others: pa.Table) -> pa.Table:
        return _near_steps(t, others, max_daily_distance, step_interval, most).select(["block", *names])

    def walk(t: pa.Table) -> pa.Table:
        return _walk(t, min_wind_speed, step_interval, max_daily_distance).select(names)

    tips.groupBy("shard", "lot").cogroup(others.groupBy("last_shard", "last_lot")).applyInArrow(near, f"block int, {WALK_DDL}").write.partitionBy("block").parquet(f"{held}/near")
    listed = spark.read.schema(f"{WALK_DDL}, block int").parquet(f"{held}/near")
    walked = [f"{held}/walked/{k}" for k in range((axis.agg(F.max("block")).first()[0] or 0) + 1)]
    for k, path in enumerate(walked):
        rows = listed.where(F.col("block") == k).select(*names)
        if k:
            rows = rows.unionByName(spark.read.schema(WALK_DDL).parquet(walked[k - 1]).where("near IS NOT NULL AND (length(near) > 0 OR more)"))
        rows.groupBy("shard").applyInArrow(walk, WALK_DDL).write.parquet(path)
    tracks = spark.read.schema(WALK_DDL).parquet(*walked).drop("duration", "wind_duration")
    ends = spark.read.schema(WALK_DDL).parquet(*walked).groupBy("first_step", "first_at").agg(F.max_by(F.struct("duration", "wind_duration"), "step").alias("end")).select("first_step", "first_at", "end.*")
    kept = ends.where((F.col("wind_duration") >= min_wind_duration) & ~F.isnan("wind_duration"))
    # Numbers by start: the tracks that start at earlier steps (a row for each step), then those of the same step.
    before = kept.groupBy("first_step").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("first_step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(W.partitionBy("first_step").orderBy("first_at")) - 1 + F.col("before")
    numbered = kept.join(F.broadcast(before.select("first_step", "before")), "first_step").withColumn("track_id", number.cast("long"))
    return tracks.join(numbered.drop("before"), ["first_step", "first_at"]).select(*(F.col(f"`{c}`") for c in TRACK_COLUMNS))


# Classification --------------------------------------------------------------------

KNOTS2 = 3.778529496  # (m/s to knots)^2


def tc_classify(tracks: DataFrame, track_id: str = "track_id", time: str = "time", wind: str = "surface_wind", pressure: str = "sea_level_pressure", x: str = "lon", y: str = "lat", regions: list[tuple[int, str, str, geo.Polygon]] | None = None) -> DataFrame:
    """One row for each track: start, duration, length (m), category, ACE, PDI, place and time of the strongest wind and the lowest pressure, and the region of the start.

    One shuffle by track: windows and the aggregate share it. Ties of extremes go to the earliest point.
    """
    w = W.partitionBy(track_id).orderBy("t")
    regions = geo.BASINS if regions is None else regions
    p = tracks.select(track_id, F.col(time).alias("t"), F.col(wind).alias("w"), F.col(pressure).alias("p"), F.col(x).alias("x"), F.col(y).alias("y"))
    p = p.withColumns({
        "dt": F.lead("t").over(w) - F.lag("t").over(w), "dt1": F.lead("t").over(w) - F.col("t"),
        "d": geo.distance_km(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")),
    })
    strong = F.col("w") >= geo.lower_bound_mps(0)
    first = lambda c: F.min_by(c, "t")
    peak, low = F.struct(F.col("w"), -F.col("t")), F.struct(F.col("p"), F.col("t"))
    out = p.groupBy(track_id).agg(
        F.min("t").alias("start_time"), first("x").alias("start_x"), first("y").alias("start_y"), (F.max("t") - F.min("t")).alias("duration"),
        (F.coalesce(F.sum("d"), F.lit(0.0)) * 1000.0).alias("length"), geo.classify_mps(F.max("w")).alias("category"),
        (F.coalesce(F.sum(F.when(strong & F.col("dt").isNotNull(), F.col("w") * F.col("w") * F.col("dt"))), F.lit(0.0)) * (2.0 * KNOTS2 * 1e-4)).alias("ACE"),
        (F.coalesce(F.sum(F.when(F.col("dt").isNotNull(), F.col("w") * F.col("w") * F.col("w") * F.col("dt"))), F.lit(0.0)) * 43200.0).alias("PDI"),
        F.max("w").alias("max_surface_wind"), F.max_by("x", peak).alias("max_surface_wind_x"), F.max_by("y", peak).alias("max_surface_wind_y"), F.max_by("t", peak).alias("max_surface_wind_t"),
        F.min("p").alias("min_sea_level_pressure"), F.min_by("x", low).alias("min_sea_level_pressure_x"), F.min_by("y", low).alias("min_sea_level_pressure_y"), F.min_by("t", low).alias("min_sea_level_pressure_t"),
    )
    # the polygons are walked once for each track; ids and names are then looked up
    place = geo.first_polygon(F.col("start_x"), F.col("start_y"), [(F.lit(n), g) for n, (_, _, _, g) in enumerate(regions)], F.lit(len(regions)))
    names = [(i, s, n) for i, s, n, _ in regions] + [(-1, "unknown", "unknown")]
    out = out.withColumn("__place", place)
    told = {c: F.get(F.array(*(F.lit(row[n]) for row in names)), F.col("__place")) for n, c in enumerate(("region_id", "region_name", "region_long_name"))}
    return out.withColumns(told).drop("__place")


# Wind radii -----------------------------------------------------------------------------


def wind_radii(storms: DataFrame, mesh: DataFrame, u: str, v: str, search_radius: float = 6.0, core_radius: float = float("inf"), bins: int = 32, critical: list[float] | None = None, profile: str = "average", key: str = "storm_id", x: str = "lon", y: str = "lat", cell: float | None = None, axes: Axes = AXES) -> DataFrame:
    """For each storm: the radii at which the radial wind profile falls below critical speeds (0 if nowhere), the peak radius and speed.

    Storms meet cells by an equal join on the step and a grid of squares of the search radius: a storm looks at nine
    squares, so no pair of step and cell is compared that lies far away. Peaks outside the core radius give null.
    """
    critical = critical if critical is not None else [geo.upper_bound_mps(c) for c in range(-1, 5)]
    side = cell or search_radius
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    near = F.explode(F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1))))
    s = storms.select("step", F.col(key).alias("__key"), F.col(x).alias("__sx"), F.col(y).alias("__sy"))
    s = s.withColumn("__gx", square("__sx")).withColumn("__gy", square("__sy")).withColumn("__dx", near).withColumn("__dy", near)
    s = s.withColumn("__gx", F.col("__gx") + F.col("__dx")).withColumn("__gy", F.col("__gy") + F.col("__dy")).drop("__dx", "__dy")
    m = mesh.select(F.col(axes.step).alias("step"), F.col(axes.x).alias("__x"), F.col(axes.y).alias("__y"), F.col(u).alias("__u"), F.col(v).alias("__v")).withColumn("__gx", square("__x")).withColumn("__gy", square("__y"))
    r = F.hypot(F.col("__x") - F.col("__sx"), F.col("__y") - F.col("__sy"))
    width = search_radius / bins
    pairs = m.join(s, ["step", "__gx", "__gy"]).withColumn("__r", r).where(F.col("__r") <= search_radius)
    wind = F.hypot("__u", "__v")
    pairs = pairs.withColumn("__bin", F.least(F.floor(F.col("__r") / width), F.lit(bins - 1)).cast("int"))
    value = F.avg(wind) if profile == "average" else F.max(wind)
    profiles = pairs.groupBy("__key", "__bin").agg(value.alias("__w"))
    shaped = profiles.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__bin", "__w"))).alias("__p"))  # at most `bins` entries
    held = F.map_from_entries("__p")
    whole = shaped.withColumn("__m", held).select("__key", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("__m")[b], F.lit(0.0))).alias("w"))
    whole = whole.withColumn("peak_wind_speed", F.array_max("w")).withColumn("__peak", (F.array_position("w", F.col("peak_wind_speed")) - 1).cast("int"))
    centre = lambda b: (b + 0.5) * width
    whole = whole.withColumn("peak_radius", centre(F.col("__peak"))).withColumn("__ok", F.col("peak_radius") <= core_radius)
    below = lambda c: lambda b: (b >= F.col("__peak")) & (F.element_at("w", b + 1) < c)
    out = whole
    for n, c in enumerate(critical):
        after = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), below(c))
        b = F.get(after, F.lit(0))
        w2, w1 = F.element_at("w", b + 1), F.element_at("w", b)
        cross = centre(b - 1) + (w1 - c) / (w1 - w2) * width
        out = out.withColumn(f"wind_radius_{n}", F.when(F.col("__ok"), F.when((F.col("peak_wind_speed") > c) & b.isNotNull() & (b > 0), cross).otherwise(F.lit(0.0))))
    cols = [f"wind_radius_{n}" for n in range(len(critical))]
    return out.select(F.col("__key").alias(key), *cols, F.when(F.col("__ok"), F.col("peak_radius")).alias("peak_radius"), F.when(F.col("__ok"), F.col("peak_wind_speed")).alias("peak_wind_speed"))


# Statistics ---------------------------------------------------------------------------------


def tc_summary(classified: DataFrame, year: str = "year") -> DataFrame:
    """year, total and the counts of categories 0 to 5."""
    counts = [F.count_if(F.col("category") == c).alias(f"cat_{c}") for c in range(6)]
    return classified.groupBy(year).agg(F.count("*").alias("total"), *counts)


def tc_counts(classified: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """Storms by year and by month, category, region or hemisphere: rows (year, kind, value, storms)."""
    hemisphere = F.when(F.col("start_y") < 0, "SH").otherwise("NH")
    kinds = {"month": F.col(month).cast("string"), "category": F.col("category").cast("string"), "region": F.col("region_name"), "hemisphere": hemisphere}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items())))
    return classified.select(year, each.alias("e")).groupBy(year, "e.kind", "e.value").agg(F.count("*").alias("storms"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts by equal bins: 1 to bins, 0 below and bins + 1 above."""
    return df.where(F.col(column).isNotNull()).groupBy(*(by or []), F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def tc_activity(classified: DataFrame, year: str = "year") -> DataFrame:
    """ACE and PDI by year for each region, for both hemispheres and for all: rows (year, level, area, storms, ACE, PDI), one pass by grouping sets."""
    prepared = classified.select(F.col(year).alias("year"), F.col("region_name").alias("region"), F.when(F.col("start_y") < 0, "SH").otherwise("NH").alias("hemisphere"), "ACE", "PDI")
    sets = prepared.groupingSets([[F.col("year"), F.col("region")], [F.col("year"), F.col("hemisphere")], [F.col("year")]], F.col("year"), F.col("region"), F.col("hemisphere"))
    out = sets.agg(F.grouping("region").alias("g1"), F.grouping("hemisphere").alias("g2"), F.count("*").alias("storms"), F.sum("ACE").alias("ACE"), F.sum("PDI").alias("PDI"))
    level = F.when(F.col("g1") == 0, "region").when(F.col("g2") == 0, "hemisphere").otherwise("global")
    return out.select("year", level.alias("level"), F.coalesce("region", "hemisphere", F.lit("all")).alias("area"), "storms", "ACE", "PDI")


def track_series(tracks: DataFrame, track_id: int, scalars: list[str]) -> DataFrame:
    """The series of scalars of one track, in long form (time, scalar, value), ready to plot."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("scalar"), F.col(s).cast("double").alias("value")) for s in scalars)))
    return tracks.where(F.col("track_id") == track_id).select("time", each.alias("e")).select("time", "e.*").orderBy("scalar", "time")
