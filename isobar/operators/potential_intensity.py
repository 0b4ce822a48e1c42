"""Tropical cyclone potential intensity of soundings.

After Bister and Emanuel (2002) and Emanuel (1995): the convective available potential energies of the environment's
parcel, of a saturated parcel at the sea surface and of one at the radius of maximum wind give, by iteration
over the central pressure, the lowest pressure and the greatest wind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.model import AXES, Axes

# Constants of moist thermodynamics (J, kg, K; vapour pressures in hPa).
CPD, CPV, CL, RV, RD, ALV0 = 1005.7, 1870.0, 2500.0, 461.5, 287.04, 2.501e6
EPS = RD / RV


def saturation_pressure(celsius: np.ndarray | float) -> np.ndarray | float:
    return 6.112 * np.exp(17.67 * celsius / (243.5 + celsius))


def _latent(celsius: np.ndarray) -> np.ndarray:
    return ALV0 + (CPV - CL) * celsius


def _entropy(t: np.ndarray, r: np.ndarray, p: np.ndarray, e: np.ndarray, rh: np.ndarray, r_total: np.ndarray) -> np.ndarray:
    return (CPD + r_total * CL) * np.log(t) - RD * np.log(p - e) + _latent(t - 273.15) * r / t - r * RV * np.log(rh)


def _saturated(s: np.ndarray, rp: np.ndarray, p: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Temperatures of saturated parcels of entropy s at pressures p, by Newton steps on all that have not settled, and which failed."""
    tg, failed = start.copy(), np.zeros(len(start), dtype=bool)
    at = np.arange(len(tg))  # those that still move
    for k in range(500):
        if not len(at):
            break
        now, rt, pl = tg[at], rp[at], p[at]
        eg = saturation_pressure(now - 273.15)
        rg = EPS * eg / (pl - eg)
        lat = _latent(now - 273.15)
        slope = (CPD + rt * CL + lat * lat * rg / (RV * now * now)) / now
        sg = (CPD + rt * CL) * np.log(now) - RD * np.log(pl - eg) + lat * rg / now
        new = now + (1.0 if k >= 3 else 0.3) * (s[at] - sg) / slope
        tg[at] = new
        lost = ~(new >= 100) | ~(saturation_pressure(new - 273.15) <= pl - 1)
        failed[at[lost]] = True
        at = at[~lost & ~(np.abs(new - now) < 1e-3)]
    return tg, failed


def capes(tp: np.ndarray, rp: np.ndarray, pp: np.ndarray, t: np.ndarray, r: np.ndarray, p: np.ndarray, ascent: float = 0.0, top: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CAPE (J/kg), outflow temperature, level of neutral buoyancy (hPa) and a flag (1 well, 0 unfit, 2 failed) of parcels (K, kg/kg, hPa), one for each sounding.

    t, r and p have a row for each sounding, from the surface up, with NaN after its last level. ascent 0 is reversible, 1 pseudo-adiabatic.
    """
    m, width = p.shape
    rows, level = np.arange(m), np.arange(width)[None, :]
    with np.errstate(all="ignore"):
        n = (p >= top).sum(axis=1)
        es, ev = saturation_pressure(tp - 273.15), rp * pp / (EPS + rp)
        rh = np.minimum(ev / es, 1.0)
        s = _entropy(tp, rp, pp, ev, np.maximum(rh, 1e-9), rp)
        lcl = pp * rh ** (tp / (1669.0 - 122.0 * rh - tp))
        fit = ~((n < 2) | (rp < 1e-6) | (tp < 200))
        use = (level < n[:, None]) & (p <= pp[:, None]) & fit[:, None]
        dry = use & (p >= lcl[:, None])
        tv = np.where(dry, tp[:, None] * (p / pp[:, None]) ** (RD / CPD) * ((1 + rp / EPS) / (1 + rp))[:, None], 0.0)
        row, at = np.nonzero(use & ~dry)
        tg, failed = _saturated(s[row], rp[row], p[row, at], t[row, at])
        eg = saturation_pressure(tg - 273.15)
        rg = EPS * eg / (p[row, at] - eg)
        tv[row, at] = tg * (1 + rg / EPS) / (1 + ascent * rg + (1 - ascent) * rp[row])
        buoyancy = np.where(use, tv - t * (1 + r / EPS) / (1 + r), 0.0)

        inb = np.where(buoyancy > 0, level, -1).max(axis=1)
        first = np.where(use, level, width).min(axis=1).clip(0, width - 1)
        lower, upper = p[:, :-1], p[:, 1:]
        part = RD * (buoyancy[:, 1:] + buoyancy[:, :-1]) * (lower - upper) / (lower + upper)
        part = np.where(use[:, :-1] & use[:, 1:] & (level[:, 1:] <= inb[:, None]), part, 0.0)
        below = p[rows, first]
        near = RD * (pp - below) / (pp + below) * buoyancy[rows, first]
        inside, above = inb.clip(0), (inb + 1).clip(0, width - 1)
        b0, b1, p0, p1, t0, t1 = (x[rows, i] for x in (buoyancy, p, t) for i in (inside, above))
        higher = inb < n - 1
        lnb = np.where(higher, (p1 * b0 - p0 * b1) / (b0 - b1), p0)
        rest = np.where(higher, RD * b0 * (p0 - lnb) / (p0 + lnb), 0.0)
        outflow = np.where(higher, (t0 * (lnb - p1) + t1 * (p0 - lnb)) / (p0 - p1), t0)
        energy = np.maximum(part.sum(axis=1) + near + rest, 0.0)
    flag = fit.astype(int)
    flag[row[failed]] = 2
    rising = (flag == 1) & (inb > 0)
    pick = lambda a, still: np.where(rising, a, still)
    return pick(energy, 0.0), pick(outflow, t[:, 0]), pick(lnb, np.where(flag == 1, p[:, 0], 0.0)), flag


def potential_intensities(sst: np.ndarray, psl: np.ndarray, p: np.ndarray, t: np.ndarray, r: np.ndarray, ckcd: float = 0.9, ascent: float = 0.0, dissipative: bool = True, reduction: float = 0.8, top: float = 50.0) -> tuple[np.ndarray, ...]:
    """V_max (m/s), P_min (hPa), flag (1 well, 0 no convergence or unfit, 2 the parcel failed), outflow temperature (K) and level (hPa) of each sounding.

    sst in C, psl and p in hPa (from the surface up), t in C, r in g/kg; p, t and r have a row for each sounding, in which levels
    with a missing value are left out. All soundings are iterated together until each has settled.
    """
    m = len(sst)
    if not m or p.shape[1] < 2:
        return (*(np.full(m, np.nan) for _ in range(2)), np.zeros(m, dtype=int), *(np.full(m, np.nan) for _ in range(2)))
    good = np.isfinite(t) & np.isfinite(r) & np.isfinite(p)
    order = np.argsort(~good, axis=1, kind="stable")
    p, t, r = (np.take_along_axis(np.where(good, a, np.nan), order, axis=1) for a in (p, t + 273.15, r * 1e-3))
    ts = sst + 273.15
    v_max, p_min, to, otl = (np.full(m, np.nan) for _ in range(4))
    flag = np.zeros(m, dtype=int)
    coldest = np.where(np.isnan(t), np.inf, t).min(axis=1)
    at = np.flatnonzero((sst > 5.0) & np.isfinite(sst + psl) & (good.sum(axis=1) >= 3) & (coldest > 100))
    c_env = np.zeros(m)
    c_env[at], _, _, flag[at] = capes(t[at, 0], r[at, 0], p[at, 0], t[at], r[at], p[at], ascent, top)
    at = at[flag[at] == 1]
    flag[at] = 0  # until they settle
    pm = np.full(m, 970.0)
    for _ in range(200):
        if not len(at):
            break
        t0, r0, ps, sea, pp = t[at, 0], r[at, 0], psl[at], ts[at], np.minimum(pm[at], 1000.0)
        es0 = saturation_pressure(sst[at])
        r_sat = EPS * es0 / (pp - es0)
        c_rm, _, _, f1 = capes(t0, EPS * r0 * ps / (pp * (EPS + r0) - r0 * ps), pp, t[at], r[at], p[at], ascent, top)
        c_sat, out, neutral, f2 = capes(sea, r_sat, pp, t[at], r[at], p[at], ascent, top)
        well = (f1 == 1) & (f2 == 1)
        ratio = sea / out if dissipative else np.ones(len(at))
        tv = 0.5 * (t0 * (1 + r0 / EPS) / (1 + r0) + sea * (1 + r_sat / EPS) / (1 + r_sat))
        gain = ckcd * ratio * (c_sat - c_rm)
        new = ps * np.exp(-np.maximum(c_rm - c_env[at] + 0.5 * gain, 0.0) / (RD * tv))
        settled = well & (np.abs(new - pm[at]) <= 0.5)
        pm[at] = new
        done = at[settled]
        flag[at[~well]], flag[done] = 2, 1
        v_max[done], p_min[done], to[done], otl[done] = reduction * np.sqrt(np.maximum(gain[settled], 0.0)), new[settled], out[settled], neutral[settled]
        at = at[well & ~settled & (new >= 400.0)]
    return v_max, p_min, flag, to, otl


#: Soundings that are iterated together.
TOGETHER = 2048


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows of a matrix, NaN after the last value of each."""
    n = lists.value_lengths().fill_null(0).to_numpy()
    out = np.full((len(n), max(2, n.max(initial=0))), np.nan)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _columns(options: dict):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(start, TOGETHER)
                sst, psl = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("__sst", "__psl"))
                sst = np.where(b.column("__sea").fill_null(False).to_numpy(zero_copy_only=False), sst, np.nan)
                got = potential_intensities(sst, psl, *(_padded(b.column(c)) for c in ("__p", "__t", "__r")), **options)
                keys = [n for n in b.schema.names if not n.startswith("__")]
                values = [pa.array(g.astype(np.int32)) if g.dtype.kind == "i" else pa.array(g, mask=np.isnan(g)) for g in got]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *values], names=[*keys, "V_max", "P_min", "IFL", "T_o", "OTL"])

    return f


def potential_intensity(df: DataFrame, sst: str, psl: str, temperature: str, mixing_ratio: str | None = None, specific_humidity: str | None = None, land: str | None = None, pressure: str = "z", axes: Axes = AXES, **options: float) -> DataFrame:
    """V_max, P_min, IFL, T_o and OTL of each column of cells over the sea.

    Inputs in K, Pa and kg/kg. Columns are gathered as arrays (short ones, a column each), and those of an Arrow batch are
    iterated together as one matrix; columns over land are missing.
    """
    r = F.col(mixing_ratio) if mixing_ratio else F.col(specific_humidity) / (1 - F.col(specific_humidity))
    keys = [c for c in (axes.step, axes.time, axes.j, axes.i, axes.y, axes.x) if c in df.columns]
    level = F.struct((-F.col(pressure)).alias("o"), (F.col(pressure) / 100.0).alias("p"), (F.col(temperature) - 273.15).alias("t"), (r * 1000.0).alias("r"))
    sea = (F.first(land) == 0) if land else F.lit(True)
    columns = df.groupBy(*keys).agg(F.sort_array(F.collect_list(level)).alias("__c"), (F.first(sst) - 273.15).cast("double").alias("__sst"), (F.first(psl) / 100.0).cast("double").alias("__psl"), sea.alias("__sea"))
    lists = [F.transform(F.col(f"__c.{n}"), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias(f"__{n}") for n in "ptr"]
    told = [T.StructField(n, T.IntegerType() if n == "IFL" else T.DoubleType()) for n in ("V_max", "P_min", "IFL", "T_o", "OTL")]
    rows = columns.select(*keys, *lists, "__sst", "__psl", "__sea")
    return rows.mapInArrow(_columns(options), T.StructType([*(columns.schema[k] for k in keys), *told]))
