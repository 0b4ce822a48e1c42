"""Potential intensity of one sounding, level by level and step by step: the plain form that the tests hold the operator against."""

import numpy as np

from isobar.operators.potential_intensity import ALV0, CL, CPD, CPV, EPS, RD, RV, saturation_pressure


def _latent(celsius: float) -> float:
    return ALV0 + (CPV - CL) * celsius


def _entropy(t: float, r: float, p: float, e: float, rh: float, r_total: float) -> float:
    return (CPD + r_total * CL) * np.log(t) - RD * np.log(p - e) + _latent(t - 273.15) * r / t - r * RV * np.log(rh)


def cape(tp: float, rp: float, pp: float, t: np.ndarray, r: np.ndarray, p: np.ndarray, ascent: float = 0.0, top: float = 50.0) -> tuple[float, float, float, int]:
    """CAPE (J/kg), outflow temperature, level of neutral buoyancy (hPa) and a flag (1 well) of a parcel (K, kg/kg, hPa).

    ascent 0 is reversible, 1 pseudo-adiabatic.
    """
    n = int((p >= top).sum())
    if n < 2 or rp < 1e-6 or tp < 200:
        return 0.0, float(t[0]), 0.0, 0
    es = saturation_pressure(tp - 273.15)
    ev = rp * pp / (EPS + rp)
    rh = min(ev / es, 1.0)
    s = _entropy(tp, rp, pp, ev, max(rh, 1e-9), rp)
    chi = tp / (1669.0 - 122.0 * rh - tp)
    lcl = pp * rh**chi
    buoyancy = np.zeros(n)
    for level in range(n):
        if p[level] > pp:
            continue
        if p[level] >= lcl:
            tg, rg = tp * (p[level] / pp) ** (RD / CPD), rp
            tv = tg * (1 + rg / EPS) / (1 + rg)
        else:
            tg = float(t[level])
            rg = EPS * saturation_pressure(tg - 273.15) / (p[level] - saturation_pressure(tg - 273.15))
            for k in range(500):
                eg = saturation_pressure(tg - 273.15)
                rg = EPS * eg / (p[level] - eg)
                lat = _latent(tg - 273.15)
                slope = (CPD + rp * CL + lat * lat * rg / (RV * tg * tg)) / tg
                sg = (CPD + rp * CL) * np.log(tg) - RD * np.log(p[level] - eg) + lat * rg / tg
                new = tg + (1.0 if k >= 3 else 0.3) * (s - sg) / slope
                done = abs(new - tg) < 1e-3
                tg = new
                if not np.isfinite(tg) or tg < 100 or saturation_pressure(tg - 273.15) > p[level] - 1:
                    return 0.0, float(t[0]), 0.0, 2
                if done:
                    break
            eg = saturation_pressure(tg - 273.15)
            rg = EPS * eg / (p[level] - eg)
            total = ascent * rg + (1 - ascent) * rp
            tv = tg * (1 + rg / EPS) / (1 + total)
        buoyancy[level] = tv - t[level] * (1 + r[level] / EPS) / (1 + r[level])
    positive = np.flatnonzero(buoyancy > 0)
    if not len(positive) or positive[-1] == 0:
        return 0.0, float(t[0]), float(p[0]), 1
    inb = int(positive[-1])
    use = [level for level in range(n) if p[level] <= pp]
    first = use[0]
    plus = minus = 0.0
    for a, b in zip(use, use[1:], strict=False):
        if b > inb:
            break
        part = RD * (buoyancy[b] + buoyancy[a]) * (p[a] - p[b]) / (p[a] + p[b])
        plus, minus = plus + max(part, 0.0), minus - min(part, 0.0)
    pma = pp + p[first]
    near = RD * (pp - p[first]) / pma * buoyancy[first]
    plus, minus = plus + max(near, 0.0), minus - min(near, 0.0)
    rest, lnb, outflow = 0.0, float(p[inb]), float(t[inb])
    if inb < n - 1:
        lnb = (p[inb + 1] * buoyancy[inb] - p[inb] * buoyancy[inb + 1]) / (buoyancy[inb] - buoyancy[inb + 1])
        rest = RD * buoyancy[inb] * (p[inb] - lnb) / (p[inb] + lnb)
        outflow = (t[inb] * (lnb - p[inb + 1]) + t[inb + 1] * (p[inb] - lnb)) / (p[inb] - p[inb + 1])
    return max(plus + rest - minus, 0.0), float(outflow), float(lnb), 1


def potential_intensity_of(sst: float, psl: float, p: np.ndarray, t: np.ndarray, r: np.ndarray, ckcd: float = 0.9, ascent: float = 0.0, dissipative: bool = True, reduction: float = 0.8, top: float = 50.0) -> tuple[float, float, int, float, float]:
    """V_max (m/s), P_min (hPa), flag (1 well, 0 no convergence or unfit, 2 the parcel failed), outflow temperature (K) and level (hPa).

    sst in C, psl and p in hPa (from the surface up), t in C, r in g/kg.
    """
    good = np.isfinite(t) & np.isfinite(r) & np.isfinite(p)
    p, t, r = p[good], t[good] + 273.15, r[good] * 1e-3
    ts = sst + 273.15
    nan = float("nan")
    if sst <= 5.0 or not np.isfinite(sst + psl) or len(t) < 3 or t.min() <= 100:
        return nan, nan, 0, nan, nan
    es0 = saturation_pressure(sst)
    c_env, _, _, flag = cape(t[0], r[0], p[0], t, r, p, ascent, top)
    if flag != 1:
        return nan, nan, flag, nan, nan
    pm, to, otl = 970.0, nan, nan
    for n in range(200):
        before = pm
        pp = min(pm, 1000.0)
        r_rm = EPS * r[0] * psl / (pp * (EPS + r[0]) - r[0] * psl)
        c_rm, _, _, f1 = cape(t[0], r_rm, pp, t, r, p, ascent, top)
        r_sat = EPS * es0 / (pp - es0)
        c_sat, to, otl, f2 = cape(ts, r_sat, pp, t, r, p, ascent, top)
        if f1 != 1 or f2 != 1:
            return nan, nan, 2, nan, nan
        ratio = ts / to if dissipative else 1.0
        tv0 = t[0] * (1 + r[0] / EPS) / (1 + r[0])
        tv_sat = ts * (1 + r_sat / EPS) / (1 + r_sat)
        tv_mean = 0.5 * (tv0 + tv_sat)
        fac = max(c_rm - c_env + 0.5 * ckcd * ratio * (c_sat - c_rm), 0.0)
        pm = psl * np.exp(-fac / (RD * tv_mean))
        if abs(pm - before) <= 0.5 or n > 1 and abs(pm - before) < 0.2:
            break
        if pm < 400.0 or n == 199:
            return nan, nan, 0, nan, nan
    cat = max(c_rm - c_env + 0.5 * ckcd * ratio * (c_sat - c_rm), 0.0)
    p_min = psl * np.exp(-cat / (RD * tv_mean))
    v_max = reduction * np.sqrt(max(ckcd * ratio * (c_sat - c_rm), 0.0))
    return float(v_max), float(p_min), 1, float(to), float(otl)
