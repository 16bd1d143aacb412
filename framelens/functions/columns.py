"""Column expressions: names and units, radial axes, equations of state, vectors, scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pressure units in GPa: fixed values.
PRESSURE_UNITS = {"gpa": 1.0, "mpa": 1e-3, "kpa": 1e-6, "pa": 1e-9, "mbar": 100.0, "kbar": 0.1, "bar": 1e-4}
_TOKEN = r"(?i)(\d+(?:[.,p]\d+)?)\s*[_-]?\s*(gpa|mpa|kpa|mbar|kbar|pa|bar)(?![a-z])"


def parse_pressure(text: Column) -> Column:
    """GPa of the first number with a unit, ``_`` or ``-`` may stand between; the decimal mark may be a point, a comma or p. Null without one."""
    number = F.regexp_replace(F.regexp_extract(text, _TOKEN, 1), "[,pP]", ".").try_cast("double")
    unit = F.lower(F.regexp_extract(text, _TOKEN, 2))
    factor = F.lit(None).cast("double")
    for name, value in PRESSURE_UNITS.items():
        factor = F.when(unit == name, value).otherwise(factor)
    return number * factor


def pressure_from_path(path: Column) -> Column:
    """The pressure in the base name, else in the nearest folder that has one."""
    found = F.transform(F.reverse(F.split(path, r"[/\\]")), parse_pressure)
    return F.try_element_at(F.filter(found, lambda p: p.isNotNull()), F.lit(1))


def scan_label(path: Column) -> Column:
    n = F.regexp_extract(path, r"(?i)scan[_-]?(\d+)", 1)
    return F.when(n == "", "scan_unknown").otherwise(F.concat(F.lit("scan"), F.lpad(n.try_cast("int").cast("string"), 3, "0")))


def folder_label(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise("folder_unknown")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def radial_to_d(radial: Column, unit: str, wavelength: float | None = None) -> Column:
    """d-spacing in angstrom of a radial value."""
    if unit == "q_A^-1":
        return 2 * math.pi / radial
    if unit == "q_nm^-1":
        return 20 * math.pi / radial
    if unit in ("2th_deg", "2th_rad"):
        if not wavelength:
            raise ValueError("an angle needs a wavelength")
        angle = F.radians(radial) if unit == "2th_deg" else radial
        return wavelength / (2 * F.sin(angle / 2))
    raise ValueError(f"unknown unit {unit}")


def d_to_radial(d: Column, unit: str, wavelength: float | None = None) -> Column:
    if unit == "q_A^-1":
        return 2 * math.pi / d
    if unit == "q_nm^-1":
        return 20 * math.pi / d
    if unit in ("2th_deg", "2th_rad"):
        if not wavelength:
            raise ValueError("an angle needs a wavelength")
        angle = 2 * F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), wavelength / (2 * d))))
        return F.degrees(angle) if unit == "2th_deg" else angle
    raise ValueError(f"unknown unit {unit}")


def d_error(q: Column, q_error: Column) -> Column:
    """The error of d = 2 pi / q; null if it isn't positive."""
    e = 2 * math.pi * q_error / (q * q)
    return F.when(e > 0, e)


def eos_pressure(eos: Column, ratio: Column, k0: Column, k0p: Column, k0pp: Column | None = None) -> Column:
    """Pressure at V / V0 for BM2, BM3 (default), BM4, Vinet and Murnaghan."""
    k0p = F.coalesce(k0p, F.lit(4.0))
    x = F.pow(ratio, F.lit(-1.0 / 3))
    strain = (x * x - 1) / 2
    base = 3 * k0 * strain * F.pow(1 + 2 * strain, F.lit(2.5))
    bm3 = base * (1 + 1.5 * (k0p - 4) * strain)
    k0pp = F.lit(None).cast("double") if k0pp is None else k0pp
    fourth = F.coalesce(k0pp, F.lit(0.0))
    bm4 = base * (1 + 1.5 * (k0p - 4) * strain + 1.5 * (k0 * fourth + (k0p - 4) * (k0p - 3) + 35 / 9) * strain * strain)
    y = F.pow(ratio, F.lit(1.0 / 3))
    vinet = 3 * k0 * (1 - y) / (y * y) * F.exp(1.5 * (k0p - 1) * (1 - y))
    murnaghan = k0 / k0p * (F.pow(ratio, -k0p) - 1)
    return F.when(eos == "BM2", base).when(eos == "BM4", bm4).when(eos == "Vinet", vinet).when(eos == "Murnaghan", murnaghan).otherwise(bm3)


#: The scan for the first crossing goes down from 1 in these steps: fixed values.
RATIO_STEP, RATIO_LEAST = 0.0025, 0.02


def _pressures(eos: str | None, ratio: np.ndarray, k0: np.ndarray, k0p: np.ndarray) -> np.ndarray:
    """:func:`eos_pressure` of arrays."""
    if eos == "Vinet":
        y = ratio ** (1.0 / 3)
        return 3 * k0 * (1 - y) / (y * y) * np.exp(1.5 * (k0p - 1) * (1 - y))
    if eos == "Murnaghan":
        return k0 / k0p * (ratio**-k0p - 1)
    x = ratio ** (-1.0 / 3)
    strain = (x * x - 1) / 2
    base = 3 * k0 * strain * (1 + 2 * strain) ** 2.5
    if eos == "BM2":
        return base
    if eos == "BM4":
        return base * (1 + 1.5 * (k0p - 4) * strain + 1.5 * ((k0p - 4) * (k0p - 3) + 35 / 9) * strain * strain)
    return base * (1 + 1.5 * (k0p - 4) * strain)


def _crossing(eos: str | None, p: np.ndarray, k0: np.ndarray, k0p: np.ndarray, halvings: int) -> np.ndarray:
    """The first crossing of each row's pressure; not a number without one."""
    grid = 1 - np.arange(1, int(round((1 - RATIO_LEAST) / RATIO_STEP)) + 1) * RATIO_STEP
    reached = _pressures(eos, grid[None, :], k0[:, None], k0p[:, None]) >= p[:, None]
    lo = np.where(reached.any(axis=1), grid[np.argmax(reached, axis=1)], np.nan)
    hi = lo + RATIO_STEP
    for _ in range(halvings):
        mid = (lo + hi) / 2
        high = _pressures(eos, mid, k0, k0p) >= p
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    return (lo + hi) / 2


def compression(eos: Column, pressure: Column, k0: Column, k0p: Column, halvings: int = 48) -> Column:
    """V / V0 at a pressure: the first crossing from 1 downwards, then bisection; 1 at 0 or less, the least ratio if none."""

    def ratios(kind: pd.Series, p: pd.Series, k: pd.Series, kp: pd.Series) -> pd.Series:
        p, k, kp = (x.to_numpy(dtype=float, na_value=np.nan) for x in (p, k, kp))
        kp, out = np.where(np.isnan(kp), 4.0, kp), np.full(len(p), np.nan)
        kinds = kind.astype(object).where(kind.notna(), None).to_numpy()
        with np.errstate(all="ignore"):
            for name in dict.fromkeys(kinds.tolist()):
                own = np.flatnonzero((kinds == name) & (p > 0) & ~np.isnan(k))
                for i in range(0, len(own), 1000):
                    rows = own[i : i + 1000]
                    out[rows] = _crossing(name, p[rows], k[rows], kp[rows], halvings)
        return pd.Series(np.where(p <= 0, 1.0, np.where(np.isnan(out), RATIO_LEAST, out)))

    return F.pandas_udf(ratios, "double")(eos.cast("string"), pressure.cast("double"), k0.cast("double"), k0p.cast("double"))


def thermal_scale(alpha: Column, temperature: Column, reference: Column) -> Column:
    return F.pow(F.greatest(F.lit(1e-6), 1 + alpha * (temperature - reference)), F.lit(1.0 / 3))


def axial_scale(pressure: Column, k0: Column, k0p: Column, beta: Column) -> Column:
    """Scale of one axis: exp(beta P) where a compressibility is given, else the cube root of an axis' own ratio."""
    return F.when(beta.isNotNull(), F.exp(beta * pressure)).otherwise(F.pow(compression(F.lit("BM3"), pressure, k0 * 3, k0p), F.lit(1.0 / 3)))


def parse_hkl(label: Column) -> Column:
    """The first three signed integers of a label."""
    return F.slice(F.transform(F.regexp_extract_all(label, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("int")), 1, 3)


def pixel_radius(row: Column, col: Column, centre_row: float, centre_col: float, pixel: float) -> Column:
    return F.hypot((row - centre_row) * pixel, (col - centre_col) * pixel)


def pixel_q(row: Column, col: Column, centre_row: float, centre_col: float, pixel: float, distance: float, wavelength: float) -> Column:
    """Scattering vector of a pixel of a flat detector; a wavelength below 1e-6 is in metres."""
    wavelength = wavelength * 1e10 if wavelength < 1e-6 else wavelength
    angle = F.atan(pixel_radius(row, col, centre_row, centre_col, pixel) / distance)
    return 4 * math.pi / wavelength * F.sin(angle / 2)


def pixel_azimuth(row: Column, col: Column, centre_row: float, centre_col: float) -> Column:
    return F.degrees(F.atan2(row - centre_row, col - centre_col))


def normalised(values: Column, clip: bool = True) -> Column:
    """Null to 0, negative to 0 if ``clip``, divided by the largest (by 1 if that isn't positive)."""
    filled = F.transform(values, lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) if clip else F.coalesce(v, F.lit(0.0)))
    top = F.array_max(filled)
    return F.transform(filled, lambda v: v / F.when(top > 0, top).otherwise(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def pseudo_voigt(x: Column, height: Column, centre: Column, fwhm: Column, eta: Column) -> Column:
    t = (x - centre) / fwhm
    return height * (eta / (1 + 4 * t * t) + (1 - eta) * F.exp(-4 * math.log(2) * t * t))


def quality_tier(flag: Column, misfit: Column, most: float = 0.05) -> Column:
    """reject: a flag is set; position: the misfit is unknown or too large; else quantitative."""
    return F.when(flag != 0, "reject").when(misfit.isNull() | (misfit > most), "position").otherwise("quantitative")


def confidence(recall: Column, precision: Column, matched: Column, penalty: Column, correlation: Column, least: int = 3, weight: float = 0.3) -> Column:
    """F1 of recall and precision, lowered by few matches, by the prior and by a poor intensity correlation."""
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return f1 * F.least(F.lit(1.0), matched / least) * penalty * (1 - weight * (1 - correlation))


def pressure_half_window(sigma: Column, k: float = 3.0, default: float = 5.0) -> Column:
    return F.greatest(F.when(sigma > 0, k * sigma).otherwise(default), F.lit(0.3))


def resolution_width(q: Column, c2: float, c1: float, c0: float) -> Column:
    return F.sqrt(F.greatest(c2 * q * q + c1 * q + c0, F.lit(1e-8)))
