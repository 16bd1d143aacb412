"""Joint fits of overlapping peaks: up to a dozen pseudo-Voigt profiles on one linear background.

Heights and background are linear, so for given centres, widths and shapes they follow from one least-squares solution (variable
projection); only centres, widths and shapes are searched, by damped Gauss-Newton steps on the residual that the linear part
leaves. A frame's pattern and candidates are one row, as a pattern has a bounded number of bins; frames are spread over the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.peaks import peak_groups, split_groups

#: Flags: a height below two sigmas, a poor fit of the peak's own bins, a centre or a width at its bound, no solution: fixed values.
LOW, POOR, DRIFTED, BOUND, FAILED = 1, 2, 4, 8, 16
#: Bounds in widths of the candidate: how far a centre moves, and a width's smallest and largest; a height's largest in its first guess: fixed values.
MOVE, NARROW, WIDE = 0.5, 0.2, 5.0
#: Widths around a peak that it is judged on, the misfit and chi2 that together make it poor: fixed values.
OWN, MISFIT, CHI2 = 2.0, 0.05, 25.0
STEPS, EASE = 80, 1e-11
#: The least share of the largest that a triangle's diagonal has for a solution from it; groups, and bins times peaks, fitted together: fixed values.
SPREAD = 1e-11
TOGETHER, TOGETHER_CELLS = 128, 1 << 19
_LN2 = math.log(2.0)


def profiles(x: np.ndarray, c: np.ndarray, w: np.ndarray, e: np.ndarray, slopes: bool = False):
    """Profiles of height 1 (columns) at x (rows); with ``slopes`` also their derivatives by centre, width and shape."""
    c, w, e = (v[..., None, :] for v in (c, w, e))
    t = (x[..., None] - c) / w
    lorentz, gauss = 1 / (1 + 4 * t * t), np.exp(-4 * _LN2 * t * t)
    p = e * lorentz + (1 - e) * gauss
    if not slopes:
        return p
    by_t = -8 * t * (e * lorentz * lorentz + (1 - e) * _LN2 * gauss)
    return p, -by_t / w, -by_t * t / w, lorentz - gauss


def linear_part(p: np.ndarray, xc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heights of 0 or more, background (value and slope) and which profiles have a height, of the best combination of these profiles."""
    used = np.ones(p.shape[1], dtype=bool)
    while True:
        a = np.column_stack([p[:, used], np.ones_like(xc), xc])
        solution = np.linalg.lstsq(a, y, rcond=None)[0]
        n = int(used.sum())
        if not n or solution[:n].min() >= 0:
            heights = np.zeros(p.shape[1])
            heights[used] = solution[:n]
            return heights, solution[n:], used
        used[np.flatnonzero(used)[int(np.argmin(solution[:n]))]] = False


def _without(a: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The columns of each matrix, unused ones moved to rows of their own, where they are orthogonal to all others."""
    k = used.shape[1]
    out = np.zeros((a.shape[0], a.shape[1] + k, a.shape[2]))
    out[:, : a.shape[1]] = a
    out[:, : a.shape[1], :k] *= used[:, None, :]
    out[:, a.shape[1] + np.arange(k), np.arange(k)] = ~used
    return out


def linear_parts(p: np.ndarray, m: np.ndarray, xc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`linear_part` of many groups with equally many profiles; ``m`` is 1 on a group's own bins, all others have zeros only.

    The bins of a group are reduced once, to a triangle; without a profile the triangle is reduced again. Groups whose
    profiles are hardly apart (SPREAD) go to :func:`linear_part`.
    """
    k = p.shape[2]
    tri = np.linalg.qr(np.concatenate([p, m[..., None], xc[..., None], y[..., None]], axis=2), mode="r")
    used, solution, todo, now = np.ones((len(p), k), dtype=bool), np.zeros((len(p), k + 2)), np.arange(len(p)), tri
    while len(todo):
        size = np.abs(np.diagonal(now[:, : k + 2, : k + 2], axis1=1, axis2=2))
        close = ~(size.min(axis=1) > SPREAD * size.max(axis=1))
        for i in todo[close]:
            own = m[i] > 0
            heights, ground, used[i] = linear_part(p[i, own], xc[i, own], y[i, own])
            solution[i] = np.concatenate([heights, ground])
        todo, now = todo[~close], now[~close]
        found = np.linalg.solve(now[:, : k + 2, : k + 2], now[:, : k + 2, k + 2 :])[..., 0]
        found[:, :k][~used[todo]] = 0.0
        solution[todo] = found
        low = np.where(used[todo], found[:, :k], np.inf)
        below = low.min(axis=1) < 0
        todo = todo[below]
        used[todo, np.argmin(low[below], axis=1)] = False
        if len(todo):
            now = np.linalg.qr(_without(tri[todo], used[todo]), mode="r")
    return solution[:, :k], solution[:, k:], used


def fit_group(x: np.ndarray, y: np.ndarray, center: np.ndarray, fwhm: np.ndarray, sigma: float = 1.0) -> list[dict]:
    """The peaks of one group, given the bins of its window and first guesses of centres and widths (any order).

    Esds come from the inverse of the whole normal matrix, scaled by the reduced chi2. A peak is judged on the bins within OWN
    widths where its profile is the highest; the residual is that of all peaks together.
    """
    return fit_groups([(x, y, center, fwhm, sigma)])[0]


def fit_groups(groups: list[tuple]) -> list[list[dict]]:
    """:func:`fit_group` of many groups (its arguments) with equally many peaks: each goes its own way, all take their steps together."""
    out: list[list[dict]] = [[] for _ in groups]
    k, fit = len(groups[0][2]), []
    nothing = dict.fromkeys(("height", "area", "chi2", "chi2_local", "rel_misfit", "center_err", "height_err", "fwhm_err"))
    for i, (x, _, center, fwhm, _) in enumerate(groups):
        if len(x) < 4 * k + 2:
            out[i] = [nothing | {"center": float(c), "fwhm": float(w), "eta": 0.5, "flag": FAILED} for c, w in zip(center, fwhm)]
        else:
            fit.append(i)
    if not fit:
        return out
    n = np.array([len(groups[i][0]) for i in fit])
    m = (np.arange(n.max()) < n[:, None]).astype(float)
    x, y, xc = np.zeros_like(m), np.zeros_like(m), np.zeros_like(m)
    for j, i in enumerate(fit):
        x[j, : n[j]], y[j, : n[j]] = groups[i][:2]
        xc[j, : n[j]] = groups[i][0] - groups[i][0].mean()
    center, fwhm = (np.array([groups[i][v] for i in fit], dtype=float) for v in (2, 3))
    sigma = np.array([groups[i][4] if groups[i][4] > 0 else 1.0 for i in fit])
    one = np.ones_like(center)
    lo = np.concatenate([center - MOVE * fwhm, NARROW * fwhm, 0 * one], axis=1)
    hi = np.concatenate([center + MOVE * fwhm, WIDE * fwhm, one], axis=1)
    size = np.concatenate([fwhm, fwhm, one], axis=1)  # of a step that matters
    at = np.concatenate([center, fwhm, 0.5 * one], axis=1)

    def judged(own: np.ndarray, at: np.ndarray):
        p = profiles(x[own], at[:, :k], at[:, k : 2 * k], at[:, 2 * k :]) * m[own][..., None]
        heights, ground, used = linear_parts(p, m[own], xc[own], y[own])
        rest = y[own] - (p @ heights[..., None])[..., 0] - ground[:, :1] * m[own] - ground[:, 1:] * xc[own]
        return heights, ground, used, rest, (rest * rest).sum(axis=1)

    heights, ground, used, rest, best = judged(np.arange(len(fit)), at)
    inner, total = np.arange(3 * k), len(fit)
    normal, pull, diagonal = np.zeros((total, 3 * k, 3 * k)), np.zeros((total, 3 * k)), np.zeros((total, 3 * k))
    # Each turn is one try of every group at work; those that moved get new slopes first, the others more damping.
    damping, taken, moved_on, on = np.full(total, 1e-2), np.zeros(total, dtype=int), np.ones(total, dtype=bool), np.arange(total)
    while len(on):
        new = on[moved_on[on]]
        if len(new):
            p, *slopes = profiles(x[new], at[new, :k], at[new, k : 2 * k], at[new, 2 * k :], True)
            mine = m[new][..., None]
            jac = np.concatenate([s * heights[new][:, None, :] for s in slopes], axis=2) * (size[new][:, None, :] * mine)
            # What heights and background can take up is no change of the residual.
            basis = np.linalg.qr(_without(np.concatenate([p * mine, mine, xc[new][..., None]], axis=2), used[new]))[0][:, : m.shape[1]]
            jac -= basis @ (basis.transpose(0, 2, 1) @ jac)
            to = (jac.transpose(0, 2, 1) @ rest[new][..., None])[..., 0]
            stuck = ((at[new] <= lo[new]) & (to < 0)) | ((at[new] >= hi[new]) & (to > 0))
            jac *= ~stuck[:, None, :]
            to[stuck] = 0.0
            pull[new], normal[new] = to, jac.transpose(0, 2, 1) @ jac
            diagonal[new] = normal[new[:, None], inner, inner] + 1e-12 * (1 + np.trace(normal[new], axis1=1, axis2=2))[:, None]
        damped = normal[on]
        damped[:, inner, inner] += damping[on][:, None] * diagonal[on]
        tried = np.clip(at[on] + np.linalg.solve(damped, pull[on][..., None])[..., 0] * size[on], lo[on], hi[on])
        found = judged(on, tried)
        good = found[-1] <= best[on]
        who, not_yet = on[good], on[~good]
        far, gain = np.abs(tried - at[on]).max(axis=1) / fwhm[on].min(axis=1), best[who] - found[-1][good]
        at[who] = tried[good]
        heights[who], ground[who], used[who], rest[who], best[who] = (v[good] for v in found)
        damping[who], damping[not_yet] = np.maximum(damping[who] / 5, 1e-10), damping[not_yet] * 4
        taken[who] += 1
        moved_on[on] = good
        done = np.zeros(total, dtype=bool)
        done[who] = (taken[who] >= STEPS) | ((gain <= EASE * (best[who] + 1e-300)) & (far[good] <= 1e-7))
        # More damping makes a step only smaller, and one of so few widths changes nothing.
        done[not_yet] = ~(damping[not_yet] < 1e8) | (far[~good] <= 1e-9)
        on = on[~done[on]]
    c, w, e = at[:, :k], at[:, k : 2 * k], at[:, 2 * k :]
    p, by_c, by_w, by_e = (v * m[..., None] for v in profiles(x, c, w, e, True))
    chi2 = best / sigma**2 / np.maximum(n - 4 * k - 2, 1)
    high = heights[:, None, :]
    whole = np.concatenate([by_c * high, p, by_w * high, by_e * high, m[..., None], xc[..., None]], axis=2) / sigma[:, None, None]
    inverse = np.linalg.pinv(whole.transpose(0, 2, 1) @ whole)
    esd = np.sqrt(np.clip(np.diagonal(inverse, axis1=1, axis2=2), 0, None) * chi2[:, None])
    owner = np.argmax(p * high, axis=2)
    for g, i in enumerate(fit):
        real = slice(0, n[g])
        for j in range(k):
            span = np.abs(x[g, real] - c[g, j]) <= OWN * w[g, j]
            own = span & (owner[g, real] == j)
            own = own if own.sum() >= 5 else span if span.sum() >= 5 else np.ones(n[g], dtype=bool)
            height, mine = heights[g, j], rest[g, real][own]
            local = float(mine @ mine)
            misfit = math.sqrt(local / own.sum()) / height if height > 0 else None
            chi2_local = local / sigma[g] ** 2 / max(int(own.sum()) - 4, 1)
            flag = LOW * (height < 2 * sigma[g]) + POOR * (chi2_local > CHI2 and (misfit is None or misfit > MISFIT))
            flag += DRIFTED * (abs(c[g, j] - center[g, j]) >= MOVE * fwhm[g, j] * 0.999) + BOUND * (w[g, j] <= NARROW * fwhm[g, j] * 1.001 or w[g, j] >= WIDE * fwhm[g, j] * 0.999)
            area = height * w[g, j] * (e[g, j] * math.pi / 2 + (1 - e[g, j]) * math.sqrt(math.pi / _LN2) / 2)
            out[i].append({
                "height": float(height), "center": float(c[g, j]), "fwhm": float(w[g, j]), "eta": float(e[g, j]), "area": float(area), "chi2": float(chi2[g]), "chi2_local": float(chi2_local), "rel_misfit": misfit,
                "center_err": float(esd[g, j]), "height_err": float(esd[g, k + j]), "fwhm_err": float(esd[g, 2 * k + j]), "flag": int(flag),
            })
    return out


RESULT = "frame long, id long, height double, center double, fwhm double, eta double, area double, chi2 double, chi2_local double, rel_misfit double, center_err double, height_err double, fwhm_err double, flag int, n_group int"


def fit_jointly(bins: DataFrame, candidates: DataFrame, y: str, sigma: DataFrame | None = None, reach: float = 3.0, most: int = 12) -> DataFrame:
    """height, center, fwhm, eta, area, chi2, chi2_local, rel_misfit, esds and flag of each candidate (frame, id, center, fwhm).

    Candidates whose windows of ``reach`` widths overlap are one group, cut until no part has more than ``most``; a group is
    fitted at once over the bins (frame, radial, y) from ``reach`` of its largest width before to as far after its peaks.
    ``sigma`` (frame, sigma) is the noise, by default 1. Null values and bins are left out; with fewer than 4 bins a peak and 2
    more the flag is FAILED and the values are null. ``n_group`` is the number of peaks fitted together.
    """
    grouped = split_groups(peak_groups(candidates.select("frame", "id", "center", "fwhm"), reach), most)
    item = F.struct(F.struct("group", "part").alias("g"), "center", "id", "fwhm")
    peaks = grouped.filter("center IS NOT NULL AND fwhm > 0").groupBy("frame").agg(F.array_sort(F.collect_list(item)).alias("c"))
    peaks = peaks.select("frame", F.transform("c", lambda v: F.concat_ws("/", v["g"]["group"].cast("string"), v["g"]["part"])).alias("groups"), *[F.col(f"c.{k}").alias(k) for k in ("id", "center", "fwhm")])
    pattern = bins.filter(F.col(y).isNotNull() & F.col("radial").isNotNull() & ~F.isnan(y)).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("radial", F.col(y).cast("double").alias("y")))).alias("b"))
    pattern = pattern.select("frame", F.col("b.radial").alias("x"), F.col("b.y").alias("y"))
    both = peaks.join(pattern, "frame")
    both = both.withColumn("sigma", F.lit(1.0)) if sigma is None else both.join(sigma.select("frame", "sigma"), "frame", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, list] = {}  # by the number of peaks, and whether there are bins enough: what fit_groups takes, and the rows to write
        cells: dict[tuple, int] = {}  # the most bins times peaks of one of them

        def fitted(own: list) -> pd.DataFrame:
            own.sort(key=lambda g: len(g[0][0]))
            out = []
            for (_, frame, ids), found in zip(own, fit_groups([g[0] for g in own])):
                out += [f | {"frame": frame, "id": int(i), "n_group": len(ids)} for i, f in zip(ids, found)]
            return pd.DataFrame(out)[[c.split()[0] for c in RESULT.split(", ")]]

        for batch in batches:
            for r in batch.itertuples(index=False):
                x, v, groups = np.asarray(r.x, dtype=float), np.asarray(r.y, dtype=float), np.asarray(r.groups)
                center, fwhm, ids = np.asarray(r.center, dtype=float), np.asarray(r.fwhm, dtype=float), np.asarray(r.id)
                noise = 1.0 if r.sigma is None or not r.sigma > 0 else float(r.sigma)
                for g in dict.fromkeys(groups.tolist()):
                    own = np.flatnonzero(groups == g)
                    far = reach * fwhm[own].max()
                    inside = (x >= center[own].min() - far) & (x <= center[own].max() + far)
                    key = len(own), int(inside.sum()) >= 4 * len(own) + 2
                    same = waiting.setdefault(key, [])
                    same.append(((x[inside], v[inside], center[own], fwhm[own], noise), r.frame, ids[own]))
                    cells[key] = max(cells.get(key, 0), int(inside.sum()) * len(own))
                    if len(same) >= TOGETHER or len(same) * cells[key] >= TOGETHER_CELLS:
                        cells.pop(key)
                        yield fitted(waiting.pop(key))
        for own in waiting.values():
            yield fitted(own)

    # Each row is much work: by number, so that they aren't put into a few tasks.
    parts = int(bins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, F.xxhash64("frame")).mapInPandas(run, RESULT)
