"""Phases and pressures of frames: every phase's lines against a frame's peaks, over a grid of pressures and finer around the best.

A frame's peaks are packed into one sorted row; frames are spread over the tasks and never shuffled again. A task takes phase by
phase (the library is a parameter, so its size is known) and finds the nearest peak of each predicted line by binary search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.operators import lattice

#: Points of the grid, the highest pressure searched, lines that count as strong, pairs for an intensity
#: agreement, its weight in the confidence, matches for full evidence, and sigmas beyond which a peak adds nothing.
GRID, P_MAX, STRONG, LEAST_PAIRS, INTENSITY, LEAST_MATCHED, REACH = 300, 100.0, 0.1, 3, 0.3, 3, 6.0
#: Finer grids around the best: points on each, every one between the neighbours of the best before.
ZOOM_POINTS, ZOOMS = 33, 2
#: So few peaks are gone through one by one.
FEW = 6
#: Frames whose rows are returned together: a fixed value.
FRAMES_AT_ONCE = 500
#: Frames of up to so many peaks are fitted together, in parts of so many places for peaks; points of pressures that are tried at
#: once; kept kernels of peaks that may come again, in numbers: fixed values.
MOST_PEAKS, PLACES, POINTS, KEPT = 64, 2048, 8192, 4_000_000
#: Steps of V / V0 in the table that an equation of state is inverted by.
RATIO_STEP, RATIO_LEAST = 1e-4, 0.02


def eos_pressure(eos: str | None, ratio: np.ndarray, k0: float, k0p: float | None) -> np.ndarray:
    """Pressure at V / V0, as :func:`framelens.functions.columns.eos_pressure` has it for columns."""
    k0p = 4.0 if k0p is None else k0p
    y = np.cbrt(ratio)
    if eos == "Vinet":
        return 3 * k0 * (1 - y) / (y * y) * np.exp(1.5 * (k0p - 1) * (1 - y))
    if eos == "Murnaghan":
        return k0 / k0p * (ratio**-k0p - 1)
    strain = (y**-2 - 1) / 2
    base = 3 * k0 * strain * (1 + 2 * strain) ** 2.5
    if eos == "BM2":
        return base
    out = base * (1 + 1.5 * (k0p - 4) * strain)
    return out + base * 1.5 * ((k0p - 4) * (k0p - 3) + 35 / 9) * strain * strain if eos == "BM4" else out


class Scale:
    """The linear scale at any pressure of one equation of state: a table up to the first pressure that doesn't rise."""

    def __init__(self, eos: str | None, k0: float, k0p: float | None):
        ratio = np.arange(1.0, RATIO_LEAST, -RATIO_STEP)
        pressure = eos_pressure(eos, ratio, k0, k0p)
        rising = np.flatnonzero(np.diff(pressure) <= 0)
        end = rising[0] + 1 if len(rising) else len(ratio)
        self.pressure, self.ratio, self.of = pressure[:end], ratio[:end], lambda r: eos_pressure(eos, r, k0, k0p)

    def __call__(self, pressure: np.ndarray, exact: bool) -> np.ndarray:
        p = np.asarray(pressure, dtype=float)
        r = np.interp(p, self.pressure, self.ratio)
        for _ in range(2 * exact):  # Newton steps from a start that is right to some 1e-9
            slope = (self.of(r + 1e-6) - self.of(r - 1e-6)) / 2e-6
            r = r - np.where(slope < 0, (self.of(r) - p) / np.where(slope < 0, slope, 1.0), 0.0)
        return np.cbrt(np.where(p <= 0, 1.0, np.where(p > self.pressure[-1], RATIO_LEAST, r)))


class Phase:
    """One phase of the library with its lines; ``row`` has the columns of :mod:`lattice`, ``lines`` d0, weight and hkl by falling d."""

    def __init__(self, row: dict, lines: list[tuple[float, float, tuple | None]]):
        get = row.get
        self.name, self.alpha, self.t0 = row["name"], get("alpha_v"), lattice.ROOM if get("t0") is None else get("t0")
        self.d0, self.weight = np.array([x[0] for x in lines]), np.array([x[1] for x in lines])
        self.hkl = np.array([x[2] for x in lines], dtype=float) if lines and all(x[2] is not None for x in lines) else None
        self.top = math.inf if get("p_max") is None else get("p_max")
        self.volume = None if get("k0") is None else Scale(get("eos"), get("k0"), get("k0p"))
        a = get("a")
        self.cell = [a, *[a if get(k) is None else get(k) for k in "bc"], *[90.0 if get(k) is None else get(k) for k in ("alpha", "beta", "gamma")]]
        self.axes: list = []
        for k in "abc":
            beta, k0 = get(f"beta_{k}"), get(f"k0_{k}")
            self.axes.append((lambda p, _, b=beta: np.exp(b * p)) if beta is not None else None if k0 is None else Scale(get(f"eos_{k}"), k0, get(f"k0p_{k}")))
        self.axial = any(x is not None for x in self.axes)
        self.moves = self.volume is not None or self.axial
        assumption = (get("assumption") or "").strip().lower()
        self.bound = assumption != "ignore_prior"
        self.ambient = self._spacings(*[np.array([x]) for x in self.cell[:3]])[0] if self.axial and self.hkl is not None and a else None

    def _spacings(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Spacings of all lines (columns) in cells of these axes (rows), by the inverse of the metric tensor."""
        ca, cb, cg = np.cos(np.radians(self.cell[3:]))
        metric = np.empty((len(a), 3, 3))
        for i, j, v in ((0, 0, a * a), (1, 1, b * b), (2, 2, c * c), (0, 1, a * b * cg), (0, 2, a * c * cb), (1, 2, b * c * ca)):
            metric[:, i, j] = metric[:, j, i] = v
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 / np.sqrt(np.einsum("li,pij,lj->pl", self.hkl, np.linalg.inv(metric), self.hkl))

    def lines(self, pressure: np.ndarray, temperature: float | None = None, exact: bool = False) -> np.ndarray:
        """The d of each line (columns) at each pressure (rows); right to a few 1e-9, or ``exact``."""
        p = np.clip(np.asarray(pressure, dtype=float), 0.0, self.top)
        iso = self.volume(p, exact) if self.volume else np.ones(len(p))
        out = self.d0 * iso[:, None]
        if self.ambient is not None:
            first = self.axes[0](p, exact) if self.axes[0] else iso
            second = self.axes[1](p, exact) if self.axes[1] else first if abs(self.cell[0] - self.cell[1]) < 1e-6 else iso
            third = self.axes[2](p, exact) if self.axes[2] else iso
            pressed = self._spacings(*[x * s for x, s in zip(self.cell[:3], (first, second, third))])
            ratio = self.d0 * (pressed / self.ambient)
            out = np.where(((p > 0)[:, None]) & np.isfinite(ratio), ratio, out)
        if temperature is not None and math.isfinite(temperature) and self.alpha:
            out = out * max(1 + self.alpha * (temperature - self.t0), 1e-6) ** (1 / 3)
        return out


class Peaks:
    """A frame's peaks by rising d, with their errors and amplitudes."""

    def __init__(self, d, err=None, amplitude=None):
        d = np.asarray(d, dtype=float)
        good = np.isfinite(d) & (d > 0)
        own = lambda x, other: np.full(good.sum(), other) if x is None else np.where(np.isfinite(y := np.asarray(x, dtype=float)[good]), y, other)
        err, amplitude = own(err, 0.0), own(amplitude, np.nan)
        order = np.lexsort((err, d[good]))
        self.d, self.err, self.amplitude = d[good][order], err[order], amplitude[order]
        self.first, self.some_err = np.searchsorted(self.d, self.d), bool(self.err.any())

    def nearest(self, lines: np.ndarray) -> np.ndarray:
        """The nearest peak of each line: the smaller d on ties, and of equal d's the one with the smallest error."""
        right = np.clip(np.searchsorted(self.d, lines), 0, len(self.d) - 1)
        left = np.maximum(right - 1, 0)
        return self.first[np.where(np.abs(lines - self.d[left]) <= np.abs(lines - self.d[right]), left, right)]


def kernels(peaks: Peaks, lines: np.ndarray, rel_tol: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(-(gap / sigma)^2 / 2) of each line's nearest peak, 0 beyond REACH sigmas, and the gaps."""
    if len(peaks.d) <= FEW:  # faster than a search
        gap, err = np.full(lines.shape, np.inf), np.zeros(lines.shape)
        for d, e in zip(peaks.d.tolist(), peaks.err.tolist()):
            own = np.abs(lines - d)
            nearer = own < gap
            gap = np.where(nearer, own, gap)
            if e:
                err[nearer] = e
            elif peaks.some_err:
                err[nearer] = 0.0
    else:
        near = peaks.nearest(lines)
        gap, err = np.abs(lines - peaks.d[near]), peaks.err[near]
    z = gap * gap / (np.maximum(rel_tol * lines, 1e-9) ** 2 + err * err)
    return np.where(z <= REACH * REACH, np.exp(-0.5 * z), 0.0), gap


def match(lines: np.ndarray, peaks: Peaks, rel_tol: float, factor: float = 2.0) -> list[tuple[int, int]]:
    """Pairs of line and peak, one to one, the closest first, ties by line and peak."""
    tolerance = factor * np.hypot(np.maximum(rel_tol * lines, 1e-9)[:, None], peaks.err[None, :])
    gap = np.abs(lines[:, None] - peaks.d[None, :])
    i, j = np.nonzero(gap < tolerance)
    lines_free, peaks_free, out = np.ones(len(lines), dtype=bool), np.ones(len(peaks.d), dtype=bool), []
    for k in np.lexsort((j, i, gap[i, j])):
        if lines_free[i[k]] and peaks_free[j[k]]:
            lines_free[i[k]] = peaks_free[j[k]] = False
            out.append((int(i[k]), int(j[k])))
    return out


def evidence(phase: Phase, peaks: Peaks, lines: np.ndarray, rel_tol: float) -> dict:
    """score, n_matched, recall, precision and the agreement of intensities (None where fewer than LEAST_PAIRS pairs have amplitudes)."""
    kernel, gap = kernels(peaks, lines, rel_tol)
    pairs = match(lines, peaks, rel_tol)
    matched = np.zeros(len(lines), dtype=bool)
    matched[[i for i, _ in pairs]] = True
    span = 2 * float(np.hypot(np.maximum(rel_tol * lines, 1e-9), peaks.err[peaks.nearest(lines)]).max())
    seen = (lines >= peaks.d[0] - span) & (lines <= peaks.d[-1] + span)
    strong = seen & (phase.weight >= STRONG * phase.weight[seen].max()) if seen.any() else seen
    whole = float(phase.weight[strong].sum())
    recall = float((phase.weight * kernel)[strong & matched].sum()) / whole if whole > 0 else 0.0
    n_inside = int(((peaks.d >= lines.min() - span) & (peaks.d <= lines.max() + span)).sum())
    precision = min(1.0, len(pairs) / n_inside) if n_inside else 0.0
    agreement = None
    own = [(phase.weight[i], peaks.amplitude[j]) for i, j in pairs if peaks.amplitude[j] >= 0]
    if len(own) >= LEAST_PAIRS:
        w, a = np.array(own).T
        norm = float(np.linalg.norm(w) * np.linalg.norm(a))
        agreement = float(w @ a) / norm if norm > 0 else None
    return {"score": float(phase.weight @ kernel), "n_matched": len(pairs), "recall": recall, "precision": precision, "intensity_corr": agreement}


def confidence(found: dict, penalty: float, weight: float = INTENSITY, least: int = LEAST_MATCHED) -> float:
    """F1 of recall and precision, lowered by few matches, by the distance from the prior, and a little by intensities that disagree."""
    r, p, corr = found["recall"], found["precision"], found["intensity_corr"]
    out = (2 * r * p / (r + p) if r + p > 0 else 0.0) * min(1.0, found["n_matched"] / least) * penalty
    return out if corr is None else out * (1 - weight * (1 - min(1.0, max(0.0, corr))))


def best_of(phase: Phase, peaks: Peaks, pressures: np.ndarray, rel_tol: float, temperature: float | None) -> tuple[float, float]:
    """The best score among these pressures and the lowest pressure that has it (to nine decimals)."""
    lines = phase.lines(pressures, temperature)
    score = kernels(peaks, lines, rel_tol)[0] @ phase.weight
    k = int(np.argmax(np.round(score, 9)))
    return float(score[k]), float(pressures[k])


class Grid:
    """All lines of a library at all pressures of its grids in one rising array, so that a peak meets only those within its reach."""

    def __init__(self, grids: list[np.ndarray], library: list[Phase], rel_tol: float):
        self.rel_tol, self.cuts = rel_tol, np.cumsum([0, *[len(g) for g in grids]])  # a row is a phase at a pressure
        d = np.concatenate([*[g.ravel() for g in grids], np.zeros(0)])
        row = np.concatenate([*[np.repeat(np.arange(i, i + len(g)), g.shape[1]) for i, g in zip(self.cuts, grids)], np.zeros(0, dtype=int)])
        weight = np.concatenate([*[np.tile(x.weight, len(g)) for x, g in zip(library, grids)], np.zeros(0)])
        order = np.argsort(d, kind="stable")
        self.d, self.row, self.weight = d[order], row[order], weight[order]
        self.width2 = np.maximum(rel_tol * self.d, 1e-9) ** 2

    def reach(self, d: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lines begin and end that a peak may add anything to."""
        far = REACH * self.rel_tol
        lo = np.searchsorted(self.d, (d - REACH * err - 1e-8) / (1 + far) * (1 - 1e-9))
        return lo, np.searchsorted(self.d, (d + REACH * err + 1e-8) / (1 - far) * (1 + 1e-9), side="right") if far < 1 else np.full(len(d), len(self.d))

    def scores(self, peaks: Peaks, near: float | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The score of each row as :func:`kernels` has it, and how many of its lines lie within ``near`` of their d of a peak."""
        one = np.flatnonzero(peaks.first == np.arange(len(peaks.d)))  # of equal d's the one with the smallest error
        d, err = peaks.d[one], peaks.err[one]
        lo, hi = self.reach(d, err)
        halves = np.searchsorted(self.d, (d[1:] + d[:-1]) / 2, side="right")  # each line belongs to its nearest peak
        lo[1:], hi[:-1] = np.maximum(lo[1:], halves), np.minimum(hi[:-1], halves)
        own = [slice(i, j) for i, j in zip(lo.tolist(), hi.tolist())]
        gap = np.concatenate([self.d[x] - c for x, c in zip(own, d.tolist())])
        z = gap * gap / np.concatenate([self.width2[x] + e * e for x, e in zip(own, err.tolist())])
        kernel = np.exp(-0.5 * z)
        kernel[z > REACH * REACH] = 0.0
        row = np.concatenate([self.row[x] for x in own])
        score = np.bincount(row, kernel * np.concatenate([self.weight[x] for x in own]), minlength=self.cuts[-1])
        if near is None:
            return score, None
        close = np.abs(gap) < near * np.concatenate([self.d[x] for x in own])
        return score, np.bincount(row[close], minlength=self.cuts[-1])


class Searcher:
    """The grids of one library."""

    def __init__(self, library: list[Phase], rel_tol: float, p_min: float, p_max: float, n_grid: int, zooms: int):
        self.library, self.rel_tol, self.p_min, self.p_max, self.n_grid, self.zooms = library, rel_tol, p_min, p_max, max(2, n_grid), zooms
        self.points = [np.linspace(p_min, max(p_min, min(p_max, x.top)), self.n_grid) for x in library]
        self.grid = Grid([x.lines(p, exact=True) for x, p in zip(library, self.points)], library, rel_tol)

    def best_whole(self, k: int, scores: np.ndarray) -> tuple[float, float]:
        """The best score of the k-th phase on its whole grid, given those of all, and the lowest pressure that has it."""
        own = scores[self.grid.cuts[k] : self.grid.cuts[k + 1]]
        i = int(np.argmax(np.round(own, 9)))
        return float(own[i]), float(self.points[k][i])

    def range_of(self, phase: Phase, prior: float | None, half: float | None) -> tuple[float, float]:
        lo, hi = self.p_min, min(self.p_max, phase.top)
        if prior is not None and half and phase.bound:
            lo, hi = max(lo, prior - half), min(hi, prior + half)
            if hi <= lo:  # the prior lies outside the phase's range
                lo = hi = min(max(prior, self.p_min), self.p_max, phase.top)
        return lo, hi

    def fit(self, k: int, peaks: Peaks, scores: np.ndarray, prior: float | None = None, half: float | None = None, temperature: float | None = None) -> dict:
        """The best pressure of the k-th phase and what speaks for it; ``scores`` are those of the whole grid."""
        phase = self.library[k]
        if not len(peaks.d) or not len(phase.d0):
            return {"pressure": 0.0, "score": 0.0, "n_matched": 0, "recall": 0.0, "precision": 0.0, "intensity_corr": None, "penalty": 1.0, "confidence": 0.0}
        lo, hi = self.range_of(phase, prior, half) if phase.moves else (0.0, 0.0)
        best = lo
        if hi > lo:
            whole = (lo, hi) == (self.points[k][0], self.points[k][-1])
            points = self.points[k] if whole else np.linspace(lo, hi, self.n_grid)
            cold = temperature is None or not phase.alpha
            score, best = self.best_whole(k, scores) if whole and cold else best_of(phase, peaks, points, self.rel_tol, temperature)
            step = points[1] - points[0]
            for _ in range(self.zooms):
                finer = np.linspace(max(lo, best - step), min(hi, best + step), ZOOM_POINTS)
                other, at = best_of(phase, peaks, finer, self.rel_tol, temperature)
                if other >= score:
                    score, best = other, at
                step = 2 * step / (ZOOM_POINTS - 1)
        found = evidence(phase, peaks, phase.lines(np.array([best]), temperature)[0], self.rel_tol)
        penalty = math.exp(-0.5 * ((best - prior) / half) ** 2) if prior is not None and half and phase.bound else 1.0
        return found | {"pressure": best, "penalty": penalty, "confidence": confidence(found, penalty)}


class Together:
    """Frames that are fitted at once, with what :class:`Peaks` holds of each in rows of equal length; places without a peak are infinite."""

    def __init__(self, d: np.ndarray, err: np.ndarray, amplitude: np.ndarray, prior: np.ndarray, half: np.ndarray, temperature: np.ndarray):
        self.d, self.err, self.amplitude, self.prior, self.half, self.temperature = d, err, amplitude, prior, half, temperature
        self.some_err = bool(err.any())

    def __getitem__(self, which) -> Together:
        return Together(*(x[which] for x in (self.d, self.err, self.amplitude, self.prior, self.half, self.temperature)))

    def kernels(self, lines: np.ndarray, rel_tol: float) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`kernels` has them for lines (last axis) of each frame (first axis), and the errors of the nearest peaks."""
        at = (slice(None), *[None] * (lines.ndim - 1))
        gap, err = np.full(lines.shape, np.inf), np.zeros(lines.shape)
        own, nearer = np.empty(lines.shape), np.empty(lines.shape, dtype=bool)
        for j in range(self.d.shape[1]):
            np.abs(np.subtract(lines, self.d[:, j][at], out=own), out=own)
            if self.some_err:
                np.copyto(err, self.err[:, j][at], where=np.less(own, gap, out=nearer))
            np.minimum(gap, own, out=gap)
        np.maximum(np.multiply(lines, rel_tol, out=own), 1e-9, out=own)
        own *= own
        if self.some_err:
            own += err * err
        gap *= gap
        gap /= own
        out = np.exp(np.multiply(gap, -0.5, out=own), out=own)
        out[gap > REACH * REACH] = 0.0
        return out, err

    def lines(self, phase: Phase, pressures: np.ndarray) -> np.ndarray:
        """The d of each line (last axis) at each of a frame's pressures, at the frame's temperature."""
        out = phase.lines(pressures.ravel()).reshape(*pressures.shape, len(phase.d0))
        if phase.alpha:
            known = np.isfinite(self.temperature)
            warm = np.maximum(1 + phase.alpha * (np.where(known, self.temperature, phase.t0) - phase.t0), 1e-6) ** (1 / 3)
            out = out * np.where(known, warm, 1.0)[:, None, None]
        return out

    def best_of(self, phase: Phase, pressures: np.ndarray, rel_tol: float) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`best_of` has it, for each frame among its own pressures."""
        score, step = np.empty(pressures.shape), max(1, POINTS // pressures.shape[1])
        for i in range(0, len(score), step):
            own = self[i : i + step]
            score[i : i + step] = own.kernels(own.lines(phase, pressures[i : i + step]), rel_tol)[0] @ phase.weight
        k = np.argmax(np.round(score, 9), axis=1)[:, None]
        return np.take_along_axis(score, k, axis=1)[:, 0], np.take_along_axis(pressures, k, axis=1)[:, 0]

    def evidence(self, phase: Phase, lines: np.ndarray, rel_tol: float) -> dict[str, np.ndarray]:
        """As :func:`evidence` has it; an agreement that isn't known is nan."""
        n, w = len(lines), phase.weight
        kernel, err = self.kernels(lines, rel_tol)
        sigma = np.maximum(rel_tol * lines, 1e-9)
        gap = np.abs(lines[:, :, None] - self.d[:, None, :])
        gap[~(gap < 2.0 * np.hypot(sigma[:, :, None], self.err[:, None, :]))] = np.inf
        matched, pairs, weights, seen_as = np.zeros(lines.shape, dtype=bool), np.zeros(n, dtype=np.int64), [], []
        for _ in range(min(gap.shape[1:])):  # the closest pair that is left of each frame
            at = gap.reshape(n, -1).argmin(axis=1)
            i, j, f = at // gap.shape[2], at % gap.shape[2], np.arange(n)
            found = np.isfinite(gap[f, i, j])
            if not found.any():
                break
            f, i, j = f[found], i[found], j[found]
            gap[f, i, :] = np.inf
            gap[f, :, j] = np.inf
            matched[f, i] = True
            pairs[f] += 1
            a = np.full(n, np.nan)
            a[f] = self.amplitude[f, j]
            good = a >= 0
            own = np.zeros(n)
            own[f] = w[i]
            weights.append(np.where(good, own, 0.0))
            seen_as.append(np.where(good, a, np.nan))
        span = 2 * np.hypot(sigma, err).max(axis=1)
        known = np.isfinite(self.d)
        last = np.where(known, self.d, -np.inf).max(axis=1)
        seen = (lines >= (self.d[:, 0] - span)[:, None]) & (lines <= (last + span)[:, None])
        strong = seen & (w >= STRONG * np.where(seen, w, -np.inf).max(axis=1)[:, None])
        whole = np.where(strong, w, 0.0).sum(axis=1)
        recall = np.divide(np.where(strong & matched, w * kernel, 0.0).sum(axis=1), whole, out=np.zeros(n), where=whole > 0)
        inside = (known & (self.d >= (lines.min(axis=1) - span)[:, None]) & (self.d <= (lines.max(axis=1) + span)[:, None])).sum(axis=1)
        precision = np.minimum(1.0, np.divide(pairs, inside, out=np.zeros(n), where=inside > 0))
        agreement = np.full(n, np.nan)
        if len(weights) >= LEAST_PAIRS:
            a = np.array(seen_as)
            count, a, b = np.isfinite(a).sum(axis=0), np.nan_to_num(a, nan=0.0), np.array(weights)
            norm = np.sqrt((b * b).sum(axis=0)) * np.sqrt((a * a).sum(axis=0))
            np.divide((a * b).sum(axis=0), norm, out=agreement, where=(count >= LEAST_PAIRS) & (norm > 0))
        return {"score": kernel @ w, "n_matched": pairs, "recall": recall, "precision": precision, "intensity_corr": agreement}


class Kept:
    """Contributions of a peak to the lines in its reach, kept as long as there is room: peaks that come again cost no exponentials."""

    def __init__(self, grid: Grid):
        self.grid, self.held, self.size = grid, {}, 0

    def of(self, d: float, err: float, lo: int, hi: int) -> np.ndarray:
        out = self.held.get((d, err))
        if out is None:
            gap = self.grid.d[lo:hi] - d
            z = gap * gap / (self.grid.width2[lo:hi] + err * err)
            out = np.exp(-0.5 * z)
            out[z > REACH * REACH] = 0.0
            out *= self.grid.weight[lo:hi]
            self.size += len(out)
            if self.size > KEPT:
                self.held, self.size = {}, len(out)
            self.held[d, err] = out
        return out

    def scores(self, d: np.ndarray, err: np.ndarray, frame: np.ndarray, n: int) -> np.ndarray:
        """The scores of ``n`` frames as :meth:`Grid.scores` has them, of peaks by rising frame and d, no two of a frame alike in d."""
        lo, hi = self.grid.reach(d, err)
        first, last = lo.copy(), hi.copy()
        same = np.flatnonzero(frame[1:] == frame[:-1])
        halves = np.searchsorted(self.grid.d, (d[same + 1] + d[same]) / 2, side="right")
        first[same + 1], last[same] = np.maximum(lo[same + 1], halves), np.minimum(hi[same], halves)
        parts = [self.of(x, e, a, b)[i - a : max(i, j) - a] for x, e, a, b, i, j in zip(*(v.tolist() for v in (d, err, lo, hi, first, last)))]
        rows = [self.grid.row[i:j] for i, j in zip(first.tolist(), last.tolist())]
        out = np.zeros((n, self.grid.cuts[-1]))
        begin = np.searchsorted(frame, np.arange(n + 1)).tolist()
        for k, (a, b) in enumerate(zip(begin, begin[1:])):
            if b > a:
                out[k] = np.bincount(np.concatenate(rows[a:b]), np.concatenate(parts[a:b]), minlength=out.shape[1])
        return out


def _fit_together(search: Searcher, kept: Kept, frames: Together) -> dict[str, np.ndarray]:
    """As :meth:`Searcher.fit` has it for each phase (columns) and frame (rows); every frame has a peak."""
    n, m = len(frames.d), len(search.library)
    out = {c: np.zeros((n, m)) for c in ("pressure", "score", "n_matched", "recall", "precision", "confidence")} | {"intensity_corr": np.full((n, m), np.nan), "penalty": np.ones((n, m))}
    own = np.isfinite(frames.d)
    own[:, 1:] &= frames.d[:, 1:] != frames.d[:, :-1]  # of equal d's the one with the smallest error
    scores = kept.scores(frames.d[own], frames.err[own], np.nonzero(own)[0], n)
    windowed = np.isfinite(frames.prior) & np.isfinite(frames.half) & (frames.half != 0)
    prior, half = np.where(windowed, frames.prior, 0.0), np.where(windowed, frames.half, 1.0)
    for k, phase in enumerate(search.library):
        if not len(phase.d0):
            continue
        bound = windowed & phase.bound
        lo, hi = np.full(n, search.p_min if phase.moves else 0.0), np.full(n, min(search.p_max, phase.top) if phase.moves else 0.0)
        if phase.moves:
            near_lo, near_hi = np.maximum(lo, prior - half), np.minimum(hi, prior + half)
            outside = np.minimum(np.minimum(np.maximum(prior, search.p_min), search.p_max), phase.top)
            lo, hi = np.where(bound, np.where(near_hi <= near_lo, outside, near_lo), lo), np.where(bound, np.where(near_hi <= near_lo, outside, near_hi), hi)
        best, wide = lo.copy(), np.flatnonzero(hi > lo)
        if len(wide):
            lo, hi, one = lo[wide], hi[wide], frames[wide]
            points = search.points[k]
            grid = (lo == points[0]) & (hi == points[-1])
            if phase.alpha:
                grid &= ~np.isfinite(one.temperature)
            step = np.where((lo == points[0]) & (hi == points[-1]), points[1] - points[0], 0.0)
            whole = scores[wide, search.grid.cuts[k] : search.grid.cuts[k + 1]]
            i = np.argmax(np.round(whole, 9), axis=1)
            score, at = whole[np.arange(len(wide)), i], points[i]
            rest = np.flatnonzero(~grid)
            if len(rest):
                those = np.linspace(lo[rest], hi[rest], search.n_grid, axis=1)
                score[rest], at[rest] = one[rest].best_of(phase, those, search.rel_tol)
                step[rest] = those[:, 1] - those[:, 0]
            for _ in range(search.zooms):
                finer = np.linspace(np.maximum(lo, at - step), np.minimum(hi, at + step), ZOOM_POINTS, axis=1)
                other, there = one.best_of(phase, finer, search.rel_tol)
                better = other >= score
                score, at = np.where(better, other, score), np.where(better, there, at)
                step = 2 * step / (ZOOM_POINTS - 1)
            best[wide] = at
        found = frames.evidence(phase, frames.lines(phase, best[:, None])[:, 0], search.rel_tol)
        penalty = np.where(bound, np.exp(-0.5 * ((best - prior) / half) ** 2), 1.0)
        r, p, corr = found["recall"], found["precision"], found["intensity_corr"]
        sure = np.divide(2 * r * p, r + p, out=np.zeros(n), where=r + p > 0) * np.minimum(1.0, found["n_matched"] / LEAST_MATCHED) * penalty
        sure = np.where(np.isnan(corr), sure, sure * (1 - INTENSITY * (1 - np.clip(np.nan_to_num(corr), 0.0, 1.0))))
        for c, v in (found | {"pressure": best, "penalty": penalty, "confidence": sure}).items():
            out[c][:, k] = v
    return out


def _fit_batch(search: Searcher, kept: Kept, batch: pd.DataFrame) -> pd.DataFrame:
    """The rows of a batch of packed frames: those with like numbers of peaks together, those with very many by themselves."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    count = batch["d"].map(len).to_numpy()
    flat = {c: np.concatenate([np.zeros(0), *[np.asarray(x, dtype=float) for x in batch[c]]]) for c in ("d", "err", "amplitude")}
    frame = np.repeat(np.arange(len(batch)), count)
    good = np.isfinite(flat["d"]) & (flat["d"] > 0)
    frame, d = frame[good], flat["d"][good]
    err, amplitude = (np.where(np.isfinite(x := flat[c][good]), x, other) for c, other in (("err", 0.0), ("amplitude", np.nan)))
    order = np.lexsort((err, d, frame))
    frame, d, err, amplitude = (x[order] for x in (frame, d, err, amplitude))
    count = np.bincount(frame, minlength=len(batch))
    begin = np.cumsum(count) - count
    place = np.arange(len(frame)) - begin[frame]
    more = {c: pd.to_numeric(batch[c]).to_numpy(dtype=float) for c in ("prior", "half", "temperature")}
    columns = {c: np.full((len(batch), len(search.library)), np.nan if c == "intensity_corr" else 0.0) for c in names[2:]}
    size = np.where(count > 0, 2 ** np.ceil(np.log2(np.maximum(count, 1))).astype(int), 0)
    for p in np.unique(size):
        which = np.flatnonzero(size == p)
        if p == 0:
            columns["penalty"][which] = 1.0
        elif p > MOST_PEAKS:
            for i in which.tolist():
                own = slice(begin[i], begin[i] + count[i])
                peaks = Peaks(d[own], err[own], amplitude[own])
                scores = search.grid.scores(peaks)[0]
                for k in range(len(search.library)):
                    x = search.fit(k, peaks, scores, *(_number(more[c][i]) for c in ("prior", "half", "temperature")))
                    for c in columns:
                        columns[c][i, k] = np.nan if x[c] is None else x[c]
        else:
            number = np.full(len(batch), -1)
            for i in range(0, len(which), max(1, PLACES // int(p))):
                part = which[i : i + max(1, PLACES // int(p))]
                number[:] = -1
                number[part] = np.arange(len(part))
                own = np.flatnonzero(number[frame] >= 0)
                rows = [np.full((len(part), int(count[part].max())), other) for other in (np.inf, 0.0, np.nan)]
                for row, v in zip(rows, (d, err, amplitude)):
                    row[number[frame[own]], place[own]] = v[own]
                for c, v in _fit_together(search, kept, Together(*rows, *(more[c][part] for c in ("prior", "half", "temperature")))).items():
                    columns[c][part] = v
    out = pd.DataFrame({"frame": np.repeat(batch["frame"].to_numpy(), len(search.library)), "phase": np.tile(np.array([x.name for x in search.library], dtype=object), len(batch))})
    return out.assign(**{c: v.ravel() for c, v in columns.items()}).astype({"n_matched": "int64"})[names]


def library_of(phases: DataFrame, reflections: DataFrame) -> list[Phase]:
    """The library as objects: a parameter, whose size doesn't depend on the data."""
    lines: dict[str, list] = {}
    for r in reflections.orderBy("phase", "line").collect():
        hkl = r["hkl"] if "hkl" in r else None
        lines.setdefault(r["phase"], []).append((r["d0"], r["weight"], None if hkl is None else tuple(hkl)))
    return [Phase(r.asDict(), lines.get(r["name"], [])) for r in phases.orderBy("name").collect()]


def packed(observed: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """A row for each frame: frame, d, err, amplitude (arrays by rising d), and prior, half, temperature of ``frames`` where it has them."""
    item = F.struct("d", *[lattice.column_of(observed, c).alias(c) for c in ("err", "amplitude")])
    own = observed.groupBy("frame").agg(F.array_sort(F.collect_list(item)).alias("p")).select("frame", *[F.col(f"p.{c}").alias(c) for c in ("d", "err", "amplitude")])
    more = ("prior", "half", "temperature")
    if frames is None:
        out = own.select("*", *[F.lit(None).cast("double").alias(c) for c in more])
    else:
        out = own.join(frames.select("frame", *[lattice.column_of(frames, c).alias(c) for c in more]), "frame")
    # By number: the packed rows are small, but each is much work, so they must not be put into a few tasks; by a hash, or
    # this exchange would go as one that the join has made already.
    return out.repartition(int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("frame"))


def _floats(x) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in x], dtype=float)


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


RESULT = "frame long, phase string, pressure double, score double, n_matched long, recall double, precision double, intensity_corr double, penalty double, confidence double"


def run_identification(observed: DataFrame, frames: DataFrame, phases: DataFrame, reflections: DataFrame, rel_tol: float = 0.01, p_min: float = 0.0, p_max: float = P_MAX, n_grid: int = GRID, zooms: int = ZOOMS, windows: DataFrame | None = None) -> DataFrame:
    """For each frame and phase the best pressure, with score, n_matched, recall, precision, intensity_corr, penalty and confidence.

    ``observed`` is (frame, d) with err and amplitude where known; ``frames`` is (frame) with excluded, prior, half and temperature
    where known; ``windows`` (frame, prior, half) may give these two instead. The pressures are ``n_grid`` points from p_min to p_max or the phase's highest pressure; with a prior, within prior
    +- half (a phase with the assumption ``ignore_prior`` is free, and has no penalty). Finer grids follow around the best, kept where
    the score isn't lower. A phase without an equation of state is held at 0. Excluded frames have
    every phase with nulls; frames without peaks have no row.
    """
    library = library_of(phases, reflections)
    if windows is not None:
        frames = frames.drop("prior", "half").join(windows.select("frame", "prior", "half"), "frame", "left")
    shown = F.coalesce(lattice.column_of(frames, "excluded", "boolean"), F.lit(False))
    live = packed(observed, frames.filter(~shown))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Searcher(library, rel_tol, p_min, p_max, n_grid, zooms)
        kept = Kept(search.grid)
        for batch in batches:
            for i in range(0, len(batch), 2 * FRAMES_AT_ONCE):
                yield _fit_batch(search, kept, batch.iloc[i : i + 2 * FRAMES_AT_ONCE])

    found = live.mapInPandas(run, RESULT)
    names = phases.select(F.col("name").alias("phase"))
    out = frames.filter(shown).select("frame").distinct().join(F.broadcast(names), F.lit(True))
    nothing = out.select("frame", "phase", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RESULT.split(", ")[2:]])
    return found.unionByName(nothing)


def score_grid(observed: DataFrame, phases: DataFrame, reflections: DataFrame, pressures: list[float], rel_tol: float = 0.01, above: float | None = None) -> DataFrame:
    """frame, phase, pressure, score, n_near for each of the pressures up to the phase's highest: n_near lines lie within 2 rel_tol of a peak.

    With ``above`` only the rows of a higher score.
    """
    library = [x for x in library_of(phases, reflections) if len(x.d0)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = [np.array([p for p in pressures if p <= x.top and (x.moves or p == 0)], dtype=float) for x in library]
        grid = Grid([x.lines(p, exact=True) for x, p in zip(library, points)], library, rel_tol)
        names, at = np.repeat(np.array([x.name for x in library], dtype=object), [len(p) for p in points]), np.concatenate([*points, np.zeros(0)])
        for batch in batches:
            for i in range(0, len(batch), FRAMES_AT_ONCE):
                out = []
                for frame, d, err in batch.iloc[i : i + FRAMES_AT_ONCE][["frame", "d", "err"]].itertuples(index=False, name=None):
                    peaks = Peaks(d, _floats(err))
                    if len(peaks.d) and len(names):
                        score, near = grid.scores(peaks, 2 * rel_tol)
                        rows = np.arange(len(score)) if above is None else np.flatnonzero(score > above)
                        out.append((frame, rows, score[rows], near[rows]))
                if out:
                    rows = np.concatenate([x[1] for x in out])
                    yield pd.DataFrame({"frame": np.repeat([x[0] for x in out], [len(x[1]) for x in out]), "phase": names[rows], "pressure": at[rows], "score": np.concatenate([x[2] for x in out]), "n_near": np.concatenate([x[3] for x in out])})

    return packed(observed).mapInPandas(run, "frame long, phase string, pressure double, score double, n_near long")


def best_on_grid(observed: DataFrame, phases: DataFrame, reflections: DataFrame, rel_tol: float = 0.01, p_max: float = P_MAX, n_grid: int = GRID) -> DataFrame:
    """frame, phase, score, pressure: the highest score on the grid alone, at the lowest pressure that has it (to nine decimals)."""
    library = library_of(phases, reflections)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Searcher(library, rel_tol, 0.0, p_max, n_grid, 0)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                peaks = Peaks(r.d, _floats(r.err))
                scores = search.grid.scores(peaks)[0] if len(peaks.d) else None
                for k, x in enumerate(library):
                    if len(x.d0) and len(peaks.d):
                        rows.append((r.frame, x.name, *(search.best_whole(k, scores) if x.moves else best_of(x, peaks, np.zeros(1), rel_tol, None))))
            yield pd.DataFrame(rows, columns=["frame", "phase", "score", "pressure"])

    return packed(observed).mapInPandas(run, "frame long, phase string, score double, pressure double")
