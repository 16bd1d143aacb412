"""Joint peak fits against planted peaks, single fits, and the minimum of the sum of squares."""

import math
import random

import numpy as np
import pytest

from framelens.operators import joint_fit as J
from framelens.operators import patterns

STEP = 0.01


def pattern(peaks, lo=0.0, hi=4.0, ground=(3.0, 0.5), noise=0.0, seed=1):
    x = np.arange(lo, hi, STEP)
    y = ground[0] + ground[1] * x
    for h, c, w, e in peaks:
        y = y + h * J.profiles(x, np.array([c]), np.array([w]), np.array([e]))[:, 0]
    return x, y + noise * np.random.default_rng(seed).normal(size=len(x))


def guessed(peaks, rng):
    return np.array([p[1] + rng.uniform(-0.2, 0.2) * p[2] for p in peaks]), np.array([p[2] * rng.uniform(0.7, 1.4) for p in peaks])


def test_slopes():
    x, c, w, e = np.linspace(-1, 1, 41), np.array([0.1, -0.3]), np.array([0.3, 0.5]), np.array([0.2, 0.9])
    _, *slopes = J.profiles(x, c, w, e, True)
    for k, own in enumerate(slopes):
        up, down = ([v + (s if i == k else 0) for i, v in enumerate((c, w, e))] for s in (1e-6, -1e-6))
        assert np.allclose(own, (J.profiles(x, *up) - J.profiles(x, *down)) / 2e-6, atol=1e-7)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
def test_planted_groups(n):
    """Overlapping peaks of any number are found exactly where there is no noise."""
    rng = random.Random(n)
    for _ in range(4):
        peaks = [(rng.uniform(20, 100), 1 + 0.13 * k + rng.uniform(0, 0.02), rng.uniform(0.09, 0.13), rng.uniform(0.1, 0.9)) for k in range(n)]
        x, y = pattern(peaks)
        keep = (x > 0.5) & (x < 1.5 + 0.13 * n)
        got = J.fit_group(x[keep], y[keep], *guessed(peaks, rng))
        for r, (h, c, w, e) in zip(got, peaks):
            assert r["center"] == pytest.approx(c, abs=1e-3) and r["height"] == pytest.approx(h, rel=0.05) and r["fwhm"] == pytest.approx(w, rel=0.05) and r["flag"] == 0, (n, r)


def test_errors_are_those_of_repeats():
    """The esds agree with the scatter of 60 noisy repeats."""
    peaks, found = [(60.0, 1.0, 0.12, 0.4), (40.0, 1.12, 0.1, 0.6)], []
    for seed in range(60):
        x, y = pattern(peaks, 0.4, 1.8, noise=1.0, seed=seed)
        found.append(J.fit_group(x, y, np.array([1.0, 1.12]), np.array([0.11, 0.11]), 1.0))
    for j in range(2):
        for k in ("center", "height", "fwhm"):
            values, esd = [f[j][k] for f in found], np.median([f[j][f"{k}_err"] for f in found])
            assert 0.6 < np.std(values) / esd < 1.7, (j, k)
    assert 0.8 < np.mean([f[0]["chi2"] for f in found]) < 1.2


def test_bounds_and_flags():
    rng = np.random.default_rng(3)
    x = np.arange(0, 2, STEP)
    flat = 5 + 0.01 * rng.normal(size=len(x))
    got = J.fit_group(x, flat, np.array([1.0]), np.array([0.1]), 1.0)[0]
    assert got["flag"] & J.LOW and got["height"] >= 0
    x, y = pattern([(50.0, 1.0, 0.1, 0.5)], 0, 2)
    away = J.fit_group(x, y, np.array([1.08]), np.array([0.1]), 1.0)[0]
    assert away["flag"] & J.DRIFTED and away["center"] == pytest.approx(1.03)
    assert J.fit_group(x[:5], y[:5], np.array([1.0]), np.array([0.1]))[0]["flag"] == J.FAILED
    box = np.where(np.abs(x - 1) < 0.3, 1000.0, 0.0)
    assert J.fit_group(x, box, np.array([1.0]), np.array([0.3]), 1.0)[0]["flag"] & J.POOR


def test_where_single_fits_fail(spark):
    """Two peaks a width apart: the joint fit finds both, each fit alone is far off; groups and rows of a frame are as planted."""
    peaks = {1: [(100.0, 1.0, 0.1, 0.5), (60.0, 1.1, 0.1, 0.5), (30.0, 3.0, 0.1, 0.2)], 2: [(10.0, 2.0, 0.2, 0.8)]}
    bins = [(f, i, float(a), float(b)) for f, own in peaks.items() for i, (a, b) in enumerate(zip(*pattern(own)))] + [(1, 9999, 1.05, None), (3, 0, 1.0, 1.0)]
    frame = spark.createDataFrame(bins, "frame long, bin int, radial double, y double")
    candidates = spark.createDataFrame([(f, k, p[1], 0.1) for f, own in peaks.items() for k, p in enumerate(own)] + [(3, 7, 1.0, 0.1), (3, 8, None, 0.1)], "frame long, id long, center double, fwhm double")
    got = {(r.frame, r.id): r for r in J.fit_jointly(frame, candidates, "y").collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 7)] and [got[k].n_group for k in sorted(got)] == [2, 2, 1, 1, 1]
    assert got[3, 7].flag == J.FAILED and got[3, 7].height is None
    for f, own in peaks.items():
        for k, (h, c, w, e) in enumerate(own):
            r = got[f, k]
            assert (r.height, r.center, r.fwhm, r.eta) == (pytest.approx(h, rel=1e-3), pytest.approx(c, abs=1e-4), pytest.approx(w, rel=1e-3), pytest.approx(e, abs=0.01))
            assert r.area == pytest.approx(h * w * (e * math.pi / 2 + (1 - e) * math.sqrt(math.pi / math.log(2)) / 2), rel=1e-3)
    alone = {r.id: r for r in patterns.fit_peaks(frame.filter("frame = 1 AND y IS NOT NULL"), candidates.filter("frame = 1"), "y", rounds=3).collect()}
    assert abs(alone[1].height - 60) > 5 * abs(got[1, 1].height - 60) + 1
    assert J.fit_jointly(frame.limit(0), candidates, "y").count() == 0


def test_groups_take_their_steps_together(monkeypatch):
    """Sixty groups of other lengths need hardly more solver calls than the slowest of them, and give what each alone gives."""
    rng = random.Random(8)
    groups = []
    for g in range(60):
        peaks = [(rng.uniform(20, 100), 1 + 0.13 * k, rng.uniform(0.09, 0.13), rng.uniform(0.1, 0.9)) for k in range(3)]
        x, y = pattern(peaks, 0.3, rng.uniform(1.8, 2.4), noise=0.1, seed=g)
        groups.append((x, y, *guessed(peaks, rng), 0.1))
    calls, solve = [0], np.linalg.solve

    def counted(*a):
        calls[0] += 1
        return solve(*a)

    monkeypatch.setattr(J.np.linalg, "solve", counted)
    alone, most = [], 0
    for g in groups:
        calls[0] = 0
        alone.append(J.fit_group(*g))
        most = max(most, calls[0])
    calls[0] = 0
    together = J.fit_groups([*groups, (x[:5], y[:5], *groups[0][2:])])
    assert calls[0] <= 4 * most and [r["flag"] for r in together[-1]] == [J.FAILED] * 3
    for a, b in zip(alone, together):
        for p, q in zip(a, b):
            assert p["flag"] == q["flag"] and all(p[k] == pytest.approx(q[k], rel=1e-5, abs=1e-6) for k in p)


def test_profiles_at_one_place():
    """Two candidates at the same place share a peak, as the smallest solution has it, alone or beside another group."""
    x, y = pattern([(50.0, 1.0, 0.1, 0.5)], 0, 2)
    twins = (x, y, np.array([1.0, 1.0]), np.array([0.1, 0.1]), 1.0)
    got = J.fit_groups([twins, (x, y, np.array([1.0, 1.5]), np.array([0.1, 0.1]), 1.0)])
    assert [r["height"] for r in got[0]] == pytest.approx([25, 25], rel=1e-3) and got[1][0]["height"] == pytest.approx(50, rel=1e-3)
