"""Operators whose tasks took more memory or time than their share of the input: their plans, and their results against brute force."""

import math
import random

import numpy as np
import pytest

from framelens.operators import library, patterns, peaks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corpus_folds_different_volumes(spark):
    """As entry by entry in the order of files, with equal, missing, negative, zero and infinite volumes; equal volumes are one before the fold."""
    rng, inf = random.Random(4), math.inf
    odd = [None, None, -5.0, -5.0, 0.0, 0.0, 1e300]
    rows = [(f, rng.choice("ab"), rng.randrange(2), rng.choice([10, 300]) if f % 9 == 0 else 10, rng.choice([*odd, *[100 + 0.1 * rng.randrange(60) for _ in range(30)]]), f % 13 > 0) for f in range(700)]
    rows += [(1000, "c", 0, 10, inf, True), (1001, "c", 0, 10, inf, True), (1002, "c", 0, 10, 7.0, True)]
    out = library.corpus_dedupe(spark.createDataFrame(rows, "file long, formula string, spacegroup int, n_sites int, volume double, parse_ok boolean"))
    kept, want = {}, {}
    for file, formula, group, sites, volume, ok in rows:
        own = kept.setdefault((formula, group), [])
        want[file] = "parse" if not ok else "sites" if sites > 200 else None
        if want[file] is None and volume is not None:
            if any(abs(k - volume) <= 0.005 * k for k in own):
                want[file] = "duplicate"
            else:
                own.append(volume)
    want[1002] = "duplicate"  # infinity is near everything but itself
    assert {r.file: r.reason for r in out.collect()} == want
    assert "partial_min(file" in plan(out)


def test_grid_of_shapes_is_no_table(spark):
    """The best point of the grid by least squares; bins without a value don't count, candidates with few bins have no row."""
    rng = np.random.default_rng(5)
    frames = {f: (x := np.sort(rng.uniform(0, 6, 70)), 3 + x + 40 / (1 + 4 * ((x - 3) / 0.6) ** 2) + rng.normal(size=70)) for f in range(3)}
    bins = [(f, float(a), float(b)) for f, (x, y) in frames.items() for a, b in zip(x, y)] + [(0, 3.01, None), (1, 2.9, None)]
    tops = [(f, i, c, w) for f in range(4) for i, (c, w) in enumerate([(2.9, 0.5), (1.0, 0.3), (9.0, 0.5), (3.3, 0.8)])] + [(0, 9, None, 0.5), (0, 10, 3.0, None)]
    out = patterns.fit_peaks(spark.createDataFrame(bins, "frame long, radial double, y double"), spark.createDataFrame(tops, "frame long, id int, center double, fwhm double"), "y")
    assert "Generate" not in plan(out) and dict(out.dtypes)["id"] == "int"
    want = {}
    for f, i, c, w in tops:
        if f not in frames or c is None or w is None:
            continue
        x, y = frames[f]
        x, y = x[(near := np.abs(x - c) <= 3 * w)], y[near]
        for s in (-0.5, 0.0, 0.5):
            for k in (0.7, 1.0, 1.4):
                for e in (0.0, 0.5, 1.0):
                    if len(x) < 5:
                        continue
                    t = (x - c - s * w) / (w * k)
                    a = np.stack([e / (1 + 4 * t * t) + (1 - e) * np.exp(-4 * math.log(2) * t * t), np.ones_like(x), x - c], axis=1)
                    solution = np.linalg.lstsq(a, y, rcond=None)[0]
                    chi2 = float(((y - a @ solution) ** 2).sum())
                    if (f, i) not in want or chi2 < want[f, i][0]:
                        want[f, i] = (chi2, c + s * w, w * k, e, float(solution[0]))
    got = {(r.frame, r.id): (r.chi2, r.center, r.fwhm, r.eta, r.height) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) == 9
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6)


def test_fractions_are_grouped_once(spark):
    """Shares of a frame by hand: repeated, empty and null frames, gated and unknown phases, areas that don't count; nothing is joined by frame."""
    rng = random.Random(6)
    own = [(rng.choice([*range(40), None]), rng.choice(["Au", "Re", "W", "", None]), rng.choice([1.0, 2.5, 0.0, -1.0]), int(rng.random() < 0.2)) for _ in range(400)]
    seen = [(rng.choice([*range(60), None]), rng.choice(["Au", "Re", None]), rng.random()) for _ in range(80)]
    at = [*range(5, 50), 7, 7, None]
    make = spark.createDataFrame
    out = peaks.phase_fractions(make(own, "frame long, phase string, area double, flag int"), make([(f,) for f in at], "frame long"), make([("Au", 2.0), ("Re", -1.0)], "phase string, rir double"), make(seen, "frame long, phase string, confidence double"), 0.5)
    best, area = {}, {}
    for f, p, c in seen:
        if f is not None and p is not None:
            best[f, p] = max(c, best.get((f, p), 0.0))
    for f, p, a, flag in own:
        if f is not None and p and a > 0 and not flag and (p == "W" or best.get((f, p), 0.0) > 0.5):
            area.setdefault(f, {}).setdefault(p, []).append(a / (2 if p == "Au" else 1))
    want = []
    for f in at:
        sums = {p: sum(x) for p, x in area.get(f, {}).items()}
        want += [(f, p, round(s / sum(sums.values()), 9)) for p, s in sums.items()] or [(f, None, None)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.frame, r.phase, r.fraction if r.fraction is None else round(r.fraction, 9)) for r in out.collect()], key=key) == sorted(want, key=key)
    assert plan(out).count("Join") <= 2 * 2  # the ratios and the gated phases, which are lists of phases
