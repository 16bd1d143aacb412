"""Lattices, lines under pressure and temperature, and identification, against plain formulas and planted truths."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import identify, lattice
from framelens.plans.views import phases

CELLS = "name string, a double, b double, c double, alpha double, beta double, gamma double, centring string"


def spacing(cell, hkl):
    """1 / |h|, by the inverse of the whole metric tensor."""
    a, b, c, *angles = cell
    ca, cb, cg = np.cos(np.radians(angles))
    g = np.array([[a * a, a * b * cg, a * c * cb], [a * b * cg, b * b, b * c * ca], [a * c * cb, b * c * ca, c * c]])
    return 1 / math.sqrt(np.array(hkl) @ np.linalg.inv(g) @ np.array(hkl))


RULES = {
    "P": lambda h, k, l: True, "I": lambda h, k, l: (h + k + l) % 2 == 0, "F": lambda h, k, l: h % 2 == k % 2 == l % 2, "A": lambda h, k, l: (k + l) % 2 == 0, "B": lambda h, k, l: (h + l) % 2 == 0,
    "C": lambda h, k, l: (h + k) % 2 == 0, "R": lambda h, k, l: (-h + k + l) % 3 == 0, "D": lambda h, k, l: h % 2 == k % 2 == l % 2 and (h + k + l) % 4 != 2, "H": lambda h, k, l: (h + 2 * k) % 3 != 0 or l % 2 == 0,
}


def test_reflections_of_any_cell(spark):
    """Every line of random cells of all centrings, with its number of planes, by going through the whole sphere."""
    rng = random.Random(2)
    cells = [(f"{c}{i}", *[rng.uniform(2.5, 5) for _ in range(3)], *[rng.uniform(75, 110) for _ in range(3)], c) for i in range(2) for c in RULES]
    cells += [("cubic", 4.0, None, None, None, None, None, "F"), ("hex", 3.0, None, 5.0, None, None, 120.0, "H")]
    got = {}
    for r in lattice.reflections(spark.createDataFrame(cells, CELLS), top=10_000, least=0.0).collect():
        got.setdefault(r.phase, []).append((r.d0, r.weight, tuple(r.hkl)))
    for name, a, b, c, *angles, centring in cells:
        cell = (a, b or a, c or a, *[x or 90.0 for x in angles])
        planes = {}
        for hkl in itertools.product(range(-6, 7), repeat=3):
            if any(hkl) and RULES[centring](*hkl) and (d := spacing(cell, hkl)) >= 1:
                planes.setdefault(round(d, 6), []).append(hkl)
        most = max(map(len, planes.values()))
        assert sorted(got[name]) == [(d, len(p) / most, max(p)) for d, p in sorted(planes.items())], name


def test_known_lines(spark):
    """Body-centred tungsten begins with 110, hexagonal rhenium with 100, 002, 101; none has lines of a face-centred lattice."""
    lines = {}
    for r in lattice.reflections(phases(spark)).orderBy("line").collect():
        lines.setdefault(r.phase, []).append((round(r.d0, 3), tuple(r.hkl)))
    assert lines["W"][:3] == [(2.238, (1, 1, 0)), (1.583, (2, 0, 0)), (1.292, (2, 1, 1))]
    assert [x[0] for x in lines["Re"][:4]] == [2.391, 2.228, 2.107, 1.630]
    assert [x[1] for x in lines["Au"][:4]] == [(1, 1, 1), (2, 0, 0), (2, 2, 0), (3, 1, 1)]


def test_given_lines_and_caps(spark):
    """A phase with a table of lines has just these; the caps follow the smallest d."""
    own = phases(spark).filter("name IN ('Au', 'W')")
    given = spark.createDataFrame([("W", 2.0, 50.0, None), ("W", 1.5, 25.0, (1, 2, 3)), ("W", 1.4, 0.1, None), ("W", 0.5, 25.0, None)], "phase string, d0 double, weight double, hkl struct<h:int,k:int,l:int>")
    rows = [(r.phase, r.line, r.d0, r.weight) for r in lattice.reflections(own, given=given).orderBy("phase", "line").collect()]
    assert [r for r in rows if r[0] == "W"] == [("W", 1, 2.0, 1.0), ("W", 2, 1.5, 0.5)] and any(r[0] == "Au" for r in rows)
    assert [lattice.data_d_min(x) for x in (None, 2.0, 0.55, 0.1)] == [1.0, 1.0, 0.55, 0.25]
    assert [lattice.line_cap(x) for x in (1.0, 0.8, 0.55, 0.25)] == [40, 78, 240, 400]


TETRAGONAL = [("tet", 4.0, 6.0, 300.0, 4.0, 100.0, 4.0)]
TETRAGONAL_COLUMNS = "name string, a double, c double, k0_a double, k0p_a double, k0_c double, k0p_c double"


def test_axial_lines(spark):
    """A softer c axis: 001 moves more than 100; the pressure is found again."""
    own = spark.createDataFrame(TETRAGONAL, TETRAGONAL_COLUMNS)
    lines = spark.createDataFrame([("tet", i, spacing((4, 4, 6, 90, 90, 90), h), 1.0, h) for i, h in enumerate([(1, 0, 0), (0, 0, 1), (1, 0, 1), (1, 1, 0), (0, 0, 2), (0, 1, 0)])], "phase string, line int, d0 double, weight double, hkl struct<h:int,k:int,l:int>")
    at = spark.createDataFrame([("tet", 8.0), ("tet", 0.0)], "phase string, pressure double")
    d = {(r.pressure, r.line): r.d for r in lattice.predict_lines(lines, own, at).collect()}
    assert d[0.0, 0] == pytest.approx(4) and d[8.0, 1] / 6 < d[8.0, 0] / 4 < 1 and d[8.0, 0] == pytest.approx(d[8.0, 5])
    a, c = d[8.0, 0], d[8.0, 1]
    assert d[8.0, 2] == pytest.approx(spacing((a, a, c, 90, 90, 90), (1, 0, 1)))
    seen = spark.createDataFrame([(1, i, x) for (p, i), x in d.items() if p == 8 and i < 5], "frame long, obs long, d double")
    got = identify.run_identification(seen, spark.createDataFrame([(1,)], "frame long"), own, lines.filter("line < 5")).first()
    assert got.pressure == pytest.approx(8, abs=0.01) and got.n_matched == 5 and got.confidence > 0.99


def test_numpy_lines_are_those_of_the_columns(spark):
    rng = random.Random(4)
    rows = []
    for i in range(24):
        rows.append((f"p{i}", *[rng.uniform(3, 5) for _ in range(3)], 85.0, 97.0, 104.0, ["BM3", "Vinet", "BM2", "Murnaghan", "BM4"][i % 5], None if i % 6 == 0 else rng.uniform(80, 400), rng.uniform(3.5, 5.5), None if i % 4 else 30.0, None if i % 3 else rng.uniform(50, 300), 4.0, 2e-3 if i % 8 == 1 else None, None if i % 2 else 3e-5))
    own = spark.createDataFrame(rows, "name string, a double, b double, c double, alpha double, beta double, gamma double, eos string, k0 double, k0p double, p_max double, k0_c double, k0p_c double, beta_b double, alpha_v double")
    lines = lattice.reflections(own, 1.5)
    at = own.select(F.col("name").alias("phase"), F.explode(F.array(*map(F.lit, (0.0, 0.4, 17.0, 60.0, 100.0)))).alias("pressure"), F.lit(700.0).alias("temperature"))
    want = {(r.phase, r.pressure, r.line): r.d for r in lattice.predict_lines(lines, own, at).collect()}
    n = 0
    for phase in identify.library_of(own, lines):
        for p in (0.0, 0.4, 17.0, 60.0, 100.0):
            for k, d in enumerate(phase.lines(np.array([p]), 700.0, exact=True)[0]):
                assert phase.lines(np.array([p]), 700.0)[0][k] == pytest.approx(d, rel=1e-7)
                assert d == pytest.approx(want[phase.name, p, k + 1], rel=1e-11), (phase.name, p)
                n += 1
    assert n == len(want) > 500


def shown(spark, pressure, amplitudes=None, temperature=None):
    """Gold's lines at a pressure as the peaks of one frame."""
    gold = phases(spark).filter("name = 'Au'").withColumn("alpha_v", F.lit(4.2e-5))
    lines = lattice.reflections(gold)
    at = spark.createDataFrame([("Au", pressure, temperature)], "phase string, pressure double, temperature double")
    seen = lattice.predict_lines(lines, gold, at).select(F.lit(1).cast("long").alias("frame"), F.col("line").cast("long").alias("obs"), "d", (amplitudes(F.col("weight")) if amplitudes is not None else F.lit(None)).cast("double").alias("amplitude"))
    return gold, lines, seen


@pytest.mark.parametrize("pressure", [0.0, 20.0, 50.0, 99.0])
def test_default_search_recovers(spark, pressure):
    gold, lines, seen = shown(spark, pressure)
    got = identify.run_identification(seen, spark.createDataFrame([(1,)], "frame long"), gold, lines).first()
    assert abs(got.pressure - pressure) < 0.05 and got.recall > 0.99 and got.precision == 1.0 and got.intensity_corr is None and got.confidence > 0.99


def test_intensities(spark):
    """Amplitudes that follow the weights raise the confidence, others lower it; the pressure stays."""
    live = spark.createDataFrame([(1,)], "frame long")
    find = lambda f: identify.run_identification(*(lambda g, l, s: (s, live, g, l))(*shown(spark, 20.0, f))).first()
    good, bad, plain = find(lambda w: w * 50), find(lambda w: 50 / (w * w + 0.01)), find(None)
    assert good.intensity_corr == pytest.approx(1) and bad.intensity_corr < 0.95 and good.confidence > bad.confidence
    assert bad.confidence == pytest.approx(plain.confidence * (1 - 0.3 * (1 - bad.intensity_corr))) and plain.intensity_corr is None
    assert abs(good.pressure - bad.pressure) < 0.01


def test_temperature(spark):
    """A hot frame is right with its temperature and at a wrong place without."""
    gold, lines, seen = shown(spark, 10.0, temperature=1500.0)
    at = lambda t: identify.run_identification(seen, spark.createDataFrame([(1, t)], "frame long, temperature double"), gold, lines).first()
    assert abs(at(1500.0).pressure - 10) < 0.05 and abs(at(None).pressure - 10) > 1


def test_evidence_against_lists():
    """Matches, recall, precision and intensities of random peaks by plain loops."""
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 9)
        lines = np.array(sorted((rng.uniform(1, 2) for _ in range(n)), reverse=True))
        phase = identify.Phase({"name": "x", "a": 4.0}, [(d, rng.choice([1.0, 0.5, 0.05]), None) for d in lines])
        d = [rng.uniform(0.9, 2.1) for _ in range(rng.randrange(1, 9))]
        err, amp = [rng.choice([None, 0.0, 0.02]) for _ in d], [rng.choice([None, 1.0, 3.0]) for _ in d]
        peaks = identify.Peaks(d, identify._floats(err), identify._floats(amp))
        got = identify.evidence(phase, peaks, lines, 0.02)
        obs = sorted(zip(d, [e or 0.0 for e in err], amp), key=lambda x: x[0])
        near = [min(range(len(obs)), key=lambda j: (abs(obs[j][0] - p), obs[j][0], obs[j][1])) for p in lines]
        sigma = [math.hypot(0.02 * p, obs[j][1]) for p, j in zip(lines, near)]
        kernel = [math.exp(-0.5 * z * z) if (z := abs(obs[j][0] - p) / s) <= 6 else 0.0 for p, j, s in zip(lines, near, sigma)]
        pairs, a, b = [], set(), set()
        for g, i, j in sorted((abs(p - o[0]), i, j) for i, p in enumerate(lines) for j, o in enumerate(obs) if abs(p - o[0]) < 2 * math.hypot(0.02 * p, o[1])):
            if i not in a and j not in b:
                pairs.append((i, j))
                a.add(i)
                b.add(j)
        span = 2 * max(sigma)
        inside = [i for i, p in enumerate(lines) if obs[0][0] - span <= p <= obs[-1][0] + span]
        strong = [i for i in inside if phase.weight[i] >= 0.1 * max(phase.weight[k] for k in inside)]
        assert got["n_matched"] == len(pairs) and got["score"] == pytest.approx(sum(w * k for w, k in zip(phase.weight, kernel)))
        assert got["recall"] == pytest.approx(sum(phase.weight[i] * kernel[i] for i in strong if i in a) / sum(phase.weight[i] for i in strong) if strong else 0)
        n_in = sum(min(lines) - span <= o[0] <= max(lines) + span for o in obs)
        assert got["precision"] == pytest.approx(min(1, len(pairs) / n_in) if n_in else 0)
        known = [(phase.weight[i], obs[j][2]) for i, j in pairs if obs[j][2] is not None]
        if len(known) < 3:
            assert got["intensity_corr"] is None
        else:
            w, x = map(np.array, zip(*known))
            assert got["intensity_corr"] == pytest.approx(w @ x / math.sqrt((w @ w) * (x @ x)))


def test_frames_without_peaks(spark):
    gold, lines, seen = shown(spark, 20.0)
    frames = spark.createDataFrame([(1, False), (2, True), (3, None)], "frame long, excluded boolean")
    got = {r.frame: r for r in identify.run_identification(seen, frames, gold, lines).collect()}
    assert sorted(got) == [1, 2] and got[2].pressure is None and got[2].confidence is None
    assert identify.run_identification(seen, frames.limit(0), gold, lines).count() == 0


def test_prior_outside_the_range(spark):
    """A prior above a phase's highest pressure holds it there; phases that ignore priors are free."""
    gold, lines, seen = shown(spark, 20.0)
    frames = spark.createDataFrame([(1, 80.0, 2.0)], "frame long, prior double, half double")
    capped = gold.withColumn("p_max", F.lit(30.0))
    assert identify.run_identification(seen, frames, capped, lines).first().pressure == 30
    free = identify.run_identification(seen, frames, capped.withColumn("assumption", F.lit("ignore_prior")), lines).first()
    assert abs(free.pressure - 20) < 0.05 and free.penalty == 1
