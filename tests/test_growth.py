"""Steps that grew faster than their input: their plans, and their results against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import identify, lattice, library, matching, tracks
from framelens.plans.views import phases
from framelens.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranking_never_moves_frames_times_prints(spark):
    """Cosines, ties and missing phases as by hand; frames and fingerprints are not joined."""
    rng = random.Random(2)
    prints = {(p, float(q)): {g: rng.choice([0.25, 0.5, 1.0]) for g in rng.sample(range(12), 4)} for p in "abc" for q in range(3)}
    prints["c", 1.0] = prints["c", 0.0]
    frames = {f: {g: rng.choice([0.0, 1.0, 2.0]) for g in rng.sample(range(14), 3)} for f in range(40)}
    own = spark.createDataFrame([(f, g, v) for f, x in frames.items() for g, v in x.items()], "frame long, g long, value double")
    ref = spark.createDataFrame([(*k, g, v) for k, x in prints.items() for g, v in x.items()], "phase string, pressure double, g long, value double")
    out = library.rank_candidates(own, ref, 2)
    assert "Join" not in plan(out)
    got = {(r.frame, r["rank"]): (r.phase, r.pressure, r.score) for r in out.collect()}
    want = {}
    for f, x in frames.items():
        x = {g: v for g, v in x.items() if v > 0}
        best = {}
        for (p, q), y in prints.items():
            if x.keys() & y.keys():
                score = round(sum(x[g] * y[g] for g in x.keys() & y.keys()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), 9)
                best[p] = max(best.get(p, (-1.0, 0.0)), (score, -q))
        for k, (p, (s, q)) in enumerate(sorted(best.items(), key=lambda b: (-b[1][0], b[0]))[:2], 1):
            want[f, k] = (p, -q, pytest.approx(s, abs=2e-9))
    assert got == want


def test_planes_are_counted_without_a_sort(spark):
    own = spark.createDataFrame([("x", 4.0)], "name string, a double")
    assert "SortAggregate" not in plan(lattice.reflections(own))


def test_lines_are_predicted_without_lambdas(spark):
    own = spark.createDataFrame([("x", 4.0, "BM3", 160.0, 4.0)], "name string, a double, eos string, k0 double, k0p double")
    at = spark.createDataFrame([("x", 10.0)], "phase string, pressure double")
    assert "lambda" not in plan(lattice.predict_lines(lattice.reflections(own), own, at))


def _frames(rng):
    lines = [(f, i, round(rng.uniform(1, 4), 2)) for f in range(30) for i in range(rng.randrange(9))]
    seen = [(f, 100 + j, round(rng.uniform(1, 4), 2), rng.choice([0.0, 0.01, 0.5])) for f in range(2, 32) for j in range(rng.randrange(9))]
    return lines, seen


def _closest_first(pairs):
    used, out = set(), []
    for f, gap, i, j in sorted(pairs):
        if (f, "l", i) not in used and (f, "o", j) not in used:
            used |= {(f, "l", i), (f, "o", j)}
            out.append((f, i, j, gap))
    return sorted(out)


def test_one_to_one_with_large_errors(spark):
    """An error wider than the usual reach finds its line too; no intermediate row for a bucket."""
    lines, seen = _frames(random.Random(4))
    want = _closest_first([(f, abs(o - d), i, j) for f, i, d in lines for g, j, o, e in seen if f == g and abs(o - d) < 2 * math.hypot(max(0.02 * d, 1e-9), e)])
    out = matching.match_one_to_one(spark.createDataFrame(lines, "frame long, line long, d double"), spark.createDataFrame(seen, "frame long, obs long, d double, err double"), 0.02)
    assert "_bucket" not in plan(out)
    assert sorted((r.frame, r.line, r.obs, r.gap) for r in out.collect()) == want


def test_attribution_by_hand(spark):
    lines, seen = _frames(random.Random(5))
    want = _closest_first([(f, abs(o - d) / o, (i % 3, i), j) for f, i, d in lines for g, j, o, _ in seen if f == g and abs(o - d) / o < 0.05])
    ours = spark.createDataFrame(lines, "frame long, line long, d double").selectExpr("frame", "line % 3 AS phase_order", "line", "d")
    out = matching.attribute_peaks(spark.createDataFrame(seen, "frame long, obs long, d double, err double"), ours, 0.05)
    assert "_bucket" not in plan(out)
    assert sorted((r.frame, (r.phase_order, r.line), r.obs, r.gap) for r in out.collect()) == want


@pytest.mark.parametrize("grid", [5, 50, 1_000_000])
def test_closest_first_of_many(grid):
    """Copies at one place, ties and unequal widths: what going through all pairs gives; 20,000 on each side are a moment's work."""
    rng = random.Random(grid)
    for _ in range(200):
        place, center = ([round(1 + rng.randrange(grid) / grid * 0.3, 4) for _ in range(rng.randrange(17, 40))] for _ in range(2))
        center.sort()
        width, wide = ([rng.choice([0.001, 0.02, 0.03]) for _ in x] for x in (place, center))
        near = [(abs(p - c), t, j) for t, p in enumerate(place) for j, c in enumerate(center) if abs(p - c) <= 1.5 * max(width[t], wide[j])]
        used, want = set(), []
        for _, t, j in sorted(near):
            if ("t", t) not in used and ("j", j) not in used:
                used |= {("t", t), ("j", j)}
                want.append((t, j))
        assert sorted(tracks.closest_first(place, width, center, wide, 1.5)) == sorted(want)
    many = sorted(round(1 + rng.expovariate(2), 4) for _ in range(20_000))
    assert len(tracks.closest_first(many, [0.025] * 20_000, many, [0.025] * 20_000, 1.5)) == 20_000


def test_an_axis_is_not_copied_to_each_row(spark, monkeypatch):
    """Linking along a slope stores no row that holds the whole axis but one a group."""
    obs = spark.range(200).selectExpr("id % 2 AS grp", "id", "id DIV 2 AS x", "2e0 + 1e-3 * id AS center", "2e-2 AS fwhm", "1e0 AS amplitude")
    kept, joined = tracks.stored, []
    monkeypatch.setattr(tracks, "stored", lambda df: joined.append(plan(df)) or kept(df))
    assert tracks.link_tracks(obs, predictor=True).count() == 200
    assert not [p for p in joined if "FlatMapGroupsInPandas" in p]  # islands and axes meet as two sides


def test_text_of_numbers_is_rounded_as_sql_does(spark):
    own = spark.createDataFrame([(1, 0, 3.5, 0.0000005), (1, 1, 3.6, None)], "frame long, bin int, radial double, y double")
    live = spark.createDataFrame([(1, False)], "frame long, excluded boolean")
    assert {r.bin: r.line for r in sinks.pattern_lines(own, live).collect()} == {0: "3.500000 0.000000", 1: None}


def test_sorted_grid_scores_as_all_lines_do(spark):
    """Equal d's, errors, wide gaps: the score of each pressure is that of going through all lines, and a zero score can be left out."""
    own = identify.library_of(phases(spark), lattice.reflections(phases(spark)))
    points = [np.linspace(0, 100, 21) for _ in own]
    grids = [x.lines(p, exact=True) for x, p in zip(own, points)]
    grid = identify.Grid(grids, own, 0.01)
    rng = random.Random(8)
    for _ in range(60):
        d = [round(rng.uniform(0.8, 6), 3) for _ in range(rng.randrange(1, 12))]
        peaks = identify.Peaks(d + d[:1], [rng.choice([0.0, 0.003, 0.05]) for _ in range(len(d) + 1)])
        score, near = grid.scores(peaks, 0.02)
        for k, (x, lines) in enumerate(zip(own, grids)):
            kernel, gap = identify.kernels(peaks, lines, 0.01)
            rows = slice(grid.cuts[k], grid.cuts[k + 1])
            assert np.allclose(score[rows], kernel @ x.weight, rtol=0, atol=1e-12) and (near[rows] == (gap < 0.02 * lines).sum(axis=1)).all()
    seen = spark.createDataFrame([(1, 1, 2.0, 0.0)], "frame long, obs long, d double, err double")
    found = identify.score_grid(seen, phases(spark), lattice.reflections(phases(spark)), [0.0, 50.0], above=0.0)
    whole = identify.score_grid(seen, phases(spark), lattice.reflections(phases(spark)), [0.0, 50.0])
    assert whole.count() == 10 and sorted(found.collect()) == sorted(whole.filter("score > 0").collect())
