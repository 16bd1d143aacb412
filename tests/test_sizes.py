"""Steps that failed on tables sixty or more times sf0.1: their plans, and their results against plain passes."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from framelens.operators import identify, lattice, tracks
from framelens.plans import track_queries
from compare import TABLES
from test_tracks import linked_by_hand


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_phases_are_never_broadcast(spark, tmp_path):
    """A library from a small file, whose size says little of its rows; the states of its phases are as many."""
    spark.range(300).selectExpr("concat('p', id) AS name", "3 + id / 300 AS a", "'BM3' AS eos", "160e0 AS k0", "4e0 AS k0p").write.parquet(f"{tmp_path}/library")
    own = spark.read.parquet(f"{tmp_path}/library")
    out = lattice.predict_lines(lattice.reflections(own), own, own.selectExpr("name AS phase", "10e0 AS pressure"))
    assert "Broadcast" not in plan(out)
    assert out.select("phase").distinct().count() == 300


def _library():
    cell = {"a": 4.1, "eos": "BM3", "k0": 160.0, "k0p": 4.5, "p_max": 80.0, "alpha_v": 2e-5}
    lines = [(round(4.1 / (h * h + k * k) ** 0.5, 6), w, (h, k, 0)) for (h, k), w in {(1, 0): 0.5, (1, 1): 1.0, (2, 0): 0.05, (2, 1): 0.7, (3, 0): 0.3, (3, 1): 0.6}.items()]
    rows = [{"name": "a", **cell}, {"name": "b", **cell, "beta_a": 1e-3, "alpha_v": None, "assumption": "ignore_prior"}, {"name": "c", "a": 4.1}, {"name": "d", **cell}]
    return [identify.Phase(row, [] if row["name"] == "d" else [(d * (1 + 0.01 * i), w, hkl) for d, w, hkl in lines]) for i, row in enumerate(rows)]


def test_frames_fitted_together_as_alone(monkeypatch):
    """With ties, equal d's, missing values, priors in and out of range, temperatures, no peaks, and more peaks than go together."""
    rng = random.Random(9)
    search = identify.Searcher(_library(), 0.01, 0.0, 100.0, 60, 2)
    rows = []
    for f in range(120):
        n = f % 7 if f % 40 else rng.choice([0, 70, 100])
        d = [None if rng.random() < 0.03 else rng.choice([1.2, 2.0, -1.0, math.nan, round(rng.uniform(1, 4.2), 3), round(rng.uniform(1, 4.2), 3), round(rng.uniform(1, 4.2), 3)]) for _ in range(n)]
        d += [x for x in d if rng.random() < 0.2]
        pick = lambda some: [rng.choice(some) for _ in d]
        prior, half, temperature = rng.choice([(math.nan, math.nan, math.nan), (20.0, 3.0, math.nan), (95.0, 2.0, 400.0), (-5.0, 1.0, math.nan), (math.nan, math.nan, 900.0), (10.0, math.nan, math.nan), (40.0, 200.0, 298.0)])
        rows.append((f, np.array(d, dtype=float), np.array(pick([0.0, 0.0, 0.02, None]), dtype=float), np.array(pick([1.0, 5.0, -1.0, None]), dtype=float), prior, half, temperature))
    batch = pd.DataFrame(rows, columns=["frame", "d", "err", "amplitude", "prior", "half", "temperature"])
    alone = search.fit
    calls = []
    monkeypatch.setattr(search, "fit", lambda *x: calls.append(x) or alone(*x))
    got = identify._fit_batch(search, identify.Kept(search.grid), batch)
    assert len(calls) <= 4 * sum(len(r[1]) > identify.MOST_PEAKS for r in rows)
    at = iter(got.itertuples(index=False))
    for f, d, err, amplitude, *more in rows:
        peaks = identify.Peaks(d, err, amplitude)
        scores = search.grid.scores(peaks)[0] if len(peaks.d) else np.zeros(0)
        for k, phase in enumerate(search.library):
            want, row = alone(k, peaks, scores, *(identify._number(x) for x in more)), next(at)
            assert (row.frame, row.phase, row.n_matched) == (f, phase.name, want["n_matched"])
            for c in ("pressure", "score", "recall", "precision", "penalty", "confidence", "intensity_corr"):
                assert getattr(row, c) == pytest.approx(math.nan if want[c] is None else want[c], abs=1e-9, nan_ok=True), (f, phase.name, c)


@pytest.mark.parametrize("predictor", [False, True])
def test_dense_islands_are_followed_sample_by_sample(monkeypatch, predictor):
    """One island of many samples: tracks as of a plain pass, numbered as they begin, and only the last samples held, however rows are cut into batches."""
    monkeypatch.setattr(tracks, "WAITING", 60)
    monkeypatch.setattr(tracks, "POINTS_AT_ONCE", 50)
    most = []
    step = tracks._Links.step
    monkeypatch.setattr(tracks._Links, "step", lambda self, *x: step(self, *x) or most.append(self.held + sum(len(v[0]) for v in self.out)))
    rng = random.Random(6)
    rows = [(k * 12 + i, float(k), 0.5 * i + rng.uniform(-0.15, 0.15) + (0.01 * k if i % 3 else 0.0), rng.uniform(0.05, 0.15)) for k in range(300) for i in range(12) if rng.random() < 0.8]
    table = pd.DataFrame(sorted(rows, key=lambda r: (r[1], r[2], r[0])), columns=["id", "x", "center", "fwhm"]).assign(grp=1, island=0, widest=max(r[3] for r in rows))
    axis = sorted(set(table["x"]))
    table["sample"] = table["x"].map({x: k for k, x in enumerate(axis, 1)})
    if predictor:
        table = pd.concat([table.iloc[:1].assign(x=math.nan, center=math.nan, fwhm=math.nan), table], ignore_index=True)
        table["samples"] = [axis] + [None] * (len(table) - 1)
    batches = (table.iloc[i : i + 97] for i in range(0, len(table), 97))
    out = pd.concat(tracks._linked(1.5, 1, 3, None, predictor)(batches))
    out = out[out["track"].notna()]
    got = {t: frozenset(own["id"]) for t, own in out.groupby("track")}
    assert set(got.values()) == linked_by_hand(rows, 1.5, 1, 3, None, predictor)
    first = {r[0]: (r[1], r[2]) for r in rows}
    assert sorted(got) == list(range(len(got)))
    assert [got[t] for t in sorted(got)] == sorted(got.values(), key=lambda ids: min(first[i] for i in ids))
    assert len(out) > 1000 and max(most) < 300


def test_linking_gathers_no_island(spark):
    own = spark.createDataFrame([(0, i, float(i), 1.0, 0.1, 1.0) for i in range(5)], "grp long, id long, x double, center double, fwhm double, amplitude double")
    assert "InPandas" in (shown := plan(tracks.link_tracks(own))) and "FlatMap" not in shown


def test_tracks_of_large_islands_stay_apart(spark, monkeypatch):
    """More than a thousand tracks of an island, and more than a million of a group: no two have one name."""
    ids = [r.id for r in track_queries.observations(spark, TABLES).select("id").orderBy("id").limit(12).collect()]
    places = [(0, 0, 1000), (0, 1, 0), (0, 0, 1_000_000), (1, 0, 0)]
    links = spark.createDataFrame([(*p, ids[3 * k + i], float(10 * k + i), 1.0) for k, p in enumerate(places) for i in range(3)], tracks.TRACK)
    monkeypatch.setattr(track_queries.O, "link_tracks", lambda obs: links)
    assert [r.n_obs for r in track_queries.run_unknowns(spark, TABLES).collect()] == [3, 3, 3, 3]
