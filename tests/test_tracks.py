"""Tracks that follow a slope, against a plain pass over whole groups."""

import random

import pytest

from framelens.operators import matching, tracks


def linked_by_hand(rows, factor, max_gap, least, max_axis_gap, predictor):
    """Tracks of a whole group: sets of ids. ``rows``: id, x, center, width."""
    axis, done, open_ = sorted({r[1] for r in rows}), [], []
    for k, x in enumerate(axis):
        peaks = sorted(r for r in rows if r[1] == x)
        still = []
        for t in open_:
            (still if k - t[-1][0] <= max_gap + 1 and (max_axis_gap is None or x - t[-1][1][1] <= max_axis_gap) else done).append(t)
        open_ = still
        pairs = []
        for n, t in enumerate(open_):
            at = t[-1][1][2]
            points = [p for _, p in t[-4:]]
            if predictor and len(points) > 1:
                mx, my = sum(p[1] for p in points) / len(points), sum(p[2] for p in points) / len(points)
                at += sum((p[1] - mx) * (p[2] - my) for p in points) / sum((p[1] - mx) ** 2 for p in points) * (x - t[-1][1][1])
            pairs += [(abs(at - p[2]), n, p) for p in peaks if abs(at - p[2]) <= factor * max(p[3], t[-1][1][3])]
        taken, used = set(), set()
        for _, n, p in sorted(pairs):
            if n not in used and p not in taken:
                open_[n].append((k, p))
                used.add(n)
                taken.add(p)
        open_ += [[(k, p)] for p in peaks if p not in taken]
    return {frozenset(p[0] for _, p in t) for t in done + open_ if len(t) >= least}


def crossing(rng, n_lines, n_x):
    """Lines of different slopes, some crossing others, with gaps and stray peaks."""
    rows, k = [], 0
    for line in range(n_lines):
        start, slope = rng.uniform(0, 30), rng.uniform(-0.4, 0.4)
        for x in range(n_x):
            if rng.random() < 0.85:
                rows.append((k, float(x) + (x >= n_x // 2) * 3, start + slope * x + rng.uniform(-0.01, 0.01), rng.uniform(0.08, 0.15)))
                k += 1
    return rows + [(k + i, float(rng.randrange(n_x // 2)), rng.uniform(-5, 35), 0.1) for i in range(20)]


@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("max_axis_gap", [None, 2.5])
def test_links(spark, predictor, max_axis_gap):
    rng = random.Random(11)
    groups = {g: crossing(rng, 6 + 3 * g, 14) for g in range(3)}
    obs = spark.createDataFrame([(g, *r, 1.0) for g, rows in groups.items() for r in rows], "grp long, id long, x double, center double, fwhm double, amplitude double")
    got = {}
    for r in tracks.link_tracks(obs, 1.5, 2, 3, max_axis_gap, predictor).collect():
        got.setdefault((r.grp, r.island, r.track), set()).add(r.id)
    for g, rows in groups.items():
        assert {frozenset(v) for k, v in got.items() if k[0] == g} == linked_by_hand(rows, 1.5, 2, 3, max_axis_gap, predictor), g


def test_a_slope_is_followed(spark):
    """A line that moves four widths a sample is one track with the predictor, which starts slowly, and none without."""
    rows, center = [], 1.0
    for x in range(12):
        center += 0.11 + 0.03 * x
        rows.append((1, x, float(x), center, 0.1, 1.0))
    obs = spark.createDataFrame(rows, "grp long, id long, x double, center double, fwhm double, amplitude double")
    sizes = lambda p: sorted(r["count"] for r in tracks.link_tracks(obs, predictor=p).groupBy("island", "track").count().collect())
    assert sizes(True) == [12] and sizes(False) == []


def test_nearest_match(spark):
    """Ties, equal places, frames without peaks, lines without a number."""
    rng = random.Random(1)
    lines = [(f, i if i else None, round(rng.uniform(0, 2), 1)) for f in range(6) for i in range(5)]
    seen = [(f, round(rng.uniform(0, 2), 1)) for f in range(5) for _ in range(rng.randrange(5))]
    got = matching.nearest_match(spark.createDataFrame(lines, "frame long, line long, d double"), spark.createDataFrame(seen + [(1, None)], "frame long, d double")).collect()
    want = []
    for f, i, d in lines:
        near = min((o for g, o in seen if g == f), key=lambda o: (abs(o - d), o), default=None)
        want.append((f, i, d, near))
    key = lambda r: tuple((x is not None, x) for x in r)
    close = lambda d, near: near is None or round(abs(d - near), 9)
    assert sorted(((r.frame, r.line, r.d) for r in got), key=key) == sorted((w[:3] for w in want), key=key)
    assert sorted(((r.frame, r.line, r.d, close(r.d, r.near)) for r in got), key=key) == sorted(((*w[:3], close(w[2], w[3])) for w in want), key=key)


def test_greedy_with_many_candidates(spark):
    """One group of 40,000 candidates: the closest pairs first, each side once."""
    rng = random.Random(6)
    rows = [(0, rng.randrange(3000), rng.randrange(3000), round(rng.random(), 3)) for _ in range(40_000)]
    got = matching.greedy_pairs(spark.createDataFrame(rows, "g int, i long, j long, gap double"), ["g"], "gap", "i", "j").collect()
    left, right, want = set(), set(), []
    for g, i, j in sorted((gap, i, j) for _, i, j, gap in rows):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.append((i, j, g))
    assert sorted((r.i, r.j, r.gap) for r in got) == sorted(want)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.9])
def test_clusters_by_hand(spark, threshold):
    """Random sets of frames, one frame that all tracks share, equal sets, single frames."""
    rng = random.Random(9)
    sets = {t: {0, *rng.sample(range(1, 12), rng.randrange(0, 6))} for t in range(1, 160)} | {500 + t: {0} for t in range(30)}
    for t in range(160, 200):
        sets[t] = set(sets[t - 150])
    parent = {t: t for t in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    points = spark.createDataFrame([(t, f) for t, own in sets.items() for f in own] * 2, "track long, frame long")
    assert {r.track: r.cluster for r in tracks.cluster_tracks(points, threshold).collect()} == {t: find(t) for t in sets}


def test_a_frame_of_very_many_tracks(spark):
    """100,000 tracks that share one frame and have two of their own: no pair of them is made, each is its own cluster."""
    points = spark.range(100_000).selectExpr("id AS track", "explode(array(0L, 2 * id + 1, 2 * id + 2)) AS frame")
    got = tracks.cluster_tracks(points)
    assert got.filter("track = cluster").count() == 100_000
