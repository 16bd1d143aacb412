"""Prominences and half widths against going through all bins."""

import random

from framelens.operators import patterns


def test_shapes_by_hand(spark):
    """Plateaus, equal heights, missing bins and values, a top at the end of the axis."""
    rng = random.Random(5)
    frames = {f: {b: None if rng.random() < 0.05 else float(rng.choice([0, 1, 2, 3, 5, 8])) for b in range(40) if rng.random() < 0.95} for f in range(12)}
    bins = spark.createDataFrame([(f, b, v) for f, own in frames.items() for b, v in own.items()], "frame long, bin int, y double")
    tops = [(f, b, v) for f, own in frames.items() for b, v in own.items() if v is not None and rng.random() < 0.4]
    got = {(r.frame, r.bin): (r.prominence, r.width) for r in patterns.peak_shapes(bins, spark.createDataFrame(tops, "frame long, bin int, height double"), "y").collect()}
    assert len(got) == len(tops)
    for f, b, h in tops:
        own = {j: v for j, v in frames[f].items() if v is not None}
        left, right = max((j for j in own if j < b and own[j] > h), default=-1), min((j for j in own if j > b and own[j] > h), default=99)
        base = max(min(own[j] for j in own if left < j <= b), min(own[j] for j in own if b <= j < right))
        low, high = [j for j in own if j < b and own[j] <= h / 2], [j for j in own if j > b and own[j] <= h / 2]
        assert got[f, b] == (h - base, min(high) - max(low) if low and high else None), (f, b)
