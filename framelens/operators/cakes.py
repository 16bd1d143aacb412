"""Pixels, cakes and rings: binning, robust channels, texture, waviness, spots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import columns as C
from framelens.operators.components import connected_components

MAD = 1.4826


def auto_mask(value: Column, saturated: float | None = None, negative: bool = True, zero: bool = True) -> Column:
    """True where a pixel is to be left out."""
    out = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    out = out | (value < 0) if negative else out
    out = out | (value == 0) if zero else out
    return F.coalesce(out | (value >= saturated) if saturated is not None else out, F.lit(True))


def polygon_mask(pixels: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """``pixels`` with inside: an odd number of the polygon's edges (row, col) crosses the ray to the right."""
    if len(points) < 3:
        raise ValueError("a polygon has three points at least")
    crossings = F.lit(0)
    for (r0, c0), (r1, c1) in zip(points, points[1:] + points[:1]):
        if r0 == r1:
            continue
        between = ((F.col("row") < r0) != (F.col("row") < r1)) & (F.col("col") < c0 + (F.col("row") - r0) * (c1 - c0) / (r1 - r0))
        crossings = crossings + between.cast("int")
    return pixels.withColumn("inside", crossings % 2 == 1)


def with_geometry(pixels: DataFrame, centre_row: float, centre_col: float, pixel: float, distance: float, wavelength: float) -> DataFrame:
    args = (F.col("row"), F.col("col"), centre_row, centre_col)
    return pixels.withColumn("q", C.pixel_q(*args, pixel, distance, wavelength)).withColumn("azimuth", C.pixel_azimuth(*args))


def azimuthal_mean(pixels: DataFrame, step: float, sector: tuple[float, float] | None = None) -> DataFrame:
    """frame, bin, mean, n of (frame, q, azimuth, value): no pixel splitting; optionally within a sector of azimuth."""
    own = pixels if sector is None else pixels.filter(F.col("azimuth").between(*sector))
    return own.groupBy("frame", F.floor(F.col("q") / step).cast("int").alias("bin")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def robust_band(pixels: DataFrame, step: float, half: float = 0.05) -> DataFrame:
    """frame, bin, robust: mean of the values between the quantiles 0.5 - half and 0.5 + half; half 0 is the median."""
    own = pixels.withColumn("bin", F.floor(F.col("q") / step).cast("int"))
    bounds = own.groupBy("frame", "bin").agg(F.percentile("value", F.lit(0.5 - half)).alias("lo"), F.percentile("value", F.lit(0.5 + half)).alias("hi"))
    if not half:
        return bounds.select("frame", "bin", F.col("lo").alias("robust"))
    inside = own.join(bounds, ["frame", "bin"]).groupBy("frame", "bin").agg(F.avg(F.when(F.col("value").between(F.col("lo"), F.col("hi")), F.col("value"))).alias("m"), ((F.max("lo") + F.max("hi")) / 2).alias("middle"))
    return inside.select("frame", "bin", F.coalesce("m", "middle").alias("robust"))


def sigmaclip_mean(pixels: DataFrame, step: float, k: float = 3.0, rounds: int = 5) -> DataFrame:
    """frame, bin, sigmaclip, n: mean after ``rounds`` times leaving out what is k deviations off; sums only, no window."""
    own = pixels.select("frame", F.floor(F.col("q") / step).cast("int").alias("bin"), "value")
    limits = None
    for _ in range(rounds):
        kept = own if limits is None else own.join(limits, ["frame", "bin"]).filter(F.abs(F.col("value") - F.col("m")) <= k * F.col("s") + 1e-12)
        limits = kept.groupBy("frame", "bin").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return limits.select("frame", "bin", F.col("m").alias("sigmaclip"), "n")


def cake(pixels: DataFrame, step: float, sectors: int) -> DataFrame:
    az = F.least(F.lit(sectors - 1), F.floor((F.col("azimuth") + 180) * sectors / 360)).cast("int")
    return pixels.groupBy("frame", az.alias("az_bin"), F.floor(F.col("q") / step).cast("int").alias("rad_bin")).agg(F.avg("value").alias("value"))


def excess(cakes: DataFrame) -> DataFrame:
    """The cake minus the azimuthal median of each radial column: rings go, spots stay."""
    return cakes.withColumn("excess", F.col("value") - F.median("value").over(Window.partitionBy("frame", "rad_bin")))


def coverage_degrees(cakes: DataFrame, sectors: int) -> DataFrame:
    """frame, rad_bin, degrees with signal."""
    return cakes.groupBy("frame", "rad_bin").agg((F.count_if(F.col("value") > 0) / F.lit(sectors) * 360).alias("degrees"))


def texture_metrics(cakes: DataFrame, rings: DataFrame, sectors: int) -> DataFrame:
    """Per frame and ring (ring, lo, hi bins): coverage, index (deviation over mean), spotty share, second harmonic.

    The harmonic solves the normal equations of 1, cos 2a, sin 2a from sums over the ring's azimuth profile.
    """
    own = cakes.join(F.broadcast(rings), F.col("rad_bin").between(F.col("lo"), F.col("hi"))).groupBy("frame", "ring", "az_bin").agg(F.avg("value").alias("v"), F.max("azimuth").alias("azimuth"))
    middle = own.withColumn("m", F.median("v").over(Window.partitionBy("frame", "ring")))
    a = F.radians(F.col("azimuth")) * 2
    c, s, v = F.cos(a), F.sin(a), F.col("v")
    sums = middle.groupBy("frame", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count_if(F.col("v") > 3 * F.col("m")).alias("bright"),
        F.sum(c).alias("sc"), F.sum(s).alias("ss"), F.sum(c * c).alias("scc"), F.sum(s * s).alias("sss"), F.sum(c * s).alias("scs"), F.sum(v).alias("sv"), F.sum(v * c).alias("svc"), F.sum(v * s).alias("svs"),
    )

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    n, sc, ss, scc, sss, scs, sv, svc, svs = (F.col(x) for x in ("n", "sc", "ss", "scc", "sss", "scs", "sv", "svc", "svs"))
    whole = det(n, sc, ss, sc, scc, scs, ss, scs, sss)
    p = det(n, sv, ss, sc, svc, scs, ss, svs, sss) / whole
    q = det(n, sc, sv, sc, scc, svc, ss, scs, svs) / whole
    ok = (F.abs(whole) > 1e-9) & (F.col("mean") > 0)
    return sums.select(
        "frame", "ring", (n / F.lit(sectors)).alias("coverage"), F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).alias("index"), (F.col("bright") / n).alias("spotty"),
        F.when(ok, F.hypot(p, q) / F.col("mean")).alias("amplitude"), F.when(ok, F.degrees(F.atan2(q, p)) / 2).alias("phase"),
    )


def ring_medians(texture: DataFrame) -> DataFrame:
    return texture.groupBy("ring").agg(*[F.median(c).alias(c) for c in ("coverage", "index", "spotty", "amplitude")])


def ring_centroids(cakes: DataFrame, rings: DataFrame, gate: float = 3.0) -> DataFrame:
    """frame, ring, az_bin, azimuth, centroid of the excess over the row's median; null if the top is below gate MADs."""
    own = cakes.join(F.broadcast(rings), F.col("rad_bin").between(F.col("lo"), F.col("hi")))
    row = Window.partitionBy("frame", "ring", "az_bin")
    own = own.withColumn("m", F.median("value").over(row)).withColumn("dev", F.abs(F.col("value") - F.col("m"))).withColumn("e", F.greatest(F.col("value") - F.col("m"), F.lit(0.0)))
    sums = own.groupBy("frame", "ring", "az_bin").agg(F.max("azimuth").alias("azimuth"), F.max("e").alias("top"), F.median("dev").alias("mad"), F.sum("e").alias("w"), F.sum(F.col("e") * F.col("radial")).alias("wx"))
    return sums.select("frame", "ring", "az_bin", "azimuth", F.when((F.col("top") >= gate * F.col("mad")) & (F.col("w") > 0), F.col("wx") / F.col("w")).alias("centroid"))


def waviness_fit(centroids: DataFrame, least: int = 8) -> DataFrame:
    """r0, a1, a2, phases and rms of r = r0 + first and second harmonic of azimuth; 15 sums, then a 5 x 5 solution a ring."""
    a = F.radians("azimuth")
    terms = {"t0": F.lit(1.0), "t1": F.cos(a), "t2": F.sin(a), "t3": F.cos(2 * a), "t4": F.sin(2 * a)}
    own = centroids.filter("centroid IS NOT NULL").select("frame", "ring", F.col("centroid").alias("r"), *[v.alias(k) for k, v in terms.items()])
    names = list(terms)
    aggs = [F.sum(F.col(x) * F.col(y)).alias(f"{x}{y}") for i, x in enumerate(names) for y in names[i:]] + [F.sum(F.col(x) * F.col("r")).alias(f"{x}r") for x in names]
    sums = own.groupBy("frame", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"), *aggs).filter(F.col("n") >= least)

    def solve(batches):
        for b in batches:
            if not len(b):
                continue
            m = np.empty((len(b), 5, 5))
            for i, x in enumerate(names):
                for j, y in enumerate(names):
                    m[:, i, j] = b[f"{x}{y}" if i <= j else f"{y}{x}"]
            v = np.stack([b[f"{x}r"] for x in names], axis=1)
            good = np.abs(np.linalg.det(m)) > 1e-9
            c = np.full((len(b), 5), np.nan)
            c[good] = np.linalg.solve(m[good], v[good][..., None])[..., 0]
            rss = np.maximum(b["rr"].to_numpy() - (c * v).sum(axis=1), 0)
            yield pd.DataFrame({
                "frame": b["frame"], "ring": b["ring"], "n": b["n"], "r0": c[:, 0], "a1": np.hypot(c[:, 1], c[:, 2]), "a2": np.hypot(c[:, 3], c[:, 4]),
                "phase1": np.degrees(np.arctan2(c[:, 2], c[:, 1])), "phase2": np.degrees(np.arctan2(c[:, 4], c[:, 3])) / 2, "rms": np.sqrt(rss / b["n"]),
            })[good]

    return sums.mapInPandas(solve, "frame long, ring int, n long, r0 double, a1 double, a2 double, phase1 double, phase2 double, rms double")


def waviness_report(fits: DataFrame, step: float, most_bins: float = 3.0) -> DataFrame:
    """One row: median amplitudes over frames (each by its strongest ring), splitting of a doublet, and the warning."""
    top = fits.groupBy("frame").agg(F.max(F.struct("a1", "a2", "r0")).alias("b"))
    return top.agg(F.median("b.a1").alias("a1"), F.median("b.a2").alias("a2")).withColumn("splitting", 2 * F.col("a1")).withColumn("warn", F.col("splitting") > most_bins * step)


def straighten(cakes: DataFrame, fits: DataFrame, step: float) -> DataFrame:
    """frame, bin, mean, median of a cake whose rows are shifted by the fitted wave (weighted by 1 / rms over rings)."""
    w = 1 / (F.col("rms") + 1e-6)
    shift = fits.groupBy("frame").agg(
        (F.sum(w * F.col("a1") * F.cos(F.radians("phase1"))) / F.sum(w)).alias("c1"), (F.sum(w * F.col("a1") * F.sin(F.radians("phase1"))) / F.sum(w)).alias("s1"),
        (F.sum(w * F.col("a2") * F.cos(2 * F.radians("phase2"))) / F.sum(w)).alias("c2"), (F.sum(w * F.col("a2") * F.sin(2 * F.radians("phase2"))) / F.sum(w)).alias("s2"),
    )
    a = F.radians("azimuth")
    wave = F.col("c1") * F.cos(a) + F.col("s1") * F.sin(a) + F.col("c2") * F.cos(2 * a) + F.col("s2") * F.sin(2 * a)
    moved = cakes.join(shift, "frame").withColumn("bin", F.round((F.col("radial") - wave) / step).cast("int"))
    return moved.groupBy("frame", "bin").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))


def pick_rings(bins: DataFrame, y: str, n: int, distance: int, k: float = 5.0) -> DataFrame:
    """The n strongest maxima of each frame that keep a distance in bins: strongest first, then by position."""
    own = bins.select("frame", "bin", F.col(y).alias("y"))
    by = Window.partitionBy("frame").orderBy("bin")
    middle = own.withColumn("m", F.median("y").over(Window.partitionBy("frame"))).withColumn("dev", F.abs(F.col("y") - F.col("m")))
    limits = middle.groupBy("frame").agg((F.max("m") + k * F.median("dev")).alias("limit"))
    tops = own.withColumn("l", F.lag("y").over(by)).withColumn("r", F.lead("y").over(by)).filter("l < y AND r < y").join(limits, "frame").filter(F.col("y") > F.col("limit"))
    packed = tops.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("neg"), F.col("bin").alias("bin")))).alias("c"))
    empty = F.array().cast("array<int>")
    kept = F.aggregate("c", empty, lambda s, x: F.when((F.size(s) < n) & F.forall(s, lambda b: F.abs(b - x["bin"]) >= distance), F.array_append(s, x["bin"])).otherwise(s), lambda s: F.array_sort(s))
    return packed.select("frame", F.posexplode(kept).alias("ring", "bin"))


def detect_spots(cakes: DataFrame, sectors: int, k: float = 6.0, floor: float = 20.0, least_rows: int = 30) -> DataFrame:
    """frame, spot, n_pixels, q, azimuth, intensity: connected hot pixels of cakes, periodic in azimuth.

    Hot: the excess over the column's median reaches max(k * 1.4826 * MAD, floor) in a column with enough rows.
    """
    column = Window.partitionBy("frame", "rad_bin")
    own = cakes.filter(F.col("value").isNotNull()).withColumn("rows", F.count(F.lit(1)).over(column)).filter(F.col("rows") >= least_rows)
    own = own.withColumn("e", F.col("value") - F.median("value").over(column))
    own = own.withColumn("mad", F.median(F.abs("e")).over(column))
    hot = own.filter(F.col("e") >= F.greatest(k * MAD * F.col("mad"), F.lit(floor))).withColumn("node", (F.col("frame") * 4096 + F.col("az_bin")) * 65536 + F.col("rad_bin"))
    steps = F.array(*[F.struct(F.lit(da).alias("da"), F.lit(dr).alias("dr")) for da, dr in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = hot.select("frame", "node", "az_bin", "rad_bin", F.explode(steps).alias("s"))
    to = near.select(F.col("node").alias("a"), ((F.col("frame") * 4096 + (F.col("az_bin") + F.col("s.da")) % sectors) * 65536 + F.col("rad_bin") + F.col("s.dr")).alias("b"))
    edges = to.join(hot.select(F.col("node").alias("b")), "b")
    labels = connected_components(edges)
    joined = hot.join(labels, "node", "left").withColumn("spot", F.coalesce("component", "node"))
    a = F.radians("azimuth")
    sums = joined.groupBy("frame", "spot").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum("e").alias("intensity"), (F.sum(F.col("e") * F.col("radial")) / F.sum("e")).alias("q"),
        F.degrees(F.atan2(F.sum(F.col("e") * F.sin(a)), F.sum(F.col("e") * F.cos(a)))).alias("azimuth"),
    )
    return sums


def summed_by_pressure(pixels: DataFrame) -> DataFrame:
    """Pixels of frames at equal pressure, summed; a pixel that is negative in any member is left out."""
    sums = pixels.groupBy("pressure", "row", "col").agg(F.sum("value").alias("value"), F.bool_or(F.col("value") < 0).alias("bad"), F.count(F.lit(1)).alias("members"))
    return sums.filter("NOT bad").drop("bad")


def poisson_bins(pixels: DataFrame, step: float) -> DataFrame:
    """pressure, bin, mean, esd, n; bins without pixels don't appear."""
    return pixels.groupBy("pressure", F.floor(F.col("q") / step).cast("int").alias("bin")).agg(F.avg("value").alias("mean"), (F.sqrt(F.sum("value")) / F.count(F.lit(1))).alias("esd"), F.count(F.lit(1)).alias("n"))


def pair_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """frame, bin, masked, unmasked (each over its largest of the frame) and their difference."""
    w = Window.partitionBy("frame")
    left = a.select("frame", "bin", (F.col("mean") / F.max("mean").over(w)).alias("masked"))
    right = b.select("frame", "bin", (F.col("mean") / F.max("mean").over(w)).alias("unmasked"))
    return left.join(right, ["frame", "bin"], "full").withColumn("difference", F.col("masked") - F.col("unmasked"))


def spot_mask(pixels: DataFrame, spots: DataFrame, half_q: float, half_azimuth: float) -> DataFrame:
    """The pixels (frame, q, azimuth) inside the padded box of a spot of their frame: a band join with a circular distance.

    Boxes that repeat count once. A box goes to each sector of azimuths that it touches, a pixel to its own.
    """
    from framelens.operators.matching import band_join

    sectors = max(1, int(180 // half_azimuth)) if half_azimuth > 0 else 360
    sector = lambda a: F.pmod(F.floor(a * sectors / 360), F.lit(sectors)).cast("long")
    first, last = (F.floor((F.col("sa") + x) * sectors / 360) for x in (-half_azimuth - 1e-9, half_azimuth + 1e-9))
    boxes = spots.select("frame", F.col("q").alias("sq"), F.col("azimuth").alias("sa")).distinct()
    boxes = boxes.withColumn("sector", F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda s: F.pmod(s, F.lit(sectors)).cast("long")))))
    near = band_join(pixels.withColumn("sector", sector(F.col("azimuth"))), boxes, ["frame", "sector"], "q", F.col("sq") - half_q, F.col("sq") + half_q, 0.25)
    around = F.abs(F.col("azimuth") - F.col("sa"))
    hit = near.filter(F.least(around, 360 - around) <= half_azimuth).select("frame", "row", "col").distinct()
    return pixels.join(hit, ["frame", "row", "col"], "left_semi")
