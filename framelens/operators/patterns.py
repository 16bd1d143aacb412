"""Patterns as arrays or bins: noise, baselines, openings, maxima, resampling, channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD = 1.4826


def to_patterns(bins: DataFrame, channels: list[str]) -> DataFrame:
    """Row-per-frame arrays of ``channels`` (frame, bin, radial, ...), in bin order."""
    packed = bins.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("bin", "radial", *channels))).alias("p"))
    return packed.select("frame", F.transform("p", lambda x: x["radial"]).alias("radial"), *[F.expr(f"transform(p, x -> x.{c})").alias(c) for c in channels])


def mad_sigma(bins: DataFrame, y: str) -> DataFrame:
    """frame, sigma: 1.4826 times the median distance from the median, over finite values."""
    own = bins.filter(F.col(y).isNotNull() & ~F.isnan(y)).select("frame", F.col(y).alias("y"))
    middle = own.groupBy("frame").agg(F.median("y").alias("m"))
    return own.join(middle, "frame").groupBy("frame").agg((MAD * F.median(F.abs(F.col("y") - F.col("m")))).alias("sigma"))


def contamination_score(bins: DataFrame) -> DataFrame:
    return bins.groupBy("frame").agg(F.sum(F.greatest(F.col("mean") - F.col("robust"), F.lit(0.0))).alias("contamination"))


def diagnose_channels(bins: DataFrame, clean: str, mean: str, k: float = 8.0, least: int = 3) -> DataFrame:
    """One row: median over frames of the ratio of outstanding bins in ``clean`` to ``mean``; spotty below one half."""
    def count(c: str) -> DataFrame:
        own = bins.select("frame", F.col(c).alias("y"))
        middle = own.groupBy("frame").agg(F.median("y").alias("m"))
        limits = mad_sigma(own, "y").join(middle, "frame")
        return own.join(limits, "frame").groupBy("frame").agg(F.count_if(F.col("y") > F.col("m") + k * F.col("sigma") / MAD).alias(f"n_{c}"))

    ratios = count(clean).join(count(mean), "frame").filter(F.col(f"n_{mean}") >= least).select((F.col(f"n_{clean}") / F.col(f"n_{mean}")).alias("ratio"))
    return ratios.agg(F.count(F.lit(1)).alias("n_frames"), F.median("ratio").alias("ratio")).withColumn("spotty", F.coalesce(F.col("ratio") < 0.5, F.lit(False)))


def _lls(v: Column) -> Column:
    return F.log(F.log(F.sqrt(F.greatest(v, F.lit(0.0)) + 1) + 1) + 1)


def _unlls(v: Column) -> Column:
    return F.pow(F.exp(F.exp(v) - 1) - 1, 2) - 1


def snip_baseline(y: Column, m: int) -> Column:
    """Baseline of an array: m rounds of replacing a bin by the mean of its neighbours at growing distance if lower.

    On log-log-sqrt values; positions are clipped at the ends, and the result never exceeds the data.
    """
    def clip(w: Column, step: Column) -> Column:
        n = F.size(w)
        return F.transform(w, lambda v, i: F.least(v, (F.get(w, F.greatest(i - step, F.lit(0))) + F.get(w, F.least(i + step, n - 1))) / 2))

    low = F.aggregate(F.sequence(F.lit(1), F.lit(m)), F.transform(y, _lls), clip)
    return F.zip_with(F.transform(low, _unlls), y, lambda b, v: F.least(b, v))


def fill_gaps(y: Column) -> Column:
    """Nulls of an array by linear interpolation between their neighbours, flat at the ends."""
    known = F.filter(F.transform(y, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"].isNotNull())

    def value(v: Column, i: Column) -> Column:
        left = F.array_max(F.filter(known, lambda x: x["i"] < i))
        right = F.array_min(F.filter(known, lambda x: x["i"] > i))
        between = left["v"] + (right["v"] - left["v"]) * (i - left["i"]) / (right["i"] - left["i"])
        return F.coalesce(v, F.when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(between))

    return F.transform(y, value)


def separate_background(bins: DataFrame, m: int = 12) -> DataFrame:
    """frame with arrays baseline, clean, spots and the contamination of each frame; no shuffle after the packing."""
    own = to_patterns(bins, ["mean", "robust", "sigmaclip"]).withColumn("baseline", snip_baseline(F.col("robust"), m))
    spots = F.zip_with("mean", "robust", lambda a, b: a - b)
    return own.select(
        "frame", "radial", "baseline", F.zip_with("robust", "baseline", lambda a, b: a - b).alias("clean"), spots.alias("spots"), F.zip_with("sigmaclip", "baseline", lambda a, b: a - b).alias("sigmaclip_residual"),
        F.aggregate(spots, F.lit(0.0), lambda s, v: s + F.greatest(v, F.lit(0.0))).alias("contamination"),
    )


def opening(bins: DataFrame, y: str, width: int) -> DataFrame:
    """Rolling minimum and then rolling maximum of an odd width (truncated at the ends)."""
    half = width // 2
    w = Window.partitionBy("frame").orderBy("bin").rowsBetween(-half, half)
    return bins.withColumn("low", F.min(y).over(w)).withColumn("opened", F.max("low").over(w)).drop("low")


def winsorize_excess(bins: DataFrame, y: str, width: int) -> DataFrame:
    """The wide part of a positive excess: what is left above zero after an opening."""
    return opening(bins.withColumn("excess", F.greatest(F.col(y), F.lit(0.0))), "excess", width).withColumn("kept", F.least("excess", "opened"))


def auto_fit_range(bins: DataFrame, y: str, share: float = 0.15, k: float = 4.0) -> DataFrame:
    """lo, hi bins of the per-bin median pattern without its leading descent and trailing floor, each ``share`` at most."""
    middle = bins.groupBy("bin").agg(F.median(y).alias("y"))
    # The median pattern has one row a bin: an axis' length, not the data's.
    by = Window.orderBy("bin")
    seen = middle.withColumn("next", F.lead("y").over(by))
    facts = middle.agg(F.median("y").alias("m"), F.max("bin").alias("last"))
    spread = middle.join(F.broadcast(facts), F.lit(True)).agg(F.max("m").alias("m"), F.max("last").alias("last"), (MAD * F.median(F.abs(F.col("y") - F.col("m")))).alias("noise"))
    own = seen.join(F.broadcast(spread), F.lit(True))
    up = F.min(F.when(F.col("next") >= F.col("y"), F.col("bin")))
    down = F.max(F.when(F.col("y") > F.col("m") + k * F.col("noise"), F.col("bin")))
    edges = own.agg(F.max("last").alias("last"), up.alias("up"), down.alias("down"))
    return edges.select(F.least(F.coalesce("up", F.lit(0)), F.floor(F.col("last") * share).cast("int")).alias("lo"), F.greatest(F.coalesce("down", "last"), F.ceil(F.col("last") * (1 - share)).cast("int")).alias("hi"))


def local_maxima(bins: DataFrame, y: str, sigma: DataFrame, snr: float, edge: int = 0) -> DataFrame:
    """frame, bin, height: maxima (a plateau counts at its middle) of at least snr sigmas."""
    by = Window.partitionBy("frame").orderBy("bin")
    own = bins.select("frame", "bin", F.col(y).alias("y"), F.col("radial"))
    new = own.withColumn("new", F.when(F.lag("y").over(by) == F.col("y"), 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy("frame", "run").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.max("y").alias("y"))
    at = Window.partitionBy("frame").orderBy("run")
    peaks = flat.withColumn("left", F.lag("y").over(at)).withColumn("right", F.lead("y").over(at)).filter("left < y AND right < y")
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    return peaks.select("frame", middle.alias("bin"), F.col("y").alias("height")).join(sigma, "frame").filter(F.col("height") >= snr * F.col("sigma")).select("frame", "bin", "height")


def _bases(y: list[float]) -> list[float]:
    """For each value the lowest one back to the last higher value, itself included: one pass with a falling stack."""
    out, stack = [], []
    for v in y:
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        stack.append((v, low))
        out.append(low)
    return out


SHAPES = "frame long, bin int, height double, prominence double, width int"


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for frame, at, y, peaks, heights in batch[["frame", "at", "y", "peaks", "heights"]].itertuples(index=False, name=None):
            at, y, peaks, heights = np.asarray(at), np.asarray(y, dtype=float), np.asarray(peaks), np.asarray(heights, dtype=float)
            left, right = np.array(_bases(y.tolist())), np.array(_bases(y[::-1].tolist())[::-1])
            place = np.searchsorted(at, peaks)
            widths = []
            for k, h in zip(place, heights):
                low = np.flatnonzero(y <= h / 2)
                i, j = np.searchsorted(low, k), np.searchsorted(low, k, side="right")
                widths.append(int(at[low[j]] - at[low[i - 1]]) if 0 < i and j < len(low) else None)
            rows = pd.DataFrame({"frame": frame, "bin": peaks, "height": heights, "prominence": heights - np.maximum(left[place], right[place])})
            yield rows.assign(width=pd.array(widths, dtype="Int32"))


def peak_shapes(bins: DataFrame, maxima: DataFrame, y: str) -> DataFrame:
    """frame, bin, height, prominence, width of maxima (frame, bin, height) of a pattern.

    The prominence is the height over the higher of the two lowest points before a higher bin on each side, the width the
    distance in bins of the nearest bins at or below half height, null without one. A frame's pattern is one row.
    """
    pattern = bins.filter(F.col(y).isNotNull()).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("bin", F.col(y).cast("double").alias("y")))).alias("b"))
    tops = maxima.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("bin", F.col("height").cast("double").alias("height")))).alias("m"))
    packed = tops.join(pattern, "frame").select(F.col("frame").cast("long").alias("frame"), F.col("b.bin").alias("at"), F.col("b.y").alias("y"), F.col("m.bin").alias("peaks"), F.col("m.height").alias("heights"))
    return packed.mapInPandas(_shapes, SHAPES)


def prominence(bins: DataFrame, maxima: DataFrame, y: str) -> DataFrame:
    """frame, bin, height, prominence of :func:`peak_shapes`."""
    return peak_shapes(bins, maxima, y).drop("width")


def half_widths(bins: DataFrame, maxima: DataFrame, y: str) -> DataFrame:
    """frame, bin, height, width of :func:`peak_shapes`."""
    return peak_shapes(bins, maxima, y).drop("prominence")


def resample(bins: DataFrame, grid: DataFrame, x: str, y: str, width: float, outside: float | None = 0.0) -> DataFrame:
    """frame, g, value: linear interpolation of each frame at the grid points (g, gx); ``outside`` beyond its ends."""
    by = Window.partitionBy("frame").orderBy(x)
    segments = bins.filter(F.col(y).isNotNull()).select("frame", F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(by).alias("x1"), F.lead(y).over(by).alias("y1")).filter("x1 > x0")
    spread = segments.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("x0") / width).cast("long"), F.floor(F.col("x1") / width).cast("long"))))
    points = grid.withColumn("bucket", F.floor(F.col("gx") / width).cast("long"))
    hit = spread.join(points, "bucket").filter(F.col("gx").between(F.col("x0"), F.col("x1")))
    value = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("gx") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    inside = hit.groupBy("frame", "g").agg(F.max(F.struct("x0", value.alias("v"))).alias("m")).select("frame", "g", F.col("m.v").alias("value"))
    every = bins.select("frame").distinct().join(F.broadcast(grid.select("g")), F.lit(True))
    return every.join(inside, ["frame", "g"], "left").select("frame", "g", F.coalesce("value", F.lit(outside).cast("double")).alias("value"))


def common_axis(points: DataFrame, x: str, least: int = 16) -> tuple[DataFrame, DataFrame]:
    """The frames of ``points`` with ``least`` points or more, and the axis (g, gx) that they share.

    It reaches from the smallest to the largest x of these frames, in steps of the median of their median steps. Its length
    is that of an axis; without any such frame it is empty.
    """
    steps = points.filter(F.col(x).isNotNull()).select("frame", F.col(x).cast("double").alias("x")).withColumn("dx", F.col("x") - F.lag("x").over(Window.partitionBy("frame").orderBy("x")))
    per = steps.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.median("dx").alias("step")).filter(F.col("n") >= least)
    whole = per.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.median("step").alias("step")).filter("step > 0")
    last = F.ceil((F.col("hi") - F.col("lo")) / F.col("step") - 0.5 + 1)
    numbers = whole.select("lo", "hi", "step", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("g"))
    axis = numbers.withColumn("gx", F.col("lo") + F.col("g") * F.col("step")).filter(F.col("gx") < F.col("hi") + F.col("step") / 2)
    return per.select("frame"), axis.select("g", "gx")


def onto_common_axis(points: DataFrame, x: str, y: str, least: int = 16) -> DataFrame:
    """frame, g, gx, value: every frame of :func:`common_axis` at every place of the axis, between its points by lines, outside its own range null."""
    frames, axis = common_axis(points, x, least)
    own = points.join(frames, "frame", "left_semi")
    width = 8.0 * (axis.agg((F.max("gx") - F.min("gx")).alias("w"), F.count(F.lit(1)).alias("n")).select((F.col("w") / F.col("n")).alias("s")).first()["s"] or 1.0)
    return resample(own, axis, x, y, width, outside=None).join(F.broadcast(axis), "g").select("frame", "g", "gx", "value")


def in_range(points: DataFrame, x: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """The rows whose x lies in [lo, hi]; a limit that is None is open. Rows without an x go where there is a limit."""
    out = points if lo is None else points.filter(F.col(x) >= lo)
    return out if hi is None else out.filter(F.col(x) <= hi)


def fit_window(bins: DataFrame, edge: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """``bins`` (bin, radial) with valid: not within ``edge`` bins of either end of the axis, and in [lo, hi]."""
    last = bins.agg(F.max("bin").alias("_last"))  # one row
    inside = F.col("bin").between(F.lit(edge), F.col("_last") - edge)
    for limit, ok in ((lo, F.col("radial") >= F.lit(lo)), (hi, F.col("radial") <= F.lit(hi))):
        inside = inside if limit is None else inside & ok
    return bins.join(F.broadcast(last), F.lit(True)).withColumn("valid", inside).drop("_last")


def fit_source(separated: DataFrame, kind: str) -> DataFrame:
    """frame, y: the channel that peaks are fitted on."""
    add = lambda a, b: F.zip_with(a, b, lambda x, z: x + z)
    wide = F.transform("spots", lambda v: F.greatest(v, F.lit(0.0)))
    channels = {"clean": F.col("clean"), "mean": add("clean", "spots"), "hybrid": add(F.col("clean"), wide), "sigmaclip": F.col("sigmaclip_residual"), "spots": F.col("spots")}
    if kind not in channels:
        raise ValueError(f"unknown source {kind}")
    return separated.select("frame", "radial", channels[kind].alias("y"))


def best_frame_per_pressure(bins: DataFrame, frames: DataFrame, y: str) -> DataFrame:
    """frame, pressure_key, snr: of the frames at a rounded pressure the one with the best signal; frames without one all stay."""
    own = bins.join(frames.filter("NOT excluded").select("frame"), "frame", "left_semi")
    smooth = own.withColumn("s", F.percentile(y, 0.5).over(Window.partitionBy("frame").orderBy("bin").rowsBetween(-2, 2)))
    signal = smooth.groupBy("frame").agg(F.max("s").alias("top")).join(mad_sigma(own, y), "frame").select("frame", F.when(F.col("sigma") > 0, F.col("top") / F.col("sigma")).otherwise(0.0).alias("snr"))
    keyed = signal.join(frames.select("frame", F.round("pressure", 3).alias("pressure_key")), "frame")
    first = Window.partitionBy(F.coalesce(F.col("pressure_key").cast("string"), F.concat(F.lit("f"), F.col("frame").cast("string")))).orderBy(F.desc(F.round("snr", 9)), "frame")
    return keyed.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def fit_peaks(bins: DataFrame, candidates: DataFrame, y: str, widths: tuple[float, ...] = (0.7, 1.0, 1.4), shifts: tuple[float, ...] = (-0.5, 0.0, 0.5), etas: tuple[float, ...] = (0.0, 0.5, 1.0), rounds: int = 1) -> DataFrame:
    """frame, id, height, center, fwhm, eta, area, chi2, rel_misfit, flag of candidates (frame, id, center, fwhm).

    Variable projection on a grid: for each of a few shifts, widths and shapes the height and a linear background
    follow from sums over the bins of the window, and the best sum of squares wins. More rounds repeat this with a
    finer grid around the winner. A frame's pattern and candidates are one row, so the grid is never rows of a table; bins
    without a value are left out. Flags: 1 a height that isn't positive, 2 a misfit above one twentieth of the height.
    """
    pattern = bins.filter(F.col(y).isNotNull() & F.col("radial").isNotNull()).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(F.col("radial").cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("b"))
    item = F.struct(F.col("center").cast("double").alias("center"), F.col("fwhm").cast("double").alias("fwhm"), "id")
    peaks = candidates.filter("center IS NOT NULL AND fwhm > 0").groupBy("frame").agg(F.array_sort(F.collect_list(item)).alias("c"))
    packed = peaks.join(pattern, "frame").select("frame", F.col("b.x").alias("x"), F.col("b.y").alias("y"), *[F.col(f"c.{k}").alias(k) for k in ("id", "center", "fwhm")])
    names = ["height", "center", "fwhm", "eta", "chi2", "n"]
    types = {k: candidates.schema[k].dataType.simpleString() for k in ("frame", "id")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for frame, x, v, ids, center, fwhm in batch[["frame", "x", "y", "id", "center", "fwhm"]].itertuples(index=False, name=None):
                x, v, ids = np.asarray(x), np.asarray(v), np.asarray(ids)
                best = np.stack([np.asarray(center), np.asarray(fwhm), np.full(len(ids), 0.5)], axis=1)
                found = np.zeros((0, len(names)))
                for k in range(rounds):
                    found = _fit_on_grid(x, v, best, 0.5**k, widths, shifts, etas)
                    ids, found = ids[~np.isnan(found[:, -1])], found[~np.isnan(found[:, -1])]
                    best = found[:, 1:4]
                out.append(pd.DataFrame(found, columns=names).assign(frame=frame, id=ids))
            if out:
                yield pd.concat(out)[["frame", "id", *names]]

    out = packed.mapInPandas(run, f"frame {types['frame']}, id {types['id']}, " + ", ".join(f"{c} double" for c in names))
    area = F.col("height") * F.col("fwhm") * (F.col("eta") * 1.5707963267948966 + (1 - F.col("eta")) * 1.0644670194312262)
    misfit = F.try_divide(F.sqrt(F.col("chi2") / F.col("n")), F.abs("height"))
    return out.select("frame", "id", "height", "center", "fwhm", "eta", area.alias("area"), "chi2", misfit.alias("rel_misfit"), (F.when(F.col("height") > 0, 0).otherwise(1) + F.when(misfit > 0.05, 2).otherwise(0)).alias("flag"))


#: Numbers of candidates, grid points and bins that meet at once: a fixed value.
GRID_CELLS = 1 << 20


def _fit_on_grid(x: np.ndarray, v: np.ndarray, peaks: np.ndarray, scale: float, widths: tuple[float, ...], shifts: tuple[float, ...], etas: tuple[float, ...]) -> np.ndarray:
    """height, center, fwhm, eta, chi2, n of the best grid point of each peak (center, fwhm, eta); n is NaN without one."""
    shift, width, eta = (a.ravel() for a in np.meshgrid(np.multiply(shifts, scale), np.power(widths, scale), np.asarray(etas, dtype=float), indexing="ij"))
    out, at = np.full((len(peaks), 6), np.nan), 0
    while at < len(peaks):
        several = max(1, GRID_CELLS // (len(x) * len(eta) + 1))
        own = peaks[at : at + several]
        c0, w0 = own[:, :1], own[:, 1:2]
        inside = (x >= (c0 - 3 * w0).min() - 1e-6 * w0.max()) & (x <= (c0 + 3 * w0).max() + 1e-6 * w0.max())
        u, y = x[inside], v[inside]
        m = (np.abs(u - c0) <= 3 * w0).astype(float)
        center, fwhm = c0 + shift * w0, w0 * width
        t = (u - center[..., None]) / fwhm[..., None]
        p = (eta[:, None] / (1 + 4 * t * t) + (1 - eta)[:, None] * np.exp(-4 * np.log(2.0) * t * t)) * m[:, None, :]
        d, z = (u - c0) * m, np.where(m > 0, y, 0.0)
        n, sx, sxx, sy, sxy, syy = (a.sum(axis=1, keepdims=True) for a in (m, d, d * d, z, z * d, z * z))
        sp, spx, spp, spy = p.sum(axis=2), (p @ d[..., None])[..., 0], (p * p).sum(axis=2), (p @ z[..., None])[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            # The background is projected out first: what is left of profile and data gives the height.
            det = n * sxx - sx * sx
            pp = spp - (sxx * sp * sp - 2 * sx * sp * spx + n * spx * spx) / det
            py = spy - (sxx * sp * sy - sx * (sp * sxy + spx * sy) + n * spx * sxy) / det
            yy = syy - (sxx * sy * sy - 2 * sx * sy * sxy + n * sxy * sxy) / det
            height, chi2 = py / pp, np.round(np.maximum(yy - py * py / pp, 0.0), 9)
            ok = (n >= 5) & (np.abs(det) > 1e-12) & (pp > 1e-12)
        for j in np.flatnonzero(ok.any(axis=1)):
            g = np.flatnonzero(ok[j])
            g = g[np.lexsort((eta[g], fwhm[j, g], center[j, g], chi2[j, g]))[0]]
            out[at + j] = height[j, g], center[j, g], fwhm[j, g], eta[g], chi2[j, g], n[j, 0]
        at += several
    return out


def subtract_profiles(bins: DataFrame, peaks: DataFrame, y: str, reach: float = 5.0) -> DataFrame:
    """frame, bin, radial, residual: the pattern without the profiles of (frame, height, center, fwhm, eta)."""
    from framelens.functions.columns import pseudo_voigt
    from framelens.operators.matching import band_join

    near = band_join(bins.select("frame", "bin", "radial"), peaks.select("frame", "height", "center", "fwhm", "eta"), ["frame"], "radial", F.col("center") - reach * F.col("fwhm"), F.col("center") + reach * F.col("fwhm"), 0.5)
    model = near.groupBy("frame", "bin").agg(F.sum(pseudo_voigt(F.col("radial"), F.col("height"), F.col("center"), F.col("fwhm"), F.col("eta"))).alias("model"))
    return bins.join(model, ["frame", "bin"], "left").select("frame", "bin", "radial", (F.col(y) - F.coalesce("model", F.lit(0.0))).alias("residual"))
