"""Peak tables: fractions, summaries, size and strain, instrument resolution, grouping."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Frames whose peaks meet in one task: a fixed value.
FRAMES_OF_PART = 100_000


def good_peaks(peaks: DataFrame) -> DataFrame:
    return peaks.filter("flag = 0")


def phase_fractions(peaks: DataFrame, frames: DataFrame, rir: DataFrame | None = None, identify: DataFrame | None = None, min_conf: float | None = None) -> DataFrame:
    """frame, phase, fraction: each phase's share of the good attributed peak area of a frame.

    Areas are divided by the phase's reference intensity ratio (missing or not positive: 1). With ``min_conf``
    only frames with a higher confidence count for a phase; phases without any row in ``identify`` always do.
    A frame without attributed area has one row with null phase and fraction.
    """
    own = good_peaks(peaks).filter("phase <> '' AND area > 0")
    if rir is not None:
        factor = F.when(F.col("rir") > 0, F.col("rir")).otherwise(1.0)
        own = own.join(rir.select("phase", "rir"), "phase", "left").withColumn("area", F.col("area") / factor)
    # Areas, confidences and frames are rows of one table, dealt out once by frame: the parts grow in number, not in size.
    no, none = F.lit(None).cast("double"), F.lit(None).cast("long")
    rows = own.filter("frame IS NOT NULL").select("frame", "phase", F.col("area").cast("double").alias("area"), none.alias("passed"), none.alias("copies"))
    one = F.lit(1).cast("long")
    rows = rows.unionByName(frames.select("frame", F.lit(None).cast("string").alias("phase"), no.alias("area"), none.alias("passed"), one.alias("copies")))
    gate = identify is not None and min_conf is not None
    if gate:
        sure = identify.filter(F.col("frame").isNotNull() & F.col("phase").isNotNull() & (F.col("confidence") > min_conf))
        rows = rows.unionByName(sure.select("frame", "phase", no.alias("area"), one.alias("passed"), none.alias("copies")))
    parts = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(frames.count() / FRAMES_OF_PART))
    sums = rows.repartition(parts, "frame").groupBy("frame", "phase").agg(F.sum("area").alias("area"), F.max("passed").alias("passed"), F.sum("copies").alias("copies"))
    if gate:
        gated = identify.select("phase").distinct().withColumn("gated", F.lit(True))
        sums = sums.join(F.broadcast(gated), "phase", "left").withColumn("area", F.when(F.col("gated").isNull() | F.col("passed").isNotNull(), F.col("area")))
    sums = sums.filter("area IS NOT NULL OR copies IS NOT NULL")
    whole = Window.partitionBy("frame")
    shares = sums.select("frame", "phase", "area", F.sum("area").over(whole).alias("total"), F.sum("copies").over(whole).alias("copies")).filter("copies IS NOT NULL AND (area IS NOT NULL OR total IS NULL)")
    return shares.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("frame", "phase", (F.col("area") / F.col("total")).alias("fraction"))


def fraction_summary(fractions: DataFrame, present: float = 0.05) -> DataFrame:
    return fractions.filter("phase IS NOT NULL").groupBy("phase").agg(F.avg("fraction").alias("mean"), F.max("fraction").alias("most"), F.count_if(F.col("fraction") > present).alias("n_present"))


def identify_summary(identify: DataFrame, seen_conf: float = 0.3, min_matched: int = 3) -> DataFrame:
    seen = (F.col("confidence") > seen_conf) & (F.col("n_matched") >= min_matched)
    return identify.groupBy("phase").agg(
        F.avg("confidence").alias("mean_conf"), F.max("confidence").alias("max_conf"), F.max("recall").alias("max_recall"), F.max("precision").alias("max_precision"),
        F.count_if(seen).alias("n_seen"), F.count_if(F.col("n_matched") > 0).alias("n_matched"), F.count_if(F.col("prior_penalty") < 1).alias("n_penalised"), F.median(F.when(seen, F.col("pressure"))).alias("median_pressure"),
    )


def explained_counts(peaks: DataFrame) -> DataFrame:
    return good_peaks(peaks).groupBy("frame").agg(F.count_if(F.col("phase") != "").alias("explained"), F.count_if(F.col("phase") == "").alias("unexplained"))


def peak_counts(peaks: DataFrame, frames: DataFrame) -> DataFrame:
    n = good_peaks(peaks).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return frames.select("frame").join(n, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n_peaks"))


def williamson_hall(peaks: DataFrame, k_shape: float = 0.9, min_peaks: int = 5) -> DataFrame:
    """Size and strain of each frame from (frame, q, width, sigma): width = 2 pi K / D + 2 strain q, weighted.

    Weights are 1 / sigma (1 where unknown) over the largest; r2 is unweighted. Two passes of sums, no solver.
    """
    raw = F.when(F.col("sigma") > 0, 1 / F.col("sigma")).otherwise(1.0)
    own = peaks.filter("width > 0 AND q > 0").withColumn("w0", raw)
    # Scaling by the largest weight of the frame leaves the line as it is but for the errors' scale.
    w = F.pow(F.col("w0") / F.max("w0").over(Window.partitionBy("frame")), 2)
    own = own.withColumn("w", w)
    x, y, w = F.col("q"), F.col("width"), F.col("w")
    sums = own.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    line = sums.filter(F.col("n") >= min_peaks).filter(det > 1e-12).select(
        "frame", "n", ((F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).alias("slope"), ((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det).alias("cut")
    )
    fitted = own.join(line, "frame").withColumn("res", F.col("width") - F.col("cut") - F.col("slope") * F.col("q"))
    return fitted.groupBy("frame").agg(
        F.max("n").alias("n"), F.max("slope").alias("slope"), F.max("cut").alias("cut"), F.sum(F.col("res") * F.col("res")).alias("ss_res"), (F.sum(F.col("width") * F.col("width")) - F.sum("width") * F.avg("width")).alias("ss_tot"),
    ).select(
        "frame", "n", (F.col("slope") / 2).alias("strain"), F.when(F.col("cut") > 0, 2 * 3.141592653589793 * k_shape / F.col("cut")).alias("size"),
        F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).alias("r2"),
    )


def deconvolved(width: Column, instrument: Column) -> Column:
    """The instrument's width taken out in quadrature; null where nothing is left."""
    left = width * width - instrument * instrument
    return F.when(left > 0, F.sqrt(left))


def fit_resolution(peaks: DataFrame, q_max: float, least: int = 12, fallback: int = 5) -> DataFrame:
    """Coefficients of width^2 = c2 q^2 + c1 q + c0 over good peaks (q, width), or the median width, in one row.

    The curve is accepted with enough peaks over 0.4 of the range and if it stays within 0.3 to 3 median
    widths on 32 probes.
    """
    x, y = F.col("q"), F.col("width") * F.col("width")
    p = [F.sum(F.pow(x, F.lit(float(i)))).alias(f"s{i}") for i in range(5)] + [F.sum(F.pow(x, F.lit(float(i))) * y).alias(f"t{i}") for i in range(3)]
    sums = peaks.filter("width > 0").agg(F.count(F.lit(1)).alias("n"), (F.max("q") - F.min("q")).alias("span"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.median("width").alias("mid"), *p)
    s = [F.col(f"s{i}") for i in range(5)]
    t = [F.col(f"t{i}") for i in range(3)]

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4])
    c0 = det(t[0], s[1], s[2], t[1], s[2], s[3], t[2], s[3], s[4]) / whole
    c1 = det(s[0], t[0], s[2], s[1], t[1], s[3], s[2], t[2], s[4]) / whole
    c2 = det(s[0], s[1], t[0], s[1], s[2], t[1], s[2], s[3], t[2]) / whole
    solved = sums.select("n", "span", "lo", "hi", "mid", F.when(F.abs(whole) > 1e-12, F.struct(c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))).alias("c"))
    probes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / 31.0)
    inside = F.forall(probes, lambda q: (F.col("c.c2") * q * q + F.col("c.c1") * q + F.col("c.c0")).between(0.09 * F.col("mid") * F.col("mid"), 9 * F.col("mid") * F.col("mid")))
    good = (F.col("n") >= least) & (F.col("span") >= 0.4 * q_max) & F.col("c").isNotNull() & inside
    return solved.select(
        "n", F.when(good, "curve").when(F.col("n") >= fallback, "median").otherwise("none").alias("kind"),
        F.when(good, F.col("c.c0")).when(F.col("n") >= fallback, F.col("mid") * F.col("mid")).alias("c0"), F.when(good, F.col("c.c1")).alias("c1"), F.when(good, F.col("c.c2")).alias("c2"),
    )


def peak_groups(peaks: DataFrame, k: float = 2.0, most: int = 12) -> DataFrame:
    """``peaks`` (frame, center, fwhm) with lo, hi and group: windows of k widths that overlap are one group.

    Groups of more than ``most`` peaks are cut at their widest gap, and again, until none is larger.
    """
    by = Window.partitionBy("frame").orderBy("center", "id")
    own = peaks.withColumn("lo", F.col("center") - k * F.col("fwhm")).withColumn("hi", F.col("center") + k * F.col("fwhm"))
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    own = own.withColumn("group", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return own.drop("new")


def _parts(centers: list[float], most: int) -> list[str]:
    """The part of each of the sorted centres: a is left and b right of each cut."""
    gaps, out, open_ = np.diff(np.asarray(centers, dtype=float)), [""] * len(centers), [(0, len(centers), "0")]
    while open_:
        lo, hi, name = open_.pop()
        if hi - lo <= most:
            out[lo:hi] = [name] * (hi - lo)
        else:
            cut = lo + 1 + int(np.argmax(gaps[lo : hi - 1]))
            open_ += [(lo, cut, name + "a"), (cut, hi, name + "b")]
    return out


def split_groups(grouped: DataFrame, most: int = 12) -> DataFrame:
    """Groups above ``most`` peaks cut at their widest gap (the first on ties), and their parts again until none is larger.

    Only the centres of a large group meet, which are of one frame.
    """
    own = grouped.withColumn("k", F.row_number().over(Window.partitionBy("frame", "group").orderBy("center", "id")))
    large = own.groupBy("frame", "group").agg(F.array_sort(F.collect_list(F.struct("k", "center")))["center"].alias("centers")).filter(F.size("centers") > most)
    parts = F.pandas_udf(lambda s: s.map(lambda c: _parts(c, most)), "array<string>")
    cut = large.select("frame", "group", parts("centers").alias("parts"))
    return own.join(cut, ["frame", "group"], "left").withColumn("part", F.coalesce(F.element_at("parts", F.col("k")), F.lit("0"))).drop("k", "parts")


def sub_resolution(flag: Column, width: Column, step: float, bins: float = 2.0) -> Column:
    """Flag bit 8 for peaks narrower than ``bins`` steps."""
    return F.when(width < bins * step, flag.bitwiseOR(F.lit(8))).otherwise(flag)


def roi_layers(bins: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """Sum of bins within tolerance * centre of each predicted line (frame, phase, center), by frame and phase.

    A band join on a bucket key: every line goes to the buckets that its window touches.
    """
    width = 0.25
    reach = F.sequence(F.floor((F.col("center") * (1 - tolerance)) / width).cast("long"), F.floor((F.col("center") * (1 + tolerance)) / width).cast("long"))
    keyed = lines.withColumn("bucket", F.explode(reach))
    own = bins.withColumn("bucket", F.floor(F.col("radial") / width).cast("long"))
    hit = own.join(keyed, ["frame", "bucket"]).filter(F.abs(F.col("radial") - F.col("center")) <= tolerance * F.col("center"))
    sums = hit.groupBy("frame", "phase").agg(F.sum("y").alias("total"))
    return sums.withColumn("relative", F.col("total") / F.max("total").over(Window.partitionBy("phase")))


def frame_values(bins: DataFrame, peaks: DataFrame, frames: DataFrame, lo: float, hi: float) -> DataFrame:
    """One row a frame: total and highest intensity in the range, contamination, good peaks, pressure, temperature."""
    scalars = bins.filter(F.col("radial").between(lo, hi)).groupBy("frame").agg(F.sum("robust").alias("total"), F.max("robust").alias("top"), F.sum(F.greatest(F.col("mean") - F.col("robust"), F.lit(0.0))).alias("contamination"))
    return frames.select("frame", "pressure", "temperature").join(scalars, "frame", "left").join(peak_counts(peaks, frames), "frame", "left")


def analysis_health(peaks: DataFrame) -> DataFrame:
    return peaks.agg(
        F.count(F.lit(1)).alias("n_peaks"), F.count_if(F.col("flag") == 0).alias("n_good"), F.count_if(F.col("flag") != 0).alias("n_flagged"),
        F.count_if((F.col("flag") == 0) & (F.col("phase") == "")).alias("n_unexplained"), F.countDistinct("frame").alias("n_frames"),
    ).withColumn("per_frame", F.when(F.col("n_frames") > 0, F.col("n_peaks") / F.col("n_frames")))


def seen_gate(identify: DataFrame, seen_conf: float = 0.3, min_matched: int = 3, allow_sparse: bool = False) -> DataFrame:
    ok = F.col("confidence") > seen_conf
    return identify.filter(ok if allow_sparse else ok & (F.col("n_matched") >= min_matched))


def top_candidates(scores: DataFrame, k: int, by: list[Column] | None = None) -> DataFrame:
    order = by or [F.desc("score"), F.col("phase")]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(*order))).filter(F.col("rank") <= k)


def shortlist(ranked: DataFrame, frames: DataFrame) -> DataFrame:
    return ranked.join(frames.filter("NOT excluded").select("frame"), "frame", "left_semi").select("phase").distinct()


def scorecard(scores: DataFrame, truth: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """hit@1, hit@k, mean reciprocal rank over the frames with a label, and the hit rate of the confident ones."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("score"), F.col("phase"))))
    top = ranked.filter("rank = 1").select("frame", F.col("score").alias("top_score"))
    hits = ranked.join(truth, ["frame", "phase"]).groupBy("frame").agg(F.min("rank").alias("rank"))
    own = hits.join(top, "frame")
    return own.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") == 1).cast("double")).alias("hit1"), F.avg((F.col("rank") <= k).cast("double")).alias("hitk"),
        F.avg(1 / F.col("rank")).alias("mrr"), F.avg(F.when(F.col("top_score") > least, (F.col("rank") == 1).cast("double"))).alias("confident_hit"),
    )


def roc_auc(scored: DataFrame, bins: int = 4096) -> DataFrame:
    """Area under the curve from (id, score, truth): the rank sum of the positives, ties by id.

    Ranks come from counts by score bucket and ranks within a bucket, so no task sees all rows.
    """
    own = scored.withColumn("bucket", F.floor(F.col("score") * bins).cast("long"))
    counts = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    ahead = counts.select("bucket", F.coalesce(F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("score", "id"))).join(ahead, "bucket").withColumn("rank", F.col("k") + F.col("ahead"))
    sums = ranked.agg(F.sum(F.when(F.col("truth"), F.col("rank"))).alias("r"), F.count_if(F.col("truth")).alias("p"), F.count_if(~F.col("truth")).alias("n"))
    return sums.select("p", "n", F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def cluster_summary(obs: DataFrame) -> DataFrame:
    """Per cluster of (cluster, frame, x, center, amplitude): extents, the fullest frame and the fingerprint there."""
    per = obs.groupBy("cluster", "frame").agg(F.count(F.lit(1)).alias("members"))
    ref = per.groupBy("cluster").agg(F.max(F.struct("members", (-F.col("frame")).alias("neg"))).alias("m")).select("cluster", (-F.col("m.neg")).alias("ref_frame"))
    prints = obs.join(ref, "cluster").filter("frame = ref_frame").groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list("center"), asc=False), lambda c: F.format_number(2 * 3.141592653589793 / c, 4)), ";").alias("fingerprint"))
    sums = obs.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_obs"), F.countDistinct("frame").alias("n_frames"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("center").alias("c_min"), F.max("center").alias("c_max"), F.sum("amplitude").alias("amplitude"),
    )
    return sums.join(ref, "cluster").join(prints, "cluster")
