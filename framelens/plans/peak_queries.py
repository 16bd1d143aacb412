"""Queries over peak tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.functions import columns as C
from framelens.operators import peaks as O
from framelens.plans.catalog import query
from framelens.plans.views import table, view


def _r(*names: str, n: int = 6) -> list:
    return [F.round(x, n).alias(x) for x in names]


def _frames_of_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"))


@query("""WITH s AS (SELECT frame, phase, sum(area) AS area FROM v_peaks WHERE flag = 0 AND phase <> '' AND area > 0 GROUP BY 1, 2)
SELECT o_orderkey AS frame, phase, round(area / sum(area) OVER (PARTITION BY s.frame), 6) AS fraction FROM orders LEFT JOIN s ON s.frame = o_orderkey""", "v_peaks")
def phase_fractions(spark: SparkSession, sf: str) -> DataFrame:
    return O.phase_fractions(view(spark, sf, "v_peaks"), _frames_of_peaks(spark, sf)).select("frame", "phase", *_r("fraction"))


@query("""WITH s AS (SELECT p.frame, p.phase, sum(area / CASE WHEN p.phase = 'Au' THEN 2e0 ELSE 1e0 END) AS area FROM v_peaks p WHERE flag = 0 AND phase <> '' AND area > 0 GROUP BY 1, 2),
g AS (SELECT s.* FROM s JOIN (SELECT frame, phase, max(confidence) AS c FROM v_identify GROUP BY 1, 2) i ON i.frame = s.frame AND i.phase = s.phase WHERE c > 5e-1)
SELECT o_orderkey AS frame, phase, round(area / sum(area) OVER (PARTITION BY g.frame), 6) AS fraction FROM orders LEFT JOIN g ON g.frame = o_orderkey""", "v_peaks", "v_identify")
def phase_fractions_rir_gated(spark: SparkSession, sf: str) -> DataFrame:
    rir = spark.createDataFrame([("Au", 2.0), ("Re", -1.0)], "phase string, rir double")
    return O.phase_fractions(view(spark, sf, "v_peaks"), _frames_of_peaks(spark, sf), rir, view(spark, sf, "v_identify"), 0.5).select("frame", "phase", *_r("fraction"))


@query("""WITH s AS (SELECT frame, phase, sum(area) AS area FROM v_peaks WHERE flag = 0 AND phase <> '' AND area > 0 GROUP BY 1, 2), f AS (SELECT phase, area / sum(area) OVER (PARTITION BY frame) AS fraction FROM s)
SELECT phase, round(avg(fraction), 6) AS mean, round(max(fraction), 6) AS most, count(*) FILTER (fraction > 5e-2) AS n_present FROM f GROUP BY phase""", "v_peaks")
def fraction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return O.fraction_summary(O.phase_fractions(view(spark, sf, "v_peaks"), _frames_of_peaks(spark, sf))).select("phase", *_r("mean", "most"), "n_present")


@query("""SELECT phase, round(avg(confidence), 6) AS mean_conf, round(max(confidence), 6) AS max_conf, round(max(recall), 6) AS max_recall, round(max(precision), 6) AS max_precision, count(*) FILTER (confidence > 3e-1 AND n_matched >= 3) AS n_seen,
count(*) FILTER (n_matched > 0) AS n_matched, count(*) FILTER (prior_penalty < 1) AS n_penalised, round(median(pressure) FILTER (confidence > 3e-1 AND n_matched >= 3), 6) AS median_pressure FROM v_identify GROUP BY phase""", "v_identify")
def identify_summary(spark: SparkSession, sf: str) -> DataFrame:
    return O.identify_summary(view(spark, sf, "v_identify")).select("phase", *_r("mean_conf", "max_conf", "max_recall", "max_precision"), "n_seen", "n_matched", "n_penalised", *_r("median_pressure"))


@query("SELECT frame, count(*) FILTER (phase <> '') AS explained, count(*) FILTER (phase = '') AS unexplained FROM v_peaks WHERE flag = 0 GROUP BY frame", "v_peaks")
def explained_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.explained_counts(view(spark, sf, "v_peaks"))


@query("SELECT o_orderkey AS frame, coalesce(n, 0) AS n_peaks FROM orders LEFT JOIN (SELECT frame, count(*) AS n FROM v_peaks WHERE flag = 0 GROUP BY 1) p ON p.frame = o_orderkey", "v_peaks")
def peak_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.peak_counts(view(spark, sf, "v_peaks"), _frames_of_peaks(spark, sf))


@query("SELECT frame, peak, k1, k2, round(center, 6) AS center, flag FROM v_peaks WHERE flag = 0", "v_peaks")
def good_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return O.good_peaks(view(spark, sf, "v_peaks")).select("frame", "peak", "k1", "k2", *_r("center"), "flag")


@query("""WITH b AS (SELECT k2 AS frame, center AS q, fwhm AS width, CASE WHEN peak % 3 = 0 THEN NULL ELSE center_err END AS sigma FROM v_peaks WHERE flag = 0),
a AS (SELECT *, CASE WHEN sigma > 0 THEN 1 / sigma ELSE 1e0 END AS w0 FROM b WHERE width > 0 AND q > 0), w AS (SELECT *, pow(w0 / max(w0) OVER (PARTITION BY frame), 2) AS w FROM a),
s AS (SELECT frame, count(*) AS n, sum(w) AS s, sum(w*q) AS sx, sum(w*q*q) AS sxx, sum(w*width) AS sy, sum(w*q*width) AS sxy FROM w GROUP BY frame),
l AS (SELECT frame, n, (s*sxy - sx*sy) / (s*sxx - sx*sx) AS slope, (sxx*sy - sx*sxy) / (s*sxx - sx*sx) AS cut FROM s WHERE n >= 5 AND s*sxx - sx*sx > 1e-12),
f AS (SELECT w.frame, n, slope, cut, width, width - cut - slope * q AS res FROM w JOIN l ON l.frame = w.frame)
SELECT frame, max(n) AS n, round(max(slope) / 2, 6) AS strain, round(CASE WHEN max(cut) > 0 THEN 2 * pi() * 9e-1 / max(cut) END, 4) AS size, round(1 - sum(res*res) / (sum(width*width) - sum(width) * avg(width)), 6) AS r2 FROM f GROUP BY frame""", "v_peaks")
def williamson_hall(spark: SparkSession, sf: str) -> DataFrame:
    own = O.good_peaks(view(spark, sf, "v_peaks")).select(F.col("k2").alias("frame"), F.col("center").alias("q"), F.col("fwhm").alias("width"), F.expr("CASE WHEN peak % 3 = 0 THEN NULL ELSE center_err END").alias("sigma"))
    return O.williamson_hall(own).select("frame", "n", *_r("strain"), *_r("size", n=4), *_r("r2"))


@query("""WITH p AS (SELECT center AS q, fwhm AS w FROM v_peaks WHERE flag = 0 AND fwhm > 0), s AS (SELECT count(*) AS n, max(q) - min(q) AS span, median(w) AS mid FROM p)
SELECT n, 'median' AS kind, round(mid * mid, 9) AS c0, CAST(NULL AS DOUBLE) AS c1, CAST(NULL AS DOUBLE) AS c2 FROM s WHERE span < 4e-1 * 50""", "v_peaks")
def fit_resolution_median(spark: SparkSession, sf: str) -> DataFrame:
    own = O.good_peaks(view(spark, sf, "v_peaks")).selectExpr("center AS q", "fwhm AS width")
    return O.fit_resolution(own, 50.0).select("n", "kind", *_r("c0", "c1", "c2", n=9))


@query("""WITH p AS (SELECT center AS q, (1e-2 + 1e-3 * center + 2e-3 * center * center) * (1 + 1e-2 * (peak - 3)) AS y FROM v_peaks WHERE flag = 0),
s AS (SELECT count(*) AS n, sum(1e0) AS a, sum(q) AS b, sum(q*q) AS c, sum(q*q*q) AS d, sum(q*q*q*q) AS e, sum(y) AS t0, sum(q*y) AS t1, sum(q*q*y) AS t2 FROM p),
w AS (SELECT *, a*(c*e-d*d) - b*(b*e-d*c) + c*(b*d-c*c) AS det FROM s)
SELECT n, 'curve' AS kind, round((t0*(c*e-d*d) - b*(t1*e-d*t2) + c*(t1*d-c*t2)) / det, 6) AS c0, round((a*(t1*e-d*t2) - t0*(b*e-d*c) + c*(b*t2-t1*c)) / det, 6) AS c1, round((a*(c*t2-t1*d) - b*(b*t2-t1*c) + t0*(b*d-c*c)) / det, 6) AS c2 FROM w""", "v_peaks")
def fit_resolution(spark: SparkSession, sf: str) -> DataFrame:
    own = O.good_peaks(view(spark, sf, "v_peaks")).selectExpr("center AS q", "sqrt((1e-2 + 1e-3 * center + 2e-3 * center * center) * (1 + 1e-2 * (peak - 3))) AS width")
    return O.fit_resolution(own, 6.0).select("n", "kind", *_r("c0", "c1", "c2"))


@query("""WITH p AS (SELECT k2 AS frame, center, fwhm, frame * 1000000 + k1 * 10 + peak AS id FROM v_peaks WHERE flag = 0), w AS (SELECT *, center - fwhm / 10 AS lo, center + fwhm / 10 AS hi FROM p),
r AS (SELECT *, max(hi) OVER (PARTITION BY frame ORDER BY center, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
SELECT frame, id, CAST(sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY center, id ROWS UNBOUNDED PRECEDING) AS INT) AS grp FROM r""", "v_peaks")
def peak_groups(spark: SparkSession, sf: str) -> DataFrame:
    own = O.good_peaks(view(spark, sf, "v_peaks")).selectExpr("k2 AS frame", "center", "fwhm", "frame * 1000000 + k1 * 10 + peak AS id")
    return O.peak_groups(own, k=0.1).select("frame", "id", F.col("group").alias("grp"))


@query()
def split_peak_groups(spark: SparkSession, sf: str) -> DataFrame:
    own = O.good_peaks(view(spark, sf, "v_peaks")).selectExpr("k2 AS frame", "center", "fwhm", "frame * 1000000 + k1 * 10 + peak AS id")
    return O.split_groups(O.peak_groups(own, k=0.5)).groupBy("frame", "group", "part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT frame, peak, k1, k2, CASE WHEN fwhm < 2 * 15e-3 THEN flag | 8 ELSE flag END AS flag FROM v_peaks", "v_peaks")
def sub_resolution_flag(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_peaks").select("frame", "peak", "k1", "k2", O.sub_resolution(F.col("flag"), F.col("fwhm"), 0.015).alias("flag"))


@query("SELECT frame, peak, k1, k2, CASE WHEN flag <> 0 THEN 'reject' WHEN peak = 2 OR eta > 5e-1 THEN 'position' ELSE 'quantitative' END AS tier FROM v_peaks", "v_peaks")
def quality_tier(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_peaks").select("frame", "peak", "k1", "k2", C.quality_tier(F.col("flag"), F.expr("CASE WHEN peak <> 2 THEN eta END"), 0.5).alias("tier"))


@query("SELECT frame, phase FROM v_identify WHERE confidence > 3e-1 AND n_matched >= 3", "v_identify")
def seen_gate(spark: SparkSession, sf: str) -> DataFrame:
    return O.seen_gate(view(spark, sf, "v_identify")).select("frame", "phase")


@query("""WITH l AS (SELECT DISTINCT i.frame, phase, center * (1 + pressure * 1e-3) AS center FROM (SELECT DISTINCT k2 AS frame, center FROM v_peaks WHERE flag = 0) p JOIN v_identify i ON i.frame = p.frame),
h AS (SELECT b.frame, phase, sum(mean) AS total FROM v_bins b JOIN l ON l.frame = b.frame AND abs(radial - center) <= 3e-2 * center GROUP BY 1, 2)
SELECT frame, phase, round(total, 4) AS total, round(total / max(total) OVER (PARTITION BY phase), 6) AS relative FROM h""", "v_peaks", "v_bins", "v_identify")
def phase_layers(spark: SparkSession, sf: str) -> DataFrame:
    centres = O.good_peaks(view(spark, sf, "v_peaks")).selectExpr("k2 AS frame", "center").distinct()
    lines = centres.join(view(spark, sf, "v_identify"), "frame").selectExpr("frame", "phase", "center * (1 + pressure * 1e-3) AS center").distinct()
    bins = view(spark, sf, "v_bins").selectExpr("frame", "radial", "mean AS y")
    return O.roi_layers(bins, lines, 0.03).select("frame", "phase", *_r("total", n=4), *_r("relative"))


@query("""WITH s AS (SELECT frame, sum(robust) AS total, max(robust) AS top, sum(greatest(mean - robust, 0)) AS contamination FROM v_bins WHERE radial BETWEEN 2 AND 5 GROUP BY frame), n AS (SELECT frame, count(*) AS n FROM v_peaks WHERE flag = 0 GROUP BY frame)
SELECT f.frame, pressure, temperature, round(total, 4) AS total, round(top, 4) AS top, round(contamination, 4) AS contamination, coalesce(n, 0) AS n_peaks FROM v_frames f LEFT JOIN s ON s.frame = f.frame LEFT JOIN n ON n.frame = f.frame""", "v_bins", "v_frames", "v_peaks")
def frame_values(spark: SparkSession, sf: str) -> DataFrame:
    out = O.frame_values(view(spark, sf, "v_bins"), view(spark, sf, "v_peaks"), view(spark, sf, "v_frames"), 2.0, 5.0)
    return out.select("frame", "pressure", "temperature", *_r("total", "top", "contamination", n=4), "n_peaks")


@query("SELECT count(*) AS n_peaks, count(*) FILTER (flag = 0) AS n_good, count(*) FILTER (flag <> 0) AS n_flagged, count(*) FILTER (flag = 0 AND phase = '') AS n_unexplained, count(DISTINCT frame) AS n_frames, round(count(*) / count(DISTINCT frame), 6) AS per_frame FROM v_peaks", "v_peaks")
def analysis_health(spark: SparkSession, sf: str) -> DataFrame:
    return O.analysis_health(view(spark, sf, "v_peaks")).withColumn("per_frame", F.round("per_frame", 6))


@query("SELECT frame, peak, k1, k2, round(center, 6) AS center, CAST(row_number() OVER (PARTITION BY frame ORDER BY center, peak, k1, k2) AS INT) AS n FROM v_peaks", "v_peaks")
def peak_order(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("frame").orderBy("center", "peak", "k1", "k2"))
    return view(spark, sf, "v_peaks").select("frame", "peak", "k1", "k2", *_r("center"), n.alias("n"))


_SCORES = """e AS (SELECT frame, scan, bin, mean FROM v_bins JOIN v_frames USING (frame)), c AS (SELECT scan AS phase, bin, avg(mean) AS m FROM e GROUP BY 1, 2),
s AS (SELECT frame, scan AS truth, phase, round(sum(mean * m) / sqrt(sum(mean * mean) * sum(m * m)), 9) AS score FROM e JOIN c USING (bin) GROUP BY 1, 2, 3)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """frame, truth, phase, score: cosine of each frame's pattern with the mean pattern of each label."""
    own = view(spark, sf, "v_bins").join(view(spark, sf, "v_frames").select("frame", "scan"), "frame").select("frame", "scan", "bin", "mean")
    centres = own.groupBy(F.col("scan").alias("phase"), "bin").agg(F.avg("mean").alias("m"))
    cosine = F.sum(F.col("mean") * F.col("m")) / F.sqrt(F.sum(F.col("mean") * F.col("mean")) * F.sum(F.col("m") * F.col("m")))
    return own.join(centres, "bin").groupBy("frame", F.col("scan").alias("truth"), "phase").agg(F.round(cosine, 9).alias("score"))


@query(f"WITH {_SCORES} SELECT frame, phase, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, phase) AS rank FROM s) WHERE rank <= 3", "v_bins", "v_frames")
def topk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return O.top_candidates(scores(spark, sf), 3).select("frame", "phase", "score", "rank")


@query(f"WITH {_SCORES} SELECT DISTINCT phase FROM (SELECT frame, phase, row_number() OVER (PARTITION BY frame ORDER BY score DESC, phase) AS rank FROM s) r JOIN v_frames f USING (frame) WHERE rank <= 2 AND NOT excluded", "v_bins", "v_frames")
def shortlist(spark: SparkSession, sf: str) -> DataFrame:
    return O.shortlist(O.top_candidates(scores(spark, sf), 2), view(spark, sf, "v_frames"))


@query(f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, phase) AS rank FROM s), h AS (SELECT frame, min(rank) FILTER (truth = phase) AS rank, max(score) AS top FROM r GROUP BY frame)
SELECT count(*) AS n, round(avg((rank = 1)::INT), 6) AS hit1, round(avg((rank <= 5)::INT), 6) AS hitk, round(avg(1 / rank), 6) AS mrr, round(avg((rank = 1)::INT) FILTER (top > 3e-1), 6) AS confident_hit FROM h""", "v_bins", "v_frames")
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    own = scores(spark, sf)
    truth = own.select("frame", F.col("truth").alias("phase")).distinct()
    return O.scorecard(own, truth).select("n", *_r("hit1", "hitk", "mrr", "confident_hit"))


@query(f"""WITH {_SCORES}, k AS (SELECT truth = phase AS t, row_number() OVER (ORDER BY score, frame * 100 + phase) AS r FROM s), a AS (SELECT sum(r) FILTER (t) AS r, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM k)
SELECT p, n, round((r - p * (p + 1) / 2) / (p * n), 6) AS auc FROM a""", "v_bins", "v_frames")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    own = scores(spark, sf).select((F.col("frame") * 100 + F.col("phase")).alias("id"), "score", (F.col("truth") == F.col("phase")).alias("truth"))
    return O.roc_auc(own).select("p", "n", *_r("auc"))


@query("""WITH m AS (SELECT grp AS cluster, frame, count(*) AS n FROM v_obs GROUP BY 1, 2), r AS (SELECT cluster, frame AS ref_frame FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, frame) = 1),
p AS (SELECT grp AS cluster, string_agg(printf('%.4f', 2 * pi() / center), ';' ORDER BY center DESC) AS fingerprint FROM v_obs JOIN r ON cluster = grp AND frame = ref_frame GROUP BY 1)
SELECT grp AS cluster, count(*) AS n_obs, count(DISTINCT frame) AS n_frames, min(frame) AS first, max(frame) AS last, round(min(center), 6) AS c_min, round(max(center), 6) AS c_max, round(sum(amplitude), 4) AS amplitude, any_value(ref_frame) AS ref_frame, any_value(fingerprint) AS fingerprint
FROM v_obs JOIN r ON r.cluster = grp JOIN p ON p.cluster = grp GROUP BY grp""", "v_obs")
def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_obs").withColumnRenamed("grp", "cluster")
    return O.cluster_summary(own).select("cluster", "n_obs", "n_frames", "first", "last", *_r("c_min", "c_max"), *_r("amplitude", n=4), "ref_frame", "fingerprint")


@query("""SELECT frame, peak, k1, k2, round(2 * pi() / center, 6) AS d, round(0.1e0 * center, 6) AS back, round(CASE WHEN center_err > 0 THEN 2 * pi() * center_err / (center * center) END, 9) AS d_err,
round(degrees(2 * asin(least(1e0, greatest(-1e0, 413e-3 * center / (4 * pi()))))), 6) AS two_theta FROM v_peaks""", "v_peaks")
def radial_to_d(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("center")
    d = C.radial_to_d(q, "q_A^-1")
    two_theta = C.d_to_radial(d, "2th_deg", 0.413)
    back = C.radial_to_d(two_theta, "2th_deg", 0.413)
    return view(spark, sf, "v_peaks").select("frame", "peak", "k1", "k2", F.round(d, 6).alias("d"), F.round(0.1 * C.d_to_radial(back, "q_A^-1"), 6).alias("back"), F.round(C.d_error(q, F.col("center_err")), 9).alias("d_err"), F.round(two_theta, 6).alias("two_theta"))


@query(r"""SELECT p_partkey AS id, list_transform(regexp_extract_all('(' || (p_size % 7 - 3) || ' ' || (p_partkey % 5) || '-' || (p_size % 4) || ')', '-?\d+'), lambda x: x::INT) AS hkl FROM part""")
def parse_hkl(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("("), F.col("p_size") % 7 - 3, F.lit(" "), F.col("p_partkey") % 5, F.lit("-"), F.col("p_size") % 4, F.lit(")"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.parse_hkl(label).alias("hkl"))


@query("""SELECT frame, phase, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END * least(1e0, n_matched / 3) * prior_penalty * (1 - 3e-1 * (1 - precision)), 9) AS conf,
round(greatest(CASE WHEN recall > 5e-1 THEN 3 * recall ELSE 5e0 END, 3e-1), 9) AS half_window FROM v_identify""", "v_identify")
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    c = C.confidence(F.col("recall"), F.col("precision"), F.col("n_matched"), F.col("prior_penalty"), F.col("precision"))
    return view(spark, sf, "v_identify").select("frame", "phase", F.round(c, 9).alias("conf"), F.round(C.pressure_half_window(F.expr("CASE WHEN recall > 5e-1 THEN recall END")), 9).alias("half_window"))


@query("""SELECT frame, peak, k1, k2, round(sqrt(greatest(1e-4 * center * center - 2e-4 * center + 5e-4, 1e-8)), 9) AS width, round(CASE WHEN fwhm * fwhm > 1e-3 THEN sqrt(fwhm * fwhm - 1e-3) END, 9) AS own_width FROM v_peaks""", "v_peaks")
def resolution(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_peaks").select("frame", "peak", "k1", "k2", F.round(C.resolution_width(F.col("center"), 1e-4, -2e-4, 5e-4), 9).alias("width"), F.round(O.deconvolved(F.col("fwhm"), F.lit(1e-3**0.5)), 9).alias("own_width"))
