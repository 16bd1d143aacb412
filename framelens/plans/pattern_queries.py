"""Queries over patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.functions import columns as C
from framelens.operators import joint_fit as J
from framelens.operators import patterns as O
from framelens.plans.catalog import query
from framelens.plans.views import table, view


def _r(*names: str, n: int = 6) -> list:
    return [F.round(x, n).alias(x) for x in names]


@query("WITH m AS (SELECT frame, median(mean) AS m FROM v_bins GROUP BY frame) SELECT frame, round(14826e-4 * median(abs(mean - m)), 6) AS sigma FROM v_bins JOIN m USING (frame) GROUP BY frame", "v_bins")
def mad_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return O.mad_sigma(view(spark, sf, "v_bins"), "mean").select("frame", *_r("sigma"))


@query("SELECT frame, round(sum(greatest(mean - robust, 0)), 4) AS contamination, sum(greatest(mean - robust, 0)) > 400 AS flagged FROM v_bins GROUP BY frame", "v_bins")
def contamination_score(spark: SparkSession, sf: str) -> DataFrame:
    return O.contamination_score(view(spark, sf, "v_bins")).select("frame", F.round("contamination", 4).alias("contamination"), (F.col("contamination") > 400).alias("flagged"))


@query("""WITH y AS (SELECT frame, robust AS c, mean AS m FROM v_bins), s AS (SELECT frame, median(c) AS mc, median(m) AS mm FROM y GROUP BY 1), d AS (SELECT y.*, mc, mm, median(abs(c - mc)) OVER (PARTITION BY frame) AS dc, median(abs(m - mm)) OVER (PARTITION BY frame) AS dm FROM y JOIN s USING (frame)),
n AS (SELECT frame, count(*) FILTER (c > mc + 2 * dc) AS nc, count(*) FILTER (m > mm + 2 * dm) AS nm FROM d GROUP BY 1)
SELECT count(*) AS n_frames, round(median(nc / nm), 6) AS ratio, coalesce(median(nc / nm) < 5e-1, false) AS spotty FROM n WHERE nm >= 3""", "v_bins")
def diagnose_channels(spark: SparkSession, sf: str) -> DataFrame:
    return O.diagnose_channels(view(spark, sf, "v_bins"), "robust", "mean", k=2.0).select("n_frames", *_r("ratio"), "spotty")


_SNIP = """WITH RECURSIVE {views}, p AS (SELECT frame, list(robust ORDER BY bin) AS y, list(mean ORDER BY bin) AS m, list(sigmaclip ORDER BY bin) AS s FROM v_bins GROUP BY frame),
r AS (SELECT frame, 0 AS k, list_transform(y, lambda v: ln(ln(sqrt(greatest(v, 0) + 1) + 1) + 1)) AS w FROM p
 UNION ALL SELECT frame, k + 1, list_transform(w, lambda v, i: least(v, (w[greatest(i - k - 1, 1)] + w[least(i + k + 1, len(w))]) / 2)) FROM r WHERE k < 12),
b AS (SELECT p.frame, y, m, s, list_transform(list_zip(w, y), lambda x: least(pow(exp(exp(x[1]) - 1) - 1, 2) - 1, x[2])) AS base FROM r JOIN p USING (frame) WHERE k = 12)
SELECT {out} FROM (SELECT frame, generate_subscripts(base, 1) - 1 AS bin, unnest(base) AS base, unnest(y) AS y, unnest(m) AS m, unnest(s) AS s FROM b)"""


def _snip_sql(out: str) -> str:
    from framelens.plans.views import with_views

    views = with_views("SELECT 1", "v_bins").removeprefix("WITH ").removesuffix("SELECT 1").strip()
    return _SNIP.replace("{views}", views).replace("{out}", out)


@query(_snip_sql("frame, CAST(bin AS INT) AS bin, round(base, 6) AS baseline"))
def snip_baseline(spark: SparkSession, sf: str) -> DataFrame:
    own = O.to_patterns(view(spark, sf, "v_bins"), ["robust"]).select("frame", O.snip_baseline(F.col("robust"), 12).alias("b"))
    return own.select("frame", F.posexplode("b").alias("bin", "baseline")).select("frame", "bin", *_r("baseline"))


@query(_snip_sql("frame, round(sum(y - base), 4) AS clean, round(sum(m - y), 4) AS spots, round(sum(s - base), 4) AS sigmaclip_residual, round(sum(greatest(m - y, 0)), 4) AS contamination") + " GROUP BY frame")
def separate_background(spark: SparkSession, sf: str) -> DataFrame:
    own = O.separate_background(view(spark, sf, "v_bins"), 12)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 4).alias(c)
    return own.select("frame", total("clean"), total("spots"), total("sigmaclip_residual"), F.round("contamination", 4).alias("contamination"))


@query("""WITH l AS (SELECT *, min(mean) OVER w AS low FROM v_bins WINDOW w AS (PARTITION BY frame ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT frame, bin, round(max(low) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS opened FROM l""", "v_bins")
def detrend_opening(spark: SparkSession, sf: str) -> DataFrame:
    return O.opening(view(spark, sf, "v_bins"), "mean", 7).select("frame", "bin", *_r("opened"))


@query("""WITH x AS (SELECT frame, bin, greatest(mean - robust - 2, 0) AS e FROM v_bins), l AS (SELECT *, min(e) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS low FROM x)
SELECT frame, bin, round(least(e, max(low) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), 6) AS kept FROM l""", "v_bins")
def winsorize_excess(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_bins").withColumn("e", F.col("mean") - F.col("robust") - 2)
    return O.winsorize_excess(own, "e", 3).select("frame", "bin", *_r("kept"))


@query("""WITH p AS (SELECT bin, median(mean) AS y FROM v_bins GROUP BY bin), n AS (SELECT *, lead(y) OVER (ORDER BY bin) AS nx FROM p), m AS (SELECT median(y) AS m, max(bin) AS last FROM p), s AS (SELECT 14826e-4 * median(abs(y - m)) AS noise FROM p, m),
e AS (SELECT max(last) AS last, min(bin) FILTER (nx >= y) AS up, max(bin) FILTER (y > m + 1 * noise) AS down FROM n, m, s)
SELECT CAST(least(coalesce(up, 0), floor(last * 15e-2)) AS INT) AS lo, CAST(greatest(coalesce(down, last), ceil(last * (1 - 15e-2))) AS INT) AS hi FROM e""", "v_bins")
def auto_fit_range(spark: SparkSession, sf: str) -> DataFrame:
    return O.auto_fit_range(view(spark, sf, "v_bins"), "mean", k=1.0)


_MAX = """m AS (SELECT frame, median(mean) AS m FROM v_bins GROUP BY frame), s AS (SELECT frame, 14826e-4 * median(abs(mean - m)) AS sigma FROM v_bins JOIN m USING (frame) GROUP BY frame),
r AS (SELECT frame, bin, mean AS y, CASE WHEN lag(mean) OVER (PARTITION BY frame ORDER BY bin) = mean THEN 0 ELSE 1 END AS new FROM v_bins), g AS (SELECT *, sum(new) OVER (PARTITION BY frame ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM r),
f AS (SELECT frame, run, min(bin) AS a, max(bin) AS b, max(y) AS y FROM g GROUP BY 1, 2), q AS (SELECT *, lag(y) OVER (PARTITION BY frame ORDER BY run) AS l, lead(y) OVER (PARTITION BY frame ORDER BY run) AS rr FROM f),
mx AS (SELECT frame, CAST(floor((a + b) / 2) AS INT) AS bin, y AS height FROM q JOIN s USING (frame) WHERE l < y AND rr < y AND y >= 8 * sigma)"""


@query(f"WITH {_MAX} SELECT frame, bin, round(height, 6) AS height FROM mx", "v_bins")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins")
    return O.local_maxima(bins, "mean", O.mad_sigma(bins, "mean"), 8.0).select("frame", "bin", *_r("height"))


@query(f"""WITH {_MAX}, w AS (SELECT x.frame, x.bin, height, max(b.bin) FILTER (b.bin < x.bin AND mean > height) AS wl, min(b.bin) FILTER (b.bin > x.bin AND mean > height) AS wr, max(b.bin) FILTER (mean <= height / 2 AND b.bin < x.bin) AS hl, min(b.bin) FILTER (mean <= height / 2 AND b.bin > x.bin) AS hr FROM mx x JOIN v_bins b USING (frame) GROUP BY 1, 2, 3)
SELECT w.frame, w.bin, round(height - greatest(min(mean) FILTER (b.bin <= w.bin AND b.bin > coalesce(wl, -1)), min(mean) FILTER (b.bin >= w.bin AND b.bin < coalesce(wr, 100000))), 6) AS prominence, any_value(hr - hl) AS width FROM w JOIN v_bins b USING (frame) GROUP BY w.frame, w.bin, height""", "v_bins")
def peak_prominence(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins")
    maxima = O.local_maxima(bins, "mean", O.mad_sigma(bins, "mean"), 8.0)
    return O.peak_shapes(bins, maxima, "mean").select("frame", "bin", *_r("prominence"), "width")


_GRID = "grid AS (SELECT g, 12e-1 + g * 17e-2 AS gx FROM range(0, 40) t(g))"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(40).selectExpr("id AS g", "12e-1 + id * 17e-2 AS gx")


@query(f"""WITH {_GRID}, s AS (SELECT frame, radial AS x0, mean AS y0, lead(radial) OVER w AS x1, lead(mean) OVER w AS y1 FROM v_bins WINDOW w AS (PARTITION BY frame ORDER BY radial)), h AS (SELECT frame, g, max(struct_pack(x := x0, v := y0 + (y1 - y0) * (gx - x0) / (x1 - x0))) AS m FROM s JOIN grid ON gx BETWEEN x0 AND x1 WHERE x1 > x0 GROUP BY 1, 2)
SELECT f.frame, grid.g, round(coalesce(m.v, 0), 4) AS value FROM (SELECT DISTINCT frame FROM v_bins) f CROSS JOIN grid LEFT JOIN h ON h.frame = f.frame AND h.g = grid.g""", "v_bins")
def interp_resample(spark: SparkSession, sf: str) -> DataFrame:
    return O.resample(view(spark, sf, "v_bins"), _grid(spark), "radial", "mean", 0.5).select("frame", "g", F.round("value", 4).alias("value"))


@query("SELECT frame, bin, round(greatest(robust - 60, 0) / CASE WHEN max(greatest(robust - 60, 0)) OVER (PARTITION BY frame) > 0 THEN max(greatest(robust - 60, 0)) OVER (PARTITION BY frame) ELSE 1 END, 6) AS y FROM v_bins", "v_bins")
def normalise_rows(spark: SparkSession, sf: str) -> DataFrame:
    own = O.to_patterns(view(spark, sf, "v_bins").withColumn("y", F.col("robust") - 60), ["y"])
    return own.select("frame", F.posexplode(C.normalised(F.col("y"))).alias("bin", "y")).select("frame", "bin", *_r("y"))


@query("WITH a AS (SELECT a.frame, sum(a.mean * b.robust) AS ab, sum(a.mean * a.mean) AS aa, sum(b.robust * b.robust) AS bb FROM v_bins a JOIN v_bins b ON b.frame = a.frame + 1 AND b.bin = a.bin GROUP BY 1) SELECT frame, round(ab / sqrt(aa * bb), 6) AS cosine FROM a", "v_bins")
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    p = O.to_patterns(view(spark, sf, "v_bins"), ["mean", "robust"])
    other = p.select((F.col("frame") - 1).alias("frame"), F.col("robust").alias("next"))
    return p.join(other, "frame").select("frame", F.round(C.cosine(F.col("mean"), F.col("next")), 6).alias("cosine"))


@query(_snip_sql("frame, round(sum(y - base + greatest(m - y, 0)), 4) AS total") + " GROUP BY frame")
def build_fit_source(spark: SparkSession, sf: str) -> DataFrame:
    own = O.fit_source(O.separate_background(view(spark, sf, "v_bins"), 12), "hybrid")
    return own.select("frame", F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("SELECT b.frame, bin, pressure AS x, round(mean - robust, 6) AS y FROM v_bins b JOIN v_frames f ON f.frame = b.frame WHERE pressure IS NOT NULL AND NOT excluded", "v_bins", "v_frames")
def pattern_image(spark: SparkSession, sf: str) -> DataFrame:
    frames = view(spark, sf, "v_frames").filter("pressure IS NOT NULL AND NOT excluded").select("frame", F.col("pressure").alias("x"))
    return view(spark, sf, "v_bins").join(frames, "frame").select("frame", "bin", "x", F.round(F.col("mean") - F.col("robust"), 6).alias("y"))


@query("""WITH b AS (SELECT v.* FROM v_bins v JOIN v_frames f ON f.frame = v.frame WHERE NOT excluded), sm AS (SELECT frame, median(mean) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM b), t AS (SELECT frame, max(s) AS top FROM sm GROUP BY 1),
m AS (SELECT frame, median(mean) AS m FROM b GROUP BY 1), d AS (SELECT frame, 14826e-4 * median(abs(mean - m)) AS sigma FROM b JOIN m USING (frame) GROUP BY 1), k AS (SELECT frame, CASE WHEN sigma > 0 THEN top / sigma ELSE 0 END AS snr, round(pressure, 3) AS pressure_key FROM t JOIN d USING (frame) JOIN v_frames USING (frame))
SELECT frame, round(snr, 6) AS snr, pressure_key FROM k QUALIFY row_number() OVER (PARTITION BY coalesce(CAST(pressure_key AS VARCHAR), 'f' || frame) ORDER BY round(snr, 9) DESC, frame) = 1""", "v_bins", "v_frames")
def best_frame_per_pressure(spark: SparkSession, sf: str) -> DataFrame:
    return O.best_frame_per_pressure(view(spark, sf, "v_bins"), view(spark, sf, "v_frames"), "mean").select("frame", *_r("snr"), "pressure_key")


@query("SELECT frame, bin, radial, bin BETWEEN 2 AND 63 - 2 AND radial BETWEEN 15e-1 AND 6 AS valid FROM v_bins", "v_bins")
def fit_window(spark: SparkSession, sf: str) -> DataFrame:
    return O.fit_window(view(spark, sf, "v_bins"), 2, 1.5, 6.0).select("frame", "bin", "radial", "valid")


@query("SELECT frame, round(sum(mean), 6) AS total, round(max(mean), 6) AS top FROM v_bins WHERE radial BETWEEN 2 AND 4 GROUP BY frame", "v_bins")
def roi_values(spark: SparkSession, sf: str) -> DataFrame:
    """Total and highest value of each frame in a radial window."""
    return O.in_range(view(spark, sf, "v_bins"), "radial", 2.0, 4.0).groupBy("frame").agg(F.round(F.sum("mean"), 6).alias("total"), F.round(F.max("mean"), 6).alias("top"))


#: Patterns whose axes begin and end at different places and lie between each other's points; every eleventh is short.
_OWN_AXES = ["frame", "radial + 1e-2 * (frame % 3) AS x", "mean AS y"]
_OWN_BINS = "bin BETWEEN frame % 5 AND 60 - frame % 3 AND (frame % 11 > 0 OR bin < 15)"


@query(f"""WITH o AS (SELECT {', '.join(_OWN_AXES)} FROM v_bins WHERE {_OWN_BINS}), s AS (SELECT frame, x, y, x - lag(x) OVER w AS dx, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM o WINDOW w AS (PARTITION BY frame ORDER BY x)),
p AS (SELECT frame, min(x) AS lo, max(x) AS hi, median(dx) AS step FROM s GROUP BY frame HAVING count(*) >= 16), a AS (SELECT min(lo) AS lo, max(hi) AS hi, median(step) AS step FROM p),
ax AS (SELECT i AS g, lo + i * step AS gx FROM a, range(0, 1000) t(i) WHERE lo + i * step < hi + step / 2),
v AS (SELECT frame, g, arg_max(y + (y1 - y) * (gx - x) / (x1 - x), x) AS value FROM s JOIN p USING (frame) JOIN ax ON gx BETWEEN x AND x1 GROUP BY 1, 2)
SELECT p.frame, ax.g, round(gx, 6) AS radial, round(value, 6) AS value FROM p CROSS JOIN ax LEFT JOIN v ON v.frame = p.frame AND v.g = ax.g""", "v_bins")
def common_axis_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Many patterns on one axis: union of their ranges, median of their median steps, nothing outside a pattern's own range."""
    own = view(spark, sf, "v_bins").filter(_OWN_BINS).selectExpr(*_OWN_AXES)
    return O.onto_common_axis(own, "x", "y").select("frame", "g", F.round("gx", 6).alias("radial"), *_r("value"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins")
    maxima = O.local_maxima(bins, "mean", O.mad_sigma(bins, "mean"), 8.0)
    return maxima.selectExpr("frame", "bin AS id", "1e0 + 1e-1 * bin AS center", "25e-2 AS fwhm")


@query()
def peak_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Joint fits of all candidates, with the frame's own noise."""
    bins = view(spark, sf, "v_bins")
    out = J.fit_jointly(bins, _candidates(spark, sf), "mean", O.mad_sigma(bins, "mean"))
    return out.select("frame", "id", *_r("height", "center", "fwhm", "eta", "area", "chi2", "chi2_local", "rel_misfit", "center_err", "height_err", "fwhm_err", n=4), "flag", "n_group")


@query()
def peak_fit_alone(spark: SparkSession, sf: str) -> DataFrame:
    """Each candidate alone on a grid of shapes."""
    out = O.fit_peaks(view(spark, sf, "v_bins"), _candidates(spark, sf), "mean", rounds=1)
    return out.select("frame", "id", *_r("height", "center", "fwhm", "eta", "area", n=5), "flag")


@query("""WITH p AS (SELECT frame, 1e0 + 1e-1 * (frame % 50) AS center, 1e1 + frame % 7 AS height FROM (SELECT DISTINCT frame FROM v_bins)), n AS (SELECT b.frame, bin, sum(height * (5e-1 / (1 + 4 * pow((radial - center) / 2e-1, 2)) + 5e-1 * exp(-4 * ln(2) * pow((radial - center) / 2e-1, 2)))) AS model FROM v_bins b JOIN p ON p.frame = b.frame AND radial BETWEEN center - 5 * 2e-1 AND center + 5 * 2e-1 GROUP BY 1, 2)
SELECT b.frame, b.bin, round(mean - coalesce(model, 0), 5) AS residual FROM v_bins b LEFT JOIN n ON n.frame = b.frame AND n.bin = b.bin""", "v_bins")
def subtract_profiles(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins")
    peaks = bins.select("frame").distinct().selectExpr("frame", "1e0 + 1e-1 * (frame % 50) AS center", "1e1 + frame % 7 AS height", "2e-1 AS fwhm", "5e-1 AS eta")
    return O.subtract_profiles(bins, peaks, "mean").select("frame", "bin", F.round("residual", 5).alias("residual"))


@query()
def subtract_and_refit(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins")
    fitted = J.fit_jointly(bins, _candidates(spark, sf), "mean", O.mad_sigma(bins, "mean")).filter("flag < 16 AND height > 0")
    rest = O.subtract_profiles(bins, fitted, "mean")
    maxima = O.local_maxima(rest, "residual", O.mad_sigma(rest, "residual"), 8.0)
    again = maxima.selectExpr("frame", "bin AS id", "1e0 + 1e-1 * bin AS center", "25e-2 AS fwhm")
    kept = J.fit_jointly(rest, again, "residual", O.mad_sigma(rest, "residual")).filter("flag = 0")
    return kept.select("frame", "id", *_r("height", "center", n=4))


@query("SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_totalprice BETWEEN 2e3 AND 3e5")
def roi_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter(F.col("o_totalprice").between(2e3, 3e5)).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
