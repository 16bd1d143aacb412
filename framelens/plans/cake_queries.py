"""Queries over pixels and cakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators import cakes as O
from framelens.plans.catalog import query
from framelens.plans.views import table, view

GEOMETRY = {"centre_row": 99.5, "centre_col": 99.5, "pixel": 0.2, "distance": 100.0, "wavelength": 0.413}
STEP = 0.2


def _r(*names: str, n: int = 6) -> list:
    return [F.round(x, n).alias(x) for x in names]


_GEO = """g AS (SELECT frame, row, col, value, 4 * pi() / 413e-3 * sin(atan(sqrt(pow((row - 995e-1) * 2e-1, 2) + pow((col - 995e-1) * 2e-1, 2)) / 100) / 2) AS q, degrees(atan2(row - 995e-1, col - 995e-1)) AS azimuth FROM v_pixels),
b AS (SELECT *, CAST(floor(q / 2e-1) AS INT) AS bin FROM g)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return O.with_geometry(view(spark, sf, "v_pixels"), **GEOMETRY)


@query(f"WITH {_GEO} SELECT frame, row, col, round(q, 6) AS q, round(azimuth, 6) AS azimuth FROM b", "v_pixels")
def pixel_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("frame", "row", "col", *_r("q", "azimuth"))


@query("SELECT frame, row, col, value, CASE WHEN row % 9 = 0 THEN NULL ELSE value - 2 END <= 0 OR row % 9 = 0 OR value - 2 >= 46 AS masked FROM v_pixels", "v_pixels")
def auto_mask(spark: SparkSession, sf: str) -> DataFrame:
    v = F.expr("CASE WHEN row % 9 = 0 THEN NULL ELSE value - 2 END")
    return view(spark, sf, "v_pixels").select("frame", "row", "col", "value", O.auto_mask(v, 46.0).alias("masked"))


@query("""SELECT frame, row, col, (CAST((row < 20) <> (row < 150) AND col < 30 + (row - 20) * 100 / 130e0 AS INT) + CAST((row < 150) <> (row < 90) AND col < 130 + (row - 150) * 50 / -60e0 AS INT) + CAST((row < 90) <> (row < 20) AND col < 180 + (row - 90) * -150 / -70e0 AS INT)) % 2 = 1 AS inside FROM v_pixels""", "v_pixels")
def polygon_mask(spark: SparkSession, sf: str) -> DataFrame:
    return O.polygon_mask(view(spark, sf, "v_pixels"), [(20.0, 30.0), (150.0, 130.0), (90.0, 180.0)]).select("frame", "row", "col", "inside")


@query(f"WITH {_GEO} SELECT frame, bin, round(avg(value), 6) AS mean, count(*) AS n FROM b GROUP BY 1, 2", "v_pixels")
def azimuthal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return O.azimuthal_mean(pixels(spark, sf), STEP).select("frame", "bin", *_r("mean"), "n")


@query(f"WITH {_GEO} SELECT frame, bin, round(avg(value), 6) AS mean, count(*) AS n FROM b WHERE azimuth BETWEEN -45 AND 60 GROUP BY 1, 2", "v_pixels")
def azimuth_sector(spark: SparkSession, sf: str) -> DataFrame:
    return O.azimuthal_mean(pixels(spark, sf), STEP, (-45.0, 60.0)).select("frame", "bin", *_r("mean"), "n")


@query(f"WITH {_GEO}, k AS (SELECT frame, bin, quantile_cont(value, 45e-2) AS lo, quantile_cont(value, 55e-2) AS hi FROM b GROUP BY 1, 2) SELECT frame, bin, round(coalesce(avg(value) FILTER (value BETWEEN lo AND hi), (max(lo) + max(hi)) / 2), 6) AS robust FROM b JOIN k USING (frame, bin) GROUP BY 1, 2", "v_pixels")
def robust_band(spark: SparkSession, sf: str) -> DataFrame:
    return O.robust_band(pixels(spark, sf), STEP).select("frame", "bin", *_r("robust"))


@query(f"""WITH {_GEO}, a AS (SELECT frame, bin, avg(value) AS m, stddev_pop(value) AS s FROM b GROUP BY 1, 2), c AS (SELECT b.* FROM b JOIN a USING (frame, bin) WHERE abs(value - m) <= 15e-1 * s + 1e-12), d AS (SELECT frame, bin, avg(value) AS m, stddev_pop(value) AS s FROM c GROUP BY 1, 2)
SELECT b.frame, b.bin, round(avg(value), 6) AS sigmaclip, count(*) AS n FROM b JOIN d USING (frame, bin) WHERE abs(value - m) <= 15e-1 * s + 1e-12 GROUP BY 1, 2""", "v_pixels")
def sigmaclip_mean(spark: SparkSession, sf: str) -> DataFrame:
    return O.sigmaclip_mean(pixels(spark, sf), STEP, k=1.5, rounds=3).select("frame", "bin", *_r("sigmaclip"), "n")


@query(f"WITH {_GEO} SELECT frame, CAST(least(35, floor((azimuth + 180) * 36 / 360)) AS INT) AS az_bin, bin AS rad_bin, round(avg(value), 6) AS value FROM b GROUP BY 1, 2, 3", "v_pixels")
def cake(spark: SparkSession, sf: str) -> DataFrame:
    return O.cake(pixels(spark, sf), STEP, 36).select("frame", "az_bin", "rad_bin", *_r("value"))


@query("SELECT frame, az_bin, rad_bin, round(value - median(value) OVER (PARTITION BY frame, rad_bin), 6) AS excess FROM v_cakes", "v_cakes")
def export_ring_removed(spark: SparkSession, sf: str) -> DataFrame:
    return O.excess(view(spark, sf, "v_cakes")).select("frame", "az_bin", "rad_bin", *_r("excess"))


@query("SELECT frame, rad_bin, round(count(*) FILTER (value - 5 > 0) / 36 * 360, 6) AS degrees FROM v_cakes GROUP BY 1, 2", "v_cakes")
def coverage_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return O.coverage_degrees(view(spark, sf, "v_cakes").withColumn("value", F.col("value") - 5), 36).select("frame", "rad_bin", *_r("degrees"))


@query("""WITH c AS (SELECT frame, rad_bin, count(*) FILTER (value - 5 > 0) / 36 * 360 AS d FROM v_cakes GROUP BY 1, 2) SELECT b.frame, bin, round(CASE WHEN d >= 50e-2 * 360 THEN mean END, 6) AS y FROM v_bins b LEFT JOIN c ON c.frame = b.frame AND rad_bin = bin""", "v_cakes", "v_bins")
def coverage_mask(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern is null where the azimuthal coverage is below half of the circle."""
    own = O.coverage_degrees(view(spark, sf, "v_cakes").withColumn("value", F.col("value") - 5), 36).withColumnRenamed("rad_bin", "bin")
    return view(spark, sf, "v_bins").join(own, ["frame", "bin"], "left").select("frame", "bin", F.round(F.when(F.col("degrees") >= 180, F.col("mean")), 6).alias("y"))


_RINGS = "rings(ring, lo, hi) AS (VALUES (0, 5, 9), (1, 20, 26), (2, 40, 47))"


def rings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 5, 9), (1, 20, 26), (2, 40, 47)], "ring int, lo int, hi int")


_TEX = f"""{_RINGS}, o AS (SELECT frame, ring, az_bin, avg(value) AS v, max(azimuth) AS az FROM v_cakes JOIN rings ON rad_bin BETWEEN lo AND hi GROUP BY 1, 2, 3), m AS (SELECT *, median(v) OVER (PARTITION BY frame, ring) AS md, cos(2 * radians(az)) AS c, sin(2 * radians(az)) AS s FROM o),
t AS (SELECT frame, ring, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, count(*) FILTER (v > 3 * md) AS bright, sum(c) AS sc, sum(s) AS ss, sum(c*c) AS scc, sum(s*s) AS sss, sum(c*s) AS scs, sum(v) AS sv, sum(v*c) AS svc, sum(v*s) AS svs FROM m GROUP BY 1, 2),
w AS (SELECT *, n*(scc*sss-scs*scs) - sc*(sc*sss-scs*ss) + ss*(sc*scs-scc*ss) AS det FROM t),
p AS (SELECT *, (n*(svc*sss-scs*svs) - sv*(sc*sss-scs*ss) + ss*(sc*svs-svc*ss)) / det AS p, (n*(scc*svs-svc*scs) - sc*(sc*svs-svc*ss) + sv*(sc*scs-scc*ss)) / det AS q FROM w WHERE abs(det) > 1e-9),
x AS (SELECT t.frame, t.ring, t.n / 36 AS coverage, t.std / t.mean AS index, t.bright / t.n AS spotty, sqrt(p*p + q*q) / p.mean AS amplitude FROM t LEFT JOIN p ON p.frame = t.frame AND p.ring = t.ring)"""


@query(f"WITH {_TEX} SELECT frame, ring, round(coverage, 6) AS coverage, round(index, 6) AS index, round(spotty, 6) AS spotty, round(amplitude, 5) AS amplitude FROM x", "v_cakes")
def texture_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return O.texture_metrics(view(spark, sf, "v_cakes"), rings(spark), 36).select("frame", "ring", *_r("coverage", "index", "spotty"), F.round("amplitude", 5).alias("amplitude"))


@query(f"WITH {_TEX} SELECT ring, round(median(coverage), 6) AS coverage, round(median(index), 6) AS index, round(median(spotty), 6) AS spotty, round(median(amplitude), 5) AS amplitude FROM x GROUP BY ring", "v_cakes")
def ring_medians(spark: SparkSession, sf: str) -> DataFrame:
    own = O.ring_medians(O.texture_metrics(view(spark, sf, "v_cakes"), rings(spark), 36))
    return own.select("ring", *_r("coverage", "index", "spotty"), F.round("amplitude", 5).alias("amplitude"))


@query(f"""WITH {_RINGS}, o AS (SELECT c.*, ring, median(value) OVER (PARTITION BY frame, ring, az_bin) AS m FROM v_cakes c JOIN rings ON rad_bin BETWEEN lo AND hi), s AS (SELECT frame, ring, az_bin, max(greatest(value - m, 0)) AS top, median(abs(value - m)) AS mad, sum(greatest(value - m, 0)) AS w, sum(greatest(value - m, 0) * radial) AS wx FROM o GROUP BY 1, 2, 3)
SELECT frame, ring, az_bin, round(CASE WHEN top >= 15e-1 * mad AND w > 0 THEN wx / w END, 6) AS centroid FROM s""", "v_cakes")
def ring_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return O.ring_centroids(view(spark, sf, "v_cakes"), rings(spark), 1.5).select("frame", "ring", "az_bin", *_r("centroid"))


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    return O.waviness_fit(O.ring_centroids(view(spark, sf, "v_cakes"), rings(spark), 1.5))


@query()
def waviness_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fits(spark, sf).select("frame", "ring", "n", *_r("r0", "a1", "a2", "rms", n=5))


@query()
def waviness_report(spark: SparkSession, sf: str) -> DataFrame:
    return O.waviness_report(_fits(spark, sf), 0.1).select(*_r("a1", "a2", "splitting", n=5), "warn")


@query()
def straighten(spark: SparkSession, sf: str) -> DataFrame:
    return O.straighten(view(spark, sf, "v_cakes"), _fits(spark, sf), 0.1).select("frame", "bin", *_r("mean", "median", n=4))


@query()
def pick_rings(spark: SparkSession, sf: str) -> DataFrame:
    return O.pick_rings(view(spark, sf, "v_bins"), "mean", 6, 3, 1.0)


@query("""WITH RECURSIVE __views__, e AS (SELECT *, value - median(value) OVER (PARTITION BY frame, rad_bin) AS e, count(*) OVER (PARTITION BY frame, rad_bin) AS n FROM v_cakes), m AS (SELECT *, median(abs(e)) OVER (PARTITION BY frame, rad_bin) AS mad FROM e WHERE n >= 30),
h AS (SELECT *, (frame * 4096 + az_bin) * 65536 + rad_bin AS node FROM m WHERE e >= greatest(3 * 14826e-4 * mad, 8)),
ed AS (SELECT a.node AS a, b.node AS b FROM h a JOIN h b ON a.frame = b.frame AND abs(a.rad_bin - b.rad_bin) <= 1 AND ((a.az_bin - b.az_bin + 36) % 36 IN (0, 1, 35)) AND a.node <> b.node),
cc(node, root) AS (SELECT node, node FROM h UNION SELECT ed.b, cc.root FROM cc JOIN ed ON ed.a = cc.node WHERE cc.root < ed.b), lab AS (SELECT node, min(root) AS spot FROM cc GROUP BY node)
SELECT frame, spot, count(*) AS n_pixels, round(sum(e), 4) AS intensity, round(sum(e * radial) / sum(e), 6) AS q FROM h JOIN lab USING (node) GROUP BY 1, 2""")
def detect_spots(spark: SparkSession, sf: str) -> DataFrame:
    return O.detect_spots(view(spark, sf, "v_cakes"), 36, 3.0, 8.0).select("frame", "spot", "n_pixels", F.round("intensity", 4).alias("intensity"), *_r("q"))


def _inline_views() -> None:
    from framelens.plans.catalog import ORACLE_SQL
    from framelens.plans.views import with_views

    body = with_views("SELECT 1", "v_cakes").removeprefix("WITH ").removesuffix("SELECT 1").strip()
    ORACLE_SQL["detect_spots"] = ORACLE_SQL["detect_spots"].replace("__views__", body)


_inline_views()


@query("""WITH p AS (SELECT frame % 3 AS pressure, row, col, sum(value) AS value, count(*) AS members FROM v_pixels GROUP BY 1, 2, 3 HAVING min(value - 3) >= 0), g AS (SELECT *, 4 * pi() / 413e-3 * sin(atan(sqrt(pow((row - 995e-1) * 2e-1, 2) + pow((col - 995e-1) * 2e-1, 2)) / 100) / 2) AS q FROM p)
SELECT pressure, CAST(floor(q / 2e-1) AS INT) AS bin, round(avg(value - 3 * members), 6) AS mean, round(sqrt(sum(value - 3 * members)) / count(*), 6) AS esd, count(*) AS n FROM g GROUP BY 1, 2""", "v_pixels")
def export_raw_by_pressure(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_pixels").select((F.col("frame") % 3).alias("pressure"), "row", "col", (F.col("value") - 3).alias("value"))
    return O.poisson_bins(O.with_geometry(O.summed_by_pressure(own), **GEOMETRY), STEP).select("pressure", "bin", *_r("mean", "esd"), "n")


@query(f"""WITH {_GEO}, a AS (SELECT frame, bin, avg(value) AS m FROM b WHERE row % 9 <> 0 GROUP BY 1, 2), c AS (SELECT frame, bin, avg(value) AS m FROM b GROUP BY 1, 2), x AS (SELECT frame, bin, m / max(m) OVER (PARTITION BY frame) AS m FROM a), y AS (SELECT frame, bin, m / max(m) OVER (PARTITION BY frame) AS m FROM c)
SELECT coalesce(x.frame, y.frame) AS frame, coalesce(x.bin, y.bin) AS bin, round(x.m, 6) AS masked, round(y.m, 6) AS unmasked, round(x.m - y.m, 6) AS difference FROM x FULL JOIN y ON x.frame = y.frame AND x.bin = y.bin""", "v_pixels")
def integrate_pair_diff(spark: SparkSession, sf: str) -> DataFrame:
    own = pixels(spark, sf)
    out = O.pair_difference(O.azimuthal_mean(own.filter("row % 9 <> 0"), STEP), O.azimuthal_mean(own, STEP))
    return out.select("frame", "bin", *_r("masked", "unmasked", "difference"))


@query("SELECT frame, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(quantile_cont(value, 5e-1), 6) AS p50, round(quantile_cont(value, 99e-2), 6) AS p99, round(count(*) FILTER (value = 1) / count(*), 6) AS floor_share FROM v_pixels GROUP BY frame", "v_pixels")
def image_stats(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_pixels").groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.99)).alias("p99"), (F.count_if(F.col("value") == 1) / F.count(F.lit(1))).alias("floor_share"),
    )
    return own.select("frame", "n", "lo", "hi", *_r("mean", "p50", "p99", "floor_share"))


_SPOTS = "s AS (SELECT DISTINCT frame % 10 AS frame, round(1 + (id % 17) * 1e-1, 6) AS sq, (id % 36) * 10 - 180 AS sa FROM v_obs)"


def _spots(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_obs").selectExpr("frame % 10 AS frame", "round(1 + (id % 17) * 1e-1, 6) AS q", "(id % 36) * 10 - 180 AS azimuth")


@query(f"WITH {_GEO}, {_SPOTS} SELECT DISTINCT b.frame, row, col FROM b WHERE EXISTS (SELECT 1 FROM s WHERE s.frame = b.frame AND abs(q - sq) <= 5e-2 AND least(abs(azimuth - sa), 360 - abs(azimuth - sa)) <= 3)", "v_pixels", "v_obs")
def export_spot_masks(spark: SparkSession, sf: str) -> DataFrame:
    return O.spot_mask(pixels(spark, sf), _spots(spark, sf), 0.05, 3.0).select("frame", "row", "col").distinct()


@query(f"""WITH {_GEO}, {_SPOTS}, k AS (SELECT DISTINCT b.frame, row, col FROM b WHERE EXISTS (SELECT 1 FROM s WHERE s.frame = b.frame AND abs(q - sq) <= 5e-2 AND least(abs(azimuth - sa), 360 - abs(azimuth - sa)) <= 3))
SELECT b.frame, bin, round(avg(value), 6) AS mean, count(*) AS n FROM b ANTI JOIN k ON k.frame = b.frame AND k.row = b.row AND k.col = b.col GROUP BY 1, 2""", "v_pixels", "v_obs")
def reintegrate_masked(spark: SparkSession, sf: str) -> DataFrame:
    own = pixels(spark, sf)
    mask = O.spot_mask(own, _spots(spark, sf), 0.05, 3.0).select("frame", "row", "col").distinct()
    return O.azimuthal_mean(own.join(mask, ["frame", "row", "col"], "left_anti"), STEP).select("frame", "bin", *_r("mean"), "n")
