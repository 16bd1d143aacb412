"""Queries over tracks, libraries, candidates and learning data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators import library as L
from framelens.operators import peaks as P
from framelens.operators import tracks as O
from framelens.plans.catalog import query
from framelens.plans.match_queries import _GRID, grid_lines, recursive
from framelens.plans.peak_queries import _SCORES, scores
from framelens.plans.views import phases, table, view


def _r(*names: str, n: int = 6) -> list:
    return [F.round(x, n).alias(x) for x in names]


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_obs").selectExpr("grp", "id", "frame AS x", "frame", "center", "fwhm", "amplitude")


@query("""WITH g AS (SELECT grp, 15e-1 * max(fwhm) AS gap FROM v_obs GROUP BY 1), n AS (SELECT v.grp, id, CASE WHEN center - lag(center) OVER (PARTITION BY v.grp ORDER BY center, id) > gap THEN 1 ELSE 0 END AS new, center FROM v_obs v JOIN g ON g.grp = v.grp)
SELECT grp, id, CAST(sum(new) OVER (PARTITION BY grp ORDER BY center, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n""", "v_obs")
def track_islands(spark: SparkSession, sf: str) -> DataFrame:
    return O.islands(observations(spark, sf)).select("grp", "id", "island")


@query()
def link_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return O.link_tracks(observations(spark, sf), least=3).select("grp", "island", "track", "id", "x", *_r("center"))


@query()
def link_sloped_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks that follow the slope of their last four points, with at most six samples of the axis between two points."""
    out = O.link_tracks(observations(spark, sf), max_gap=2, least=3, max_axis_gap=6.0, predictor=True)
    return out.select("grp", "island", "track", "id", "x", *_r("center"))


_POINTS = "pts AS (SELECT DISTINCT track, o % 60 + 60 * (track % 7) AS frame FROM (SELECT (l_partkey + l_suppkey) % 13 * 40 + l_suppkey % 40 AS track, l_orderkey AS o FROM lineitem))"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").selectExpr("(l_partkey + l_suppkey) % 13 * 40 + l_suppkey % 40 AS track", "l_orderkey AS o")
    return own.selectExpr("track", "o % 60 + 60 * (track % 7) AS frame").distinct()


@query(f"""WITH RECURSIVE {_POINTS}, n AS (SELECT track, count(*) AS n FROM pts GROUP BY 1), j AS (SELECT a.track AS a, b.track AS b, count(*) AS k FROM pts a JOIN pts b ON a.frame = b.frame AND a.track <> b.track GROUP BY 1, 2),
e AS (SELECT a, b FROM j JOIN n x ON x.track = a JOIN n y ON y.track = b WHERE k / (x.n + y.n - k) >= 6e-1), c(node, root) AS (SELECT track, track FROM n UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b)
SELECT node AS track, min(root) AS cluster FROM c GROUP BY node""")
def cluster_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return O.cluster_tracks(_points(spark, sf), 0.6).select("track", "cluster")


@query()
def run_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks, their clusters and a summary of each cluster."""
    from framelens.operators.shared import stored

    obs = observations(spark, sf)
    # Wide enough for any number of tracks: a dense island has more than a million on large tables.
    name = (F.col("grp") * (1 << 20) + F.col("island")) * (1 << 32) + F.col("track")
    linked = stored(O.link_tracks(obs).select(name.alias("track"), "id", F.col("x").cast("long").alias("frame")))
    clusters = stored(O.cluster_tracks(linked))
    own = linked.join(clusters, "track").join(obs.select("id", "center", "amplitude"), "id")
    return P.cluster_summary(own.select("cluster", "frame", "center", "amplitude")).select("cluster", "n_obs", "n_frames", "first", "last", *_r("amplitude", n=4), "ref_frame", "fingerprint")


def _spots(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_obs").selectExpr("grp", "id", "(frame % 40) * 1e0 AS pressure", "round(1 + (id % 23) * 1e-1 + (id % 7) * 1e-3, 6) AS q", "((id * 7) % 360 - 180) * 1e0 AS azimuth", "amplitude AS intensity")


@query()
def consolidate_spots(spark: SparkSession, sf: str) -> DataFrame:
    return O.consolidate_spots(_spots(spark, sf)).select("grp", "pressure", "spot", *_r("q", "azimuth", "intensity", n=5), "members")


@query()
def link_spot_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return O.link_spot_tracks(O.consolidate_spots(_spots(spark, sf)), q_tol=0.15, azimuth_tol=40.0).select("grp", "track", "pressure", *_r("q", "azimuth", n=5))


@query("""WITH p AS (SELECT grp * 100 + id % 20 AS track, frame, (frame % 40) * 1e0 AS pressure, center AS d, ((id * 7) % 360 - 180) * 1e0 AS azimuth, amplitude AS w FROM v_obs),
s AS (SELECT track, count(*) AS n_points, count(DISTINCT frame) AS n_frames, min(pressure) AS p_min, max(pressure) AS p_max, min(d) AS d_min, max(d) AS d_max, min(struct_pack(p := pressure, f := frame, d := d)).d AS d0, regr_slope(d, pressure) AS slope, sum(w * sin(radians(azimuth))) AS s, sum(w * cos(radians(azimuth))) AS c, sum(w) AS w, max(struct_pack(i := w, n := -frame)).n AS nf FROM p GROUP BY track)
SELECT track, n_points, n_frames, p_min, p_max, round(d_min, 6) AS d_min, round(d_max, 6) AS d_max, round(d0, 6) AS d0, round(slope, 6) AS slope, round(degrees(atan2(s, c)), 4) AS azimuth, round(degrees(sqrt(greatest(0, -2 * ln(least(1, sqrt(s*s + c*c) / w))))), 4) AS spread, -nf AS best_frame FROM s""", "v_obs")
def spot_track_summary(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_obs").selectExpr("grp * 100 + id % 20 AS track", "frame", "(frame % 40) * 1e0 AS pressure", "center AS d", "((id * 7) % 360 - 180) * 1e0 AS azimuth", "amplitude AS intensity")
    return O.spot_track_summary(own).select("track", "n_points", "n_frames", "p_min", "p_max", *_r("d_min", "d_max", "d0", "slope"), *_r("azimuth", "spread", n=4), "best_frame")


@query("WITH s AS (SELECT grp * 100 + id % 20 AS track, round(sum(amplitude), 6) AS amplitude FROM v_obs GROUP BY 1) SELECT track, round(amplitude, 4) AS amplitude, CAST(row_number() OVER (ORDER BY amplitude DESC, track) AS INT) AS place FROM s", "v_obs")
def track_order(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_obs").selectExpr("grp * 100 + id % 20 AS track", "amplitude")
    return O.ordered_tracks(own).select("track", F.round("amplitude", 4).alias("amplitude"), "place")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN -1 ELSE id % 50 END AS track, CASE WHEN id % 3 = 0 OR (id % 50) % 2 = 0 THEN -1 ELSE (id % 50) // 10 END AS cluster FROM v_obs", "v_obs")
def cluster_of_track(spark: SparkSession, sf: str) -> DataFrame:
    obs = view(spark, sf, "v_obs").select("id")
    tracks = obs.filter("id % 3 <> 0").selectExpr("id", "id % 50 AS track")
    clusters = tracks.select("track").distinct().filter("track % 2 <> 0").selectExpr("track", "CAST(floor(track / 10) AS BIGINT) AS cluster")
    return O.labels_of_observations(obs, tracks, clusters)


@query("SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'user' ELSE 'bundled' END AS origin FROM part")
def library_union(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey")).alias("name"), "p_partkey")
    user = own.filter("p_partkey % 3 = 0").select("name", F.lit("user").alias("origin"))
    bundled = own.select("name", F.lit("bundled").alias("origin"))
    return L.library_union(user, bundled)


@query("SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 1000 END, lower(p_name || p_partkey), p_name || p_partkey) AS INT) AS rank FROM part")
def phase_library(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.col("p_partkey")).alias("name"), F.col("p_brand").alias("category"))
    return L.ordered_library(own, ["Brand#3", "Brand#1"]).select("id", "rank")


@query("SELECT p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS k0 FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 2 <> 0)")
def upsert_phase(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").selectExpr("p_partkey AS name", "p_retailprice AS k0")
    changed = L.upsert(own, own.filter("name % 5 = 0").withColumn("k0", F.col("k0") + 1))
    return L.remove(changed, own.filter("name % 2 = 0"), own.filter("name % 7 = 0"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'no lattice' WHEN p_size % 5 = 0 THEN 'no space group' WHEN p_size % 3 = 0 THEN 'no atoms' END AS skipped FROM part")
def structure_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE 4e0 END AS a", "CASE WHEN p_size % 5 = 0 THEN '' ELSE 'Fm-3m' END AS space_group", "CASE WHEN p_size % 3 = 0 THEN array() ELSE array('Au') END AS atoms")
    return L.structure_filter(own).select("id", "skipped")


@query("""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY formula, spacegroup ORDER BY file) AS n FROM __corpus__ WHERE parse_ok AND n_sites <= 200),
w AS (SELECT formula, spacegroup, 0::BIGINT AS n, []::DOUBLE[] AS kept, NULL::BIGINT AS file, false AS dup FROM (SELECT DISTINCT formula, spacegroup FROM c)
 UNION ALL SELECT c.formula, c.spacegroup, c.n, CASE WHEN len(list_filter(kept, lambda k: abs(k - c.volume) <= 5e-3 * k)) > 0 THEN kept ELSE list_append(kept, c.volume) END, c.file, len(list_filter(kept, lambda k: abs(k - c.volume) <= 5e-3 * k)) > 0 FROM w JOIN c ON c.formula = w.formula AND c.spacegroup = w.spacegroup AND c.n = w.n + 1)
SELECT v.file, CASE WHEN NOT parse_ok THEN 'parse' WHEN n_sites > 200 THEN 'sites' WHEN dup THEN 'duplicate' END AS reason FROM __corpus__ v LEFT JOIN w ON w.file = v.file""")
def corpus_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return L.corpus_dedupe(view(spark, sf, "v_corpus"))


def _inline_corpus() -> None:
    from framelens.plans.catalog import ORACLE_SQL
    from framelens.plans.views import VIEWS

    ORACLE_SQL["corpus_dedupe"] = ORACLE_SQL["corpus_dedupe"].replace("__corpus__", f"(SELECT {', '.join(VIEWS['v_corpus'][1])} FROM part)")


_inline_corpus()


@query("SELECT DISTINCT o_custkey % 4000 AS id FROM orders WHERE o_custkey % 4000 NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)")
def pending_downloads(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") % 4000).alias("id")).distinct()
    return wanted.join(table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id")), "id", "left_anti")


_DGRID = "dg AS (SELECT g, 12e-1 + g * 1e-2 AS gx FROM range(0, 300) t(g))"
_FP = f"""{_GRID}, {_DGRID}, raw AS (SELECT phase, pressure, g, sum(weight * exp(-5e-1 * pow((gx - d) / (6e-2 / 23548200450309493e-16), 2))) AS v FROM dg JOIN lines ON gx BETWEEN d - 5 * 6e-2 / 23548200450309493e-16 AND d + 5 * 6e-2 / 23548200450309493e-16 GROUP BY 1, 2, 3), fp AS (SELECT phase, pressure, g, v / max(v) OVER (PARTITION BY phase, pressure) AS v FROM raw)"""


def _prints(spark: SparkSession) -> DataFrame:
    return L.fingerprints(grid_lines(spark, 21), spark.range(300).selectExpr("id AS g", "12e-1 + id * 1e-2 AS gx"), 0.06)


_FEAT = "ft AS (SELECT frame, CAST(floor((2 * pi() / center - 12e-1) / 1e-2) AS BIGINT) AS g, sum(amplitude) AS v FROM v_peaks WHERE flag = 0 AND 2 * pi() / center BETWEEN 12e-1 AND 419e-2 GROUP BY 1, 2)"


def _features(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_peaks").filter("flag = 0").withColumn("d", 2 * F.pi() / F.col("center")).filter("d BETWEEN 12e-1 AND 419e-2")
    return own.groupBy("frame", F.floor((F.col("d") - 1.2) / 0.01).cast("long").alias("g")).agg(F.sum("amplitude").alias("value"))


@recursive(f"WITH {_FP}, {_FEAT} SELECT frame, ft.g, phase, pressure, round(fp.v, 6) AS value FROM ft JOIN fp ON fp.g = ft.g", "v_peaks")
def fingerprint_library(spark: SparkSession, sf: str) -> DataFrame:
    own = _features(spark, sf).select("frame", "g")
    # The library is a parameter of known size: rounded once, then joined where the rows are.
    return own.join(F.broadcast(_prints(spark).select("g", "phase", "pressure", *_r("value"))), "g").select("frame", "g", "phase", "pressure", "value")


@query(f"WITH {_FEAT} SELECT frame, g, round(v / max(v) OVER (PARTITION BY frame), 6) AS value FROM ft", "v_peaks")
def frame_features(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return _features(spark, sf).select("frame", "g", F.round(F.col("value") / F.max("value").over(Window.partitionBy("frame")), 6).alias("value"))


@recursive(f"""WITH {_FP}, {_FEAT}, fn AS (SELECT frame, sqrt(sum(v*v)) AS fn FROM ft GROUP BY 1), pn AS (SELECT phase, pressure, sqrt(sum(v*v)) AS pn FROM fp GROUP BY 1, 2), dt AS (SELECT frame, phase, pressure, sum(ft.v * fp.v) AS dot FROM ft JOIN fp ON fp.g = ft.g GROUP BY 1, 2, 3),
s AS (SELECT frame, phase, max(struct_pack(s := round(dot / (fn * pn), 9), p := -pressure)) AS b FROM dt JOIN fn USING (frame) JOIN pn USING (phase, pressure) GROUP BY 1, 2), r AS (SELECT frame, phase, b.s AS score, abs(b.p) AS pressure, row_number() OVER (PARTITION BY frame ORDER BY b.s DESC, phase) AS rank FROM s)
SELECT frame, phase, round(score, 6) AS score, pressure, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""", "v_peaks")
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return L.rank_candidates(_features(spark, sf), _prints(spark), 3).select("frame", "phase", *_r("score"), "pressure", "rank")


@query()
def rank_then_verify(spark: SparkSession, sf: str) -> DataFrame:
    """The shortlist of the ranking is the candidate set of the identification."""
    from framelens.operators.identify import run_identification
    from framelens.operators.shared import stored
    from framelens.plans.match_queries import observed_once, reflections_of

    ranked = stored(L.rank_candidates(_features(spark, sf), _prints(spark), 1).filter("score > 0.5").select("phase").distinct())
    own = observed_once(spark, sf)
    frames = own.select("frame").distinct().withColumn("excluded", F.lit(False))
    few = phases(spark).join(ranked, F.col("name") == F.col("phase"), "left_semi")
    return run_identification(own, frames, few, reflections_of(spark)).select("frame", "phase", "pressure", *_r("score"), "n_matched", *_r("confidence"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_frames").filter("pressure IS NOT NULL").selectExpr("frame", "scan AS phase", "pressure")


@query()
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    truth = _truth(spark, sf)
    return L.training_pairs(truth, truth.select("phase").distinct())


@query()
def augment_patterns(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "embeddings").selectExpr("vec_id AS sample", "transform(embedding, v -> abs(CAST(v AS DOUBLE))) AS y")
    return L.augment_patterns(own).select("sample", "copy", F.transform("y", lambda v: F.round(v, 6)).alias("y"))


@query()
def pair_scorer(spark: SparkSession, sf: str) -> DataFrame:
    own = scores(spark, sf).select("frame", "phase", "score", (F.col("truth") == F.col("phase")).cast("double").alias("label"))
    from pyspark.sql import Window

    pairs = own.withColumn("lead", F.col("score") - F.max("score").over(Window.partitionBy("frame"))).filter("frame % 2 = 0")
    held = own.withColumn("lead", F.col("score") - F.max("score").over(Window.partitionBy("frame"))).filter("frame % 2 = 1")
    model = L.pair_scorer(pairs, ["score", "lead"])
    out = model.transform(held).select("frame", "phase", "label", F.col("prediction"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 3).alias("mean_prediction"))


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, phase) AS rank FROM s) SELECT frame, truth, count(*) FILTER (score >= 5e-1) AS n_labels, round(max(score), 6) AS top FROM r GROUP BY 1, 2", "v_bins", "v_frames")
def export_ml_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).groupBy("frame", "truth").agg(F.count_if(F.col("score") >= 0.5).alias("n_labels"), F.round(F.max("score"), 6).alias("top"))
