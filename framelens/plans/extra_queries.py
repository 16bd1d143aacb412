"""Further queries: seeds, lookups, stored results, file listings, compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.functions import columns as C
from framelens.operators import frames as FR
from framelens.operators import library as L
from framelens.operators import peaks as P
from framelens.operators import tracks as T
from framelens.operators.shared import scratch, stored
from framelens.plans.catalog import query
from framelens.plans.match_queries import _REFL, observed_once, reflections_of
from framelens.plans.views import phases, table, view
from framelens.sources import text as S


def _r(*names: str, n: int = 6) -> list:
    return [F.round(x, n).alias(x) for x in names]


_ORDER = "ord AS (SELECT frame, CASE WHEN pressure IS NULL THEN 'f' || frame ELSE 'g' || scan END AS path, row_number() OVER (PARTITION BY CASE WHEN pressure IS NULL THEN 'f' || frame ELSE 'g' || scan END ORDER BY pressure, frame) AS step FROM v_frames)"


@query(f"""WITH {_ORDER}, d AS (SELECT DISTINCT frame, round(center, 6) AS center FROM v_peaks WHERE flag = 0 AND phase <> ''), p AS (SELECT d.*, path, step FROM d JOIN ord USING (frame)),
n AS (SELECT o.frame, p.center AS c FROM p JOIN ord o ON o.path = p.path AND o.step = p.step + 1), s AS (SELECT DISTINCT frame, c AS center FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = n.frame AND abs(p.center - n.c) <= 5e-2))
SELECT frame, center, false AS seeded FROM p UNION ALL SELECT frame, center, true FROM s""", "v_frames", "v_peaks")
def seed_recovery(spark: SparkSession, sf: str) -> DataFrame:
    order = FR.seed_order(view(spark, sf, "v_frames"), "scan", "pressure")
    own = view(spark, sf, "v_peaks").filter("flag = 0 AND phase <> ''").select("frame", F.round("center", 6).alias("center")).distinct().withColumn("good", F.lit(True))
    return T.seed_recovery(own, order, 0.05, 1)


@query()
def seed_recovery_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds carried along whole paths, with extrapolation and axis gaps; seed_recovery is the one round that SQL expresses."""
    order = FR.seed_order(view(spark, sf, "v_frames"), "scan", "pressure").withColumn("x", F.col("pressure"))
    own = view(spark, sf, "v_peaks").select("frame", "center", (F.col("flag").eqNullSafe(0) & (F.col("phase") != "")).alias("good"))
    lo, hi = own.agg(F.min("center"), F.max("center")).first()
    if lo is None:
        lo, hi = 0.0, 0.0
    return T.carry_seeds(own, order, 0.05, lo, hi, max_axis_gap=5.0).select("frame", *_r("center"), "seeded")


@query(r"""WITH l AS (SELECT o_orderkey AS row, 'P_' || ((o_custkey % 500) % 50) || 'p' || ((o_custkey % 500) % 10) || 'GPa_' || (o_custkey % 500) AS stem, o_orderpriority AS label FROM orders)
SELECT frame, label FROM v_frames JOIN l ON regexp_replace(regexp_extract(filename, '[^/]*$'), '\.[^.]*$', '') = stem QUALIFY row_number() OVER (PARTITION BY frame ORDER BY row) = 1""", "v_frames")
def label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Truth labels of pattern files by tolerant names; the first writer wins."""
    k = F.col("o_custkey") % 500
    labels = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.concat(F.lit("P_"), k % 50, F.lit("p"), k % 10, F.lit("GPa_"), k).alias("stem"), F.col("o_orderpriority").alias("label"))
    own = view(spark, sf, "v_frames").select("frame", C.stem(F.col("filename")).alias("stem"))
    first = Window.partitionBy("frame").orderBy("row")
    return own.join(labels, "stem").withColumn("k", F.row_number().over(first)).filter("k = 1").select("frame", "label")


@query(f"WITH {_REFL}, x AS (SELECT DISTINCT p_size, phase, line, weight FROM part, refl), r AS (SELECT *, row_number() OVER (PARTITION BY p_size, phase ORDER BY weight DESC, line) AS k FROM x) SELECT p_size, phase, line FROM r WHERE k <= 1 + p_size % 4")
def strongest_reflections(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest lines of each phase, as many as a cap that depends on the data allows."""
    caps = table(spark, sf, "part").select("p_size").distinct()
    first = Window.partitionBy("p_size", "phase").orderBy(F.desc("weight"), "line")
    return caps.join(F.broadcast(reflections_of(spark)), F.lit(True)).withColumn("k", F.row_number().over(first)).filter("k <= 1 + p_size % 4").select("p_size", "phase", "line")


@query("""SELECT grp * 100 + id % 20 AS track, count(*) AS n, list(round(center, 6) ORDER BY frame, id) AS centers FROM v_obs GROUP BY 1 HAVING count(*) >= 4""", "v_obs")
def load_spots(spark: SparkSession, sf: str) -> DataFrame:
    """Stored tracks read back: pressure-sorted arrays of the tracks with enough points."""
    path = scratch(spark)
    view(spark, sf, "v_obs").selectExpr("grp * 100 + id % 20 AS track", "frame", "id", "round(center, 6) AS center").write.parquet(path)
    own = spark.read.parquet(path).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("frame", "id", "center"))).alias("p"))
    return own.filter(F.size("p") >= 4).select("track", F.size("p").cast("long").alias("n"), F.transform("p", lambda x: x["center"]).alias("centers"))


@query("SELECT grp * 100 + id % 20 AS track, id, round(amplitude, 6) AS amplitude, 'scan' || lpad(CAST(scan AS VARCHAR), 3, '0') AS scan_name FROM v_obs o JOIN v_frames f ON f.frame = o.frame", "v_obs", "v_frames")
def export_spot_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Points of tracks with the scan of their frame."""
    names = view(spark, sf, "v_frames").select("frame", C.scan_label(F.col("filename")).alias("scan_name"))
    return view(spark, sf, "v_obs").selectExpr("grp * 100 + id % 20 AS track", "frame", "id", "round(amplitude, 6) AS amplitude").join(names, "frame").select("track", "id", "amplitude", "scan_name")


@query("SELECT frame, id, round(center, 6) AS center, round(2 * pi() / center, 6) AS d FROM v_obs WHERE amplitude > 10", "v_obs")
def export_residual_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_obs").filter("amplitude > 10").select("frame", "id", *_r("center"), F.round(C.radial_to_d(F.col("center"), "q_A^-1"), 6).alias("d"))


@query("""SELECT f.frame, coalesce(CASE WHEN f.frame % 3 = 0 THEN f.frame * 1e0 END, pressure) AS pressure, f.frame % 3 = 0 AS user_edited FROM v_frames f""", "v_frames")
def write_frames_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Set a metadata channel for some frames, mark them as edited, write, and read back."""
    frames = view(spark, sf, "v_frames").withColumn("user_edited", F.lit(False))
    new = frames.filter("frame % 3 = 0").selectExpr("frame", "frame * 1e0 AS pressure")
    merged = FR.metadata_merge(frames, new, ["pressure"])
    marked = merged.join(new.select("frame").withColumn("hit", F.lit(True)), "frame", "left").withColumn("user_edited", F.coalesce("hit", F.lit(False)))
    return stored(marked.select("frame", "pressure", "user_edited"))


@query("SELECT frame, sum(greatest(mean - robust, 0)) > 400 AS flagged FROM v_bins GROUP BY frame", "v_bins")
def contamination_flag(spark: SparkSession, sf: str) -> DataFrame:
    from framelens.operators.patterns import contamination_score

    return contamination_score(view(spark, sf, "v_bins")).select("frame", (F.col("contamination") > 400).alias("flagged"))


@query("""WITH l AS (SELECT frame, 2e0 + (frame % 5) * 1e-1 AS center FROM v_frames) SELECT l.frame, round(sum(mean), 4) AS total FROM v_bins b JOIN l ON l.frame = b.frame AND abs(radial - center) <= 5e-2 * center GROUP BY 1""", "v_frames", "v_bins")
def roi_sum_join(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "v_frames").selectExpr("frame", "'one' AS phase", "2e0 + (frame % 5) * 1e-1 AS center")
    return P.roi_layers(view(spark, sf, "v_bins").selectExpr("frame", "radial", "mean AS y"), lines, 0.05).select("frame", F.round("total", 4).alias("total"))


@query("SELECT frame, phase, round(pressure, 6) AS pressure, round(confidence, 6) AS confidence, CAST(row_number() OVER (PARTITION BY phase ORDER BY frame) AS INT) AS n FROM v_identify WHERE phase = 'Au'", "v_identify")
def identify_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The series of one phase along the frames."""
    own = view(spark, sf, "v_identify").filter("phase = 'Au'").withColumn("block", F.expr("CAST(floor(frame / 4096) AS BIGINT)"))
    sizes = own.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    ahead = sizes.select("block", F.coalesce(F.sum("c").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = own.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("frame"))).join(ahead, "block")
    return placed.select("frame", "phase", *_r("pressure", "confidence"), (F.col("k") + F.col("ahead")).cast("int").alias("n"))


@query()
def scan_frames(spark: SparkSession, sf: str) -> DataFrame:
    own = S.scan_frames(spark, sf, "events*.parquet; orders*.parquet")
    return own.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query()
def fingerprint_files(spark: SparkSession, sf: str) -> DataFrame:
    own = S.fingerprint_files(spark, sf, "{orders,supplier}*.parquet")
    return own.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "digest")


@query()
def benchmark_run(spark: SparkSession, sf: str) -> DataFrame:
    """Text patterns to a scorecard: parse, separate, find maxima, rank against labels, score."""
    from framelens.operators import patterns as PT
    from framelens.plans.peak_queries import scores

    bins = view(spark, sf, "v_bins")
    n = PT.local_maxima(bins, "mean", PT.mad_sigma(bins, "mean"), 8.0).groupBy("frame").agg(F.count(F.lit(1)).alias("n_peaks"))
    own = stored(scores(spark, sf))
    truth = own.select("frame", F.col("truth").alias("phase")).distinct()
    card = P.scorecard(own, truth)
    counts = n.agg(F.avg("n_peaks").alias("peaks_per_frame"))
    return card.join(F.broadcast(counts), F.lit(True)).select("n", *_r("hit1", "hitk", "mrr", "peaks_per_frame", n=5))


@query("SELECT o_orderkey AS frame, CASE WHEN o_custkey % 3 = 0 THEN 'Au' ELSE 'Re' END AS phase, round(o_totalprice, 2) AS score FROM orders")
def read_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Stored candidates read back; a column that an older file lacks is null."""
    path = scratch(spark)
    own = table(spark, sf, "orders").selectExpr("o_orderkey AS frame", "CASE WHEN o_custkey % 3 = 0 THEN 'Au' ELSE 'Re' END AS phase", "round(o_totalprice, 2) AS score")
    own.write.parquet(path)
    return spark.read.parquet(path).unionByName(own.limit(0).withColumn("pressure", F.lit(None).cast("double")), allowMissingColumns=True).select("frame", "phase", "score")


@query("SELECT DISTINCT frame, phase FROM v_identify WHERE phase IN ('Au', 'Re')", "v_identify")
def library_phases_seen(spark: SparkSession, sf: str) -> DataFrame:
    known = L.ordered_library(phases(spark), ["marker", "sample", "gasket"]).select(F.col("name").alias("phase"))
    return view(spark, sf, "v_identify").select("frame", "phase").distinct().join(F.broadcast(known), "phase", "left_semi").select("frame", "phase")


@query("SELECT frame, count(*) AS n FROM (SELECT DISTINCT frame, frame * 10000 + k1 * 10 + peak AS obs FROM v_peaks WHERE flag = 0) GROUP BY frame", "v_peaks")
def peak_map(spark: SparkSession, sf: str) -> DataFrame:
    return observed_once(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
