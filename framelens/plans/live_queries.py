"""Queries over streams, text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators.shared import scratch
from framelens.plans.catalog import query
from framelens.plans.views import phases, table, view
from framelens.sources import sinks as K
from framelens.sources import text as S
from framelens.streaming import live as T


def _r(*names: str, n: int = 6) -> list:
    return [F.round(x, n).alias(x) for x in names]


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf)


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events WHERE value > 100")
def watch_source(spark: SparkSession, sf: str) -> DataFrame:
    return T.run_to_table(events(spark, sf).filter("value > 100").select("event_id", "user_id", "event_type", *_r("value")))


@query("""WITH p AS (SELECT event_id % 500 AS path, event_id % 3 AS size, lag(event_id % 3) OVER (PARTITION BY event_id % 500 ORDER BY event_id) AS b, event_id FROM events)
SELECT CAST(path AS VARCHAR) AS path, arg_max(size, event_id) AS size FROM p GROUP BY path HAVING bool_or(size = b)""")
def settle_filter(spark: SparkSession, sf: str) -> DataFrame:
    listing = events(spark, sf).selectExpr("CAST(event_id % 500 AS STRING) AS path", "event_id % 3 AS size", "0L AS mtime", "event_id AS poll")
    return T.run_to_table(T.settled(listing))


@query("SELECT DISTINCT user_id FROM events")
def seen_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return T.run_to_table(T.seen_once(events(spark, sf).select("user_id"), "user_id"))


@query("""WITH a AS (SELECT event_id % 700 AS name, event_id % 11 = 0 AS ok, row_number() OVER (PARTITION BY event_id % 700 ORDER BY event_id) AS n FROM events), g AS (SELECT name, min(n) FILTER (ok) AS first_ok, max(n) AS most FROM a GROUP BY name)
SELECT CAST(name AS VARCHAR) AS name, least(coalesce(first_ok, 3), 3) AS attempts, CASE WHEN first_ok <= 3 THEN 'done' ELSE 'failed' END AS status FROM g WHERE first_ok <= 3 OR most >= 3""")
def retry_failed(spark: SparkSession, sf: str) -> DataFrame:
    attempts = events(spark, sf).selectExpr("CAST(event_id % 700 AS STRING) AS name", "event_id % 11 = 0 AS ok", "event_type AS reason", "event_id AS attempt")
    return T.run_to_table(T.with_retries(attempts)).select("name", "attempts", "status")


@query("SELECT event_id, round(value, 6) AS value FROM events")
def append_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    T.append_sink(events(spark, sf).select("event_id", *_r("value")), f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def rolling_analysis(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)

    def analyse(rows: DataFrame, batch_id: int) -> None:
        rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    T.rolling_analysis(events(spark, sf), analyse, f"{path}/live")
    return spark.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query()
def stream_tracks(spark: SparkSession, sf: str) -> DataFrame:
    own = events(spark, sf).selectExpr("user_id % 5 AS grp", "event_id AS id", "CAST(floor((unix_seconds(CAST(ts AS TIMESTAMP)) - 1704067200) / 1800) AS DOUBLE) AS x", "1e0 + value / 100 AS center", "2e-2 + 1e-3 * (user_id % 10) AS fwhm")
    return T.run_to_table(T.stream_tracks(own)).select("grp", "track", "id", "x", *_r("center"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS file", "l_orderkey * 10 + l_linenumber AS line",
        "CASE l_linenumber WHEN 1 THEN concat('#Wave', l_partkey % 3, '= ', l_orderkey, ' ') WHEN 2 THEN concat(l_orderkey, ',', l_partkey) WHEN 3 THEN 'x y' ELSE concat(' ', l_orderkey, '  ', l_partkey) END AS value",
    )


@query("SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS line, CAST(l_orderkey AS DOUBLE) AS x, CAST(l_partkey AS DOUBLE) AS y FROM lineitem WHERE l_linenumber NOT IN (1, 3)")
def read_xy_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_xy(_lines(spark, sf))


@query("SELECT l_suppkey AS file, 'wave' || l_partkey % 3 AS key, CAST(l_orderkey AS VARCHAR) AS value FROM lineitem WHERE l_linenumber = 1")
def read_xy_headers(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_headers(_lines(spark, sf))


@query("SELECT p_name || p_partkey AS filename, unnest(CASE WHEN p_size % 2 = 0 THEN [p_type, p_brand] ELSE [p_type] END) AS phase FROM part WHERE p_partkey % 11 <> 0")
def read_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("CASE WHEN p_partkey % 11 = 0 THEN 'Filename' ELSE concat(p_name, p_partkey, ' ') END AS filename", "CASE WHEN p_size % 2 = 0 THEN concat(p_type, '; ', p_brand, ',') ELSE p_type END AS phases")
    return S.parse_labels(rows)


@query("""SELECT o_orderkey AS row, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS frame, 'f' || o_orderkey AS filename, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS pressure, CAST(o_custkey % 300 AS DOUBLE) AS temperature FROM orders""")
def read_metadata_csv(spark: SparkSession, sf: str) -> DataFrame:
    sheet = table(spark, sf, "orders").selectExpr("o_orderkey AS row", "CASE WHEN o_custkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS Index", "concat('f', o_orderkey, ' ') AS File", "CASE WHEN o_custkey % 7 = 0 THEN 'nan' ELSE CAST(round(o_totalprice, 2) AS STRING) END AS `Pressure GPa`", "CAST(o_custkey % 300 AS STRING) AS T")
    return S.metadata_sheet(sheet).select("row", "frame", "filename", "pressure", "temperature")


@query("SELECT o_orderkey AS frame, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) WHEN o_custkey % 3 = 1 THEN CAST(o_custkey % 50 AS DOUBLE) END AS value FROM orders")
def header_values(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").selectExpr("o_orderkey AS frame", "o_custkey")
    rows = own.selectExpr("frame", """explode(CASE WHEN o_custkey % 3 = 0 THEN map('SampleX', CAST(o_custkey AS STRING)) WHEN o_custkey % 3 = 1 THEN map('motor_mne', 'a samplex b', 'motor_pos', concat('1 ', o_custkey % 50, ' 3')) ELSE map('other', '1') END) AS (key, value)""")
    return S.header_values(rows, "samplex")


@query("""SELECT p_partkey AS file, i AS line, CAST(p_size + i AS DOUBLE) AS d, CAST(p_partkey % 90 AS DOUBLE) AS intensity FROM part, range(1, 4) t(i) WHERE p_size > 0""")
def reflection_list_read(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").selectExpr("p_partkey AS file", "p_size AS s").withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    text = F.expr("""CASE WHEN file % 3 = 0 THEN CASE WHEN line = 0 THEN 'h k l d I' ELSE concat('1 0 ', line, ' ', s + line, ' ', file % 90) END
    WHEN file % 3 = 1 THEN CASE WHEN line = 0 THEN '# two columns' ELSE concat(s + line, ', ', file % 90) END ELSE CASE WHEN line = 0 THEN 'I d' ELSE concat(file % 90, ' ', s + line) END END""")
    return S.reflection_list(own.select("file", "line", text.alias("value"))).select("file", "line", "d", "intensity")


@query("""SELECT 'h' || o_orderkey AS histogram, phase, CASE phase WHEN 'Au' THEN 7e-1 ELSE 3e-1 END AS weight_fraction, CASE WHEN phase = 'Au' THEN 7 END AS n_cell, o_custkey % 9 * 1e0 AS rwp FROM orders, (VALUES ('Au'), ('Rhenium')) v(phase)""")
def refinement_results_read(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").selectExpr("""array(named_struct('name', concat('h', o_orderkey), 'rwp', o_custkey % 9 * 1e0, 'gof', 1e0, 'converged', true, 'phases', map('Au', named_struct('weight_fraction', 7e-1, 'weight_fraction_esd', 1e-2, 'cell', array_repeat(4e0, 7), 'cell_esd', array_repeat(0e0, 7)),
    'Re', named_struct('weight_fraction', 3e-1, 'weight_fraction_esd', 1e-2, 'cell', array_repeat(4e0, 3), 'cell_esd', array_repeat(0e0, 7))))) AS histograms""")
    rename = spark.createDataFrame([("Re", "Rhenium")], "old string, new string")
    out = S.refinement_results(own, rename)
    return out.select("histogram", "phase", "weight_fraction", F.when(F.col("cell").isNotNull(), F.size("cell")).alias("n_cell"), "rwp")


@query("SELECT b.frame, bin, printf('%.6f %.6f', radial, mean) AS line FROM v_bins b JOIN v_frames f ON f.frame = b.frame WHERE NOT excluded AND NOT (radial BETWEEN 3e0 AND 32e-1)", "v_bins", "v_frames")
def export_patterns(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins").selectExpr("frame", "bin", "radial", "mean AS y")
    windows = spark.createDataFrame([(3.0, 3.2)], "lo double, hi double")
    return K.pattern_lines(bins, view(spark, sf, "v_frames"), windows)


@query("SELECT p.frame, peak, k1, k2, filename, flag FROM v_peaks p JOIN v_frames f ON f.frame = p.frame WHERE f.frame % 2 = 0", "v_peaks", "v_frames")
def export_peaks(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    K.write_table_csv(K.peak_table(view(spark, sf, "v_peaks"), view(spark, sf, "v_frames").filter("frame % 2 = 0")).select("frame", "peak", "k1", "k2", "filename", "flag"), path)
    return spark.read.csv(path, header=True, schema="frame bigint, peak int, k1 bigint, k2 bigint, filename string, flag int")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN -1 ELSE grp END AS cluster FROM v_obs", "v_obs")
def export_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    obs = view(spark, sf, "v_obs")
    tracks = obs.filter("id % 3 <> 0").select("id", F.col("grp").alias("cluster"))
    return obs.select("id").join(tracks, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query("""WITH g AS (SELECT grp * 50 + id % 50 AS cluster, count(*) AS n_obs, count(DISTINCT frame) AS n_frames FROM v_obs GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT frame) >= 2)
SELECT id, grp * 50 + id % 50 AS cluster FROM v_obs WHERE grp * 50 + id % 50 IN (SELECT cluster FROM g)""", "v_obs")
def export_unknown_diagram(spark: SparkSession, sf: str) -> DataFrame:
    obs = view(spark, sf, "v_obs").selectExpr("id", "grp * 50 + id % 50 AS cluster", "frame", "center", "amplitude")
    return K.unknown_diagram(obs, 3, 2)[0].select("id", "cluster")


@query("SELECT CAST(scan AS VARCHAR) AS label, count(*) AS n, list(frame ORDER BY frame) AS frames FROM v_frames WHERE NOT excluded GROUP BY scan", "v_frames")
def refinement_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return K.manifest(view(spark, sf, "v_frames"), "scan")


@query("SELECT DISTINCT CASE WHEN phase = '' THEN 'glass' ELSE phase END AS phase, CASE WHEN phase = '' THEN 'not in the library' END AS reason FROM v_peaks", "v_peaks")
def bundle_phases(spark: SparkSession, sf: str) -> DataFrame:
    wanted = view(spark, sf, "v_peaks").select(F.expr("CASE WHEN phase = '' THEN 'glass' ELSE phase END").alias("phase")).distinct()
    return K.phase_reasons(wanted, phases(spark))


@query()
def lineage_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each step's last lineage row, with the size of what it read."""
    log = K.lineage_row(spark, "peaks", "fit", 1, {"snr": "8"}).unionByName(K.lineage_row(spark, "frames", "ingest", 1, {}))
    sizes = view(spark, sf, "v_peaks").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit("peaks")).unionByName(view(spark, sf, "v_frames").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit("frames")))
    return K.latest_lineage(log).join(sizes, "step").select("step", "tool", "version", "config", "n")


@query("SELECT f.frame, pressure, n AS n_good, round(total, 4) AS total FROM v_frames f LEFT JOIN (SELECT frame, count(*) AS n FROM v_peaks WHERE flag = 0 GROUP BY 1) p ON p.frame = f.frame LEFT JOIN (SELECT frame, sum(mean) AS total FROM v_bins GROUP BY 1) b ON b.frame = f.frame WHERE f.frame % 50 = 7", "v_frames", "v_peaks", "v_bins")
def frame_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    """Everything about a few frames: the filter on the frame reaches each scan."""
    want = "frame % 50 = 7"
    good = view(spark, sf, "v_peaks").filter(want).filter("flag = 0").groupBy("frame").agg(F.count(F.lit(1)).alias("n_good"))
    total = view(spark, sf, "v_bins").filter(want).groupBy("frame").agg(F.round(F.sum("mean"), 4).alias("total"))
    return view(spark, sf, "v_frames").filter(want).select("frame", "pressure").join(good, "frame", "left").join(total, "frame", "left")
