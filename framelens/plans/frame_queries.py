"""Queries over frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import columns as C
from framelens.operators import frames as O
from framelens.plans.catalog import query
from framelens.plans.views import table, view

_PRESSURE_SQL = r"""
try_cast(replace(replace(replace(regexp_extract({0}, '(?i)(\d+(?:[.,p]\d+)?)\s*[_-]?\s*(gpa|mpa|kpa|mbar|kbar|pa|bar)([^a-zA-Z]|$)', 1), ',', '.'), 'p', '.'), 'P', '.') AS DOUBLE)
* CASE lower(regexp_extract({0}, '(?i)(\d+(?:[.,p]\d+)?)\s*[_-]?\s*(gpa|mpa|kpa|mbar|kbar|pa|bar)([^a-zA-Z]|$)', 2)) WHEN 'gpa' THEN 1e0 WHEN 'mpa' THEN 1e-3 WHEN 'kpa' THEN 1e-6 WHEN 'pa' THEN 1e-9 WHEN 'mbar' THEN 1e2 WHEN 'kbar' THEN 1e-1 WHEN 'bar' THEN 1e-4 END
"""


@query("SELECT frame, round(" + _PRESSURE_SQL.format("filename") + ", 9) AS parsed FROM v_frames", "v_frames")
def parse_pressure(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_frames").select("frame", F.round(C.parse_pressure(F.col("filename")), 9).alias("parsed"))


@query("SELECT o_orderkey AS id, round(coalesce(" + _PRESSURE_SQL.format("o_orderpriority || '.tif'") + ", " + _PRESSURE_SQL.format("'run_' || o_custkey % 90 || 'kbar'") + "), 9) AS parsed FROM orders")
def pressure_from_path(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("data"), F.concat(F.lit("run_"), (F.col("o_custkey") % 90).cast("string"), F.lit("kbar")), F.concat("o_orderpriority", F.lit(".tif")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(C.pressure_from_path(path), 9).alias("parsed"))


@query(r"""SELECT frame, 'scan' || lpad(CAST(CAST(regexp_extract(filename, 'scan(\d+)', 1) AS INT) AS VARCHAR), 3, '0') AS scan_name, regexp_extract(filename, '([^/]*)/[^/]*$', 1) AS folder FROM v_frames""", "v_frames")
def scan_label(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("filename")
    return view(spark, sf, "v_frames").select("frame", C.scan_label(f).alias("scan_name"), C.folder_label(f).alias("folder"))


@query("""SELECT s_name AS file, i AS index, printf('%s::%s#%06d', s_name, 'entry/data', i) AS display
FROM (SELECT s_name, CAST(s_suppkey % 7 AS INT) AS n, unnest(range(0, CAST(s_suppkey % 7 AS INT)))::INT AS i FROM supplier)""")
def expand_stacks(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "supplier").select(F.col("s_name").alias("file"), F.lit("entry/data").alias("dataset"), (F.col("s_suppkey") % 7).cast("int").alias("n_frames"))
    out = O.expand_stacks(catalog).withColumn("p", O.parse_display(F.col("display")))
    return out.filter("p.index = index").select(F.col("p.file").alias("file"), "index", "display")


@query("""WITH raw AS (SELECT l_suppkey AS file, l_linenumber AS field, l_partkey % 3 AS rank, list(l_quantity ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice)[1:CAST(1 + l_suppkey % 9 AS INT)] AS vals FROM lineitem GROUP BY 1, 2, 3),
fit AS (SELECT file, field, rank, CASE WHEN len(vals) = 1 THEN [vals[1] FOR x IN range(0, 4)] WHEN len(vals) >= 4 THEN vals[1:4] END AS fitted FROM raw),
best AS (SELECT file, field, arg_min(fitted, rank) AS f FROM fit WHERE fitted IS NOT NULL GROUP BY 1, 2)
SELECT file, field, generate_subscripts(f, 1)::INT - 1 AS index, unnest(f) AS value FROM best""")
def harvest_metadata(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("field"), (F.col("l_partkey") % 3).alias("rank"), F.struct("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").alias("v"))
    arrays = own.groupBy("file", "field", "rank").agg(F.array_sort(F.collect_list("v")).alias("v"))
    values = arrays.select("file", "field", "rank", F.expr("slice(transform(v, x -> x.l_quantity), 1, CAST(1 + file % 9 AS INT))").alias("values"))
    sizes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(4).alias("n_frames"))
    return O.harvest_metadata(values, sizes).select("file", "field", "index", "value")


_CSV = """csv AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 700 END AS frame, CASE WHEN o_orderkey % 3 = 1 THEN 'scan00' || ((o_custkey % 500) % 10) || '/P_' || ((o_custkey % 500) % 50) || 'p' || ((o_custkey % 500) % 10) || 'GPa_' || (o_custkey % 500) || '.tif'
 WHEN o_orderkey % 3 = 2 THEN 'P_' || ((o_custkey % 500) % 50) || 'p' || ((o_custkey % 500) % 10) || 'GPa_' || (o_custkey % 500) || '.cbf' END AS filename, o_totalprice AS pressure FROM orders)"""


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey") % 500
    name = F.concat(F.lit("P_"), k % 50, F.lit("p"), k % 10, F.lit("GPa_"), k)
    kind = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row"), F.when(kind == 0, F.col("o_custkey") % 700).alias("frame"),
        F.when(kind == 1, F.concat(F.lit("scan00"), k % 10, F.lit("/"), name, F.lit(".tif"))).when(kind == 2, F.concat(name, F.lit(".cbf"))).alias("filename"), F.col("o_totalprice").alias("pressure"),
    )


_J1 = f"""WITH {_CSV}, k AS (SELECT frame, filename AS full_name, regexp_extract(filename, '[^/]*$') AS base, regexp_replace(regexp_extract(filename, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM v_frames),
c AS (SELECT *, regexp_extract(filename, '[^/]*$') AS base, regexp_replace(regexp_extract(filename, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM csv),
m AS (SELECT k.frame, c.row, c.pressure, 0 AS kind FROM c JOIN k ON c.frame = k.frame
 UNION ALL SELECT k.frame, c.row, c.pressure, 1 FROM c JOIN k ON c.frame IS NULL AND c.filename = k.full_name
 UNION ALL SELECT k.frame, c.row, c.pressure, 2 FROM c JOIN k ON c.frame IS NULL AND c.base = k.base
 UNION ALL SELECT k.frame, c.row, c.pressure, 3 FROM c JOIN k ON c.frame IS NULL AND c.stem = k.stem),
b AS (SELECT * FROM m QUALIFY kind = min(kind) OVER (PARTITION BY row))
SELECT frame, row, pressure FROM b QUALIFY row_number() OVER (PARTITION BY frame ORDER BY row DESC) = 1"""


@query(_J1, "v_frames")
def metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    return O.metadata_join(_csv(spark, sf), view(spark, sf, "v_frames")).select("frame", "row", "pressure")


@query(r"""SELECT f.frame, CASE WHEN f.frame % 7 = 0 THEN f.pressure ELSE coalesce(n.o_totalprice, f.pressure) END AS pressure, CASE WHEN f.frame % 7 = 0 THEN f.temperature ELSE coalesce(CASE WHEN n.o_orderkey % 2 = 0 THEN n.o_custkey * 1e0 END, f.temperature) END AS temperature
FROM v_frames f LEFT JOIN orders n ON n.o_orderkey = f.frame""", "v_frames")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    frames = view(spark, sf, "v_frames").withColumn("user_edited", F.expr("frame % 7 = 0"))
    new = table(spark, sf, "orders").selectExpr("o_orderkey AS frame", "o_totalprice AS pressure", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 1e0 END AS temperature")
    return O.metadata_merge(frames, new, ["pressure", "temperature"]).select("frame", "pressure", "temperature")


@query(r"""SELECT f.frame, coalesce(p.pressure + 100, f.pressure) AS pressure, p.frame IS NOT NULL AS user_edited FROM v_frames f LEFT JOIN (SELECT * FROM v_frames WHERE frame % 5 = 0) p ON p.filename = f.filename""", "v_frames")
def carry_user_edits(spark: SparkSession, sf: str) -> DataFrame:
    frames = view(spark, sf, "v_frames").select("frame", "filename", "pressure", F.lit(False).alias("user_edited"))
    before = frames.filter("frame % 5 = 0").withColumn("pressure", F.col("pressure") + 100).withColumn("user_edited", F.lit(True))
    return O.carry_user_edits(frames, before, ["pressure"]).select("frame", "pressure", "user_edited")


@query("SELECT frame, CASE WHEN frame % 4 = 0 THEN true ELSE excluded END AS excluded FROM v_frames", "v_frames")
def exclude_frames(spark: SparkSession, sf: str) -> DataFrame:
    frames = view(spark, sf, "v_frames")
    return O.set_excluded(frames, frames.filter("frame % 4 = 0"), True).select("frame", "excluded")


@query("SELECT frame, CAST(seconds - (SELECT min(seconds) FROM v_frames) AS DOUBLE) AS x FROM v_frames", "v_frames")
def series_axis(spark: SparkSession, sf: str) -> DataFrame:
    return O.series_axis(view(spark, sf, "v_frames"), "time")


@query("""SELECT frame, path, CAST(row_number() OVER (PARTITION BY path ORDER BY pressure, frame) AS INT) AS step FROM (SELECT *, CASE WHEN pressure IS NULL THEN 'f' || frame ELSE 'g' || scan END AS path FROM v_frames)""", "v_frames")
def seed_order(spark: SparkSession, sf: str) -> DataFrame:
    return O.seed_order(view(spark, sf, "v_frames"), "scan", "pressure").select("frame", "path", "step")


@query("""WITH g AS (SELECT frame, CAST(frame // 20 AS INT) AS row, CAST(CASE WHEN (frame // 20) % 2 = 1 THEN 19 - frame % 20 ELSE frame % 20 END AS INT) AS col FROM v_frames)
SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, coalesce(frame, -1) AS frame FROM range(0, 130) a(r), range(0, 20) b(c) LEFT JOIN g ON g.row = r AND g.col = c""", "v_frames")
def frame_grid(spark: SparkSession, sf: str) -> DataFrame:
    return O.full_grid(O.frame_grid(view(spark, sf, "v_frames"), 20), 130, 20)


@query("""SELECT CAST(floor(frame / 20) AS INT) AS row, CAST(frame % 20 AS INT) AS col, frame FROM v_frames""", "v_frames")
def coordinate_grid(spark: SparkSession, sf: str) -> DataFrame:
    return O.coordinate_grid(view(spark, sf, "v_frames"), 0.05).select("row", "col", "frame")


@query("""WITH x AS (SELECT DISTINCT round(pos_x + (frame % 3) * 1e-4, 9) AS x FROM v_frames), g AS (SELECT round(x - lag(x) OVER (ORDER BY x), 9) AS gap FROM x), h AS (SELECT gap, lag(gap) OVER (ORDER BY gap) AS b FROM g WHERE gap > 0),
j AS (SELECT gap, b FROM h WHERE gap / b > 4 ORDER BY gap / b DESC, gap DESC, b DESC LIMIT 1)
SELECT round(coalesce((SELECT sqrt(gap * b) FROM j), (SELECT min(gap) / 2 FROM h)), 6) AS tolerance""", "v_frames")
def auto_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    frames = view(spark, sf, "v_frames").withColumn("pos_x", F.expr("pos_x + (frame % 3) * 1e-4"))
    return O.auto_tolerance(frames, "pos_x").select(F.round("tolerance", 6).alias("tolerance"))


@query("""WITH s AS (SELECT pressure - lag(pressure) OVER (ORDER BY frame) AS d FROM v_frames WHERE pressure IS NOT NULL)
SELECT count(*) AS n, count(pressure) AS parsed, round(count(pressure) / count(*), 9) AS fraction, min(pressure) AS p_min, max(pressure) AS p_max, (SELECT bool_and(d >= -1e-9) OR bool_and(d <= 1e-9) FROM s WHERE d IS NOT NULL) AS monotonic FROM v_frames""", "v_frames")
def pressure_summary(spark: SparkSession, sf: str) -> DataFrame:
    return O.pressure_summary(view(spark, sf, "v_frames")).select("n", "parsed", F.round("fraction", 9).alias("fraction"), "p_min", "p_max", "monotonic")


@query("""WITH k AS (SELECT frame, pressure FROM v_frames WHERE pressure IS NOT NULL), m AS (SELECT median(pressure) AS m FROM k), l AS (SELECT greatest(5e0, 8 * 1.4826e0 * median(abs(pressure - m))) AS l FROM k, m)
SELECT frame, pressure, abs(pressure - m) > l AS outlier FROM k, m, l WHERE pressure - 5 < 0 OR pressure + 5 > 50""", "v_frames")
def prior_offenders(spark: SparkSession, sf: str) -> DataFrame:
    return O.prior_offenders(view(spark, sf, "v_frames"), 0.0, 50.0, 5.0)


@query("SELECT least(0e0, min(pressure - 5)) AS p_min, greatest(50e0, max(pressure + 5)) AS p_max FROM v_frames", "v_frames")
def auto_widen_range(spark: SparkSession, sf: str) -> DataFrame:
    return O.widened_range(view(spark, sf, "v_frames"), 0.0, 50.0, 5.0)


@query("""WITH b AS (SELECT frame, CASE WHEN (frame + bin) % 3 = 0 THEN NULL WHEN frame % 41 = 0 THEN -1e0 ELSE mean END AS y FROM v_bins),
n AS (SELECT frame, count(*) AS n, count(*) FILTER (y IS NULL) AS missing, count(*) FILTER (y <= 0) AS low FROM b GROUP BY frame)
SELECT frame, n, missing, low, CASE WHEN missing = n THEN 'empty' WHEN low + missing = n THEN 'non-positive' WHEN missing * 2 > n THEN 'half missing' ELSE 'ok' END AS verdict FROM n""", "v_bins")
def reduction_health(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins").select("frame", F.expr("CASE WHEN (frame + bin) % 3 = 0 THEN NULL WHEN frame % 41 = 0 THEN -1e0 ELSE mean END").alias("y"))
    return O.reduction_health(bins, "y")


@query("""WITH r AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS rank, count(*) OVER () AS n FROM v_frames) SELECT frame, rank FROM r WHERE rank IN (SELECT floor(i * ((SELECT count(*) FROM v_frames) - 1) / 11)::BIGINT FROM range(0, 12) t(i))""", "v_frames")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return O.even_sample(view(spark, sf, "v_frames"), 12)
