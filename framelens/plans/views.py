"""Stand-in views: the given tables seen as frames, patterns, cakes, peaks, pixels and phases.

Each view is a source and a list of expressions that mean the same in Spark SQL and in DuckDB, so the
Spark side and the SQL twin of a query start from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PEAK = [
    "l_orderkey AS frame", "l_linenumber AS peak", "l_partkey AS k1", "l_suppkey AS k2", "1e0 + 1e-1 * l_quantity AS center", "l_extendedprice / 1e3 AS amplitude",
    "2e-2 + 5e-1 * l_discount AS fwhm", "1e1 * l_tax AS eta", "l_extendedprice AS area", "1e-3 * l_linenumber AS center_err",
    "CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END AS flag", "CASE l_returnflag WHEN 'A' THEN 'Au' WHEN 'R' THEN 'Re' ELSE '' END AS phase",
]

#: name: (table, expressions, how the Spark and DuckDB sources differ)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_frames": ("embeddings", [
        "vec_id AS frame", "label AS scan", "CASE WHEN vec_id % 23 = 0 THEN NULL ELSE (vec_id % 50) + (vec_id % 10) / 1e1 END AS pressure", "3e2 + 10 * label AS temperature",
        "vec_id * 10 AS seconds", "(vec_id % 20) * 1e-1 AS pos_x", "floor(vec_id / 20) * 1e-1 AS pos_y", "vec_id % 17 = 0 AS excluded",
        "concat('scan00', label, '/P_', vec_id % 50, 'p', vec_id % 10, 'GPa_', vec_id, '.tif') AS filename",
    ]),
    "v_bins": ("#bins", ["frame", "bin", "1e0 + 1e-1 * bin AS radial", "5e1 + 1e2 * abs(v) AS mean", "5e1 + 6e1 * abs(v) AS robust", "5e1 + 8e1 * abs(v) AS sigmaclip"]),
    "v_cakes": ("#bins", ["CAST(floor(frame / 36) AS BIGINT) AS frame", "CAST(frame % 36 AS INT) AS az_bin", "-18e1 + 10 * (frame % 36) AS azimuth", "bin AS rad_bin", "1e0 + 1e-1 * bin AS radial", "1e2 * abs(v) AS value"]),
    "v_peaks": ("lineitem", _PEAK),
    "v_identify": ("orders", [
        "o_orderkey AS frame", "CASE WHEN o_orderkey % 2 = 0 THEN 'Au' ELSE 'Re' END AS phase", "(o_totalprice % 100) / 1e2 AS confidence", "CAST(o_custkey % 8 AS INT) AS n_matched", "o_totalprice % 60 AS pressure",
        "(o_totalprice % 10) / 1e1 AS recall", "(o_totalprice % 7) / 7e0 AS precision", "(o_custkey % 5) / 5e0 AS prior_penalty",
    ]),
    "v_obs": ("#events", ["CAST(floor((s - 1704067200) / 1800) AS BIGINT) AS frame", "user_id % 5 AS grp", "1e0 + value / 100 AS center", "value AS amplitude", "2e-2 + 1e-3 * (user_id % 10) AS fwhm", "event_id AS id"]),
    "v_pixels": ("lineitem", ["l_suppkey % 10 AS frame", "CAST(l_partkey % 200 AS INT) AS row", "CAST(l_orderkey % 200 AS INT) AS col", "l_quantity AS value", "l_orderkey", "l_partkey"]),
    "v_corpus": ("part", ["p_partkey AS file", "p_type AS formula", "CAST(p_size % 5 AS INT) AS spacegroup", "p_size * 6 AS n_sites", "p_retailprice AS volume", "p_partkey % 31 <> 0 AS parse_ok"]),
}

_DUCK_SOURCES = {
    "#bins": "(SELECT vec_id AS frame, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "#events": "(SELECT *, epoch(ts) AS s FROM events)",
}

#: Phases as (name, category, crystal axes a and c, equation of state, K0, K0', highest pressure, angle gamma, centring): fixed values.
PHASES = (
    ("Au", "marker", 4.0782, 4.0782, "BM3", 167.0, 5.5, 200.0, 90.0, "F"),
    ("Pt", "marker", 3.9231, 3.9231, "Vinet", 273.0, 5.2, 200.0, 90.0, "F"),
    ("W", "marker", 3.1652, 3.1652, "BM3", 308.0, 4.2, 150.0, 90.0, "I"),
    ("MgO", "sample", 4.2117, 4.2117, "BM3", 160.2, 3.99, 150.0, 90.0, "F"),
    ("Re", "gasket", 2.761, 4.456, "BM3", 353.0, 4.8, 150.0, 120.0, "H"),
)
PHASE_COLUMNS = "name string, category string, a double, c double, eos string, k0 double, k0p double, p_max double, gamma double, centring string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a DataFrame."""
    source, columns = VIEWS[name]
    if source == "#bins":
        own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("bin", "v")).withColumn("v", F.col("v").cast("double"))
    elif source == "#events":
        own = table(spark, sf_dir, "events").withColumn("s", F.expr("unix_seconds(CAST(ts AS TIMESTAMP))"))
    else:
        own = table(spark, sf_dir, source)
    return own.selectExpr(*columns)


def phases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHASES, PHASE_COLUMNS)


def phases_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in p) + ")" for p in PHASES)
    return f"v_phases(name, category, a, c, eos, k0, k0p, p_max, gamma, centring) AS (VALUES {rows})"


def with_views(sql: str, *views: str) -> str:
    """``sql`` after the common table expressions of the views; a body that starts with its own goes on with them."""
    parts = [f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {_DUCK_SOURCES.get(VIEWS[v][0], VIEWS[v][0])})" for v in views]
    if "v_phases" in sql:
        parts.append(phases_sql())
    body = sql.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
