"""Writers: patterns, peak and track tables, hand-off bundles, lineage."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file at most, so that one frame or table never becomes one task's file.
ROWS_A_FILE = 5_000_000


def pattern_lines(bins: DataFrame, frames: DataFrame, windows: DataFrame | None = None, mode: str = "drop") -> DataFrame:
    """frame, bin, line: text of the live frames' points; bins inside contaminant windows (lo, hi) are dropped or zeroed."""
    own = bins.join(frames.filter("NOT excluded").select("frame"), "frame", "left_semi")
    if windows is not None:
        from framelens.operators.matching import band_join

        hit = band_join(own.select("frame", "bin", "radial"), windows, [], "radial", F.col("lo"), F.col("hi"), 0.25).select("frame", "bin").distinct()
        if mode == "drop":
            own = own.join(hit, ["frame", "bin"], "left_anti")
        else:
            own = own.join(hit.withColumn("zero", F.lit(True)), ["frame", "bin"], "left").withColumn("y", F.when(F.col("zero"), 0.0).otherwise(F.col("y"))).drop("zero")
    return own.select("frame", "bin", F.when(F.col("radial").isNotNull() & F.col("y").isNotNull(), F.pandas_udf(_two_numbers, "string")("radial", "y")).alias("line"))


def _two_numbers(a: pd.Series, b: pd.Series) -> pd.Series:
    """Six decimals each, rounded as C and SQL do: by the whole binary value, not by its shortest decimal form."""
    return pd.Series([f"{x:.6f} {y:.6f}" for x, y in zip(a, b)], dtype=object)


def write_patterns(lines: DataFrame, path: str) -> None:
    """A folder for each frame with its points in order."""
    lines.repartition("frame").sortWithinPartitions("frame", "bin").select("frame", "line").write.partitionBy("frame").option("maxRecordsPerFile", ROWS_A_FILE).text(path)


def write_table_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).option("maxRecordsPerFile", ROWS_A_FILE).csv(path)


def peak_table(peaks: DataFrame, frames: DataFrame) -> DataFrame:
    """All peaks of the chosen frames, flagged ones too, with the file name."""
    return peaks.join(frames.select("frame", "filename"), "frame")


def unknown_diagram(obs: DataFrame, least_obs: int = 1, least_frames: int = 1) -> tuple[DataFrame, DataFrame]:
    """Observations and summary of the clusters (cluster, frame, center, amplitude) that are large enough."""
    from framelens.operators.peaks import cluster_summary

    kept = cluster_summary(obs).filter((F.col("n_obs") >= least_obs) & (F.col("n_frames") >= least_frames))
    return obs.join(kept.select("cluster"), "cluster", "left_semi"), kept


def manifest(frames: DataFrame, group: str) -> DataFrame:
    """label, n, frames of a hand-off: the members of each group in order."""
    return frames.filter("NOT excluded").groupBy(F.col(group).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("frame")).alias("frames"))


def phase_reasons(wanted: DataFrame, library: DataFrame) -> DataFrame:
    """phase, reason: null for phases that can be written."""
    joined = wanted.join(library.select(F.col("name").alias("phase"), "a").withColumn("known", F.lit(True)), "phase", "left")
    return joined.select("phase", F.when(F.col("known").isNull(), "not in the library").when(F.col("a").isNull(), "no structure").alias("reason"))


def lineage_row(spark: SparkSession, step: str, tool: str, version: int, config: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame([(step, tool, version, dict(config))], "step string, tool string, version int, config map<string,string>").withColumn("created_at", F.current_timestamp())


def latest_lineage(log: DataFrame) -> DataFrame:
    """The last row of each step: a re-run replaces its step."""
    return log.groupBy("step").agg(F.max(F.struct("created_at", "tool", "version", F.to_json("config").alias("config"))).alias("r")).select("step", "r.*")
