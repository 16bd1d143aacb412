"""Readers for text patterns, label and metadata sheets, reflection lists, refinement results and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header names of a metadata sheet and the column that each stands for: fixed values.
METADATA_ALIASES = {
    "frame": "frame", "frame_index": "frame", "index": "frame", "idx": "frame", "i": "frame", "n": "frame",
    "filename": "filename", "file": "filename", "name": "filename", "fname": "filename", "path": "filename",
    "pressure_gpa": "pressure", "pressure": "pressure", "p_gpa": "pressure", "p": "pressure", "gpa": "pressure",
    "pressure_sigma_gpa": "pressure_sigma", "pressure_sigma": "pressure_sigma", "sigma_gpa": "pressure_sigma", "sigma": "pressure_sigma", "p_sigma": "pressure_sigma", "dp": "pressure_sigma", "p_err": "pressure_sigma",
    "temperature_k": "temperature", "temperature": "temperature", "temp_k": "temperature", "temp": "temperature", "t_k": "temperature", "t": "temperature",
    "pos_x_mm": "pos_x", "pos_x": "pos_x", "x_mm": "pos_x", "x": "pos_x", "sam_x": "pos_x", "sample_x": "pos_x", "motor_x": "pos_x", "samx": "pos_x",
    "pos_y_mm": "pos_y", "pos_y": "pos_y", "y_mm": "pos_y", "y": "pos_y", "sam_y": "pos_y", "sample_y": "pos_y", "motor_y": "pos_y", "samy": "pos_y",
}
METADATA = ("frame", "filename", "pressure", "pressure_sigma", "temperature", "pos_x", "pos_y")


def scan_frames(spark: SparkSession, folder: str, patterns: str = "*.tif;*.cbf", recursive: bool = False) -> DataFrame:
    """path, length, modified of the files in a folder that match any of the ``;``-separated patterns."""
    glob = "{" + ",".join(p.strip() for p in patterns.split(";") if p.strip()) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).distinct()


def fingerprint_files(spark: SparkSession, folder: str, glob: str = "*", whole: int = 64 << 20, sample: int = 1 << 20) -> DataFrame:
    """path, length, modified, digest: SHA-256 of the content, of its head and tail for files above ``whole`` bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    ends = F.concat(F.substring("content", 1, sample), F.substring("content", -sample, sample))
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2(F.when(F.col("length") <= whole, F.col("content")).otherwise(ends), 256).alias("digest"))


def parse_xy(lines: DataFrame) -> DataFrame:
    """file, line, x, y of two-column text (file, line, value); comma or space; other rows are left out."""
    parts = F.split(F.trim(F.regexp_replace("value", ",", " ")), r"\s+")
    own = lines.filter(~F.col("value").startswith("#")).select("file", "line", F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))
    return own.filter("x IS NOT NULL AND y IS NOT NULL")


def parse_headers(lines: DataFrame) -> DataFrame:
    """file, key (lower case), value of ``#KEY=VALUE`` lines."""
    pattern = r"^#+\s*([^=]+?)\s*=\s*(.*?)\s*$"
    own = lines.filter(F.col("value").rlike(pattern))
    return own.select("file", F.lower(F.regexp_extract("value", pattern, 1)).alias("key"), F.regexp_extract("value", pattern, 2).alias("value"))


def read_xy_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points and header values of all text patterns under a path."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return parse_xy(lines), parse_headers(lines)


def parse_labels(rows: DataFrame) -> DataFrame:
    """filename, phase from (filename, phases) with ``;`` or ``,`` between phases; a header row is left out."""
    own = rows.filter(~F.lower(F.trim("filename")).isin("filename", "file", "name"))
    phases = F.transform(F.split(F.regexp_replace("phases", ";", ","), ","), lambda p: F.trim(p))
    return own.select(F.trim("filename").alias("filename"), F.explode(phases).alias("phase")).filter("phase <> ''")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(spark.read.csv(path, schema="filename string, phases string"))


def metadata_sheet(rows: DataFrame) -> DataFrame:
    """A sheet of strings with any known header names as METADATA columns; what isn't a finite number is null.

    Rows need a frame or a file name and at least one value; ``row`` keeps their order.
    """
    found: dict[str, Column] = {}
    for c in rows.columns:
        name = METADATA_ALIASES.get(c.strip().lower().replace(" ", "_"))
        if name and name not in found:
            found[name] = F.col(f"`{c}`")

    def number(name: str, kind: str) -> Column:
        v = found[name].try_cast(kind) if name in found else F.lit(None).cast(kind)
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) if kind == "double" else v

    columns = [F.col("row") if "row" in rows.columns else F.monotonically_increasing_id().alias("row")]
    columns += [number("frame", "bigint").alias("frame"), (F.trim(found["filename"]) if "filename" in found else F.lit(None).cast("string")).alias("filename")]
    columns += [number(c, "double").alias(c) for c in METADATA[2:]]
    out = rows.select(*columns)
    return out.filter("(frame IS NOT NULL OR coalesce(filename, '') <> '') AND coalesce(pressure, pressure_sigma, temperature, pos_x, pos_y) IS NOT NULL")


def read_metadata_csv(spark: SparkSession, path: str, delimiters: str = ",;\t") -> DataFrame:
    """A metadata sheet; the delimiter is the one that its first line has most of."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0]["value"] if head else ""
    return metadata_sheet(spark.read.csv(path, header=True, sep=max(delimiters, key=line.count)))


def header_values(headers: DataFrame, key: str) -> DataFrame:
    """frame, value of a header key without regard to case, from the headers (frame, key, value) themselves or from paired motor names and positions."""
    own = headers.withColumn("key", F.lower("key"))
    direct = own.filter(F.col("key") == key.lower()).groupBy("frame").agg(F.min("value").try_cast("double").alias("direct"))
    names = own.filter("key = 'motor_mne'").select("frame", F.split(F.trim("value"), " +").alias("names"))
    places = own.filter("key = 'motor_pos'").select("frame", F.split(F.trim("value"), " +").alias("places"))
    pairs = names.join(places, "frame").select("frame", F.explode(F.arrays_zip("names", "places")).alias("p")).filter(F.lower("p.names") == key.lower())
    motor = pairs.groupBy("frame").agg(F.min("p.places").try_cast("double").alias("motor"))
    return headers.select("frame").distinct().join(direct, "frame", "left").join(motor, "frame", "left").select("frame", F.coalesce("direct", "motor").alias("value"))


def reflection_list(lines: DataFrame) -> DataFrame:
    """file, d, intensity, hkl of reflection tables in text: a header row names the columns, else two columns are d and I,
    else h k l d and the last one I. Only rows as long as a file's longest count."""
    parts = F.split(F.trim(F.regexp_replace("value", "[,;]", " ")), r"\s+")
    own = lines.filter(F.trim("value") != "").select("file", "line", parts.alias("p"))
    first = own.groupBy("file").agg(F.min(F.struct("line", "p")).alias("h"))
    head = F.transform("h.p", lambda x: F.lower(x))
    named = F.array_contains(head, "d")
    at = first.select("file", F.when(named, F.array_position(head, "d")).alias("d_at"), F.when(named, F.greatest(F.array_position(head, "i"), F.array_position(head, "intensity"))).alias("i_at"))
    longest = Window.partitionBy("file")
    numbers = own.withColumn("n", F.transform("p", lambda x: x.try_cast("double"))).filter(F.forall("n", lambda x: x.isNotNull())).withColumn("most", F.max(F.size("n")).over(longest)).filter("size(n) = most")
    joined = numbers.join(at, "file", "left")
    d_at = F.coalesce("d_at", F.when(F.col("most") == 2, 1).otherwise(4))
    i_at = F.coalesce(F.when(F.col("i_at") > 0, F.col("i_at")), F.when(F.col("d_at").isNull(), F.col("most")))
    get = lambda i: F.get(F.col("n"), i.cast("int") - 1)
    hkl = F.when(F.col("d_at").isNull() & (F.col("most") >= 5), F.transform(F.slice("n", 1, 3), lambda x: x.cast("int")))
    return joined.select("file", "line", get(d_at).alias("d"), get(i_at).alias("intensity"), hkl.alias("hkl")).filter("d > 0")


RESULTS = "schema string, version int, histograms array<struct<name string, rwp double, gof double, converged boolean, phases map<string, struct<weight_fraction double, weight_fraction_esd double, cell array<double>, cell_esd array<double>>>>>"


def refinement_results(results: DataFrame, rename: DataFrame | None = None) -> DataFrame:
    """histogram, phase, weight_fraction, esd, cell, rwp, gof, converged; cells that don't have 7 numbers are null."""
    per = results.select(F.explode("histograms").alias("h")).select(F.col("h.name").alias("histogram"), "h.rwp", "h.gof", "h.converged", F.explode("h.phases").alias("phase", "v"))
    out = per.select("histogram", "phase", F.col("v.weight_fraction").alias("weight_fraction"), F.col("v.weight_fraction_esd").alias("esd"), F.when(F.size("v.cell") == 7, F.col("v.cell")).alias("cell"), "rwp", "gof", "converged")
    if rename is None:
        return out
    return out.join(rename.select(F.col("old").alias("phase"), "new"), "phase", "left").withColumn("phase", F.coalesce("new", "phase")).drop("new")


def duplicate_phases(results: DataFrame) -> DataFrame:
    """Histograms in which two phases got the same name: an error of the renaming."""
    return results.groupBy("histogram", "phase").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_refinement(spark: SparkSession, path: str, schema: str = "sequential-refinement", version: int = 1) -> DataFrame:
    rows = spark.read.schema(RESULTS).option("multiLine", True).json(path)
    wrong = rows.filter((F.col("schema") != schema) | (F.col("version") != version)).limit(1).collect()
    if wrong:
        raise ValueError(f"not version {version} of {schema}")
    return refinement_results(rows)
