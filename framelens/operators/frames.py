"""Frame tables: metadata joins and merges, series axes, scan grids, pressure checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import columns as C


def expand_stacks(catalog: DataFrame) -> DataFrame:
    """One row for each slice of a container (file, dataset, n_frames): index and display name."""
    slices = catalog.filter("n_frames > 0").withColumn("index", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)))
    return slices.withColumn("display", F.format_string("%s::%s#%06d", "file", "dataset", "index"))


def parse_display(display: Column) -> Column:
    """file, dataset and index of a display name."""
    pattern = r"^(.*)::(.*)#(\d+)$"
    return F.struct(F.regexp_extract(display, pattern, 1).alias("file"), F.regexp_extract(display, pattern, 2).alias("dataset"), F.regexp_extract(display, pattern, 3).try_cast("int").alias("index"))


def harvest_metadata(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per-slice metadata from (file, field, rank, values): the first path of a field that fits wins.

    A single value is repeated for all slices, a longer array is cut, a shorter one is rejected.
    """
    n = F.col("n_frames")
    fitted = F.when(F.size("values") == 1, F.array_repeat(F.element_at("values", 1), n)).when(F.size("values") >= n, F.slice("values", 1, n))
    usable = values.join(sizes, "file").withColumn("fitted", fitted).filter("fitted IS NOT NULL AND n_frames > 0")
    first = usable.groupBy("file", "field").agg(F.min(F.struct("rank", "fitted")).alias("best"))
    return first.select("file", "field", F.posexplode("best.fitted").alias("index", "value"))


def metadata_join(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows (row, frame, filename, ...) to frames: by index where one is given, else by path, base name, stem.

    The first kind of key that finds a frame counts for a row; of the rows of a frame the last one wins.
    """
    extra = [c for c in rows.columns if c not in ("row", "frame", "filename")]
    by_index = rows.filter("frame IS NOT NULL").join(frames.select("frame"), "frame").select("frame", "row", F.lit(0).alias("kind"), *extra)
    kinds = [(1, F.col("filename")), (2, C.base_name(F.col("filename"))), (3, C.stem(F.col("filename")))]
    named = rows.filter("frame IS NULL AND filename IS NOT NULL").drop("frame")
    keys = frames.select("frame", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("key")) for k, e in kinds])).alias("k")).select("frame", "k.*")
    wanted = named.select("row", *extra, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("key")) for k, e in kinds])).alias("k")).select("row", *extra, "k.*")
    by_name = wanted.join(keys, ["kind", "key"]).withColumn("best", F.min("kind").over(Window.partitionBy("row"))).filter("kind = best")
    found = by_index.unionByName(by_name.select("frame", "row", "kind", *extra))
    last = Window.partitionBy("frame").orderBy(F.desc("row"))
    return found.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "kind")


def metadata_merge(frames: DataFrame, new: DataFrame, columns: Sequence[str], replace: bool = False) -> DataFrame:
    """New values where they are present, else the old ones; rows that a user edited stay unless ``replace``."""
    fresh = new.select("frame", *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = frames.join(fresh, "frame", "left")
    out = []
    for c in columns:
        value = F.coalesce(f"new_{c}", c)
        out.append((value if replace else F.when(F.col("user_edited"), F.col(c)).otherwise(value)).alias(c))
    kept = [c for c in frames.columns if c not in columns]
    return joined.select(*kept, *out)


def carry_user_edits(frames: DataFrame, previous: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edited values of an earlier table, by file name, else by index when both have as many frames."""
    edits = previous.filter("user_edited")
    by_name = edits.groupBy("filename").agg(F.max(F.struct("frame", *columns)).alias("n")).select("filename", "n")
    counts = frames.agg(F.count(F.lit(1)).alias("now")).join(F.broadcast(previous.agg(F.count(F.lit(1)).alias("then"))), F.lit(True))
    by_index = edits.join(F.broadcast(counts), F.expr("now = then")).select("frame", F.struct(F.col("frame"), *columns).alias("i"))
    joined = frames.join(by_name, "filename", "left").join(by_index, "frame", "left")
    found = F.coalesce("n", "i")
    kept = [c for c in frames.columns if c not in (*columns, "user_edited")]
    return joined.select(*kept, *[F.coalesce(found[c], F.col(c)).alias(c) for c in columns], found.isNotNull().alias("user_edited"))


def set_excluded(frames: DataFrame, chosen: DataFrame, excluded: bool) -> DataFrame:
    marked = chosen.select("frame").distinct().withColumn("hit", F.lit(True))
    return frames.join(marked, "frame", "left").withColumn("excluded", F.when(F.col("hit"), excluded).otherwise(F.coalesce("excluded", F.lit(False)))).drop("hit")


def series_axis(frames: DataFrame, kind: str) -> DataFrame:
    """frame, x: index, pressure, temperature or seconds since the first stamp; raises if no frame has one."""
    x = {"frame": F.col("frame").cast("double"), "pressure": F.col("pressure"), "temperature": F.col("temperature"), "time": F.col("seconds").cast("double")}
    if kind not in x:
        raise ValueError(f"unknown axis {kind}")
    out = frames.select("frame", x[kind].cast("double").alias("x"))
    if out.filter("x IS NOT NULL").isEmpty():
        raise ValueError(f"no frame has a {kind}")
    if kind == "time":
        first = out.agg(F.min("x").alias("first"))
        out = out.join(F.broadcast(first), F.lit(True)).select("frame", (F.col("x") - F.col("first")).alias("x"))
    return out


def seed_order(frames: DataFrame, group: str, axis: str) -> DataFrame:
    """path and step of each frame: a path is a group in axis order; frames without an axis are paths alone."""
    known = F.col(axis).isNotNull()
    path = F.when(known, F.concat(F.lit("g"), F.col(group).cast("string"))).otherwise(F.concat(F.lit("f"), F.col("frame").cast("string")))
    return frames.withColumn("path", path).withColumn("step", F.row_number().over(Window.partitionBy("path").orderBy(axis, "frame")))


def frame_grid(frames: DataFrame, line: int, serpentine: bool = True, vertical: bool = False) -> DataFrame:
    """frame, row, col of a scan in lines of ``line`` frames, every other line backwards if ``serpentine``."""
    at, step = F.expr(f"CAST(floor(frame / {line}) AS INT)"), F.expr(f"CAST(frame % {line} AS INT)")
    step = F.when(at % 2 == 1, line - 1 - step).otherwise(step) if serpentine else step
    row, col = (step, at) if vertical else (at, step)
    return frames.select("frame", row.alias("row"), col.alias("col"))


def full_grid(placed: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of the grid; -1 where no frame stands."""
    spark = placed.sparkSession
    cells = spark.range(rows * cols).select(F.expr(f"CAST(floor(id / {cols}) AS INT)").alias("row"), F.expr(f"CAST(id % {cols} AS INT)").alias("col"))
    return cells.join(placed, ["row", "col"], "left").select("row", "col", F.coalesce("frame", F.lit(-1)).alias("frame"))


def grid_lines(frames: DataFrame, position: str, tolerance: float) -> DataFrame:
    """Distinct positions with the number of their grid line: a gap above the tolerance begins a new one."""
    # Stage positions are few (the grid's lines times the encoder's noise): one window over the distinct ones.
    distinct = frames.filter(F.col(position).isNotNull()).select(F.col(position).alias("x")).distinct()
    gap = F.coalesce(F.col("x") - F.lag("x").over(Window.orderBy("x")), F.lit(0.0))
    new = distinct.withColumn("new", (gap > tolerance).cast("int"))
    return new.select("x", F.sum("new").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("line"))


def auto_tolerance(frames: DataFrame, position: str) -> DataFrame:
    """The gap that parts jitter from steps: at the largest ratio of sorted gaps above 4 their geometric mean, else half the smallest."""
    distinct = frames.filter(F.col(position).isNotNull()).select(F.round(position, 9).alias("x")).distinct()
    gaps = distinct.select((F.col("x") - F.lag("x").over(Window.orderBy("x"))).alias("gap")).filter("gap > 0")
    gaps = gaps.select(F.round("gap", 9).alias("gap"))
    ratios = gaps.withColumn("before", F.lag("gap").over(Window.orderBy("gap"))).withColumn("ratio", F.col("gap") / F.col("before"))
    return ratios.agg(F.max(F.when(F.col("ratio") > 4, F.struct("ratio", "gap", "before"))).alias("jump"), F.min("gap").alias("least")).select(
        F.coalesce(F.sqrt(F.col("jump.gap") * F.col("jump.before")), F.col("least") / 2).alias("tolerance")
    )


def coordinate_grid(frames: DataFrame, tolerance: float) -> DataFrame:
    """frame, row, col from stage positions; where two frames fall into one cell the later one stays."""
    cols = grid_lines(frames, "pos_x", tolerance).select(F.col("x").alias("pos_x"), F.col("line").alias("col"))
    rows = grid_lines(frames, "pos_y", tolerance).select(F.col("x").alias("pos_y"), F.col("line").alias("row"))
    cells = frames.join(cols, "pos_x").join(rows, "pos_y").select("frame", "row", "col")
    return cells.groupBy("row", "col").agg(F.max("frame").alias("frame"))


def pressure_summary(frames: DataFrame) -> DataFrame:
    """n, parsed, fraction, least and most pressure, and whether it only rises or only falls."""
    # lag needs the order of all frames: a frame is compared with its neighbour by index instead of by one window.
    known = frames.filter("pressure IS NOT NULL").select("frame", "pressure")
    blocks = known.withColumn("block", F.expr("CAST(floor(frame / 4096) AS BIGINT)"))
    inside = blocks.withColumn("d", F.col("pressure") - F.lag("pressure").over(Window.partitionBy("block").orderBy("frame")))
    ends = blocks.groupBy("block").agg(F.min(F.struct("frame", "pressure")).alias("a"), F.max(F.struct("frame", "pressure")).alias("b"))
    across = ends.select((F.col("a.pressure") - F.lag("b.pressure").over(Window.orderBy("block"))).alias("d"))
    steps = inside.select("d").unionByName(across).filter("d IS NOT NULL")
    way = steps.agg(F.coalesce(F.bool_and(F.col("d") >= -1e-9) | F.bool_and(F.col("d") <= 1e-9), F.lit(True)).alias("monotonic"))
    counts = frames.agg(F.count(F.lit(1)).alias("n"), F.count("pressure").alias("parsed"), F.min("pressure").alias("p_min"), F.max("pressure").alias("p_max"))
    return counts.withColumn("fraction", F.when(F.col("n") > 0, F.col("parsed") / F.col("n"))).join(F.broadcast(way), F.lit(True))


def prior_offenders(frames: DataFrame, p_min: float, p_max: float, window: float) -> DataFrame:
    """Frames whose prior and window leave the range; ``outlier`` where the prior is far from the median."""
    known = frames.filter("pressure IS NOT NULL").select("frame", "pressure")
    middle = known.agg(F.median("pressure").alias("m"))
    spread = known.join(F.broadcast(middle), F.lit(True)).withColumn("dev", F.abs(F.col("pressure") - F.col("m")))
    limit = spread.agg(F.max("m").alias("m"), F.greatest(F.lit(5.0), 8 * 1.4826 * F.median("dev")).alias("limit"))
    out = known.filter((F.col("pressure") - window < p_min) | (F.col("pressure") + window > p_max))
    return out.join(F.broadcast(limit), F.lit(True)).select("frame", "pressure", (F.abs(F.col("pressure") - F.col("m")) > F.col("limit")).alias("outlier"))


def widened_range(frames: DataFrame, p_min: float, p_max: float, window: float) -> DataFrame:
    """The range widened to cover all priors and their windows."""
    return frames.agg(F.least(F.lit(p_min), F.min(F.col("pressure") - window)).alias("p_min"), F.greatest(F.lit(p_max), F.max(F.col("pressure") + window)).alias("p_max"))


def reduction_health(bins: DataFrame, channel: str) -> DataFrame:
    """For each frame: bins, missing ones, non-positive ones, and the verdict."""
    n = bins.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(channel).isNull() | F.isnan(channel)).alias("missing"), F.count_if(F.col(channel) <= 0).alias("low"))
    verdict = F.when(F.col("missing") == F.col("n"), "empty").when(F.col("low") + F.col("missing") == F.col("n"), "non-positive").when(F.col("missing") * 2 > F.col("n"), "half missing").otherwise("ok")
    return n.withColumn("verdict", verdict)


def even_sample(frames: DataFrame, n: int) -> DataFrame:
    """``n`` frames spread evenly over the ranks of the frame numbers (a report's sample)."""
    total = frames.agg(F.count(F.lit(1)).alias("total"))
    ranked = frames.select("frame").withColumn("block", F.expr("CAST(floor(frame / 4096) AS BIGINT)"))
    inside = ranked.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("frame")))
    sizes = ranked.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("block", F.coalesce(F.sum("c").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = inside.join(before, "block").select("frame", (F.col("k") + F.col("ahead") - 1).alias("rank"))
    wanted = total.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("total") - 1) / (n - 1)))).alias("rank")).distinct()
    return placed.join(F.broadcast(wanted), "rank").select("frame", "rank")
