"""Phase libraries and structure corpora, fingerprints and candidate ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def library_union(user: DataFrame, bundled: DataFrame, key: str = "name") -> DataFrame:
    """The user's entries and the bundled ones that they don't shadow."""
    return user.unionByName(bundled.join(user.select(key), key, "left_anti"), allowMissingColumns=True)


def ordered_library(phases: DataFrame, categories: list[str]) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    return phases.withColumn("rank", F.row_number().over(Window.orderBy(F.when(place == 0, 1 << 30).otherwise(place), F.lower("name"), "name")))


def upsert(user: DataFrame, entry: DataFrame, key: str = "name") -> DataFrame:
    return user.join(entry.select(key), key, "left_anti").unionByName(entry)


def remove(user: DataFrame, bundled: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """The user's entries without the named ones; bundled names stay as they are."""
    gone = names.select(key).join(bundled.select(key), key, "left_anti")
    return user.join(gone, key, "left_anti")


def structure_filter(phases: DataFrame) -> DataFrame:
    """``phases`` with skipped: why a phase can't be simulated, null if it can."""
    why = F.when(F.col("a").isNull() | (F.col("a") <= 0), "no lattice").when(F.coalesce(F.col("space_group"), F.lit("")) == "", "no space group").when(F.coalesce(F.size("atoms"), F.lit(0)) <= 0, "no atoms")
    return phases.withColumn("skipped", why)


def corpus_dedupe(corpus: DataFrame, max_sites: int = 200, tolerance: float = 0.005) -> DataFrame:
    """file, reason: parse failure, too big, near duplicate of a kept entry, or null for those that stay.

    Near: same formula and space group and a volume within ``tolerance`` of an entry that is already kept, in the
    order of files. Of equal volumes only the first can stay, and only entries of one chain of close volumes can meet, so
    the different volumes of a chain are folded, not the groups. What a fold carries are the kept entries: volumes of
    a chain that lie ``tolerance`` apart, however many entries there are.
    """
    reason = F.when(~F.col("parse_ok"), "parse").when(F.col("n_sites") > max_sites, "sites")
    checked = corpus.withColumn("reason", reason)
    # Without a volume, below zero and at infinity an entry isn't near itself.
    own = F.when((F.col("volume") < 0) | (F.col("volume") == float("inf")), F.col("file"))
    first = checked.filter("reason IS NULL AND volume IS NOT NULL").groupBy("formula", "spacegroup", "volume", own.alias("own")).agg(F.min("file").alias("file"))
    by = Window.partitionBy("formula", "spacegroup").orderBy("volume", "file")
    apart = F.col("volume") - F.lag("volume").over(by) > tolerance * F.col("volume") * 1.02
    chained = first.withColumn("chain", F.sum(F.when(apart, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    packed = chained.groupBy("formula", "spacegroup", "chain").agg(F.array_sort(F.collect_list(F.struct("file", "volume"))).alias("v"))

    def step(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(k["volume"] - x["volume"]) <= tolerance * k["volume"])
        return F.when(near, kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate("v", F.array().cast(packed.schema["v"].dataType), step, lambda k: F.transform(k, lambda x: x["file"]))
    stays = packed.select(F.explode(kept).alias("file")).withColumn("stays", F.lit(True))
    gone = F.when(F.col("stays").isNull() & F.col("volume").isNotNull(), "duplicate")
    return checked.join(stays, "file", "left").select("file", F.coalesce("reason", gone).alias("reason"))


def fingerprints(lines: DataFrame, grid: DataFrame, fwhm: float) -> DataFrame:
    """phase, pressure, g, value: line profiles on a grid of d (g, gx), over the largest value of the phase and pressure."""
    from framelens.operators.matching import band_join

    s = fwhm / 2.3548200450309493
    hit = band_join(grid, lines.withColumnRenamed("d", "line_d"), [], "gx", F.col("line_d") - 5 * s, F.col("line_d") + 5 * s, 0.05)
    raw = hit.groupBy("phase", "pressure", "g").agg(F.sum(F.col("weight") * F.exp(-0.5 * F.pow((F.col("gx") - F.col("line_d")) / s, 2))).alias("value"))
    return raw.withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("phase", "pressure")))


#: Frames that are compared with the fingerprints at once: a fixed value.
FRAMES_AT_ONCE = 2000


def rank_candidates(features: DataFrame, prints: DataFrame, top: int = 5) -> DataFrame:
    """frame, phase, score, pressure, rank: the best cosine over a phase's pressures; frames without signal are left out.

    ``features`` (frame, g, value) and ``prints`` (phase, pressure, g, value) are sparse: only shared grid points count, and a
    phase without any has no row. The fingerprints are bounded by the library and its grid: they go to every task as one matrix.
    A frame's features are packed into one row, so nothing of the size of frames x fingerprints is ever shuffled.
    """
    rows = prints.select("phase", F.col("pressure").cast("double").alias("pressure"), "g", F.col("value").cast("double").alias("value")).toPandas()
    rows["of"] = rows.groupby(["phase", "pressure"], sort=True).ngroup()
    of = rows[["of", "phase", "pressure"]].drop_duplicates().sort_values("of")
    names, pressures, grid = of["phase"].to_numpy(), of["pressure"].to_numpy(), np.sort(rows["g"].unique())
    place = (np.searchsorted(grid, rows["g"].to_numpy()), rows["of"].to_numpy())
    matrix, seen = np.zeros((len(grid), len(of))), np.zeros((len(grid), len(of)))
    np.add.at(matrix, place, rows["value"].to_numpy())
    seen[place] = 1.0
    norms = np.sqrt((matrix * matrix).sum(axis=0))
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, dtype=int)

    def ranked(frames: np.ndarray, gs: list, values: list) -> pd.DataFrame:
        row, g, v = np.repeat(np.arange(len(frames)), [len(x) for x in gs]), np.concatenate(gs), np.concatenate(values)
        own = np.sqrt(np.bincount(row, v * v, minlength=len(frames)))
        col = np.searchsorted(grid, g)
        known = np.flatnonzero((col < len(grid)) & (grid[np.minimum(col, len(grid) - 1)] == g))
        x = np.zeros((len(frames), len(grid)))
        np.add.at(x, (row[known], col[known]), v[known])
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(x @ matrix / (own[:, None] * norms), 9)
        score[((x > 0) @ seen == 0) | np.isnan(score)] = -np.inf
        # Of equal scores the lowest pressure, which comes first, and then the first name.
        best = np.stack([i + np.argmax(score[:, i:j], axis=1) for i, j in zip(starts, [*starts[1:], len(names)])], axis=1)
        scores = np.take_along_axis(score, best, axis=1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
        best, scores = np.take_along_axis(best, order, axis=1).ravel(), np.take_along_axis(scores, order, axis=1).ravel()
        out = pd.DataFrame({"frame": np.repeat(frames, order.shape[1]), "phase": names[best], "score": scores, "pressure": pressures[best], "rank": np.tile(np.arange(1, order.shape[1] + 1, dtype="int32"), len(frames))})
        return out[np.isfinite(scores)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch) if len(names) else 0, FRAMES_AT_ONCE):
                part = batch.iloc[k : k + FRAMES_AT_ONCE]
                yield ranked(part["frame"].to_numpy(), part["g"].tolist(), part["value"].tolist())

    own = features.filter("value > 0").groupBy("frame").agg(F.collect_list(F.struct("g", F.col("value").cast("double").alias("value"))).alias("p"))
    types = {k: d.schema[k].dataType.simpleString() for d, k in ((features, "frame"), (prints, "phase"))}
    return own.select("frame", F.col("p.g").alias("g"), F.col("p.value").alias("value")).mapInPandas(run, f"frame {types['frame']}, phase {types['phase']}, score double, pressure double, rank int")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) hashed from seed and row: the same wherever the row is."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / float(1 << 30)


def training_pairs(truth: DataFrame, phases: DataFrame, seed: int = 7, move: float = 10.0, least: float = 5.0, ceiling: float = 100.0) -> DataFrame:
    """frame, phase, pressure, label for labelled frames (frame, phase, pressure): the truth, a wrong pressure, an absent phase."""
    u = uniform(seed, F.col("frame"), F.col("phase"))
    wrong = F.greatest(F.lit(0.0), F.least(F.lit(ceiling), F.col("pressure") + F.when(u < 0.5, -move).otherwise(move)))
    positive = truth.select("frame", "phase", "pressure", F.lit(1).alias("label"))
    moved = truth.withColumn("w", wrong).filter(F.abs(F.col("w") - F.col("pressure")) >= least).select("frame", "phase", F.col("w").alias("pressure"), F.lit(0).alias("label"))
    absent = truth.select("frame", "pressure").join(F.broadcast(phases.select("phase")), F.lit(True)).join(truth.select("frame", "phase"), ["frame", "phase"], "left_anti")
    first = Window.partitionBy("frame").orderBy(uniform(seed + 1, F.col("frame"), F.col("phase")), "phase")
    one = absent.withColumn("k", F.row_number().over(first)).filter("k = 1").select("frame", "phase", "pressure", F.lit(0).alias("label"))
    return positive.unionByName(moved).unionByName(one)


def augment_patterns(patterns: DataFrame, copies: int = 2, seed: int = 11, jitter: float = 0.2, noise: float = 0.02, dropout: float = 0.1, drift: int = 2) -> DataFrame:
    """sample, copy, y: each array changed by drift, dropout, intensity jitter and noise drawn from hashes of the sample."""
    own = patterns.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    shift = F.floor(uniform(seed, F.col("sample"), F.col("copy")) * (2 * drift + 1)).cast("int") - drift
    n = F.size("y")

    def value(v: Column, i: Column) -> Column:
        at = F.least(n - 1, F.greatest(F.lit(0), i + F.col("shift")))
        base = F.get(F.col("y"), at)
        kept = F.when(uniform(seed + 1, F.col("sample"), F.col("copy"), i) < dropout, 0.0).otherwise(base)
        scaled = kept * F.exp(jitter * (2 * uniform(seed + 2, F.col("sample"), F.col("copy"), i) - 1))
        return F.greatest(F.lit(0.0), scaled + noise * (2 * uniform(seed + 3, F.col("sample"), F.col("copy"), i) - 1))

    changed = own.withColumn("shift", shift).withColumn("z", F.transform("y", value))
    top = F.array_max("z")
    return changed.select("sample", "copy", F.transform("z", lambda v: v / F.when(top > 0, top).otherwise(1.0)).alias("y"))


def pair_scorer(pairs: DataFrame, features: list[str], seed: int = 5):
    """A fitted model (logistic regression on ``features`` of a pair) that scores frame and candidate."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), LogisticRegression(labelCol="label", maxIter=30, regParam=0.01)]).fit(pairs)
