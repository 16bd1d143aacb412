"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.shared import Shelf, hot_join


def _stars(edges: DataFrame, large: bool, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """One step: every node sends its larger (or smaller) neighbours to the smallest node it knows.

    The new edges, and the table of smallest neighbours that they are read from.
    """
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = shelf.put(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n")))
    total = max(1, least.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"])
    joined = hot_join(pairs, least, ["u"], total)
    if large:
        out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        own = least.filter("m < u").select(F.col("m").alias("a"), F.col("u").alias("b"))
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(own)
    return out.filter("a <> b").distinct(), least


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, component`` of every node in ``edges`` (a, b: long); a component is named by its smallest node.

    Alternating large and small stars: the rounds grow with the logarithm of the longest path, every round
    moves the edges once, and each is written to the shared folder, so lost executors cost one round at most.
    """
    shelf = Shelf(edges.sparkSession)
    now = shelf.put(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        for large in (True, False):
            old, (new, least) = now, _stars(now, large, shelf)
            now = shelf.put(new)
            shelf.drop(old, least)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
