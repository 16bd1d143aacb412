"""Sharding by proportional stratified interleaving.

Within each source the rows are ranked in a seeded random order; rank and size of the source give every row
a fraction between 0 and 1; all rows are sorted by that fraction and the sorted sequence is cut into shards
of equal row counts (law ``rows``). As each source is spread evenly over the fractions, every shard holds the
mixture of the whole.

No source is ranked in one task: its rows fall into buckets of the random number that orders them, a rank is
the count of the buckets before (a sum over a small table) plus the rank within the bucket. The global
position is found in the same way over buckets of the fraction. Only numbers are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import hot_join, md5_number, n_buckets, set_aside, stored, text_of

#: Random numbers are below 2 to the power of this.
RANDOM_BITS = 60


def row_bytes(column: str = "text") -> Column:
    """The size of a row: UTF-8 bytes of its text (null: none) and 16 for the rest."""
    return F.octet_length(text_of(column)).cast("long") + 16


def interleaved(docs: DataFrame, strata: str = "source", seed: int = 17) -> DataFrame:
    """All columns of ``docs``, with ``position__`` (0 to rows - 1) in the interleaved order and ``rows__``.

    A source (null is one too) starts at a random phase, so that small sources don't meet at one place. Ties
    are ordered by checksum, size and doc_id; rows that tie in all of them are copies of each other.
    """
    rows = max(1, docs.count())
    buckets = n_buckets(rows)
    bits = buckets.bit_length() - 1
    own, at = set_aside(docs)
    doc_id, crc = F.col(at["doc_id"]), F.crc32(text_of(at["text"]))
    keyed = own.withColumn("_stratum", F.coalesce(F.concat(F.lit("="), F.col(at[strata]).cast("string")), F.lit("~"))).withColumn("_random", md5_number(F.lit(seed), doc_id, crc))
    keyed = keyed.withColumn("_crc", crc).withColumn("_size", row_bytes(at["text"])).withColumn("_bucket", F.shiftright("_random", RANDOM_BITS - bits))

    # A row for each source and bucket: small, so its windows are.
    counts = stored(keyed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    of_source = Window.partitionBy("_stratum")
    offsets = (
        counts.withColumn("_of", F.sum("_n").over(of_source))
        .withColumn("_before", F.sum("_n").over(of_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_stratum", "_bucket", "_n", "_of", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    tie = ["_random", "_crc", "_size", at["doc_id"]]
    within = Window.partitionBy("_stratum", "_bucket").orderBy(*tie)
    ranked = hot_join(keyed, offsets, ["_stratum", "_bucket"], rows).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    phase = md5_number(F.lit(seed), F.lit("phase"), F.col("_stratum")) / float(1 << RANDOM_BITS)
    placed = ranked.withColumn("_fraction", (F.col("_rank") + phase) / F.col("_of")).withColumn("_slice", F.least(F.lit(buckets - 1), F.floor(F.col("_fraction") * buckets)).cast("int"))

    # One row a slice, as many slices as buckets: the one window without a partition is over these.
    slices = stored(placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_in")))
    ahead = slices.withColumn("_ahead", F.coalesce(F.sum("_in").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    in_slice = Window.partitionBy("_slice").orderBy("_fraction", "_stratum", *tie)
    # At most 2^20 slices of two numbers: the broadcast is bounded.
    done = placed.withColumn("_at", F.row_number().over(in_slice)).join(F.broadcast(ahead), "_slice").withColumn("_position", F.col("_ahead") + F.col("_at") - 1)
    return done.select(*[F.col(n).alias(c) for c, n in at.items()], F.col("_crc").alias("crc__"), F.col("_size").alias("size__"), F.col("_position").alias("position__"), F.lit(rows).cast("long").alias("rows__"))


def shard(docs: DataFrame, shards: int = 40, strata: str = "source", seed: int = 17) -> DataFrame:
    """The rows and columns of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``rows``: the row counts of two shards differ by one at most; ``slot`` counts the rows of a shard
    from 0 without gaps; ``grown_shard`` is null under this law. A null text counts as empty, null sources
    make a source of their own, repeated rows are rows like any other, and an empty table gives no rows.
    Columns of ``docs`` that have the names of results are replaced.
    """
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    # Shard s holds the positions from ceil(s * rows / shards); whole numbers only, to be exact at any size.
    which = F.expr(f"(position__ * {shards}) div rows__")
    placed = interleaved(docs.select(*[F.col(f"`{c}`") for c in own]), strata, seed).withColumn("shard__", which)
    first = F.expr(f"(shard__ * rows__ + {shards - 1}) div {shards}")
    return placed.select(
        *[F.col(f"`{c}`") for c in own], F.col("size__").alias("size"), F.col("crc__").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard__").cast("int").alias("shard"), (F.col("position__") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, strata: str = "source", seed: int = 17) -> None:
    """Write each shard to a folder of its own, its rows in the order of their slots."""
    placed = shard(docs, shards, strata, seed)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
