"""Mixing sources to target weights by Poisson replication.

Each source has a rate, the number of times that its documents are to occur on average: its share of the
wanted rows over its rows. A document draws its own number of copies from the Poisson distribution with that
mean, by inverting the distribution at a uniform number hashed from seed and document; so any executor
draws the same number again. The copies are exploded and all rows are shuffled by a hash of document and copy.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import hot_join, md5_number, set_aside, stored

#: Uniform numbers have so many bits.
BITS = 60


def poisson_count(rate: Column, uniform: Column) -> Column:
    """The smallest k with CDF(k) > uniform, for a Poisson distribution with mean ``rate``.

    The walk over the terms starts at exp(-rate), so rates are limited to 600, where that is still a normal
    number; ``rates`` raises beyond it.
    """
    last = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        return F.when(
            state["sum"] > uniform, state
        ).otherwise(F.struct(k.alias("k"), term.alias("term"), (state["sum"] + term).alias("sum")))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.7, rows: int | None = None) -> DataFrame:
    """A row for each source: _stratum, source, _n (its rows), rate.

    ``weights`` gives each source's share of the result (missing ones get none); without it a source weighs its
    number of rows to the ``power``. ``rows`` is the expected size of the result, by default that of ``docs``.
    """
    counts = stored(docs.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n")))
    if weights is None:
        weighed = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(power)))
    else:
        names = [("~" if k is None else f"={k}", float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(names or [("", 0.0)], "_stratum string, _w double")
        weighed = counts.join(given, "_stratum", "left").fillna(0.0, ["_w"])
    sums = weighed.agg(F.sum("_w").alias("w"), F.sum("_n").alias("n")).first()
    wanted, w = float(rows if rows is not None else sums["n"] or 0), sums["w"] or 0.0
    if w <= 0:
        return weighed.select("_stratum", "_n", F.lit(0.0).alias("rate"))
    out = weighed.select("_stratum", "_n", F.round(F.lit(wanted) * F.col("_w") / F.lit(w) / F.col("_n"), 9).alias("rate"))
    if (most := out.agg(F.max("rate")).first()[0]) and most > 600:
        raise ValueError(f"a source would be repeated {math.ceil(most)} times; 600 is the most")
    return out


def _drawn(docs: DataFrame, weights: Mapping[str | None, float] | None, power: float, rows: int | None, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """The copies in their order, with copy, n_copies and shuffle_key; the columns of ``docs`` are under the names in the dictionary."""
    safe, at = set_aside(docs)
    doc_id = F.col(at["doc_id"])
    keyed = safe.withColumn("_stratum", F.coalesce(F.concat(F.lit("="), F.col(at["source"]).cast("string")), F.lit("~")))
    table = stored(rates(keyed, weights, power, rows))
    total = table.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    uniform = md5_number(F.lit(seed), doc_id) / F.lit(float(1 << BITS))
    drawn = hot_join(keyed, table, ["_stratum"], max(1, total)).withColumn("n_copies", poisson_count(F.col("rate"), uniform))
    copies = drawn.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed_out = copies.withColumn("shuffle_key", md5_number(F.lit(seed), F.lit("at"), doc_id, F.col("copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed_out.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key"), at


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.7, rows: int | None = None, seed: int = 23) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, in a random order, with copy, n_copies and shuffle_key.

    A null source is a source of its own. Rows with the same doc_id draw the same number if their source is the same. An empty
    table, or weights that are all 0, give no rows. Columns of ``docs`` with the names of results are replaced (:func:`resample`
    keeps them). A source that would be repeated more than 600 times is an error.
    """
    dealt, at = _drawn(docs, weights, power, rows, seed)
    own = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    return dealt.select(*[F.col(at[c]).alias(c) for c in own], "copy", "n_copies", "shuffle_key")


def resample(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.7, rows: int | None = None, seed: int = 23) -> DataFrame:
    """The same rows as :func:`mix`, with just the columns of ``docs`` and their values, whatever their names."""
    dealt, at = _drawn(docs, weights, power, rows, seed)
    return dealt.select(*[F.col(v).alias(k) for k, v in at.items()])
