"""URL filters: path rules, and exact list membership by a cascade of Bloom filters.

The first filter of the cascade encodes the listed keys. The second encodes the keys of the corpus that are
not listed and yet pass the first, the third the listed keys that pass the second, and so on until no key is
wrong. As the cascade is built against all keys of the corpus, its answer is exact for each of them, and
a page is judged from a few bits in memory, without a join with the list. The keys are the host of a page and
its parent domains.

What is broadcast are the filters' bits, at most ``MOST_BITS`` a filter: fewer bits for a key make the cascade
longer, never wrong. The keys themselves stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import stored

#: Bits of the largest filter: 256 MB.
MOST_BITS = 1 << 31
BITS_A_KEY, HASHES = 10, 5

#: Rules as (verdict, host, start of the path): fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The blocklist of the registered query: fixed values, each name under each ending.
LISTED_NAMES = ("spam-farm", "cheap-pills", "casino-win", "ads-track", "adult-x", "free-bets")
LISTED_ENDINGS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{ending}" for name, ending in product(LISTED_NAMES, LISTED_ENDINGS))

_MIX = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """verdict and rule of the longest rule that fits host (or a parent of it) and path; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule"))).otherwise(out)
    return out


def domains(host: Column) -> Column:
    """A host and its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def _places(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    """HASHES places below ``bits`` for each key, from two 64-bit hashes of it."""
    with np.errstate(over="ignore"):
        x = (a ^ (_MIX * np.uint64(2 * level + 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        y = ((b + _MIX * np.uint64(level)) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        return (x[:, None] + y[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def _passes(words: np.ndarray, bits: int, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    at = _places(a, b, level, bits)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(dtype=np.int64).view(np.uint64)


def _filter(keys: DataFrame, n: int, level: int) -> tuple[int, np.ndarray]:
    """The Bloom filter over ``keys`` (a, b); its words are OR-ed together by Spark."""
    bits = min(MOST_BITS, max(64, n * BITS_A_KEY))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = np.unique(_places(_unsigned(x["a"]), _unsigned(x["b"]), level, bits))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                yield pd.DataFrame({"word": word.astype(np.int64), "mask": np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start).view(np.int64)})

    rows = keys.select("a", "b").mapInPandas(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(-(-bits // 64), dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = _unsigned(rows["mask"])
    return bits, out


def cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> list[tuple[int, np.ndarray]]:
    """The filters for ``listed`` (key) that are exact on all of ``universe`` (key)."""
    hashes = [F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b")]
    names = listed.filter("key is not null").select("key").distinct()
    inside = stored(names.select("key", *hashes))
    outside = stored(universe.filter("key is not null").select("key").distinct().join(names, "key", "left_anti").select("key", *hashes))
    sides, levels = [inside, outside], []
    for level in range(most_levels):
        own = sides[level % 2]
        n = own.count()
        if not n and level:
            return levels
        levels.append(_filter(own, n, level))
        bits, words = levels[-1]
        sent = own.sparkSession.sparkContext.broadcast(words)

        def wrong(batches: Iterator[pd.DataFrame], bits=bits, sent=sent, level=level) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield x[_passes(sent.value, bits, _unsigned(x["a"]), _unsigned(x["b"]), level)]

        other = sides[(level + 1) % 2]
        sides[(level + 1) % 2] = stored(other.mapInPandas(wrong, other.schema))
    raise ValueError(f"keys are still wrong after {most_levels} filters: two keys may share both hashes")


def listed_flag(levels: list[tuple[int, np.ndarray]], spark) -> object:
    """A function of two columns, the arrays of both hashes of a row's keys: is any of the keys listed?"""
    sent = spark.sparkContext.broadcast(levels)

    def inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alive, out = np.ones(len(a), dtype=bool), np.full(len(a), len(sent.value) % 2 == 1)
        for level, (bits, words) in enumerate(sent.value):
            at = np.flatnonzero(alive)
            gone = at[~_passes(words, bits, a[at], b[at], level)]
            out[gone] = level % 2 == 1
            alive[gone] = False
        return out

    @F.pandas_udf("boolean")
    def any_listed(a: pd.Series, b: pd.Series) -> pd.Series:
        n = a.map(len).to_numpy()
        flat = [np.concatenate([np.asarray(x, dtype=np.int64) for x in s] or [np.zeros(0, np.int64)]).view(np.uint64) for s in (a, b)]
        row = np.repeat(np.arange(len(a)), n)
        return pd.Series(np.bincount(row, inside(*flat), len(a)) > 0)

    return any_listed


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, listed.

    The longest rule that fits decides; where none does, a page is blocked if its host or a parent domain of it
    is in ``listed`` (key), and allowed otherwise. A null url and one without ``://`` have an empty host and
    path, fit no rule and are allowed. Repeated rows and ids are judged alike; an empty table gives no rows and
    an empty list blocks nothing. Other columns are ignored.
    """
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = at.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    levels = cascade(listed, universe)
    flag = listed_flag(levels, pages.sparkSession)
    keys = domains(F.col("host"))
    hashes = [F.transform(keys, lambda k: F.xxhash64(F.lit(1), k)), F.transform(keys, lambda k: F.xxhash64(F.lit(2), k))]
    judged = at.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("listed", flag(*hashes))
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )


