"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.operators.shared import HOT_PARTS, Shelf, hot_join, scratch, stored

__all__ = ["HOT_PARTS", "Shelf", "hot_join", "md5_number", "n_buckets", "scratch", "set_aside", "stored", "text_of"]


def text_of(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns under names that clash with none of ours, and what each column is called now."""
    names = [f"in{i}__" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def n_buckets(rows: int, per_bucket: int = 20_000, least: int = 64, most: int = 1 << 20) -> int:
    """A power of two of buckets that hold about ``per_bucket`` of ``rows`` each."""
    n = least
    while n < most and n * per_bucket < rows:
        n *= 2
    return n


def md5_number(*parts: Column) -> Column:
    """A uniform whole number below 2^60 made of the first 15 hexadecimal digits of an MD5; the same in any engine."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
