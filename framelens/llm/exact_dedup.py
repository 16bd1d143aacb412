"""Exact deduplication by deterministic block naming.

A text without its white space is cut into blocks of ``block_bytes`` bytes. Equal blocks get equal whole
numbers and different blocks different ones: the blocks are dealt into buckets by a hash, sorted within
their bucket, and named by bucket and rank. Then neighbouring names are paired and the pairs named in the
same way, again and again, until one name a document is left. Names are given by sorting and never by
hashing, so two documents share their last level and name if and only if their texts are equal.

Only DataFrame operations. Texts are read twice: once for digests and the blocks' hashes, which are stored, and
once for the first sort, which shuffles the text; all later levels move a few numbers a document. Blocks with very
many occurrences (copies, common passages) do not enter that sort: the stored hashes tell them, and their names,
``HOT_PARTS`` at most apart from collisions of the hash, are looked up by the blocks themselves where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import HOT_PARTS, Shelf, hot_join, n_buckets, set_aside, text_of

#: The characters that are deleted before texts are compared: fixed values.
SPACES = " \t\n\x0b\x0c\r"

#: Bits of a name that hold the rank within a bucket.
RANK_BITS = 31

#: The id that stands for a null doc_id where ids are looked up.
NO_ID = -(1 << 63)


def _named(rows: DataFrame, keys: list[str], often: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``name`` in place of ``keys``: equal keys, and only these, have equal names; none is 0.

    ``often`` has keys with very many rows, ``HOT_PARTS`` at most: each has a negative name and its rows are dealt
    at random, as far as the sort goes. All other names are the bucket of the keys' hash and the rank in it.
    """
    # One row for each of at most HOT_PARTS keys: the only window without a partition, and its table is tiny.
    names = often.withColumn("_hot", -F.row_number().over(Window.orderBy(*keys)).cast("long"))
    known = rows.join(F.broadcast(names), keys, "left")
    cold = F.col("_hot").isNull()
    spread = F.when(cold, F.xxhash64(*keys)).otherwise(F.xxhash64("_row", "pos"))
    dealt = known.withColumn("_bucket", F.pmod(spread, F.lit(n_buckets(total))))
    for k in keys:
        dealt = dealt.withColumn(k, F.when(cold, F.col(k)))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*keys))
    name = F.coalesce("_hot", F.shiftleft(F.col("_bucket").cast("long"), RANK_BITS) + rank)
    return dealt.withColumn("name", name).drop("_hot", "_bucket", *keys)


def _bare(text: Column) -> Column:
    """The text without its white space; six byte searches are faster than one pass by characters."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _pieces(bare: Column, block_bytes: int) -> Column:
    """The blocks of a binary, one at least; a substring of binary counts bytes and copies only its piece."""
    last = F.greatest(F.lit(1), F.ceil(F.octet_length(bare) / F.lit(block_bytes))).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(bare, i * block_bytes + 1, F.lit(block_bytes)))


def _of_bare(make: Callable[[Column], Column]) -> Column:
    """``make`` of the bare text: as a lambda's variable, the bare text is made once."""
    return F.element_at(F.transform(F.array(_bare(text_of()).cast("binary")), make), 1)


def _row_key(digest: Column) -> Column:
    """Equal for rows with the same doc_id and bare text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), digest), 256))


def facts(docs: DataFrame, block_bytes: int = 1024) -> DataFrame:
    """``_row, doc_id, _cp`` (code points), ``text_sha256`` and ``hashes`` (of the blocks) of each row of ``docs``."""
    own = docs.select("doc_id", F.length(text_of()).cast("long").alias("_cp"), _of_bare(lambda b: F.struct(F.sha2(b, 256).alias("sha"), F.transform(_pieces(b, block_bytes), lambda p: F.xxhash64(p)).alias("hashes"))).alias("_made"))
    return own.select(_row_key(F.col("_made.sha")).alias("_row"), "doc_id", "_cp", F.col("_made.sha").alias("text_sha256"), F.col("_made.hashes").alias("hashes"))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``_row, n`` (blocks of the row)``, pos, block`` of each block."""
    own = docs.select("doc_id", _of_bare(lambda b: F.struct(F.sha2(b, 256).alias("sha"), _pieces(b, block_bytes).alias("cut"))).alias("_made"))
    return own.select(_row_key(F.col("_made.sha")).alias("_row"), F.size("_made.cut").alias("n"), F.posexplode("_made.cut").alias("pos", "block"))


def identities(docs: DataFrame, rows: DataFrame, shelf: Shelf, block_bytes: int = 1024) -> DataFrame:
    """``_row, level, name`` for each distinct (doc_id, text without white space) of ``docs``, whose facts are ``rows``.

    (level, name) is equal for two rows if and only if their texts without white space are.
    """
    size = F.size("hashes")
    sums = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.coalesce(F.max(size), F.lit(1)).alias("most")).first()
    total, most = max(1, sums["total"]), sums["most"]

    # Of each frequent hash one row's blocks are fetched; a different block with this hash is not among them and counts as rare.
    hashes = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.explode("hashes").alias("_h"))
    hot = shelf.put(hashes.groupBy("_h").count().filter(F.col("count") * HOT_PARTS >= F.lit(total)).select("_h"))
    ids = shelf.put(hashes.join(F.broadcast(hot), "_h").groupBy("_h").agg(F.min("_id").alias("_id")).select("_id").distinct())
    some = docs.join(F.broadcast(ids), F.coalesce(docs["doc_id"], F.lit(NO_ID)) == ids["_id"], "left_semi")
    often = _blocks(some, block_bytes).withColumn("_h", F.xxhash64("block")).join(F.broadcast(hot), "_h", "left_semi").select("block").distinct()

    named, level, ends = shelf.put(_named(_blocks(docs, block_bytes), ["block"], shelf.put(often), total)), 0, []
    while True:
        ends.append(named.filter("n = 1").select("_row", F.lit(level).alias("level"), "name").distinct())
        if most <= 1:
            break
        pairs = (
            named.filter("n > 1")
            .groupBy("_row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).cast("long").alias("b"))
        )
        total, most, level = max(1, -(-total // 2)), -(-most // 2), level + 1
        pairs = shelf.put(pairs)
        often = pairs.groupBy("a", "b").count().filter(F.col("count") * HOT_PARTS >= F.lit(total)).select("a", "b")
        named = shelf.put(_named(pairs, ["a", "b"], shelf.put(often), total))
        shelf.drop(pairs)
    out = ends[0]
    for x in ends[1:]:
        out = out.unionByName(x)
    return out


def _decided(docs: DataFrame, block_bytes: int) -> DataFrame:
    """For each different (doc_id, bare text, code points) of ``docs``: how often it occurs, and the decision.

    ``_row, _cp, doc_id, keep_id, group_size, stays, _times, text_sha256``; of rows that occur often, one stays.
    """
    shelf = Shelf(docs.sparkSession)
    rows = shelf.put(facts(docs, block_bytes))
    names = shelf.put(identities(docs, rows, shelf, block_bytes))
    own = rows.groupBy("_row", "doc_id", "_cp", "text_sha256").agg(F.count(F.lit(1)).alias("_times"))
    numbered = shelf.put(own.join(names, "_row"))
    shelf.drop(rows, names)
    best = F.min(F.struct((-F.col("_cp")).alias("c"), F.col("doc_id")))
    groups = shelf.put(numbered.groupBy("level", "name").agg(best.alias("_best"), F.sum("_times").alias("group_size"), F.count(F.lit(1)).alias("_n")))
    total = max(1, groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"])
    stays = (F.col("_cp") == -F.col("_best.c")) & F.col("doc_id").eqNullSafe(F.col("_best.doc_id"))
    return hot_join(numbered, groups, ["level", "name"], total).select("_row", "_cp", "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", stays.alias("stays"), "_times", "text_sha256")


def exact_dedup(docs: DataFrame, block_bytes: int = 1024) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after the six ASCII white-space characters are deleted. Of equal
    texts the row with the most code points stays, then the smallest doc_id. A null text counts as empty, and
    empty texts are equal to each other; a null doc_id comes before all others; of rows that repeat a doc_id
    and text, one stays. An empty table gives no rows. Other columns are ignored.
    """
    each = _decided(docs.select("doc_id", "text"), block_bytes).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("_time") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, block_bytes: int = 1024) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with the columns they came with.

    Of rows that repeat a doc_id, text and number of code points any one stays, whatever its other columns. Nulls, empty
    texts, ties and empty tables as in :func:`exact_dedup`.
    """
    kept = _decided(docs.select("doc_id", "text"), block_bytes).filter("stays").select("_row", "_cp")
    apart, names = set_aside(docs)
    packed = apart.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"), F.struct(*apart.columns).alias("_all"))
    rows = packed.select(_row_key(_of_bare(lambda b: F.sha2(b, 256))).alias("_row"), F.length(text_of()).cast("long").alias("_cp"), "_all")
    return rows.join(kept, ["_row", "_cp"]).dropDuplicates(["_row", "_cp"]).select(*[F.col(f"_all.{v}").alias(k) for k, v in names.items()])
