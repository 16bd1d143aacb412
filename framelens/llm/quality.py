"""Quality rules: surface counts, and perplexity under a character n-gram model of the corpus itself.

For each language Spark counts the trigrams of whole code points (21 bits each, so a trigram is exactly one long;
only white space is made alike) of all documents. The model is modified Kneser-Ney, interpolated, of order 3: a table, as
large as the corpus makes it, with for each n-gram its count (for the lower orders: the number of different symbols before
it), the sum after its context, and how many symbols follow the context once, twice and more often. It is never gathered:
documents lie in blocks of some megabytes, and each block is sent the rows of its own n-grams, as sorted arrays of keys.

A document is scored by the counts of all other documents: its own are taken off counts, sums and numbers of followers
exactly, or else the rare characters of noise, which only the document itself has, would seem certain. The discounts of a
language come from all its counts. From the scores a histogram is counted for each language, and its quartiles give
the band of perplexities, far below the first and far above the third quartile, outside which a document is
rejected. Every language, however rare, has counts and a band of its own; a null language is one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import Shelf, hot_join, set_aside, text_of

BLANK = 32

#: A code point's bits, what stands before and after a text (no text has them), and the number of choices.
POINT_BITS = 21
BEFORE, AFTER, POINTS = 0x1FFFFE, 0x1FFFFF, 1 << 21
TWO, ONE = (1 << (2 * POINT_BITS)) - 1, (1 << POINT_BITS) - 1

#: Symbols that count as junk: fixed values.
JUNK = b"#*$%&|<>"

#: Words of a window that counts as repeated, and the base's limits: fixed values.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20

#: Log perplexities are counted in bins of this width; the band reaches so many quartile distances outward.
BIN = 0.002
REACH = 4.0
#: The least quartile distance: one language may have scores that hardly differ.
LEAST_IQR = 0.03

#: Characters of a block of documents, beyond the last document; and those scored at once.
BLOCK_CHARS, SCORED_CHARS = 12 << 20, 1 << 20

#: Rows of the model that are packed at once for the blocks.
PACKED_ROWS = 1 << 20


# --- surface counts


def surface(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() cuts at exactly the six ASCII white-space characters
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(joined) - len(joined.translate(None, JUNK))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words within windows of ``n`` words that occur twice or more in the text, first occurrences included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        key = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m] + np.uint64(1)
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    # Equal hashes only nominate windows; the words themselves decide.
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    seen: dict[tuple, int] = {}
    windows = [tuple(ids[i : i + n].tolist()) for i in suspects]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = np.zeros(len(words), dtype=bool)
    for i, w in zip(suspects, windows):
        if seen[w] > 1:
            covered[i : i + n] = True
    return int(covered.sum())


# --- the counts


def points_of(text: str) -> np.ndarray:
    """The code points of a text, two BEFORE and one AFTER it; runs of white space are one blank."""
    out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (out <= BLANK) | (out == 160)
    out = np.where(blank, BLANK, out)
    out = out[~(blank & np.concatenate([[False], blank[:-1]]))] if len(out) else out
    return np.concatenate([[BEFORE, BEFORE], out, [AFTER]]).astype(np.int64)


def point_trigrams(text: str) -> np.ndarray:
    s = points_of(text)
    return (s[:-2] << (2 * POINT_BITS)) | (s[1:-1] << POINT_BITS) | s[2:]


BLOCKS = "block long, doc_ids array<string>, row_keys array<binary>, langs array<string>, sizes array<int>, texts binary"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each block: neighbours of a task, BLOCK_CHARS or one document, their texts compressed together."""
    block, rows, size = TaskContext.get().partitionId() << 32, [], 0

    def packed() -> pd.DataFrame:
        texts = [x[3] for x in rows]
        data = zstandard.ZstdCompressor(level=7).compress(b"".join(texts))
        return pd.DataFrame([(block, *[[x[k] for x in rows] for k in range(3)], [len(x) for x in texts], data)], columns=["block", "doc_ids", "row_keys", "langs", "sizes", "texts"])

    for batch in batches:
        for *own, text in batch[["doc_id", "row_key", "model_lang", "text"]].itertuples(index=False, name=None):
            rows.append((*own, text.encode("utf-8", "surrogatepass")))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield packed()
                block, rows, size = block + 1, [], 0
    if rows:
        yield packed()


def _texts(packed: bytes, sizes: list[int]) -> Iterator[str]:
    data, at = zstandard.ZstdDecompressor().decompress(packed), 0
    for n in sizes:
        yield data[at : at + n].decode("utf-8", "surrogatepass")
        at += n


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each block, language and trigram of the texts at hand: Spark's own aggregation adds them up."""
    for batch in batches:
        for block, langs, sizes, packed in zip(batch["block"], batch["langs"], batch["sizes"], batch["texts"]):
            waiting: dict[str, list] = {}
            size: dict[str, int] = {}
            for lang, text in zip(langs, _texts(packed, sizes)):
                waiting.setdefault(lang, []).append((point_trigrams(text), None))
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= SCORED_CHARS:
                    waiting[lang], size[lang] = [_added(waiting[lang])], 0
            for lang, parts in waiting.items():
                grams, n = _added(parts)
                yield pd.DataFrame({"block": block, "model_lang": lang, "gram": grams, "n": n})


def _added(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of several arrays and their counts; without counts each n-gram is one."""
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.bincount(back, np.concatenate([np.ones(len(g)) if n is None else n for g, n in parts]))
    return grams, n.astype(np.int64)


ROW = ["c", "t", "n1", "n2", "n3"]


def model_tables(counts: DataFrame, shelf: Shelf) -> tuple[dict[int, DataFrame], DataFrame]:
    """For each order ``model_lang, key, c, t, n1, n2, n3``; and ``model_lang, key`` (the order) with the numbers of n-grams that count 1 to 4.

    c is the count of the n-gram, t the sum over its context, n1 to n3 how many of the context's n-grams count 1, 2 and more.
    """
    lang, c = "model_lang", F.col("c")
    grams = shelf.put(counts.groupBy(lang, F.col("gram").alias("key")).agg(F.sum("n").alias("c")))
    orders, met = {}, []
    for order in (3, 2, 1):
        context = F.shiftright("key", POINT_BITS)
        after = grams.groupBy(lang, context.alias("context")).agg(F.sum("c").alias("t"), *[F.count_if(x).alias(f"n{i}") for i, x in ((1, c == 1), (2, c == 2), (3, c > 2))])
        orders[order] = grams.withColumn("context", context).join(after, [lang, "context"]).select(lang, "key", *ROW)
        met.append(grams.groupBy(lang).agg(*[F.count_if(c == i).alias(x) for i, x in enumerate(ROW[:4], 1)]).select(lang, F.lit(order).cast("long").alias("key"), *ROW[:4], F.lit(0).cast("long").alias("n3")))
        if order > 1:
            mask = TWO if order == 3 else ONE
            grams = shelf.put(grams.groupBy(lang, F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count(F.lit(1)).alias("c")))
    return orders, met[0].unionByName(met[1]).unionByName(met[2])


PACKED = "block long, model_lang string, part int, data binary"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model's rows of each block and language as compressed arrays: order, key, and the numbers of ROW.

    Rows wait as whole numbers, a language as its place in ``langs``: some 150 bytes a row at most.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    waiting, size, langs = [], 0, {}

    def told() -> pd.DataFrame:
        table = np.concatenate(waiting, axis=1)
        waiting.clear()
        table = table[:, np.lexsort((table[3], table[2], table[1], table[0]))]
        cuts = np.flatnonzero((np.diff(table[0]) != 0) | (np.diff(table[1]) != 0)) + 1
        names, out = list(langs), []
        for lo, hi in zip([0, *cuts], [*cuts, table.shape[1]]):
            own = table[2:, lo:hi].copy()
            own[1] = np.diff(own[1], prepend=0)
            out.append((int(table[0, lo]), names[table[1, lo]], hi - lo, pack(own.tobytes())))
        return pd.DataFrame(out, columns=["block", "model_lang", "part", "data"])

    for batch in batches:
        codes, met = pd.factorize(batch["model_lang"])
        codes = np.array([langs.setdefault(x, len(langs)) for x in met], dtype=np.int64)[codes]
        waiting.append(np.stack([batch["block"].to_numpy(np.int64), codes, *[batch[x].to_numpy(np.int64) for x in ("ord", "key", *ROW)]]))
        size += len(batch)
        if size >= PACKED_ROWS:
            yield told()
            size = 0
    if size:
        yield told()


# --- scores by all other documents


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of n-grams that count 1 to 4; usual values where one of the first three is missing."""
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.concatenate([[0.0], np.clip(d, 0.05, [0.95, 1.9, 2.9])])


def _level(keys: np.ndarray, gone: np.ndarray, rows: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of a document's n-grams without its own counts, given the lower order's.

    ``keys`` are sorted and distinct, ``gone`` is what they lose without the document, ``rows`` has their c, t, n1, n2, n3.
    """
    context = keys >> POINT_BITS
    group = np.cumsum(np.concatenate([[True], context[1:] != context[:-1]])) - 1
    c, t = rows[0] - gone, rows[1] - np.bincount(group, gone)[group]
    mass = np.zeros(len(keys))
    for k in (1, 2, 3):
        was, now = np.minimum(rows[0], 3) == k, np.minimum(c, 3) == k
        mass += discount[k] * (rows[1 + k] + np.bincount(group, now.astype(float) - was)[group])
    return np.where(t > 0, (c - discount[np.minimum(c, 3).astype(np.int64)] + mass * lower) / np.maximum(t, 1), lower)


def document_score(grams: np.ndarray, table: dict[int, tuple[np.ndarray, np.ndarray]], discount: dict[int, np.ndarray]) -> float:
    """The mean negative log probability of a text's trigrams by all other texts; ``table`` has each order's sorted keys and their rows."""
    keys3, n = np.unique(grams, return_counts=True)
    keys2, back2 = np.unique(keys3 & TWO, return_inverse=True)
    keys1, back1 = np.unique(keys2 & ONE, return_inverse=True)
    rows = {k: table[k][1][:, np.searchsorted(table[k][0], x)] for k, x in ((3, keys3), (2, keys2), (1, keys1))}
    gone2 = np.bincount(back2, rows[3][0] == n)
    gone1 = np.bincount(back1, rows[2][0] == gone2)
    p1 = _level(keys1, gone1, rows[1], discount[1], np.full(len(keys1), 1.0 / POINTS))
    p2 = _level(keys2, gone2, rows[2], discount[2], p1[back1])
    p3 = _level(keys3, n, rows[3], discount[3], p2[back2])
    return -float((n * np.log(p3)).sum()) / len(grams)


# --- scores and bands


FEATURES = "doc_id long, row_key binary, model_lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def _scored(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """The features of a block's documents by the model's rows of its n-grams."""
    tables, discount = {}, {}
    for lang, own in model.groupby("model_lang"):
        parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.int64).reshape(2 + len(ROW), n).copy() for n, x in zip(own["part"], own["data"])]
        for x in parts:
            x[1] = np.cumsum(x[1])
        whole = np.concatenate(parts, axis=1)
        whole = whole[:, np.lexsort((whole[1], whole[0]))]
        tables[lang] = {k: (whole[1, whole[0] == k], whole[2:, whole[0] == k]) for k in (1, 2, 3)}
        discount[lang] = {int(k): discounts(*row[:4]) for k, row in zip(whole[1, whole[0] == 0], whole[2:, whole[0] == 0].T)}
    found = []
    for doc_ids, row_keys, langs, sizes, packed in zip(*[rows[c] for c in ("doc_ids", "row_keys", "langs", "sizes", "texts")]):
        for doc_id, row_key, lang, text in zip(doc_ids, row_keys, langs, _texts(packed, sizes)):
            base = surface(text)
            found.append((doc_id, row_key, lang, *base, document_score(point_trigrams(text), tables[lang], discount[lang]) if base[0] else None))
    return pd.DataFrame(found, columns=["doc_id", "row_key", "model_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"])


def features(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """The surface counts and the log perplexity (null without words) of each document (doc_id, row_key, model_lang, text)."""
    # Stored: the blocks must stay as they are. Null ids and long ids don't go through pandas as floats: doc_id travels as text.
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "row_key", "model_lang", "text")
    blocks = shelf.put(slim.mapInPandas(_blocks, BLOCKS))
    counts = shelf.put(blocks.mapInPandas(_counted, "block long, model_lang string, gram long, n long"))
    orders, met = model_tables(counts, shelf)
    wanted = counts.select("block", "model_lang", F.col("gram").alias("key"))  # each once: a block is counted as a whole
    sent = wanted.select("block", "model_lang").distinct().join(met, "model_lang").withColumn("ord", F.lit(0))
    for order, mask in ((3, None), (2, TWO), (1, ONE)):
        own = wanted if mask is None else wanted.select("block", "model_lang", F.col("key").bitwiseAND(F.lit(mask)).alias("key")).distinct()
        sent = sent.unionByName(own.join(orders[order], ["model_lang", "key"]).withColumn("ord", F.lit(order)))
    packed = sent.mapInPandas(_packed, PACKED)
    scored = blocks.groupBy("block").cogroup(packed.groupBy("block")).applyInPandas(_scored, FEATURES.replace("doc_id long", "doc_id string"))
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def bands(scored: DataFrame, reach: float = REACH) -> DataFrame:
    """model_lang, low and high log perplexity of each language, from a histogram over all documents that pass the base."""
    bins = scored.filter(~base_failed() & F.col("log_ppl").isNotNull()).groupBy("model_lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Log perplexities lie between 0 and some 40, so a language has some 20,000 bins at most.
    up = F.sum("n").over(Window.partitionBy("model_lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    own = bins.withColumn("up", up).withColumn("all", F.sum("n").over(Window.partitionBy("model_lang")))
    q1, q3 = ((F.min(F.when(F.col("up") >= q * F.col("all"), F.col("bin"))) + 0.5) * BIN for q in (0.25, 0.75))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_IQR))
    return own.groupBy("model_lang").agg(q1.alias("q1"), q3.alias("q3")).select("model_lang", (F.col("q1") - reach * wide).alias("low"), (F.col("q3") + reach * wide).alias("high"))


def row_key(names: dict[str, str] | None = None) -> Column:
    """Equal for rows with the same doc_id, language and text; ``names`` tells what these columns are called."""
    doc_id, lang, text = ((names or {}).get(c, c) for c in ("doc_id", "lang", "text"))
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.coalesce(F.col(lang).cast("string"), F.lit("~")), text_of(text)), 256))


def judged(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The features of each row of ``docs`` with base_failed and kept."""
    lang = F.col("lang").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), lang), F.lit("~")).alias("model_lang"), text_of().alias("text"), row_key().alias("row_key"))
    shelf = Shelf(docs.sparkSession)
    scored = shelf.put(features(slim, shelf))
    sizes = scored.groupBy("model_lang").agg(F.count(F.lit(1)).alias("_n"))
    known = shelf.put(sizes.join(bands(scored, reach), "model_lang", "left"))
    own = hot_join(scored, known, ["model_lang"], scored.count())
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return own.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """A row for each document (doc_id, text, lang): the counts, base_failed, kept and log_ppl.

    A null text counts as empty; without words there is no perplexity and the base fails. A null language is
    a language of its own. Repeated rows are counted and judged like any other, and an empty
    table gives no rows. Other columns are ignored.
    """
    return judged(docs, reach).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_ppl", 6).alias("log_ppl"))


def keep_good(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with the columns they came with, whatever their names.

    Nulls, empty texts, repeated rows and empty tables as in :func:`quality_rules`: null and empty texts go, repeats stay or go together.
    """
    good = judged(docs, reach).filter("kept").select(F.col("row_key").alias("_row_key")).distinct()
    apart, names = set_aside(docs)
    return apart.withColumn("_row_key", row_key(names)).join(good, "_row_key", "left_semi").select(*[F.col(v).alias(k) for k, v in names.items()])
