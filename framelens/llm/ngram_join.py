"""N-gram Jaccard self-join with prefix filters under several global token orders.

A document is its set of word n-grams (hashes). If two sets are similar enough, then in any global order of the
tokens their prefixes share a token: that holds for every order at once, so a pair is a candidate only if it passes
under each of them. In every order the tokens of one set alone come first; then the first order goes on by rarity,
and the others by other hashes. So a set that has many tokens alone has an empty prefix, and a passage that
many share stands at the end of the first order.

Counts: texts stay where they are and are read once. A block of documents sends its tokens, five bytes each, to the
range of hashes that each lies in; the range counts them over all different sets, and returns to each block the shared
ones and how many each set has alone. Rows are written only for ranges that a block has tokens in, so they are never more
than the tokens. A set with too few shared tokens for any partner is out.

The result is the connected components, so copies and large groups need no list of pairs. Equal sets are one
node. All nodes of a token's list are compared with its centre, the node that has least before this token; that
joins most of a large group at the cost of one pair a node and list, and the centre is then done in this list. After that
only pairs across components are made, each of a node outside the centre's component, by bands of sizes and with long lists
dealt to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import Shelf, hot_join, n_buckets, set_aside, text_of
from framelens.operators.components import connected_components

#: A block of documents has so many at most, and so many tokens beyond its last document's.
BLOCK_DOCS, BLOCK_TOKENS = 2048, 2_000_000
#: Bytes of a token beside the bits of its range, and tokens of a range of hashes.
TOKEN_BYTES, RANGE_TOKENS = 5, 2_000_000
#: The pairs of a centre are dealt to so many tasks at most.
SPREAD = 256
#: Rows that a block hands over at once, and nodes of a list that meet its others in one task.
ROWS_AT_ONCE, LIST_NODES = 4096, 1000
#: The id that stands for a null doc_id.
NO_ID = -(1 << 63)
STAR_ROUNDS = 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed) * _MIX[0]) ^ (x >> np.uint64(31))
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams; of the whole sequence where there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    seen = {} if seen is None else seen
    ids = np.empty(len(words), dtype=np.uint64)
    for k, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            if len(seen) > 500_000:
                seen.clear()
            h = seen[w] = xxhash.xxh64_intdigest(w)
        ids[k] = h
    m = max(1, len(words) - n + 1)
    out = np.full(m, min(n, len(words)), dtype=np.uint64)
    for k in range(min(n, len(words))):
        out = _mixed(out ^ ids[k : k + m], k + 1)
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """So many first tokens of a set of size n meet those of any similar set."""
    return n - -(-percent * n // 100) + 1


def prefix_of(n: Column, percent: int) -> Column:
    """:func:`prefix_length` as a column."""
    return n - F.floor((n * percent + 99) / 100) + 1


def _bits(keys: np.ndarray) -> int:
    """A signature of 64 bits: two sets that share a key share a bit, so it can only let pairs pass."""
    return int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), keys.astype(np.uint32).astype(np.uint64) & np.uint64(63)), initial=np.uint64(0)).astype(np.int64))


# --- blocks of documents and ranges of hashes


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(x: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)


def _low_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _from_low_bytes(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // TOKEN_BYTES, 8), dtype=np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(x, dtype=np.uint8).reshape(-1, TOKEN_BYTES)
    return out.reshape(-1).view("<u8")


BLOCKS = "row long, doc_id long, class_key binary, n long, block long, part long, who binary, counts binary, tokens binary"


def _blocks(n: int, bits: int) -> Callable:
    """A row for each document (its number ``row``, digest and size of its set), and one for each block and range of hashes that it has tokens in.

    ``who`` has the documents of the block with tokens in this range, ``counts`` how many each has, ``tokens`` their lower bytes.
    So a block's rows are at most as many as its tokens, however many ranges there are.
    """
    part_of, below = np.uint64(64 - bits), np.uint64(64 - bits - 8 * TOKEN_BYTES)
    mask = np.uint64((1 << (8 * TOKEN_BYTES)) - 1)

    def block_of(begin: int, ids: list, sets: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        rows = pd.DataFrame({"row": begin + np.arange(len(sets)), "doc_id": np.array(ids, dtype=np.int64), "class_key": keys, "n": sizes, "block": begin})
        yield rows.assign(part=pd.array([None] * len(rows), dtype="Int64"), who=None, counts=None, tokens=None)
        # Of equal sets of a block that of the smallest doc_id is counted: no other can stand for all of them everywhere.
        first: dict[bytes, int] = {}
        for i in np.lexsort((np.arange(len(ids)), np.array(ids, dtype=np.int64))).tolist():
            first.setdefault(keys[i], i)
        own = np.array([first[k] == i for i, k in enumerate(keys)])
        all_tokens = np.concatenate([s if o else s[:0] for s, o in zip(sets, own)])
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), np.where(own, sizes, 0))
        order = np.argsort((all_tokens >> part_of).astype(np.uint32), kind="stable")
        parts, owner, low = (all_tokens[order] >> part_of).astype(np.int64), owner[order], (all_tokens[order] >> below) & mask
        runs = np.flatnonzero((np.diff(parts, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))  # of one range and document
        who, counts = owner[runs].astype(np.uint16), np.diff(np.append(runs, len(order))).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(parts[runs], prepend=-1))  # where a range's runs begin
        for at in range(0, len(cuts), ROWS_AT_ONCE):
            begins = cuts[at : at + ROWS_AT_ONCE]
            ends = np.append(cuts[at + 1 : at + 1 + ROWS_AT_ONCE], len(runs))[: len(begins)]
            spans = list(zip(begins, ends, runs[begins], np.append(runs, len(order))[ends]))
            out = pd.DataFrame({"part": parts[runs[begins]], "who": [_packed(who[a:b]) for a, b, _, _ in spans], "counts": [_packed(counts[a:b]) for a, b, _, _ in spans]})
            out["tokens"] = [_low_bytes(low[c:d]) for _, _, c, d in spans]
            yield out.assign(row=pd.array([None] * len(out), dtype="Int64"), doc_id=pd.array([None] * len(out), dtype="Int64"), class_key=None, n=0, block=begin)[list(rows.columns) + ["part", "who", "counts", "tokens"]]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        begin, ids, sets, size = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(doc_id)
                sets.append(shingles(text, n, seen))
                size += len(sets[-1])
                if size >= BLOCK_TOKENS or len(sets) == BLOCK_DOCS:
                    yield from block_of(begin, ids, sets)
                    begin, ids, sets, size = begin + len(sets), [], [], 0
        if sets:
            yield from block_of(begin, ids, sets)

    return blocks


def _gone_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block and range of hashes the documents that have tokens there and don't stand for their sets (``others`` of the block)."""
    for batch in batches:
        out = []
        for block, part, who, others in zip(batch["block"], batch["part"], batch["who"], batch["others"]):
            gone = np.intersect1d(_unpacked(who, np.uint16), np.asarray(others, dtype=np.uint16))
            if len(gone):
                out.append((block, part, _packed(gone)))
        yield pd.DataFrame(out, columns=["block", "part", "gone"])


COUNTED = "block long, part long, who binary, alone binary, shared binary, tokens binary, often binary"


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts a range's tokens over all different sets: what each block's documents have alone there, and their shared tokens."""
    gone = {b: _unpacked(x, np.uint16) for b, x in zip(rows["block"], rows["gone"]) if x is not None}
    owners, tokens, blocks, base = [], [], [], 0
    for block, who, counts, data in zip(rows["block"], rows["who"], rows["counts"], rows["tokens"]):
        if data is None:
            continue
        who, counts = _unpacked(who, np.uint16), _unpacked(counts, np.uint32)
        flags = ~np.isin(who, gone[block]) if block in gone else np.ones(len(who), dtype=bool)
        if not flags.any():
            continue
        low = _from_low_bytes(data)
        tokens.append(low if flags.all() else low[np.repeat(flags, counts)])
        who, counts = who[flags], counts[flags]
        owners.append(base + np.repeat(np.arange(len(who)), counts))
        blocks.append((block, base, who))
        base += len(who)
    if not blocks:
        return pd.DataFrame({c: [] for c in ("block", "part", "who", "alone", "shared", "tokens", "often")})
    all_tokens, owner = np.concatenate(tokens), np.concatenate(owners)
    order = np.argsort(all_tokens, kind="stable")
    sorted_tokens = all_tokens[order]
    groups = np.append(np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]])), len(order))
    often = np.empty(len(order), dtype=np.uint32)
    often[order] = np.repeat(np.diff(groups), np.diff(groups))
    alone = np.bincount(owner[often == 1], minlength=base).astype(np.uint32)
    more = often > 1
    shared = np.bincount(owner[more], minlength=base).astype(np.uint32)
    all_tokens, often = all_tokens[more], often[more]
    ends = np.concatenate([[0], np.cumsum(shared, dtype=np.int64)])
    out = []
    for block, begin, who in blocks:
        end = begin + len(who)
        a, b = ends[begin], ends[end]
        out.append((block, rows["part"].iloc[0], _packed(who), _packed(alone[begin:end]), _packed(shared[begin:end]), _low_bytes(all_tokens[a:b]), _packed(often[a:b])))
    return pd.DataFrame(out, columns=["block", "part", "who", "alone", "shared", "tokens", "often"])


SETS = "row long, n long, low long, tokens array<long>, second array<int>, third array<int>, second_bits long, third_bits long"


def _survivors(percent: int) -> Callable:
    def survivors(rows: pd.DataFrame) -> pd.DataFrame:
        """Of a block's sets those that have shared tokens enough for a partner.

        Size, number of tokens alone, the shared ones in the first order, and the prefixes under the others without the tokens alone.
        """
        who = [_unpacked(x, np.uint16).astype(np.int64) for x in rows["who"]]
        per_part = [_unpacked(x, np.uint32) for x in rows["shared"]]
        everyone = np.concatenate(who)
        alone = np.bincount(everyone, np.concatenate([_unpacked(x, np.uint32) for x in rows["alone"]]), BLOCK_DOCS).astype(np.int64)
        shared = np.bincount(everyone, np.concatenate(per_part), BLOCK_DOCS).astype(np.int64)
        n = alone + shared
        stay = (n > 0) & (shared * 100 >= percent * n)
        owner, tokens, often = [], [], []
        for part, ids, counts, data, df in zip(rows["part"], who, per_part, rows["tokens"], rows["often"]):
            own = np.repeat(ids, counts)
            good = stay[own]
            owner.append(own[good])
            tokens.append((_from_low_bytes(data)[good] | (np.uint64(part) << np.uint64(8 * TOKEN_BYTES))).astype(np.int64))
            often.append(_unpacked(df, np.uint32)[good])
        owner, tokens, often = map(np.concatenate, (owner, tokens, often))
        order = np.lexsort((tokens, often, owner))
        owner, tokens = owner[order], tokens[order]
        out = []
        for at in np.flatnonzero(stay):
            own = tokens[np.searchsorted(owner, at) : np.searchsorted(owner, at, side="right")]
            most = max(0, prefix_length(int(n[at]), percent) - int(alone[at]))
            second, third = ((np.sort(_mixed(own.view(np.uint64), 101 + k))[:most] >> np.uint64(32)).astype(np.uint32) for k in (2, 3))
            out.append((rows["block"].iloc[0] + at, n[at], alone[at], own, second.view(np.int32), third.view(np.int32), _bits(second), _bits(third)))
        return pd.DataFrame(out, columns=["row", "n", "low", "tokens", "second", "third", "second_bits", "third_bits"])

    return survivors


# --- pairs


def _close(a: str, b: str, percent: int) -> Column:
    """What a pair's first shared token must fulfil: sizes near enough, enough tokens left behind its places, signatures of the other orders that meet."""
    na, nb, pa, pb = (F.col(f"{x}{s}") for x in ("n", "place") for s in (a, b))
    need = F.floor(((na + nb) * percent + (99 + percent)) / (100 + percent))
    meet = [F.col(f"{c}{a}").bitwiseAND(F.col(f"{c}{b}")) != 0 for c in ("second_bits", "third_bits")]
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa, nb - pb) >= need) & meet[0] & meet[1]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the filters of the other orders and whose sets are similar. ``b`` may be the same in very many."""
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("a"), F.lit(SPREAD)))
    left = dealt.join(sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "tokens", "second", "third")]), "a")
    right = dealt.select("b", "deal").distinct().join(sets.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "tokens", "second", "third")]), "b")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    passed = left.join(right, ["b", "deal"]).filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    return passed.filter(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).select("a", "b")


def _total(counted: DataFrame) -> int:
    return max(1, counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"])


LIST = ["token", "node", "n", "place", "second_bits", "third_bits"]


def _across(others: DataFrame, open_lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) across components of every list; each has a node outside the centre's component (``others``).

    A node meets those in its band of sizes and the two next to it only. The nodes on one side of a long list are dealt to
    tasks of ``LIST_NODES`` each, to which the other side goes as a whole.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / (percent - 1e-6)))).cast("int") if percent < 100 else F.col("n").cast("int")
    deals = F.ceil(F.col("_n") / LIST_NODES).cast("int")
    sides = [F.col(c) for c in (*LIST[1:], "component")]
    left = others.select("token", band.alias("band"), F.pmod(F.xxhash64("node"), deals).cast("int").alias("deal"), *[c.alias(f"{k}_a") for c, k in zip(sides, (*LIST[1:], "component"))])
    right = open_lists.select("token", F.explode(F.array(band - 1, band, band + 1) if percent < 100 else F.array(band)).alias("band"), deals.alias("deals"), (F.col("component") == F.col("component_c")).alias("central"), *[c.alias(f"{k}_b") for c, k in zip(sides, (*LIST[1:], "component"))])
    right = right.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    fits = (F.col("component_a") != F.col("component_b")) & (F.col("central") | (F.col("node_a") < F.col("node_b"))) & _close("_a", "_b", percent)
    return left.join(right, ["token", "band", "deal"]).filter(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _components_of(lists: DataFrame, sets: DataFrame, links: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """The components of the nodes that are linked by ``links`` or similar; lists is used up."""
    components = shelf.put(connected_components(links))
    for last in [False] * STAR_ROUNDS + [True]:
        marked = shelf.put(lists.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
        one = F.struct("place", *[c for c in LIST if c not in ("token", "place")], "component")
        per_list = marked.groupBy("token").agg(F.min(one).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("_n"))
        mixed = shelf.put(per_list.filter("lo < hi").select("token", "_n", *[F.col(f"c.{c}").alias(f"{c}_c") for c in (*LIST[1:], "component")]))
        if mixed.isEmpty():
            break
        open_lists = shelf.put(hot_join(marked, mixed, ["token"], _total(mixed)))
        shelf.drop(lists, marked, mixed)
        others = open_lists.filter("component <> component_c")
        if last:
            pairs = _across(others, open_lists, percent)
        else:
            own = others.toDF(*[f"{c}_a" if c in LIST[1:] else c for c in others.columns])
            pairs = own.filter(_close("_a", "_c", percent)).select(F.col("node_a").alias("a"), F.col("node_c").alias("b"))
        pairs = shelf.put(pairs.distinct())
        if not pairs.isEmpty():
            links = shelf.put(links.unionByName(_verified(pairs, sets, percent)))
            components = shelf.put(connected_components(links))
        lists = shelf.put(open_lists.filter("node <> node_c").select(*LIST))
        shelf.drop(open_lists)
    return components


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text).

    Sets are of ``n`` lower-cased (A-Z) words; a text with fewer is its whole sequence; one without words, an
    empty and a null text have an empty set and are linked with nothing. Rows are linked if their sets have a
    Jaccard similarity of ``percent`` hundredths or more, and a component is named by its smallest doc_id. Rows
    with the same doc_id are linked, as are all rows with a null doc_id, which comes before all others.
    An empty table gives no rows. Other columns are ignored.

    Tokens are compared by 40 bits of their hash and those of the range, whose number grows with the input.
    """
    shelf = Shelf(docs.sparkSession)
    slim = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = n_buckets(size // 6, RANGE_TOKENS).bit_length() - 1
    blocks = shelf.put(slim.mapInPandas(_blocks(n, bits), BLOCKS))

    # Equal sets are one node, the row of their smallest doc_id.
    own = shelf.put(blocks.filter("row IS NOT NULL").select("row", "doc_id", "class_key", "n", "block"))
    classes = shelf.put(own.filter("n > 0").groupBy("class_key").agg(F.min(F.struct("doc_id", "row", "block")).alias("rep"), F.count(F.lit(1)).alias("_n")).select("class_key", "_n", F.col("rep.row").alias("node"), "rep.doc_id", F.col("rep.block").alias("block")))
    nodes = shelf.put(hot_join(own.filter("n > 0").select("doc_id", "class_key"), classes.select("class_key", "_n", "node"), ["class_key"], _total(classes)).groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("_rows")))
    named = shelf.put(nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("_n")))
    twins = named.filter("_n > 1")
    links = shelf.put(hot_join(nodes.select("doc_id", F.col("node").alias("b")), twins, ["doc_id"], _total(twins)).filter("a <> b").select("a", "b"))

    # Rows that don't stand for their sets, BLOCK_DOCS a block at most; each range is told those with tokens in it.
    others = own.filter("n > 0").join(classes.select(F.col("node").alias("row")), "row", "left_anti")
    others = others.groupBy("block").agg(F.collect_list((F.col("row") - F.col("block")).cast("int")).alias("others"))
    sent = blocks.filter("part IS NOT NULL")
    gone = sent.select("block", "part", "who").join(others, "block").mapInPandas(_gone_rows, "block long, part long, gone binary")
    none = F.lit(None).cast("binary")
    both = sent.select("part", "block", none.alias("gone"), "who", "counts", "tokens").unionByName(gone.select("part", "block", "gone", *[none.alias(c) for c in ("who", "counts", "tokens")]))
    counted = both.groupBy("part").applyInPandas(_count, COUNTED)
    found = counted.groupBy("block").applyInPandas(_survivors(percent), SETS)
    sets = shelf.put(found.withColumnRenamed("row", "node"))
    shelf.drop(blocks)

    most = F.greatest(F.lit(0), prefix_of(F.col("n"), percent) - F.col("low")).cast("int")
    lists = sets.filter(most > 0).select("node", "n", "low", "second_bits", "third_bits", F.posexplode(F.slice("tokens", F.lit(1), most)).alias("rank", "token"))
    lists = shelf.put(lists.withColumn("place", F.col("low") + F.col("rank")).select(*LIST))
    components = _components_of(lists, sets, links, percent, shelf)

    of_node = shelf.put(classes.select("node", "doc_id").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    names = shelf.put(of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n")))
    by_node = hot_join(of_node.select("node", "component"), names, ["component"], _total(names)).select(F.col("node").alias("a"), "component_id")
    of_doc = named.select("doc_id", "a").join(by_node, "a").select("doc_id", "component_id")
    out = own.join(of_doc, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(null("doc_id"), "n_shingles", null("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component: one document of each group of similar ones.

    Of rows that repeat that doc_id all stay; rows of any other doc_id of the group go. Null, empty and blank texts have no words,
    are in no group and stay, as do all rows with a null doc_id. An empty table gives no rows.
    """
    groups = similar_groups(docs.select("doc_id", "text"), n, percent)
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    apart, names = set_aside(docs)
    return apart.join(gone, F.col(names["doc_id"]) == F.col("_gone"), "left_anti").select(*[F.col(v).alias(k) for k, v in names.items()])
