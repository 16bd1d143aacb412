"""A Merkle manifest of a dataset: a postorder append log, and proofs read from it by closed-form positions.

Each source has a tree over its rows in the order of doc_id, 16 children a node; the roots of the sources are the leaves
of one more tree. A tree's log has its nodes in the order in which they are completed: a node stands right after its
subtree. So the place of node ``index`` of a ``level`` follows from subtree sizes alone (:func:`positions`), and the log
needs no pointers: siblings are found by computing where they stand.

A builder takes an aligned range of 16^3 leaves, appends them one by one and writes each node when its last child is there;
its part of the log is contiguous. The roots of these ranges are the leaves of the next round, again in aligned ranges,
so a tree of n leaves takes log n / log 4096 rounds and no task ever holds more than one range. Proofs go the other way: a
range hands each child range the siblings above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import Shelf

#: Children of a node, levels that a builder adds to its leaves, and the leaves of its range.
FAN, LEVELS = 16, 3
RANGE = FAN**LEVELS
#: Fields of a leaf, in this order: fixed values.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every so many-th crc32 of a decimal doc_id marks a row whose text is changed to see that its proof fails.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(joined: bytes) -> bytes:
    """The digest of joined inputs, as lowercase hexadecimal letters."""
    return hashlib.sha256(joined).hexdigest().encode()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def positions(level: int, index: np.ndarray, n: int) -> np.ndarray:
    """Where the nodes ``index`` of a ``level`` stand in the log of a tree of ``n`` leaves.

    Before a node's subtree stand the complete subtrees to its left, one run of siblings for each digit of its first leaf
    in base 16; then its subtree, which has ceil(r / 16^k) nodes on level k over its r leaves, itself the last.
    """
    index = np.asarray(index, dtype=np.int64)
    first = index * FAN**level
    out = np.full(len(index), -1, dtype=np.int64)
    for k in range(level, height(n) + 1):
        out += (first // FAN**k) % FAN * ((FAN ** (k + 1) - 1) // (FAN - 1))
    leaves = np.minimum(FAN**level, n - first)
    for k in range(level + 1):
        out += -(-leaves // FAN**k)
    return out


# --- leaves


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(docs: DataFrame, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(text if c == "text" else docs[c]) for c in FIELDS]), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and, where the row is to be tampered with, the digest it has then.

    ``tree`` orders the sources: the null source first, then by bytes.
    """
    touched = F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), _leaf(docs, docs["text"]).alias("digest"),
        F.when(touched, _leaf(docs, F.translate(docs["text"], _UPPER, _LOWER))).alias("changed"),
    )


def numbered(rows: DataFrame, order: list[str], shelf: Shelf) -> DataFrame:
    """``rows`` with ``index``, the place of each in its tree (by ``order``), and ``n``, the tree's size.

    The rows are sorted by ranges; a row's place is the sizes of the tree's earlier ranges and its place within its own.
    Rows that are equal in ``order`` are told apart by their place in the table, so their many may lie in several ranges.
    """
    told = shelf.put(rows.withColumn("tie", F.monotonically_increasing_id()))
    keys = ["tree", *order, "tie"]
    at = shelf.put(told.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    shelf.drop(told)
    runs = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n"))
    return at.join(runs, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift", "tie")


# --- the log


SEGMENT = "tree string, block long, n long, positions binary, log binary, doc_ids array<long>, changed array<binary>"


def append(leaves: list[bytes], levels: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, number on this level, digest) of the nodes over ``leaves``, each when it is completed, up to ``levels`` above them."""
    waiting: list[list[bytes]] = [[] for _ in range(levels + 1)]
    made = [0] * (levels + 1)

    def add(level: int, node: bytes) -> Iterator[tuple[int, int, bytes]]:
        yield level, made[level], node
        made[level] += 1
        waiting[level].append(node)
        if level < levels and len(waiting[level]) == FAN:
            yield from close(level)

    def close(level: int) -> Iterator[tuple[int, int, bytes]]:
        run, waiting[level] = waiting[level], []
        yield from add(level + 1, hashed(b"".join(run)))

    for x in leaves:
        yield from add(0, x)
    for level in range(levels):  # the last runs have fewer
        if waiting[level]:
            yield from close(level)


def _segments(base: int):
    """The part of the log that each range of nodes of level ``base`` adds."""

    def segment(tree: str, block: int, rows: list[tuple]) -> tuple:
        n = int(rows[0][1])
        levels = min(LEVELS, height(n) - base)
        nodes = list(append([bytes(x[2]).hex().encode() for x in rows], levels))
        if base:
            own = [x for x in nodes if x[0]]  # the leaves of this round are in the log already
            at = np.empty(len(own), dtype=np.int64)
            level, index = (np.array([x[k] for x in own], dtype=np.int64) for k in (0, 1))
            for k in range(1, levels + 1):
                at[level == k] = positions(base + k, block * FAN ** (LEVELS - k) + index[level == k], n)
        else:
            own = nodes
            at = positions(0, np.array([block * RANGE]), n)[0] + np.arange(len(own), dtype=np.int64)
        if base:  # siblings of this round's leaves are looked up here too
            leaves = [x for x in nodes if not x[0]]
            at = np.concatenate([at, positions(base, block * RANGE + np.arange(len(leaves)), n)])
            own = own + leaves
        order = np.argsort(at, kind="stable")
        log = b"".join(bytes.fromhex(own[k][2].decode()) for k in order)
        return tree, block, n, at[order].tobytes(), log, [x[3] for x in rows] if not base else None, [x[4] for x in rows] if not base else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, key, rows, done = [x.split()[0] for x in SEGMENT.split(", ")], None, [], []
        for batch in batches:
            batch = batch.astype({"doc_id": "Int64"}).astype({"doc_id": object}).where(batch.notna(), None)
            for tree, index, *row in batch[["tree", "index", "block", "n", "digest", "doc_id", "changed"]].itertuples(index=False, name=None):
                if (tree, row[0]) != key:
                    if rows:
                        done.append(segment(*key, rows))
                    key, rows = (tree, row[0]), []
                rows.append((index, *row[1:]))
            if len(done) > 64:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if rows:
            done.append(segment(*key, rows))
        if done:
            yield pd.DataFrame(done, columns=columns)

    return run


def append_log(rows: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """The segments of the logs of all trees, a table for each round. ``rows``: tree, index, n, digest, doc_id, changed."""
    rows = shelf.put(rows)
    most = rows.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    out, base = [], 0
    while True:
        ranges = rows.withColumn("block", F.expr(f"index div {RANGE}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
        built = shelf.put(ranges.mapInPandas(_segments(base), SEGMENT))
        out.append(built)
        base += LEVELS
        if FAN**base >= most:
            return out
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("changed", "binary"))]
        rows = built.filter(F.col("n") > FAN**base).select("tree", F.col("block").alias("index"), "n", F.substring("log", -32, 32).alias("digest"), *nothing)


def _last(base: int) -> Column:
    """Whether a segment's root is its tree's."""
    return F.col("n") <= FAN ** (base + LEVELS)


def roots(log: list[DataFrame]) -> DataFrame:
    """tree and digest of each tree's root."""
    out = None
    for k, built in enumerate(log):
        own = built.filter(_last(k * LEVELS) & (F.lit(k == 0) | (F.col("n") > FAN ** (k * LEVELS)))).select("tree", F.substring("log", -32, 32).alias("digest"))
        out = own if out is None else out.unionByName(own)
    return out


# --- proofs


class Range:
    """The siblings of each leaf of one segment, read from the log by position."""

    def __init__(self, block: int, n: int, base: int, at: bytes, log: bytes):
        levels = min(LEVELS, height(n) - base)
        place, text = np.frombuffer(at, dtype=np.int64), bytes(log).hex().encode()
        self.first = block * RANGE
        self.size = min(RANGE, -(-n // FAN**base) - self.first)
        self.runs: list[list[bytes]] = []
        for k in range(levels + 1):
            begin, end = self.first // FAN**k, -(-(self.first + self.size) // FAN**k)
            wanted = positions(base + k, np.arange(begin, end), n)
            found = np.searchsorted(place, wanted)
            if not np.array_equal(place[np.minimum(found, len(place) - 1)], wanted):
                raise ValueError("the log has no node at a sibling's position")
            nodes = [text[64 * i : 64 * i + 64] for i in found.tolist()]
            self.runs.append([b"".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        self.levels = levels

    def leaf(self, i: int) -> bytes:
        return self.runs[0][i // FAN][64 * (i % FAN) : 64 * (i % FAN) + 64]

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        """The siblings on the left and on the right of the i-th leaf and of each node above it in this range."""
        out = []
        for k in range(self.levels):
            run, slot = self.runs[k][i // FAN], i % FAN
            out.append((run[: 64 * slot], run[64 * slot + 64 :]))
            i //= FAN
        return out


def packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: for each level how many siblings are on the left and on the right, and their digests."""
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpacked(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        text = data[at + 2 : at + 2 + 32 * (left + right)].hex().encode()
        out.append((text[: 64 * left], text[64 * left :]))
        at += 2 + 32 * (left + right)
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = hashed(left + leaf + right)
    return leaf


def _handed_down(base: int):
    """For each leaf of the segments its whole path, with what its tree knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, block, n, at, log, above, root, subroot in batch[["tree", "block", "n", "positions", "log", "path", "root", "subroot"]].itertuples(index=False, name=None):
                own = Range(block, n, base, at, log)
                out = {"tree": tree, "index": own.first + np.arange(own.size), "path": [packed(own.path(i)) + bytes(above) for i in range(own.size)]}
                yield pd.DataFrame(out).assign(root=root, subroot=subroot)

    return run


PATHS = "tree string, index long, path binary, root binary, subroot binary"


def _paths(log: list[DataFrame], prefix: DataFrame, shelf: Shelf, to: int) -> DataFrame:
    """tree, index, path, root, subroot of the nodes whose rounds begin at round ``to``, from the segments above. ``prefix`` has a row a tree."""
    below = None
    for k in reversed(range(to, len(log))):
        done = log[k].filter(_last(k * LEVELS) & (F.lit(k == 0) | (F.col("n") > FAN ** (k * LEVELS))))
        ready = done.select("tree", "block").join(prefix, "tree")
        if below is not None:
            ready = ready.unionByName(below.withColumnRenamed("index", "block"))
        if k == to:
            return ready
        below = shelf.put(log[k].drop("doc_ids", "changed").join(ready, ["tree", "block"]).mapInPandas(_handed_down(k * LEVELS), PATHS))
    raise ValueError("no segments")


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(with_proof: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, n, at, log, ids, changed, above, root, subroot in batch[["block", "n", "positions", "log", "doc_ids", "changed", "path", "root", "subroot"]].itertuples(index=False, name=None):
                own, upper, wanted = Range(block, n, 0, at, log), unpacked(bytes(above)), bytes(root).hex()
                rest, out = b"".join(a + b for a, b in upper), []
                for i in range(own.size):
                    path = own.path(i)
                    start = own.leaf(i) if changed[i] is None else bytes(changed[i]).hex().encode()
                    folded = fold(fold(start, path), upper).decode()
                    proof = hashed(b"".join(a + b for a, b in path) + rest).decode()
                    out.append((own.leaf(i).decode(), proof, folded, folded == wanted, packed(path) + bytes(above) if with_proof else None))
                rows = pd.DataFrame(out, columns=["leaf", "proof_sha256", "folded_root", "verified", "proof"]).assign(subroot=bytes(subroot).hex(), root=wanted)
                rows["doc_id"] = pd.array([None if x is None or x != x else int(x) for x in ids], dtype="Int64")
                yield rows if with_proof else rows.drop(columns="proof")

    return run


def _built(docs: DataFrame, shelf: Shelf) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The logs of the sources and of the tree over their roots, and the numbered roots of the sources."""
    log = append_log(numbered(leaves_of(docs), ["doc_id", "digest"], shelf), shelf)
    names = roots(log).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = shelf.put(numbered(names, ["name"], shelf))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("changed", "binary"))]
    return log, append_log(top.select("tree", "index", "n", "digest", *nothing), shelf), top


def manifest(docs: DataFrame) -> DataFrame:
    """The append logs as rows: source, position, digest; the log over all sources has ``whole`` true and no source.

    The last position of a log is its root. Rows as in :func:`proofs`; an empty table gives no rows.
    """
    log, over, _ = _built(docs, Shelf(docs.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, at, data in batch[["tree", "positions", "log"]].itertuples(index=False, name=None):
                yield pd.DataFrame({"tree": tree, "position": np.frombuffer(at, dtype=np.int64), "digest": [bytes(data[32 * i : 32 * i + 32]).hex() for i in range(len(data) // 32)]})

    parts = []
    for logs, whole in ((log, False), (over, True)):
        for built in logs:
            rows = built.select("tree", "positions", "log").mapInPandas(run, "tree string, position long, digest string")
            source = F.lit(None).cast("string") if whole else F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
            parts.append(rows.select(F.lit(whole).alias("whole"), source.alias("source"), "position", "digest"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct() if len(log) + len(over) > 2 else out  # a round's leaves are the last round's roots


def proofs(docs: DataFrame, with_proof: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and if wanted the packed proof.

    A leaf is the digest of doc_id, source, lang, n_chars and text; null fields are ``-``, so a null text and an empty one differ. The
    null source is a source of its own, before all others; a null doc_id comes before all others and is never tampered
    with. Rows with the same source and doc_id stand in the order of their digests; equal rows are leaves of their
    own, next to each other. An empty table gives no rows. Other columns are ignored. ``folded_root`` is the root that a row's
    tampered text, or else its own, leads to; where tampering changes nothing, the proof holds.
    """
    shelf = Shelf(docs.sparkSession)
    log, over, top = _built(docs, shelf)
    root = roots(over).select("tree", F.lit(b"").alias("path"), F.col("digest").alias("root"), F.col("digest").alias("subroot"))
    blocks = _paths(over, root, shelf, 0)
    of_source = shelf.put(over[0].drop("doc_ids", "changed").join(blocks, ["tree", "block"]).mapInPandas(_handed_down(0), PATHS))
    prefix = shelf.put(top.select("index", "name", "digest").join(of_source, "index").select(F.col("name").alias("tree"), "path", "root", F.col("digest").alias("subroot")))
    ready = log[0].join(_paths(log, prefix, shelf, 0), ["tree", "block"])
    out = ready.mapInPandas(_proved(with_proof), PROOFS + ", proof binary" * with_proof)
    return out
