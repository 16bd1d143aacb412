"""Removal of repeated byte strings with a hash-compared suffix sort.

Two equal strings of ``length`` bytes have the same lowest k-gram at the same place (k-grams ordered by a hash,
leftmost on ties), so each string belongs to one anchor: a k-gram that is lowest in it. Anchors are
some 2 / (length - k) of all positions. Only anchors whose hash occurs again can start equal strings: their
surroundings, all bytes that a string of theirs can reach, are shuffled by the hash. There the suffixes at the
strings' starts are sorted by a mergesort whose comparisons use prefix polynomial hashes: the common extension
of two suffixes is found by binary search, so a comparison takes a logarithmic number of steps. Neighbours that
agree in ``length`` bytes are equal strings, which their bytes confirm; the first of each group in (document,
start) order stays. Surroundings that are equal as a whole are combined before the shuffle, in each batch of
rows: only their first occurrence is compared, and every later one is removed as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import md5_number, stored, text_of

K = 24
#: Starts of strings that are handled at once.
CHUNK = 1 << 16
#: Surroundings that are compared at once, beyond the last whole group.
COMPARED = 4000
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next text."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of data[m] * base^m for i <= m < j, modulo 2^64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=out[1:], dtype=np.uint64)
    return out


def string_hashes(h: np.ndarray, starts: np.ndarray, size) -> np.ndarray:
    """The polynomial hashes of the strings of ``size`` bytes at ``starts``, wherever they stand."""
    with np.errstate(over="ignore"):
        return (h[starts + size] - h[starts]) * _power(_INVERSE, len(h))[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours: of every 1, 2, 4 and so on, the last two overlapping."""
    size = 1
    while size < w:
        step = min(size, w - size)
        keys = np.minimum(keys[:-step], keys[step:])
        size += step
    return keys


#: Bits of a position within a block.
_PLACE = 22


def owners(texts: list[bytes], length: int, k: int = K) -> dict[str, np.ndarray]:
    """The anchors of all strings of ``length`` bytes: text (its number), place, hash, lo and hi, the first and the last start that it owns.

    The starts of an anchor follow each other. Texts are handled in blocks, so that short ones share the calls and long ones stay in the cache.
    """
    found: dict[str, list[np.ndarray]] = {c: [] for c in ("text", "place", "hash", "lo", "hi")}
    pieces: list[bytes] = []
    numbers: list[int] = []
    offsets: list[int] = []

    def block() -> None:
        sizes = np.array([len(x) for x in pieces])
        begin = np.cumsum(sizes) - sizes
        part = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        prefix = prefix_hashes(part)
        h = prefix[k:] - prefix[:-k]
        h *= _power(_INVERSE, len(prefix))[: len(h)]
        h = _mixed(h)
        # The upper 42 bits order the k-grams; the position decides ties, which the content decides alike.
        keys = h & ~np.uint64((1 << _PLACE) - 1)
        keys |= np.arange(len(h), dtype=np.uint64)
        at = (_sliding_least(keys, length - k + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        head = np.zeros(len(at), dtype=bool)  # where a run of starts with one anchor begins, also one that crosses texts and is none
        head[0] = True
        np.not_equal(at[1:], at[:-1], out=head[1:])
        stop = begin + sizes - length + 1
        head[begin] = True
        head[stop[:-1]] = True
        lo = np.flatnonzero(head)
        hi = np.append(lo[1:], len(at)) - 1
        text = np.searchsorted(begin, lo, side="right") - 1
        inside = lo < stop[text]
        lo, hi, text = lo[inside], hi[inside], text[inside]
        shift = np.array(offsets)[text] - begin[text]
        for c, v in (("text", np.array(numbers)[text]), ("place", at[lo] + shift), ("hash", h[at[lo]].view(np.int64)), ("lo", lo + shift), ("hi", hi + shift)):
            found[c].append(v)
        pieces.clear(), numbers.clear(), offsets.clear()

    held = 0
    for i, raw in enumerate(texts):
        for begin in range(0, len(raw) - length + 1, CHUNK):
            piece = raw[begin : begin + CHUNK + length - 1]
            if pieces and held + len(piece) > CHUNK + length:
                block()
                held = 0
            pieces.append(piece), numbers.append(i), offsets.append(begin)
            held += len(piece)
    if pieces:
        block()
    out = {c: np.concatenate([np.zeros(0, dtype=np.int64), *v]) for c, v in found.items()}
    # An anchor whose starts lie in two pieces of its text is one.
    new = np.append(True, (out["text"][1:] != out["text"][:-1]) | (out["place"][1:] != out["place"][:-1]))[: len(out["text"])]
    return {c: v[new] for c, v in out.items() if c != "hi"} | {"hi": out["hi"][np.append(new[1:], True)[: len(new)]]}


def anchor_hashes(data: np.ndarray, places: np.ndarray, k: int = K) -> np.ndarray:
    """The hashes that :func:`owners` has for the k-grams at ``places``."""
    return _mixed(((data[places[:, None] + np.arange(k)].astype(np.uint64) + np.uint64(1)) * _power(_BASE, k)).sum(axis=1, dtype=np.uint64)).view(np.int64)


def coded(place: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """An anchor and its starts as one number, in the order of places: starts lie within ``length`` before their anchor."""
    return (place * length + (place - lo)) * length + (place - hi)


def decoded(code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, lo and hi of :func:`coded` numbers."""
    place = code // (length * length)
    return place, place - code // length % length, place - code % length


def _anchors(length: int):
    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.iloc[begin : begin + 500]
                found = owners([t.encode("utf-8", "surrogatepass") for t in part["text"]], length)
                ids, digests = (part[c].to_numpy()[found["text"]] for c in ("doc_id", "digest"))
                rows = pd.DataFrame({"hash": found["hash"], "doc_id": ids, "digest": digests, "anchor": coded(found["place"], found["lo"], found["hi"], length)})
                yield from (rows.iloc[i : i + 200_000] for i in range(0, len(rows), 200_000))

    return anchors


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as compressed bytes, for the shuffles by document."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for begin in range(0, len(batch), 500):
            part = batch.iloc[begin : begin + 500]
            yield pd.DataFrame({"doc_id": part["doc_id"], "digest": part["digest"], "packed": [pack(t.encode("utf-8", "surrogatepass")) for t in part["text"]]})


def _around(length: int):
    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """hash, bytes around, bytes before the anchor, document and anchor: the first of equal ones in the batch.

        The bytes are those of the strings that belong to the anchor, so their starts are all but the last length - 1.
        """
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            firsts: dict[tuple[int, bytes, int], tuple[int, int, int]] = {}
            for doc_id, digest, packed, anchors in zip(batch["doc_id"], batch["digest"], batch["packed"], batch["anchors"]):
                raw, anchors = unpack(packed), np.asarray(anchors, dtype=np.int64)
                place, lo, hi = decoded(anchors, length)
                h = anchor_hashes(np.frombuffer(raw, dtype=np.uint8), place)
                for x, a, before, begin, end in zip(h.tolist(), anchors.tolist(), (place - lo).tolist(), lo.tolist(), (hi + length).tolist()):
                    key, value = (x, raw[begin:end], before), (doc_id, digest, a)
                    if firsts.setdefault(key, value) > value:
                        firsts[key] = value
            if firsts:
                keys, values = list(zip(*firsts)), list(zip(*firsts.values()))
                yield pd.DataFrame({"hash": keys[0], "around": keys[1], "before": keys[2], "doc_id": values[0], "digest": values[1], "anchor": values[2]})

    return around


def common_extension(h: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The number of equal bytes, ``most`` at most, of the suffixes at a and b: a binary search over hashes."""
    out = np.full(len(a), most, dtype=np.int64)
    differ = np.flatnonzero(string_hashes(h, a, most) != string_hashes(h, b, most))
    x, y = a[differ], b[differ]
    lo, hi = np.zeros(len(x), dtype=np.int64), np.full(len(x), most - 1, dtype=np.int64)
    for _ in range(most.bit_length()):
        mid = (lo + hi + 1) // 2
        same = string_hashes(h, x, mid) == string_hashes(h, y, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        hi = np.maximum(lo, hi)
    out[differ] = lo
    return out


def suffix_sort(data: np.ndarray, h: np.ndarray, starts: np.ndarray, lists: np.ndarray, most: int) -> np.ndarray:
    """The order that sorts the suffixes at ``starts`` within each of the contiguous ``lists`` by their first ``most`` bytes.

    A mergesort from below, of all lists at once: each suffix finds its place in the neighbouring run by binary search.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(lists[1:] != lists[:-1]) + 1])
    sizes = np.diff(np.concatenate([first, [n]]))
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    run = 1
    while run < sizes.max():
        at = np.flatnonzero(size > run)  # the other lists are sorted
        a, own = begin[at], (at - begin[at]) // run
        side = own ^ 1
        lo = np.minimum(side * run, size[at])
        start, hi = lo.copy(), np.minimum(lo + run, size[at])
        while (open_ := lo < hi).any():
            which = np.flatnonzero(open_)
            mid = (lo[which] + hi[which]) // 2
            x, y = starts[order[at[which]]], starts[order[a[which] + mid]]
            ext = common_extension(h, x, y, most)
            end = ext >= most
            safe = np.where(end, 0, ext)
            cx, cy = data[x + safe].astype(np.int16), data[y + safe].astype(np.int16)
            # Equal ones keep their order: those of the left run come first.
            before = np.where(end, own[which] % 2 == 1, cy < cx)
            lo[which] = np.where(before, mid + 1, lo[which])
            hi[which] = np.where(before, hi[which], mid)
        to = a + (own // 2) * 2 * run + (at - a - own * run) + (lo - start)
        moved = order.copy()
        moved[to] = order[at]
        order, run = moved, run * 2
    return order


def _compare(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """For the first occurrence of each surrounding of whole groups: the starts that an earlier string repeats."""
    rows = rows.sort_values(["doc_id", "digest", "anchor"], kind="stable").drop_duplicates(["hash", "around", "before"]).reset_index(drop=True)
    texts = rows["around"].tolist()
    size = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    anchor, before = rows["anchor"].to_numpy(np.int64), rows["before"].to_numpy(np.int64)
    lo = decoded(anchor, length)[1]
    _, group, members = np.unique(rows["hash"].to_numpy(np.int64), return_inverse=True, return_counts=True)
    # Strings of surroundings whose group has others; equal ones stand alike to their anchors.
    own = np.where(members[group] > 1, size - length + 1, 0)
    row = np.repeat(np.arange(len(rows)), own)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
    start, offset = base[row] + inside, before[row] - inside
    starts: list = [()] * len(rows)
    h = prefix_hashes(data)
    if len(row):
        # A string whose hash no other one of its list has is equal to none: it needs no place in the order.
        key = _mixed(string_hashes(h, start, length) + _mixed((group[row] * (length + 1) + offset).astype(np.uint64)))
        ordered = np.sort(key)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        again = again[np.append(True, again[1:] != again[:-1])[: len(again)]]
        several = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key if len(again) else np.zeros(len(key), dtype=bool)
        row, start, offset = row[several], start[several], offset[several]
    if len(row):
        by = np.lexsort((row, offset, group[row]))
        row, start, offset = row[by], start[by], offset[by]
        lists = np.cumsum(np.concatenate([[0], (np.diff(group[row]) != 0) | (np.diff(offset) != 0)]))
        several = np.bincount(lists)[lists] > 1
        row, start, lists = row[several], start[several], lists[several]
    if len(row):
        order = suffix_sort(data, h, start, lists, length)
        row, start, lists = row[order], start[order], lists[order]
        equal = np.zeros(len(row), dtype=bool)
        pair = np.flatnonzero(lists[1:] == lists[:-1])
        pair = pair[string_hashes(h, start[pair], length) == string_hashes(h, start[pair + 1], length)]
        span = np.arange(length)
        for part in np.array_split(pair, len(pair) // 50_000 + 1):
            equal[part + 1] = (data[start[part][:, None] + span] == data[start[part + 1][:, None] + span]).all(axis=1)
        # Rows are in (document, place) order: the lowest row of a class has its first string.
        heads = np.flatnonzero(~equal)
        low = np.minimum.reduceat(row, heads)[np.cumsum(~equal) - 1]
        late = np.flatnonzero(row > low)
        late = late[np.lexsort((start[late], row[late]))]
        at = row[late]
        where = lo[at] + start[late] - base[at]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for r, found in zip(at[np.concatenate([[0], cuts])].tolist() if len(at) else [], np.split(where, cuts)):
            starts[r] = found
    return pd.DataFrame({"doc_id": rows["doc_id"], "digest": rows["digest"], "anchor": anchor, "starts": [np.asarray(x, dtype=np.int32) for x in starts]})


def _compared(length: int):
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held < COMPARED:
                continue
            rows = pd.concat(waiting, ignore_index=True)
            hashes = rows["hash"].to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1]))  # sorted by hash: the last group may go on
            if cut:
                yield from (_compare(part, length) for part in _groups(rows.iloc[:cut]))
            waiting, held = [rows.iloc[cut:]], len(rows) - cut
        if held:
            yield from (_compare(part, length) for part in _groups(pd.concat(waiting, ignore_index=True)))

    return compared


def _groups(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of about COMPARED rows that cut no group."""
    hashes, begin = rows["hash"].to_numpy(), 0
    while begin < len(rows):
        end = min(begin + COMPARED, len(rows))
        if end < len(rows):
            end = int(np.searchsorted(hashes, hashes[end - 1], side="right"))
        yield rows.iloc[begin:end]
        begin = end


def removed_bytes(size: int, length: int, anchors: np.ndarray, firsts: dict[int, np.ndarray]) -> np.ndarray:
    """Which bytes of a text go: all strings of a repeated anchor, but for a first surrounding only those that were found."""
    _, lo, hi = decoded(np.array([a for a in anchors.tolist() if a not in firsts], dtype=np.int64), length)
    found = np.concatenate([np.zeros(0, dtype=np.int64), *firsts.values()])
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, np.concatenate([lo, found]), 1)
    np.add.at(edge, np.concatenate([hi, found]) + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _finish(length: int, with_bytes: bool):
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, packed, anchors, firsts in zip(batch["doc_id"], batch["packed"], batch["anchors"], batch["firsts"]):
                raw = unpack(packed)
                kept, n_removed, n_spans = raw, 0, 0
                if anchors is not None and len(raw) >= length:
                    known = {} if firsts is None else {x["anchor"]: np.asarray(x["starts"], dtype=np.int64) for x in firsts}
                    gone = removed_bytes(len(raw), length, np.asarray(anchors, dtype=np.int64), known)
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    n_removed, n_spans = int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                rows.append((doc_id, len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes])

    return finish


def remove_repeated(docs: DataFrame, length: int = 100, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the remaining bytes) of each row.

    Each byte is removed that a string of ``length`` bytes covers which also starts earlier: in a document with a
    smaller doc_id, or further left in the same one. Strings don't cross documents and are judged on the input.
    A null text counts as empty; texts shorter than ``length`` stay. Rows with a null doc_id come first. Different
    texts that share a doc_id, null too, are different documents, in the order of a digest of their text; exact repeats of
    a row are one document, so they are treated alike. An empty table
    gives no rows. Other columns are ignored.
    """
    slim = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), md5_number(text_of()).alias("digest"), text_of().alias("text"))
    row = ["doc_id", "digest"]
    anchors = slim.mapInPandas(_anchors(length), "hash long, doc_id long, digest long, anchor long")
    shared = stored(anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    # One scan of the anchors; partitions with very frequent ones are split by the adaptive join.
    met = stored(anchors.join(shared.hint("merge"), "hash").select(*row, "anchor"))
    hits = stored(met.groupBy(*row).agg(F.collect_set("anchor").alias("anchors")))

    packed = slim.mapInPandas(_packed, "doc_id long, digest long, packed binary")
    around = packed.join(hits, row).mapInPandas(_around(length), "hash long, around binary, before int, doc_id long, digest long, anchor long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = stored(around.repartition(parts, "hash").sortWithinPartitions("hash").mapInPandas(_compared(length), "doc_id long, digest long, anchor long, starts array<int>"))
    found = firsts.groupBy(*row).agg(F.collect_list(F.struct("anchor", "starts")).alias("firsts"))
    result = packed.join(hits.join(found, row, "left"), row, "left").mapInPandas(_finish(length, with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
    own_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return result.select(own_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes)


def repeated_strings(docs: DataFrame, length: int = 100) -> DataFrame:
    """:func:`remove_repeated` without the bytes."""
    return remove_repeated(docs, length, with_bytes=False)
