"""Byte-level BPE by recursive queries, a DuckDB in each partition.

A text is split by the tokenizer's pattern. The pieces that a partition has not met before become rows, one a
byte: (piece, position, token). A recursive query joins neighbouring tokens with the merge table, contracts
each piece's leftmost pair of the lowest rank, and repeats until no pair of a piece is in the table. Decoding
joins (document, position, token) with the vocabulary and concatenates the bytes by an ordered aggregation.

A long piece is encoded in chunks, so its cost grows with its length only. A sequence of tokens is the encoding of its
bytes if each two neighbours are that of theirs: as long as no contraction has crossed a border, both sides are as they
would be alone, so the first one to cross it would also cross it in the two neighbours' bytes. So two encodings may be joined
at a token that both have at the same place, and an encoding of the bytes around the border of two chunks joins them.

Texts are neither shuffled nor gathered; a task holds a block of texts, the vocabulary (its size is a
parameter of the tokenizer, not of the data), and a cache of pieces of bounded size, which the next tasks of the same
worker go on with.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from framelens.llm.common import text_of

#: Bytes of text that are encoded at once, and pieces in each of the cache's two halves.
BLOCK_BYTES, CACHE_PIECES = 4 << 20, 300_000

#: Bytes of new pieces in one recursive query, the bytes of a long piece's chunks, and the tokens on either side of a border that are encoded anew at first.
QUERY_BYTES, CHUNK_BYTES, AROUND = 1 << 20, 192, 8

#: A round contracts the leftmost pair of the lowest rank of each piece; pieces without a pair stay as they are.
ENCODE = """
WITH RECURSIVE rounds(w, ids) USING KEY (w) AS (
  SELECT w, ids FROM start
  UNION ALL
  SELECT r.w, list_concat(list_append(r.ids[1 : (b & 2147483647) - 1], (b >> 31)::INT), r.ids[(b & 2147483647) + 2 : ])
  FROM rounds r JOIN (
    SELECT w, min((rank::BIGINT << 31) | p) AS b
    FROM (SELECT w, unnest(ids[:-2]) AS t, unnest(ids[2:]) AS next, generate_subscripts(ids[2:], 1) AS p FROM rounds)
    JOIN merges ON pair = ((t::BIGINT << 32) | next)
    GROUP BY w) USING (w))
SELECT w, ids FROM rounds ORDER BY w
"""

#: Ids in a row of the decoder's table, and ids and pieces that are worked on at once, also within one text.
WIDTH, RUN_IDS, RUN_PIECES = 4, 1 << 18, 1 << 18

DECODE = f"""
SELECT d, string_agg({" || ".join(f"v{i}.hex" for i in range(WIDTH))}, '' ORDER BY p) AS hex
FROM texts {" ".join(f"JOIN vocabulary v{i} ON v{i}.id = texts.i{i}" for i in range(WIDTH))}
GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines: base64 of the token, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("SET temp_directory = ''")
        pairs = [(ranks[a], ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        self._table("merges", {"pair": np.array([(a << 32) | b for a, b, _ in pairs], dtype=np.int64), "rank": np.array([m for *_, m in pairs], dtype=np.int32)})
        self._table("vocabulary", {"id": np.array([-1, *ranks.values()], dtype=np.int32), "hex": ["", *(t.hex() for t in ranks)]})
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.recent: dict[str, bytes] = {}  # pieces and the bytes of their ids (int32)
        self.older: dict[str, bytes] = {}
        self.names = list(map(str, range(len(self.lengths))))

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, raw: list[bytes]) -> list[bytes]:
        """The ids (int32, as bytes) of short strings, in queries of about QUERY_BYTES."""
        out, begin = [], 0
        while begin < len(raw):
            end, size = begin, 0
            while end < len(raw) and (size < QUERY_BYTES or end == begin):
                size += len(raw[end])
                end += 1
            part = raw[begin:end]
            data = self.byte_ids[np.frombuffer(b"".join(part), dtype=np.uint8)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]).astype(np.int32)), pa.array(data))
            self._table("start", {"w": np.arange(len(part), dtype=np.int32), "ids": lists})
            for batch in self.db.sql(ENCODE).to_arrow_table().to_batches():
                ids = batch.column("ids")
                data, at = ids.values.to_numpy().tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
                out.extend(map(data.__getitem__, map(slice, at[:-1], at[1:])))
            begin = end
        return out

    def _merge_long(self, raw: list[bytes]) -> list[bytes]:
        """The ids of long strings: chunks first, then neighbours are joined, pairs of pairs after pairs."""
        cuts = [list(range(0, len(b), CHUNK_BYTES)) for b in raw]
        chunks = iter(self._merge([b[c : c + CHUNK_BYTES] for b, own in zip(raw, cuts) for c in own]))
        rows = [[(c, np.frombuffer(next(chunks), dtype=np.int32)) for c in own] for own in cuts]
        while any(len(row) > 1 for row in rows):
            borders = [(k, i) for k, row in enumerate(rows) for i in range(0, len(row) - 1, 2)]
            joined: dict[tuple[int, int], np.ndarray] = {}
            around = AROUND
            while waiting := [x for x in borders if x not in joined]:
                spans = []
                for k, i in waiting:
                    (begin, a), (middle, b) = rows[k][i], rows[k][i + 1]
                    spans.append((middle - int(self.lengths[a[-around:]].sum()), middle + int(self.lengths[b[:around]].sum())))
                for (k, i), (lo, _), new in zip(waiting, spans, self._merge([raw[k][lo:hi] for (k, _), (lo, hi) in zip(waiting, spans)])):
                    (_, a), (middle, b) = rows[k][i], rows[k][i + 1]
                    done = self._joined(a, b, np.frombuffer(new, dtype=np.int32), lo, middle, around)
                    if done is not None:
                        joined[k, i] = done
                around *= 2
            rows = [[(row[i][0], joined[k, i]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)] for k, row in enumerate(rows)]
        return [row[0][1].tobytes() for row in rows]

    def _joined(self, a: np.ndarray, b: np.ndarray, new: np.ndarray, begin: int, middle: int, around: int) -> np.ndarray | None:
        """``a`` and ``b``, whose border is at ``middle``, by way of the encoding of the bytes from ``begin`` on around it.

        None where ``new`` shares no token at its place with one of them.
        """
        starts = begin + np.cumsum(self.lengths[new]) - self.lengths[new]
        at_a, at_b = max(0, len(a) - around), min(around, len(b))
        left = dict(zip((begin + np.cumsum(self.lengths[a[at_a:]]) - self.lengths[a[at_a:]]).tolist(), range(at_a, len(a))))
        right = dict(zip((middle + np.cumsum(self.lengths[b[:at_b]]) - self.lengths[b[:at_b]]).tolist(), range(at_b)))
        same = [j for j, (s, t) in enumerate(zip(starts.tolist(), new.tolist())) if (s in left and a[left[s]] == t) or (s in right and b[right[s]] == t)]
        first = 0 if at_a == 0 else next((j for j in same if int(starts[j]) in left), None)
        last = len(new) if at_b == len(b) else next((j for j in reversed(same) if int(starts[j]) in right), None)
        if first is None or last is None:
            return None
        head = a[:0] if at_a == 0 else a[: left[int(starts[first])]]
        tail = b[len(b) :] if at_b == len(b) else b[right[int(starts[last])] :]
        return np.concatenate([head, new[first:last], tail])

    def _learn(self, new: set[str]) -> None:
        """Bring the pieces into the recent half of the cache, by the older half or by encoding them."""
        if len(self.recent) + len(new) > CACHE_PIECES:
            self.recent, self.older = {}, self.recent
        unknown = []
        for p in new:
            if p not in self.recent:
                ids = self.older.get(p)
                if ids is None:
                    unknown.append(p)
                else:
                    self.recent[p] = ids
        raw = [p.encode("utf-8", "surrogatepass") for p in unknown]
        for long, merge in ((False, self._merge), (True, self._merge_long)):
            which = [k for k, b in enumerate(raw) if (len(b) > CHUNK_BYTES) == long]
            self.recent.update(zip([unknown[k] for k in which], merge([raw[k] for k in which])))

    def _encoded(self, split: list[list[str]]) -> list[bytes]:
        self._learn(set(chain.from_iterable(split)))
        get = self.recent.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text; the pieces of a text that is longer than a block in runs."""
        short = [len(t) <= BLOCK_BYTES for t in texts]
        done = iter(self._encoded([self.pattern.findall(t) for t, s in zip(texts, short) if s]))
        return [np.frombuffer(next(done) if s else self._long(t), dtype=np.int32) for t, s in zip(texts, short)]

    def _long(self, text: str) -> bytes:
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while pieces := list(islice(found, RUN_PIECES)):
            out.extend(self._encoded([pieces]))
        return b"".join(out)

    def digest(self, ids: np.ndarray) -> str:
        """The digest of the ids as decimal numbers joined by commas."""
        sha = hashlib.sha256()
        for i in range(0, len(ids), RUN_IDS):
            sha.update(b"," * (i > 0) + ",".join(map(self.names.__getitem__, ids[i : i + RUN_IDS].tolist())).encode())
        return sha.hexdigest()

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids, decoded in runs of RUN_IDS: ids may be cut anywhere."""
        out: list[list[bytes]] = [[] for _ in ids]
        owners, run, size = [], [], 0
        for k, own in enumerate(ids):
            for i in range(0, len(own), RUN_IDS):
                owners.append(k)
                run.append(own[i : i + RUN_IDS])
                size += len(run[-1])
                if size >= RUN_IDS:
                    for at, data in zip(owners, self._decode(run)):
                        out[at].append(data)
                    owners, run, size = [], [], 0
        for at, data in zip(owners, self._decode(run)):
            out[at].append(data)
        return [b"".join(x) for x in out]

    def _decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        n = -(-sizes // WIDTH)
        starts = np.cumsum(n) - n
        rows = np.full((int(n.sum()), WIDTH), -1, dtype=np.int32)
        if len(rows):
            rows.reshape(-1)[np.repeat(starts * WIDTH - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = np.concatenate(ids)
        d = np.repeat(np.arange(len(ids), dtype=np.int32), n)
        self.db.register("texts", pa.table({"d": d, "p": (np.arange(len(rows)) - starts[d]).astype(np.int32), **{f"i{i}": np.ascontiguousarray(rows[:, i]) for i in range(WIDTH)}}))
        out = [b""] * len(ids)
        for k, text in self.db.execute(DECODE).fetchall():
            out[k] = bytes.fromhex(text)
        self.db.unregister("texts")
        return out


#: The coder of this Python worker, by vocabulary and pattern: the next task finds it warm.
_CODERS: dict[tuple, Coder] = {}


def _coder(key: str, ranks, pattern: str) -> Coder:
    if (key, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[key, pattern] = Coder(ranks.value, pattern)
    return _CODERS[key, pattern]


def _blocks(batches: Iterator[pd.DataFrame], size_of: Callable, column: str) -> Iterator[pd.DataFrame]:
    """The batches, cut so that no block but one of a single long row has more than BLOCK_BYTES."""
    for batch in batches:
        sizes = batch[column].map(size_of).to_numpy()
        begin, total = 0, 0
        for k, size in enumerate(sizes):
            if total and total + size > BLOCK_BYTES:
                yield batch.iloc[begin:k]
                begin, total = k, 0
            total += size
        if begin < len(batch):
            yield batch.iloc[begin:]


def _whole(column: pd.Series) -> np.ndarray:
    return column.astype("Int64").to_numpy() if column.isna().any() else column.to_numpy()


def _vocabulary(spark: SparkSession, path: str):
    """The ranks for the workers, and a digest of them."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of ``docs`` (doc_id, text)."""
    ranks, key = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(key, ranks, pattern)
        for block in _blocks(batches, len, "text"):
            yield pd.DataFrame({"doc_id": _whole(block["doc_id"]), "ids": coder.encode(block["text"].tolist())})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary) of each row of ``encoded`` (doc_id, ids)."""
    ranks, key = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(key, ranks, pattern)
        for block in _blocks(batches, len, "ids"):
            yield pd.DataFrame({"doc_id": _whole(block["doc_id"]), "data": coder.decode([np.asarray(x, dtype=np.int32) for x in block["ids"]])})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, data binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256 and decoded_sha256 after a round trip, and ids if wanted.

    The digests are of the decimal ids joined by commas and of the decoded bytes. A null text counts as empty:
    no ids, no bytes. Repeated rows are encoded alike; an empty table gives no rows. Other columns are ignored.
    """
    ranks, key = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(key, ranks, pattern)
        for block in _blocks(batches, len, "text"):
            ids = coder.encode(block["text"].tolist())
            out = {
                "doc_id": _whole(block["doc_id"]),
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [coder.digest(x) for x in ids],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in coder.decode(ids)],
            }
            yield pd.DataFrame(out | ({"ids": ids} if with_ids else {}))

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
