"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers are given a space and the text; tokens are byte ranges. In each batch of rows pandas' ``merge_asof``, keyed by
document, finds for each token start the token of the other side that covers it; both directions together give all overlapping
pairs. The overlapping pairs whose ranges end together are the links, and cut the document into groups.

How often a pair of ids is linked in the whole corpus is counted by Spark: a block of documents (some megabytes) sends
its different pairs with their numbers, and gets back each pair's count and whether it is its B id's highest, so
neither texts nor links are shuffled, and tables of pairs are never gathered.

A space after a character that isn't white space, before one that isn't, always begins a token on both sides: A's pattern
has no match that goes on there, and B has no token with a space mark after another character (checked when it is
read). So words between such spaces are encoded by themselves, and those that a worker has met lately needn't be encoded
again; only one such word has to fit in memory, never a text's tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import Shelf, hot_join, text_of

#: Characters of text that are aligned at once, and of a block of documents, each beyond the last piece.
BATCH_CHARS, BLOCK_CHARS = 1 << 20, 8 << 20
#: Characters of words that a worker remembers, at most.
CACHE_CHARS = 4 << 20
#: Where a text may be cut: the space itself goes with what follows.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space beside white space; where there is none, every space within is such a place.
UNEVEN = re.compile(r"\s\s")
#: New words are encoded together up to so many characters.
JOINED_CHARS = 1 << 14
#: Letters (to U+024F) that both libraries are known to sort alike into letters, numbers, white space and others.
FAST_LETTERS = re.compile("[\0-\u024f]*")
#: The pre-tokenizer whose pattern this is: fixed values.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 letters are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer: the bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.texts = pa.array([str(i) for i in range(len(tokens))])


class ByteLevel(Side):
    """A byte-level BPE in the ``tokenizers`` library's format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        letters, model = _byte_letters(), given["model"]
        vocab = dict(model["vocab"]) | {x["content"]: x["id"] for x in given["added_tokens"]}
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        super().__init__(tokens)
        # Where ids ascend as the merges do, tiktoken gives the same ids, several times faster.
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"][x + y] for x, y in merges]
        first = set(range(256)) == {model["vocab"][c] for c in letters}
        self.fast = None
        if first and ids == list(range(256, 256 + len(merges))) and given["pre_tokenizer"] == BYTE_LEVEL and not given["normalizer"]:
            import tiktoken

            ranks = {tokens[i]: i for i in model["vocab"].values()}
            self.fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.fast and FAST_LETTERS.fullmatch(text):
            return self.fast(" " + text)
        return self.library.encode(" " + text, add_special_tokens=False).ids


class Pieces(Side):
    """A ``sentencepiece`` model, which itself puts the space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in names):
            raise ValueError("a piece has a space after another character: texts can't be cut at spaces")
        super().__init__([bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(names)])

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


class Words:
    """The ids of words under one tokenizer, one after another, and where each word's begin."""

    def __init__(self):
        self.ids, self.begin, self.n, self.size = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words of the given numbers of ids."""
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.begin[self.n + 1 : self.n + 1 + len(sizes)] = self.size + np.cumsum(sizes)
        self.n, self.size = self.n + len(sizes), self.size + len(ids)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words joined, and how many each has."""
        sizes = self.begin[which + 1] - self.begin[which]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[which] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes


class Aligner:
    """Both tokenizers of one worker, and the words it has met."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.chars = 0
        self.valid = np.zeros(0, dtype=bool)
        self.known = (Words(), Words())

    def _learn(self, words: list[str]) -> None:
        """Encode new words, joined by the spaces at which both tokenizers cut; a word with white space at an end by itself."""
        begin, runs = 0, []
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (size < JOINED_CHARS or end == begin):
                w = words[end]
                if not w or w[0].isspace() or w[-1].isspace() or SPACE_MARK in w:
                    if end == begin:
                        end += 1
                    break
                size += len(w) + 1
                end += 1
            runs.append(words[begin:end])
            begin = end
        for run in runs:
            self._encode(run)

    def _encode(self, words: list[str]) -> None:
        joined = " ".join(words)
        raw = (" " + joined).encode("utf-8", "surrogatepass")
        found = [side.encode(joined) for side in self.sides]
        valid = all(b"".join([side.tokens[i] for i in ids]) == raw for side, ids in zip(self.sides, found))
        if not valid and len(words) > 1:
            for w in words:
                self._encode([w])
            return
        ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
        for side, known, ids in zip(self.sides, self.known, found):
            ids = np.array(ids if valid else [], dtype=np.int32)
            last = np.searchsorted(np.cumsum(side.lengths[ids]), ends) + 1 if valid else np.zeros(1, dtype=np.int64)
            known.add(ids, np.diff(last, prepend=0))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.valid = np.append(self.valid, np.full(len(words), valid))
        self.chars += len(raw)

    def tokens(self, parts: list[list[str]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Whether each part's tokens have its bytes; and for each side the ids of all parts' tokens, and the part of each. Parts without have none."""
        if self.chars > CACHE_CHARS:
            self._forget()
        flat = list(chain.from_iterable(parts))
        get = self.words.get
        which = np.fromiter((get(w, -1) for w in flat), dtype=np.int64, count=len(flat))
        if len(new := np.flatnonzero(which < 0)):
            self._learn(list(dict.fromkeys(flat[k] for k in new.tolist())))
            which[new] = [self.words[flat[k]] for k in new.tolist()]
        part = np.repeat(np.arange(len(parts)), [len(words) for words in parts])
        valid = np.bincount(part[~self.valid[which]], minlength=len(parts)) == 0
        which, part = which[valid[part]], part[valid[part]]
        out = []
        for known in self.known:
            ids, sizes = known.of(which)
            out.append((ids, np.repeat(part, sizes)))
        return valid, out

    def overlaps(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of overlapping tokens of the same document, by A then B: their places in both sides, and whether they end together."""
        frames, ends = [], []
        for side, (ids, doc), name in zip(self.sides, tokens, "ab"):
            sizes = side.lengths[ids]
            end = np.cumsum(sizes)
            ends.append(end)
            # Documents follow each other, so ``start`` is ascending as merge_asof wants it; both sides have the same bytes.
            frames.append(pd.DataFrame({"doc": doc, "start": end - sizes, name: np.arange(len(ids))}))
        of_a, of_b = (pd.merge_asof(x, y, on="start", by="doc") for x, y in (frames, frames[::-1]))
        # Equal starts are found from both sides.
        of_b = of_b[frames[0]["start"].to_numpy()[of_b["a"].to_numpy()] != of_b["start"].to_numpy()]
        pairs = np.sort(np.concatenate([(x["a"].to_numpy() << 32) | x["b"].to_numpy() for x in (of_a, of_b)]), kind="stable")
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        return a, b, ends[0][a] == ends[1][b]

    def groups(self, tokens: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> pa.Array:
        """``a1,a2|b1`` for each group, given the links: its last tokens."""
        halves = []
        for side, (ids, _), last in zip(self.sides, tokens, (a, b)):
            cuts = np.concatenate([[0], last + 1]).astype(np.int32)
            halves.append(pc.binary_join(pa.ListArray.from_arrays(cuts, side.texts.take(pa.array(ids))), ","))
        return pc.binary_join_element_wise(*halves, "|")

    def align(self, parts: list[list[str]]) -> list[tuple]:
        """For each part (words of a text) None where bytes differ, or n_a, n_b, n_groups, its groups as text and its links' pairs of ids."""
        valid, tokens = self.tokens(parts)
        a, b, together = self.overlaps(tokens)
        a, b = a[together], b[together]
        groups = self.groups(tokens, a, b)
        per_part = np.bincount(tokens[0][1][a], minlength=len(parts))
        cuts = np.concatenate([[0], np.cumsum(per_part)]).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, groups), ";").to_pylist()
        keys = (tokens[0][0][a].astype(np.int64) << 32) | tokens[1][0][b]
        n_a, n_b = (np.bincount(doc, minlength=len(parts)) for _, doc in tokens)
        return [(int(n_a[k]), int(n_b[k]), int(per_part[k]), texts[k], keys[cuts[k] : cuts[k + 1]]) if v else None for k, v in enumerate(valid.tolist())]


def parts_of(text: str) -> Iterator[list[str]]:
    """The words of a text, in parts of BATCH_CHARS; the cut between two parts is one between words. An empty text has none."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + BATCH_CHARS) if len(text) - at > BATCH_CHARS else None
        part = text[at : cut.start()] if cut else text[at:]
        yield CUT.split(part) if part[0] == " " or part[-1] == " " or UNEVEN.search(part) else part.split(" ")
        at = cut.end() if cut else len(text)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


class _Document:
    """What is known of a document while its parts come in."""

    def __init__(self, doc_id):
        self.doc_id, self.valid, self.n, self.sha, self.keys = doc_id, True, np.zeros(3, dtype=np.int64), None, []

    def add(self, found: tuple | None) -> None:
        if found is None or not self.valid:
            self.valid, self.sha, self.keys, self.n = False, None, [], np.zeros(3, dtype=np.int64)
            return
        if self.sha is None:
            self.sha = hashlib.sha256()
        elif found[2]:
            self.sha.update(b";")
        self.n += found[:3]
        self.sha.update(found[3].encode())
        self.keys.append(found[4])


BLOCKS = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, links binary, pairs array<long>, numbers array<long>"


def _block(block: int, docs: list[_Document]) -> pd.DataFrame:
    keys = np.concatenate([np.zeros(0, dtype=np.int64), *[k for d in docs for k in d.keys]])
    pairs, which, numbers = np.unique(keys, return_inverse=True, return_counts=True)
    links = zstandard.ZstdCompressor(level=1).compress(which.astype(np.uint32).tobytes())
    n = [[int(d.n[k]) for d in docs] for k in range(3)]
    row = (block, [d.doc_id for d in docs], *n, [d.sha.hexdigest() if d.sha else "" for d in docs], links, pairs, numbers)
    return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, block = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        docs, waiting, chars, held = [], [], 0, 0

        def work() -> None:
            for (doc, _), found in zip(waiting, aligner.align([words for _, words in waiting])):
                doc.add(found)
            waiting.clear()

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                docs.append(_Document(None if pd.isna(doc_id) else int(doc_id)))
                for words in parts_of(text):
                    size = sum(map(len, words)) + len(words)
                    waiting.append((docs[-1], words))
                    chars, held = chars + size, held + size
                    if chars >= BATCH_CHARS:
                        work()
                        chars = 0
                if held >= BLOCK_CHARS:
                    work()
                    yield _block(block, docs)
                    docs, chars, held, block = [], 0, 0, block + 1
        if docs:
            work()
            yield _block(block, docs)

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            links = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.links), dtype=np.uint32)
            pairs = np.asarray(row.pairs, dtype=np.int64)
            counts, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
            if len(pairs):
                at = np.searchsorted(pairs, np.asarray(row.found, dtype=np.int64))
                counts[at], best[at] = row.counts, row.best
            n = np.asarray(row.n_groups, dtype=np.int64)  # a link ends a group
            before = np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([[0], np.cumsum(x[links])])[before] for x in (best, counts)]
            out = {"n_a": row.n_a, "n_b": row.n_b, "n_groups": n, "n_links": n, "n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1]), "groups_sha256": row.groups_sha256}
            ids = pd.array([None if x is None or x != x else int(x) for x in row.doc_ids], dtype="Int64")
            yield pd.DataFrame({"doc_id": ids} | out)


def _blocks_and_counts(docs: DataFrame, a_path: str, b_path: str, shelf: Shelf) -> tuple[DataFrame, DataFrame, DataFrame]:
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = shelf.put(slim.mapInPandas(_aligned(a_path, b_path), BLOCKS))
    sent = blocks.select("block", F.explode(F.arrays_zip("pairs", "numbers")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.numbers").alias("number"))
    counts = shelf.put(sent.groupBy("pair").agg(F.sum("number").alias("count"), F.count(F.lit(1)).alias("_n")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    highest = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return blocks, sent, shelf.put(counts.join(highest, "b_id").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"), "_n"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, count (links of the whole corpus that hold the pair), best (no other pair of this B id has more)."""
    counts = _blocks_and_counts(docs, a_path, b_path, Shelf(docs.sparkSession))[2]
    return counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "count", (F.col("best") == 1).alias("best"))


def overlaps(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each row doc_id, a_ids, b_ids, and the overlapping pairs as arrays of places: a_at, b_at, together (whether they end together).

    Texts that are null, empty or whose tokens have other bytes have empty arrays. A text's pairs are one row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found: list[list[np.ndarray]] = [[] for _ in range(5)]
                begin = [0, 0]
                for words in parts_of(text):
                    valid, tokens = aligner.tokens([words])
                    if not valid[0]:
                        found = [[] for _ in range(5)]
                        break
                    a, b, together = aligner.overlaps(tokens)
                    for own, x in zip(found, (tokens[0][0], tokens[1][0], a + begin[0], b + begin[1], together)):
                        own.append(x)
                    begin = [begin[0] + len(tokens[0][0]), begin[1] + len(tokens[1][0])]
                row = [None if pd.isna(doc_id) else int(doc_id), *[np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found]]
                yield pd.DataFrame([row], columns=["doc_id", "a_ids", "b_ids", "a_at", "b_at", "together"]).astype({"doc_id": "Int64"})

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInPandas(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_at array<long>, b_at array<long>, together array<boolean>")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or whose tokens' joined bytes on either side differ from a space and the text, has no tokens:
    zeros, and '' for the digest. Rows that repeat a doc_id or a text are documents of their own. An empty table gives no rows.
    Other columns are ignored. A link ends a group, so there are as many of both. Long texts are aligned in parts; one
    word (without a space at which texts may be cut) is encoded as a whole.
    """
    shelf = Shelf(docs.sparkSession)
    blocks, sent, counts = _blocks_and_counts(docs, a_path, b_path, shelf)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    found = hot_join(sent.select("block", "pair"), counts, ["pair"], max(1, total))
    per_block = found.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))  # a block's different pairs
    arrays = per_block.select("block", F.col("found.pair").alias("found"), F.col("found.count").alias("counts"), F.col("found.best").alias("best"))
    return blocks.join(arrays, "block", "left").mapInPandas(_scored, RESULT)
