"""Quality as compressibility: zstandard dictionaries of good and of bad text, and a calibrated score of their difference.

Two dictionaries of the same size are built from as many bytes of text labelled good and labelled bad. A text is compressed, in
pieces of a kilobyte so that the dictionary rather than the text itself explains a piece, with each of them; its feature is the
difference of the two compressed sizes in parts of the size without a dictionary. A logistic curve, fitted to labelled texts
that no dictionary has seen, turns the feature into the probability of the label 1.

Only the fit sees labels, and it takes a bounded sample of labelled rows: the rows of the smallest seeded hashes, at most
``SAMPLE_ROWS`` and ``SAMPLE_BYTES`` of each label. Half of them make the dictionaries, half the curve. Every document is
scored, as a whole, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import Shelf, md5_number, text_of

#: The sample for the fit, for each label: rows, bytes in all, and bytes of a row.
SAMPLE_ROWS, SAMPLE_BYTES, ROW_BYTES = 6_000, 16 << 20, 1 << 20
#: Bytes of a dictionary, of a piece of text, and zstandard's level.
DICTIONARY_BYTES, PIECE_BYTES, LEVEL = 112_640, 1024, 3
#: Labelled rows whose crc32(doc_id) modulo FOLDS is HELD_OUT are not learned from: fixed values of the query.
FOLDS, HELD_OUT = 4, 2
#: Scores from here on predict label 1.
THRESHOLD = 0.7
SEED = 41


def pieces(data: bytes) -> list[bytes]:
    """Consecutive pieces of the whole text."""
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of about ``size`` bytes; of too few samples to train one, their text itself."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of pieces with either dictionary and with none."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]
        for data in (good, bad):
            own = zstandard.ZstdCompressionDict(data)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False))

    def feature(self, data: bytes) -> float:
        """How much smaller the text gets with the good dictionary than with the bad one; 0 for an empty text."""
        plain, good, bad = (sum([len(c.compress(p)) for p in pieces(data)]) for c in self.compressors)
        return (bad - good) / plain if plain else 0.0


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve: score = 1 / (1 + exp(-(slope * feature + offset))); ``empty`` is the score of an empty text."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    empty: float

    def sizes(self) -> Sizes | None:
        return Sizes(self.good, self.bad) if self.good or self.bad else None

    def score(self, sizes: Sizes | None, data: bytes) -> float:
        if not data or sizes is None:
            return self.empty
        return float(1 / (1 + np.exp(-np.clip(self.slope * sizes.feature(data) + self.offset, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, by Newton steps; the slope of the standardised feature is held by a small ridge."""
    scale, centre = float(x.std()) or 1.0, float(x.mean())
    z = np.column_stack([(x - centre) / scale, np.ones_like(x)])
    w = np.zeros(2)
    penalty = np.array([ridge * len(x) + 1e-9, 1e-9])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def learned(good: list[bytes], bad: list[bytes], good_left: list[bytes], bad_left: list[bytes]) -> Model:
    """The model of the texts that make the dictionaries and of those left for the curve."""
    n, m = len(good) + len(good_left), len(bad) + len(bad_left)
    empty = (n + 1) / (n + m + 2)
    if not (good and bad and good_left and bad_left):
        return Model(b"", b"", 0.0, 0.0, empty)
    # As many bytes on both sides, or the larger sample would explain more of any text.
    least = min(sum(map(len, good)), sum(map(len, bad)))
    halves = []
    for texts in (good, bad):
        own, size = [], 0
        for t in texts:
            if size >= least:
                break
            own.append(t[: least - size])
            size += len(own[-1])
        halves.append([p for t in own for p in pieces(t) if len(p) >= 8])
    made = [dictionary(h, min(DICTIONARY_BYTES, max(1024, least // 4))) for h in halves]
    sizes = Sizes(*made)
    x = np.array([sizes.feature(t) for t in (*good_left, *bad_left)])
    y = np.repeat([1.0, 0.0], [len(good_left), len(bad_left)])
    # The curve must know how frequent the labels are, also where one label's sample was cut off.
    return Model(*made, *logistic(x, y), empty)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int | None = HELD_OUT) -> Model:
    """A model of ``labels`` (doc_id, quality 0 or 1) and the texts that they name; rows of the fold ``held_out`` are left out.

    Null ids and labels are ignored, as are other labels than 0 and 1 and texts that are null, empty or longer than ROW_BYTES;
    an id with several labels has the least, one with several texts the first in order. The sample (see above) is the only thing that is gathered.
    """
    shelf = Shelf(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    if held_out is not None:
        usable = usable.filter(fold != held_out)
    usable = shelf.put(usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("draw", md5_number(F.lit(SEED), F.col("doc_id"))))
    shares = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    drawn = [usable.filter(F.col("quality") == q).orderBy("draw", "doc_id").limit(SAMPLE_ROWS) for q in (0, 1)]
    chosen = shelf.put(drawn[0].unionByName(drawn[1]))  # 2 * SAMPLE_ROWS rows at most, so it may be broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter(F.octet_length("text").between(1, ROW_BYTES))
    own = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "draw").agg(F.min("text").alias("text"))
    running = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy("draw", "doc_id"))
    sample = own.withColumn("bytes", running).filter(F.col("bytes") <= SAMPLE_BYTES).orderBy("draw", "doc_id").collect()
    parts: dict[tuple[int, int], list[bytes]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for r in sample:
        parts[r["quality"], r["draw"] // 2 % 2].append(r["text"].encode("utf-8", "surrogatepass"))
    model = learned(parts[1, 0], parts[0, 0], parts[1, 1], parts[0, 1])
    return reweighed(model, {q: len(parts[q, 1]) for q in (0, 1)}, shares)


def reweighed(model: Model, sampled: dict[int, int], all_rows: dict[int, int]) -> Model:
    """The model with its offset moved from the labels' odds in the sample to those among all labelled rows."""
    if not all(sampled.get(q) and all_rows.get(q) for q in (0, 1)):
        return model
    moved = np.log(all_rows[1] / all_rows[0]) - np.log(sampled[1] / sampled[0])
    return Model(model.good, model.bad, model.slope, model.offset + float(moved), all_rows[1] / (all_rows[0] + all_rows[1]))


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, held_out, score (0 to 1, likelier label 1), predicted (1 from ``threshold`` on).

    Null and empty texts have the share of label 1 among the labelled rows as their score (0.5 without any), as have all texts where a label has too
    few rows to learn from. A null doc_id is not held out. Equal texts have equal scores. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = model.sizes()
        for batch in batches:
            found = [model.score(sizes, t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield batch[["doc_id", "held_out"]].assign(score=found, predicted=(np.array(found) >= threshold).astype(np.int32))

    is_held = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % folds == held_out, F.lit(False))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), is_held.alias("held_out"), text_of().alias("text"))
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return slim.mapInPandas(lambda it: run(b.astype({"doc_id": "Int64"}) for b in it), schema)
