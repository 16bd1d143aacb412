"""Work of op6 that grew faster than its input: strings that have no equal are never sorted, and anchors are found once a text."""

import random

import numpy as np
import pandas as pd

from framelens.llm import suffix_dedup


def anchors_by_hand(raw, length, k):
    """place: (lo, hi) over all strings of a text."""
    out = {}
    data = np.frombuffer(raw, dtype=np.uint8)
    h = suffix_dedup.anchor_hashes(data, np.arange(len(raw) - k + 1), k).view(np.uint64) >> np.uint64(22)
    for s in range(len(raw) - length + 1):
        p = min(range(s, s + length - k + 1), key=lambda p: (h[p], p))
        out[p] = (out.get(p, (s,))[0], s)
    return out


def test_owners_across_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 39, 40, 41, 250, 1000, 90, 3000, 299, 300, 301)] + [b"a" * 900]
    got = suffix_dedup.owners(texts, 40)
    for i, raw in enumerate(texts):
        own = got["text"] == i
        place, lo, hi = suffix_dedup.decoded(suffix_dedup.coded(got["place"][own], got["lo"][own], got["hi"][own], 40), 40)
        assert {p: (a, b) for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist())} == anchors_by_hand(raw, 40, suffix_dedup.K)
        assert (got["hash"][own] == suffix_dedup.anchor_hashes(np.frombuffer(raw, dtype=np.uint8), place)).all()


def test_strings_without_equals_are_not_sorted(monkeypatch):
    sorted_ = []
    sort = suffix_dedup.suffix_sort
    monkeypatch.setattr(suffix_dedup, "suffix_sort", lambda data, h, starts, *more: sorted_.append(len(starts)) or sort(data, h, starts, *more))
    rng, length = random.Random(5), 60
    around = [bytes(rng.choice(b"abcdefgh") for _ in range(70)) + b"anchor" for _ in range(50)]
    around[7] = b"x" * 8 + around[3][8:]
    code = [int(suffix_dedup.coded(36, 0, 76 - length, length))] * 50
    rows = pd.DataFrame({"hash": 1, "around": around, "before": 36, "doc_id": range(50), "digest": 0, "anchor": code})
    out = suffix_dedup._compare(rows, length)
    assert {d: s.tolist() for d, s in zip(out["doc_id"], out["starts"]) if len(s)} == {7: list(range(8, 17))}
    assert sorted_ == [18]
