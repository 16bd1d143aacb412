"""The rows of op4's model on their way to the blocks."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import zstandard

from framelens.llm import quality


def _rows(n, seed=1):
    """Batches of distinct rows (block, model_lang, ord, key) in any order, with strings of their own as they come from Spark."""
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    keys = rng.permutation(n).astype(np.int64) << 20
    for at in range(0, n, 10_000):
        own = keys[at : at + 10_000]
        numbers = {x: rng.integers(0, 1 << 40, len(own)) for x in quality.ROW}
        yield pd.DataFrame({"block": rng.integers(0, 5, len(own)), "model_lang": ["".join(("=", draw.choice("abcd"))) for _ in own], "key": own, **numbers, "ord": rng.integers(0, 4, len(own)).astype(np.int32)})


def test_packed_rows_are_those_sent(monkeypatch):
    monkeypatch.setattr(quality, "PACKED_ROWS", 25_000)
    names = ["block", "model_lang", "ord", "key", *quality.ROW]
    want = sorted(x for b in _rows(60_000) for x in b[names].itertuples(index=False, name=None))
    got = []
    for batch in quality._packed(_rows(60_000)):
        for block, lang, n, data in batch.itertuples(index=False, name=None):
            table = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.int64).reshape(2 + len(quality.ROW), n).copy()
            table[1] = np.cumsum(table[1])
            assert np.array_equal(np.lexsort((table[1], table[0])), np.arange(n))
            got += [(block, lang, *x) for x in table.T.tolist()]
    assert sorted(got) == want


def test_waiting_rows_are_small():
    """Many rows wait at once; two tasks of an executor hold them beside a full heap."""
    n = 300_000
    batches = list(_rows(n))
    tracemalloc.start()
    try:
        for _ in quality._packed(iter(b.copy() for b in batches)):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 250 * n, most / n
