"""The exchange of the n-gram join between blocks of documents and ranges of hashes, and its long lists."""

import random

import numpy as np
import pytest
from test_llm import _hold_components

from framelens.llm import ngram_join
from framelens.llm.ngram_join import _blocks, _from_low_bytes, _unpacked


@pytest.mark.parametrize("bits", [6, 17, 20])
def test_rows_of_a_block_grow_with_its_tokens(spark, bits):
    rng = random.Random(bits)
    for n_docs in (40, 400):
        docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(32))) for i in range(n_docs)], "doc_id long, text string").coalesce(1)
        rows = docs.mapInPandas(_blocks(3, bits), ngram_join.BLOCKS).filter("part IS NOT NULL").collect()
        tokens = sum(len(_from_low_bytes(r.tokens)) for r in rows)
        assert tokens == 30 * n_docs and len(rows) <= min(tokens, 1 << bits)
        assert len({r.part for r in rows}) == len(rows)
        for r in rows:
            who, counts = _unpacked(r.who, np.uint16), _unpacked(r.counts, np.uint32)
            assert len(who) == len(counts) <= counts.sum() == len(_from_low_bytes(r.tokens))
        assert sum(len(_unpacked(r.who, np.uint16)) for r in rows) <= tokens


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 100)])
def test_many_ranges_small_blocks_and_dealt_lists(spark, monkeypatch, n, percent):
    """Thousands of ranges with hardly a token each, copies in different blocks, and lists that go to many tasks."""
    monkeypatch.setattr(ngram_join, "RANGE_TOKENS", 4)
    monkeypatch.setattr(ngram_join, "LIST_NODES", 2)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    rng = random.Random(n)
    docs = {}
    base = [f"b{i}" for i in range(60)]
    for k in range(60):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(60)] = f"x{rng.randrange(9)}"
        docs[k] = " ".join(own)
        docs[500 - k] = docs[k].upper() if k % 3 == 0 else " ".join(own[: rng.randrange(1, 60)])
    for k in range(40):
        docs[1000 + k] = " ".join([*base[:25], *[f"y{k // 2}.{i}" for i in range(30 + k % 2)]])
    docs |= {2000: "", 2001: "one", 2002: "ONE", 2003: "one two"}
    _hold_components(spark, docs, n, percent)
