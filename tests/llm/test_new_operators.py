"""Token alignment, the compression classifier and the Merkle manifest against brute force and odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import TABLES
from odd_documents import rows as odd_rows
from framelens.llm import compression_quality, merkle, queries, token_align

ordered = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# --- 11: alignment


def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_of_letters():
    """The byte-level letters, by the usual recipe: bytes without a letter of their own come in order from 256 on."""
    out, more = {}, 0
    for b in range(256):
        own = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out[chr(b if own else 256 + more)] = b
        more += not own
    return out


def aligned_by_hand(rows):
    """The contract's columns by whole texts: each is encoded at once, ends are compared, pairs are counted."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(paths()[0])
    a_side.encode_special_tokens = True
    b_side, letters = SentencePieceProcessor(model_file=paths()[1]), byte_of_letters()
    name = {i: bytes(letters[c] for c in t) if t != "<|endoftext|>" else t.encode() for t, i in a_side.get_vocab().items()}
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        if not text or b"".join(name[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            docs.append((doc_id, None))
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in own]).tolist(), range(len(own)))) for own in ([name[i] for i in a], [piece(i) for i in b])]
        links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        cuts = [(-1, -1), *links]
        groups = ";".join(",".join(map(str, a[i + 1 : k + 1])) + "|" + ",".join(map(str, b[j + 1 : m + 1])) for (i, j), (k, m) in zip(cuts, links))
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        docs.append((doc_id, (len(a), len(b), len(links), len(links), pairs, hashlib.sha256(groups.encode()).hexdigest())))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if d is None else (i, *d[:4], sum(counts[p] == most[p[1]] for p in d[4]), sum(counts[p] for p in d[4]), d[5]) for i, d in docs]


LETTERS = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "١", "𝒳", "\x1c", "\x85", "\xa0", "'s", "!!", "12", "ß", "🙂", "\x00", "　", "\r", "th", "ing", " the", " \n", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", "▁"]


def test_op11(spark):
    rng = random.Random(3)
    rows = [(k if k % 9 else None, "".join(rng.choice(LETTERS[: 29 + (k % 10 == 0)]) for _ in range(rng.randrange(60)))) for k in range(800)]
    rows += [(1, None), (2, ""), (3, "a▁b c"), (4, " "), (5, "x" * 5000), (6, "the end of it " * 50), (7, "▁"), (6, "the end of it " * 50)]
    rows += [(i, t) for i, t, *_ in odd_rows()] + duckdb.sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet'").fetchall()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(tuple(r) for r in token_align.align(docs, *paths()).collect()) == ordered(aligned_by_hand(rows))


def test_op11_parts(monkeypatch):
    """A long text, aligned in parts, has the groups of the whole; so have words that are forgotten and met again."""
    rng = random.Random(4)
    text = "".join(rng.choice(LETTERS[:-1]) for _ in range(20_000)) + " plain words " * 100
    whole = token_align.Aligner(*paths()).align([token_align.CUT.split(text)])[0]
    monkeypatch.setattr(token_align, "BATCH_CHARS", 700)
    monkeypatch.setattr(token_align, "CACHE_CHARS", 900)
    aligner, parts = token_align.Aligner(*paths()), list(token_align.parts_of(text))
    assert len(parts) > 20
    found = [aligner.align([p])[0] for p in parts]
    assert [sum(x[k] for x in found) for k in range(3)] == list(whole[:3])
    assert ";".join(x[3] for x in found) == whole[3] and np.concatenate([x[4] for x in found]).tolist() == whole[4].tolist()


def test_op11_overlaps(spark):
    docs = spark.createDataFrame([(1, "Unglaublichkeiten, 日本 and so on"), (2, None), (3, "▁")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_align.overlaps(docs, *paths()).collect()}
    assert got[2].a_ids == got[3].a_at == []
    sides = token_align.Aligner(*paths()).sides
    ranges = []
    for side, ids in zip(sides, (got[1].a_ids, got[1].b_ids)):
        ends = np.cumsum(side.lengths[ids])
        ranges.append(list(zip((ends - side.lengths[ids]).tolist(), ends.tolist())))
    want = [(i, j, e == f) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1]) if s < f and t < e]
    assert list(zip(got[1].a_at, got[1].b_at, got[1].together)) == want


def test_op11_fast_letters():
    """Up to U+024F the fast library gives what the vocabulary's own gives."""
    side, rng = token_align.ByteLevel(paths()[0]), random.Random(1)
    assert side.fast is not None
    base = [chr(c) for c in range(0x250)]
    for _ in range(20_000):
        w = "".join(rng.choice(base if rng.random() < 0.5 else ["a", "1", " ", "\n", ".", "'s", "é"]) for _ in range(rng.randrange(1, 8)))
        assert side.fast(" " + w) == side.library.encode(" " + w, add_special_tokens=False).ids


def test_op11_pair_counts(spark):
    docs = spark.createDataFrame([(1, "the cat the dog"), (2, "the the"), (3, "the")], "doc_id long, text string")
    rows = token_align.pair_counts(docs, *paths()).collect()
    sides = token_align.Aligner(*paths()).sides
    by = {(sides[0].tokens[r.a_id], sides[1].tokens[r.b_id]): (r["count"], r.best) for r in rows}
    assert by[b" the", b" the"] == (5, True) and sum(n for n, _ in by.values()) == 7


# --- 12: the classifier


def fitted(spark, folder=TABLES):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, compression_quality.fit(docs, labels)


def test_op12_held_out(spark):
    """On rows that it has not learned from, good and bad are told apart and good ones stay."""
    docs, labels, model = fitted(spark, "/root/testdata/sf0.01")
    rows = compression_quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.97 and np.mean([s < 0.7 for s in bad]) > 0.7


def test_op12_learns_only_from_its_folds(spark):
    """Labels of the held-out fold, and columns other than the text, change nothing."""
    docs, labels, model = fitted(spark)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression_quality.fit(docs.repartition(3), turned.repartition(5)) == model
    a = {r.doc_id: r.score for r in compression_quality.score(docs, model).collect()}
    b = {r.doc_id: r.score for r in compression_quality.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "score": F.lit("z")}), model).collect()}
    assert a == b


def test_op12_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 7), (5, 1), (6, 0)], "doc_id long, quality int")
    model = compression_quality.fit(odd, labels)
    assert model.good == b"" and 0 < model.empty < 1
    rows = compression_quality.score(clashing, model).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {model.empty}
    assert compression_quality.score(empty, model).collect() == []
    nothing = compression_quality.fit(empty, labels.limit(0))
    assert nothing.empty == 0.5
    _, _, real = fitted(spark)
    scores = defaultdict(set)
    for r, t in ((r, t) for r in compression_quality.score(odd.filter("doc_id < 9"), real).collect() for i, t, *_ in odd_rows() if i == r.doc_id):
        scores[t].add(r.score)
    assert all(len(x) == 1 for x in scores.values()) and scores[""] == scores[None] == {real.empty}


def test_op12_long_text_counts_as_a_whole(spark):
    _, _, model = fitted(spark)
    good, bad = "And the thing of that, is in the. " * 2000, "x### y$$$ z%%% | w&&& " * 4000
    sizes = model.sizes()
    a, b, both = (model.score(sizes, t.encode()) for t in (good, bad, good + bad))
    assert min(a, b) < both < max(a, b)


def test_op12_curve():
    rng = np.random.default_rng(2)
    x = rng.normal(0.1, 0.2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(9 * x - 0.5)))).astype(float)
    slope, offset = compression_quality.logistic(x, y)
    assert abs(slope - 9) < 1 and abs(offset + 0.5) < 0.2
    assert all(map(np.isfinite, compression_quality.logistic(np.repeat([0.0, 1.0], 20), np.repeat([0.0, 1.0], 20))))


# --- 13: the manifest


def proved_by_hand(rows):
    """The contract's columns by plain lists of whole levels. ``rows``: doc_id, source, lang, n_chars, text."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda *fields: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def tree(nodes):
        siblings, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
            for own, a in zip(siblings, at):
                own.append((runs[a // 16][: a % 16], runs[a // 16][a % 16 + 1 :]))
            at, nodes = [a // 16 for a in at], [digest("".join(r)) for r in runs]
        return nodes[0], siblings

    per = defaultdict(list)
    for r in rows:
        per[r[1]].append(r)
    for own in per.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: tree([leaf(*r) for r in own]) for s, own in per.items()}
    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, above):
        for r, below in zip(per[s], trees[s][1]):
            path, text = below + top, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            x = leaf(*r[:4], text)
            for a, b in path:
                x = digest("".join(a) + x + "".join(b))
            out.append((r[0], leaf(*r), trees[s][0], root, digest("".join(x for a, b in path for x in a + b)), x, x == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 4095, 4096, 4097, 9000])
def test_op13_positions(n):
    """The closed form gives each node the place at which it is appended."""
    nodes = list(merkle.append([b"x"] * n, merkle.height(n)))
    assert [int(merkle.positions(level, np.array([k]), n)[0]) for level, k, _ in nodes] == list(range(len(nodes)))


def test_op13(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{TABLES}/documents.parquet'").fetchall()
    assert ordered(tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, TABLES).collect()) == ordered(proved_by_hand(rows))


def test_op13_odd_rows(spark, odd, clashing, empty):
    rows = [(i, s, l, n, t) for i, t, l, s, n in odd_rows()]
    assert ordered(tuple(r) for r in merkle.proofs(clashing).collect()) == ordered(proved_by_hand(rows))
    assert merkle.proofs(empty).collect() == [] and merkle.manifest(empty).collect() == []


def test_op13_long_source(spark):
    """A source of more than one range of leaves and of several rounds, many small ones, nulls, repeated ids and rows."""
    rows = [(k * 7 % 9001, "hot", "en", k, f"Text {k}") for k in range(9001)] + [(k, f"s{k % 40}", None, None, "A") for k in range(300)]
    rows += [(None if k % 2 else 5, None, "é", 1, "Same") for k in range(40)] + [(1, "", "x", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = merkle.proofs(docs, with_proof=True).collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered(proved_by_hand(rows))
    for r in got[::97]:  # the proof alone leads from the leaf to the root
        path = merkle.unpacked(bytes(r.proof))
        assert merkle.fold(r.leaf.encode(), path).decode() == r.root and hashlib.sha256(b"".join(a + b for a, b in path)).hexdigest() == r.proof_sha256
    log = defaultdict(list)
    for r in merkle.manifest(docs).collect():
        log[r.whole, r.source].append((r.position, r.digest))
    size = lambda n: sum(-(-n // 16**k) for k in range(merkle.height(n) + 1))
    per = Counter((False, r[1]) for r in rows) | Counter({(True, None): len({r[1] for r in rows})})
    assert {k: sorted(p for p, _ in v) for k, v in log.items()} == {k: list(range(size(n))) for k, n in per.items()}
    assert max(log[True, None])[1] == got[0].root


def test_op13_tampering(spark):
    rows = [(k, "a", None, None, "UPPER" if k % 2 else "lower") for k in range(400)]
    for r in merkle.proofs(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2)) == (r.folded_root == r.root)
