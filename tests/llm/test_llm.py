"""The training-data operators against brute force, SQL and odd inputs."""

import base64
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import TABLES, assert_same, database
from odd_documents import rows as odd_rows
from framelens.llm import byte_bpe, exact_dedup, license_scan, mixing, ngram_join, quality, queries, secret_scan, sharding, suffix_dedup, url_filter

SPACE = re.compile(r"[\x20\x09-\x0D]")


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, TABLES), database(TABLES), queries.ORACLE_SQL[name])


OPERATORS = {
    1: exact_dedup.exact_dedup,
    2: lambda d: byte_bpe.encode_and_decode(d, *tokenizer()),
    3: lambda d: sharding.shard(d, 3),
    4: quality.quality_rules,
    5: mixing.mix,
    6: suffix_dedup.remove_repeated,
    7: license_scan.scan_licenses,
    8: secret_scan.scan_secrets,
    9: ngram_join.similar_groups,
}


def tokenizer():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_odd_rows(odd, clashing, empty, n):
    rows = OPERATORS[n](odd).collect()
    if n != 5:
        assert len(rows) == odd.count()
    assert len(OPERATORS[n](clashing).collect()) == len(rows)
    assert OPERATORS[n](empty).collect() == []


def test_op1(odd):
    rows = odd_rows()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is not None, i or 0, i))
    got = exact_dedup.exact_dedup(odd, block_bytes=16).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, min(groups[k])[3], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t, *_ in rows for k in [SPACE.sub("", t or "")])
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.drop_copies(odd).count() == len(groups)


def test_op2_is_tiktoken(spark, odd):
    import public_tokenizers as P
    import tiktoken

    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.Coder(ranks, pattern)
    rng = random.Random(5)
    letters = ["a", "b", " ", "\n", "\t", "é", "日", "١", "𝒳", "\x1c", "\x85", "\xa0", "​", "'s", "!!", "12", "ß", "🙂", "\x00", "　", "\r", "th", "ing"]
    texts = ["", "ab" * 400 + "xyz" * 200, *["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)], *[t for _, t in documents()[:40]]]
    texts += ["x" * 300_000, "".join(rng.choice("acgt") for _ in range(100_000)), "".join(rng.choice(["ing", "house", "er", "日本", "ation"]) for _ in range(9_000)), " " * 5000 + "y", *["".join(rng.choice("abc") for _ in range(k)) for k in range(190, 420)]]
    ids = coder.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]
    encoded = byte_bpe.encode(odd.filter("doc_id = 14"), path, pattern)
    assert bytes(byte_bpe.decode(encoded, path, pattern).first().data).decode() == "a b 日本語 🙂\r\nz"


def test_op3(spark, odd):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = sharding.shard(docs, 7).collect()
    texts = dict(documents())
    per = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        per[r.shard].append(r.slot)
    assert sorted(per) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    mixture = Counter((r.shard, r.source) for r in rows)
    whole = Counter(r.source for r in rows)
    assert all(abs(mixture[s, k] - n / 7) <= 2 for s in per for k, n in whole.items())
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(5), 7).collect())


def md5_number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("shards", [7, 40])
def test_op3_order(spark, shards):
    """Shard and slot of every row by plain sorting: seeded order within each source, fractions of all, equal cuts."""
    rows, per = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), source FROM '{TABLES}/documents.parquet'").fetchall(), defaultdict(list)
    for i, t, source in rows:
        raw = t.encode()
        per["~" if source is None else f"={source}"].append((md5_number(17, i, zlib.crc32(raw)), zlib.crc32(raw), len(raw) + 16, i))
    order = []
    for stratum, own in per.items():
        phase = md5_number(17, "phase", stratum) / 2**60
        order += [((rank + phase) / len(own), stratum, *tie) for rank, tie in enumerate(sorted(own))]
    want = {}
    for position, (*_, i) in enumerate(sorted(order)):
        at = position * shards // len(rows)
        want[i] = (at, position - -(-at * len(rows) // shards))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(spark.read.parquet(f"{TABLES}/documents.parquet").repartition(5), shards).collect()}
    assert got == want


def brute_surface(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_op4_counts(spark, odd):
    for _, text in documents()[:120]:
        assert quality.surface(text) == brute_surface(text)
    got = {(r.doc_id, r.n_words): (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(odd).collect()}
    for i, t, *_ in odd_rows():
        want = brute_surface(t or "")
        assert got[i, want[0]] == want


def test_op4_kept(spark):
    """The verdict by the scores: the base, and the band of each language by its quartiles in bins."""
    rows = quality.quality_rules(spark.read.parquet(f"{TABLES}/documents.parquet")).collect()
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{TABLES}/documents.parquet'").fetchall())
    bins = defaultdict(list)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if not r.base_failed:
            bins[langs[r.doc_id]].append(math.floor(r.log_ppl / quality.BIN))
    for r in rows:
        own, inside = sorted(bins[langs[r.doc_id]]), False
        if r.log_ppl is not None and own:
            q1, q3 = ((own[math.ceil(q * len(own)) - 1] + 0.5) * quality.BIN for q in (0.25, 0.75))
            wide = quality.REACH * max(q3 - q1, quality.LEAST_IQR)
            inside = q1 - wide <= r.log_ppl <= q3 + wide
        assert r.kept == (inside and not r.base_failed)


def test_op4_clashing_names(spark, odd):
    own = odd.withColumn("_row_key", F.lit("mine")).withColumn("row_key", F.col("doc_id"))
    got = quality.keep_good(own)
    assert got.columns == own.columns and all(r["_row_key"] == "mine" for r in got.collect())


def test_op4_keeps_clean_and_rejects_noise(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    noise = spark.createDataFrame([(10_000 + i, " ".join("".join(random.Random(i * 100 + k).choice("#$%&@!^*QZXJ0987") for _ in range(9)) for k in range(60)), "en", "src0", 1) for i in range(5)], docs.schema)
    got = {r.doc_id: r for r in quality.quality_rules(docs.unionByName(noise)).collect()}
    assert not any(got[10_000 + i].kept for i in range(5))
    clean = [r for k, r in got.items() if k < 10_000 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.9 * len(clean)


def test_op5_rates(spark):
    own = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(own, {"a": 3.0, "b": 1.0}, rows=8000).groupBy("source").count().collect()}
    assert abs(got["a"] - 6000) < 300 and abs(got["b"] - 2000) < 200
    assert mixing.mix(own, {"z": 1.0}).count() == 0


def test_op6(spark, odd):
    length = 40
    rows = [(i, t or "") for i, t, *_ in odd_rows() if i is not None]
    own = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in suffix_dedup.remove_repeated(own, length).collect()}
    seen = set()
    for i, t in sorted(dict(rows).items()):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        assert bytes(got[i].kept) == kept and got[i].n_removed == sum(gone)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op6_documents(spark):
    """All documents by strings of 100 bytes, against a set of all strings seen before."""
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op6_suffix_dedup"](spark, TABLES).collect()}
    seen = set()
    for i, t in documents():
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            h = hashlib.blake2b(raw[k : k + 100], digest_size=12).digest()
            if h in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(h)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        assert got[i] == (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()), i


def test_op6_suffix_sort():
    import numpy as np

    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(300)
    lists = np.repeat([0, 1, 2], [120, 1, 179])
    order = suffix_dedup.suffix_sort(data, suffix_dedup.prefix_hashes(data), starts, lists, 50)
    raw = data.tobytes()
    want = sorted(range(300), key=lambda i: (lists[i], raw[i : i + 50]))
    assert [raw[starts[i] : starts[i] + 50] for i in order] == [raw[i : i + 50] for i in want] and (lists[order] == lists).all()


def test_op7_templates(spark, odd):
    got = {r.doc_id: r for r in license_scan.scan_licenses(odd).collect() if r.doc_id}
    assert got[11].licences == "MIT" and got[11].n_matches == 1 and got[11].dice == 1.0 and got[1].n_matches == 0
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    for r in license_scan.scan_licenses(texts).collect():
        assert r.licence == license_scan.TEMPLATES[r.doc_id][0]


def test_op7_wrapped(spark):
    """Licences wrapped over lines are found by their paragraphs, with and without comment marks before the lines."""
    mit = [t for name, t in license_scan.TEMPLATES if name == "MIT"][2:]
    plain = "\n\n".join(textwrap.fill(x, 76) for x in ["MIT License", "Copyright (c) 2020 Some One", *mit])
    bsd = [t for name, t in license_scan.TEMPLATES if name == "BSD"]
    marked = "/*\n" + "\n *\n".join(textwrap.fill(x, 72, initial_indent=" * ", subsequent_indent=" * ") for x in [bsd[4], bsd[5]]) + "\n */\nint main;\n"
    rows = [(1, plain), (2, marked), (3, "\n".join(["some lines", "on no license"] * 50)), (4, "\n" * 1000 + "x\n"), (5, "Released under the\nMIT License.")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].licences, got[1].n_paragraphs, got[1].n_matches) == ("MIT", 3, 0)
    assert (got[2].licences, got[2].n_paragraphs) == ("BSD", 2)
    assert (got[3].licences, got[3].n_paragraphs, got[4].n_paragraphs) == ("", 0, 0)
    assert (got[5].licences, got[5].n_paragraphs, got[5].whole) == ("MIT", 1, True)


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_op8(spark, odd):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, "TOKEN = 'abcdefgh' ſecret=12345678 Key api_Key:x api_key: ABCDEFGH1 AKIA AKIA0123456789AB ghp_" + "a" * 36)], docs.schema)
    texts = {**dict(documents()), 9001: extra.first().text}
    for r in secret_scan.scan_secrets(docs.unionByName(extra)).collect():
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        every = [(m.start(), k, m.end()) for k, rule in enumerate(secret_scan.RULES) for m in re.finditer(rule.pattern, t, re.ASCII) if len(m[rule.group]) >= rule.least]
        assert r.spans == ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(every))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_op9(spark, n, percent):
    docs = dict(documents())
    rng = random.Random(9)
    base = [w for w in " ".join(docs[i] for i in range(3)).split()][:300]
    for k in range(40):  # a dense group on both sides of the threshold
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10_000)}"
        docs[5000 + k] = " ".join(own)
    _hold_components(spark, docs, n, percent)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_op9_hot_groups(spark, n, percent):
    """A passage that all documents hold, a group of 500 near copies, chains, and a group that no one document is the centre of."""
    rng = random.Random(19)
    word = lambda k: f"w{rng.randrange(k)}"
    passage, base = [word(400) for _ in range(60)], [word(400) for _ in range(90)]
    docs = {k: " ".join([word(10**6) for _ in range(rng.randrange(5, 60))] + passage) for k in range(150)}
    for k in range(500):
        own = list(base)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [word(30)] * rng.randrange(1, 3)
        docs[1000 + k] = " ".join(own)
    chain = [word(10**6) for _ in range(80)]
    for k in range(40):
        chain[2 * k] = word(10**6)
        docs[3000 - k] = " ".join(chain)
    for k in range(60):
        docs[4000 + k] = " ".join(x for x in base[:80] + passage if rng.random() > 0.02)
    _hold_components(spark, docs, n, percent)


def _hold_components(spark, docs, n, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in docs.items():
        w = t.encode().translate(lower).split()
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {p for v in inverted.values() for p in itertools.combinations(v, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    own = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(own, n, percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_op10_cascade(spark):
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("h"), F.col("id"), F.lit(".org")).alias("key"))
    universe = spark.range(3000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".org")).alias("key"))
    levels = url_filter.cascade(listed, universe)
    flag = url_filter.listed_flag(levels, spark)
    judged = universe.select("key", flag(F.array(F.xxhash64(F.lit(1), "key")), F.array(F.xxhash64(F.lit(2), "key"))).alias("f"))
    assert {r.key for r in judged.filter("f").collect()} == {r.key for r in listed.collect()}


def test_op10_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Sub.SPAM-farm.example.net?x=://y"), (6, "http://example.org/en/1#a"), (7, "http://a.example.org"), (7, "http://a.example.org"), (None, "ftp://x.com/fr/a?b")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("verdict", F.lit(1))
    listed = spark.createDataFrame([(x,) for x in url_filter.LISTED], "key string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got[1, ""] == ("", None, "allow") and got[4, ""] == ("", None, "allow")
    assert got[5, "sub.spam-farm.example.net"] == ("", None, "block")
    assert got[6, "example.org"] == ("/en/1", "example.org/en/1", "block") and got[7, "a.example.org"] == ("", None, "allow")
    assert got[None, "x.com"] == ("/fr/a", "com/fr/", "allow")
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_pipeline(spark, odd, clashing, empty):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality rules", "exact copies", "near copies", "mixture", "tokens"]
    for own in (odd, clashing, empty):
        out = own
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, out, TABLES)
            assert out.columns == own.columns, name
            out = spark.createDataFrame(out.collect(), own.schema)
        last = P.STAGES[-1][1](spark, out, TABLES).collect()
        assert len(last) == out.count()
        assert Counter((r.doc_id, r.decoded_sha256) for r in last) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())


def test_pipeline_keeps_extra_columns(spark, odd):
    """Columns with the names of results, of the operators' own columns, and with dots come back from every stage with their values."""
    import corpus_pipeline as P

    names = ("a.b", "copy", "n_copies", "shuffle_key", "component_id", "_n", "_gone", "_row", "_row_key", "rate", "kept", "in0__", "c`d")
    own = odd.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in names])
    given = {tuple(r) for r in own.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, own, TABLES)
        assert out.columns == own.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and set(rows) <= given, name


def test_op2_very_long_texts():
    """Texts far above a block: one of many pieces and one of a single piece."""
    import tiktoken

    path, pattern = tokenizer()
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.Coder(ranks, pattern)
    text = "the quick brown fox, 日本 jumped over 12 lazy dogs\n" * 1_250_000
    ids = coder.encode([text, "tail"])
    assert len(text.encode()) > 64e6 and ids[1].tolist() == library.encode_ordinary("tail")
    one = library.encode_ordinary(text[:5000])
    assert ids[0][: len(one) - 8].tolist() == one[:-8]
    data = coder.decode(ids)
    assert data == [text.encode(), b"tail"]
    assert coder.digest(ids[0][:600_000]) == hashlib.sha256(",".join(map(str, ids[0][:600_000].tolist())).encode()).hexdigest()


def test_pipeline_stages(spark):
    """Each stage on all that the one before kept, against brute force."""
    import corpus_pipeline as P
    import tiktoken

    stages, docs = dict(P.STAGES), spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    def run(name, ids):
        out = stages[name](spark, spark.createDataFrame([rows[i] for i in ids], docs.schema), TABLES)
        assert out.columns == docs.columns
        found = out.collect()
        assert all(rows[r.doc_id] == r for r in found)
        return [r.doc_id for r in found]

    good = sorted(r.doc_id for r in quality.quality_rules(docs).collect() if r.kept)
    assert sorted(run("quality rules", rows)) == good and len(good) < len(rows)

    best = {}
    for i in good:
        key = SPACE.sub("", rows[i].text)
        best[key] = min(best.get(key, (0, i)), (-len(rows[i].text), i)) if key in best else (-len(rows[i].text), i)
    single = sorted(i for _, i in best.values())
    assert sorted(run("exact copies", good)) == single and len(single) < len(good)

    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i in single:
        w = rows[i].text.encode().translate(lower).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in single}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(single, 2):
        both = len(sets[a] & sets[b]) if sets[a] and sets[b] else 0
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    near = sorted(i for i in single if find(i) == i)
    assert sorted(run("near copies", single)) == near and len(near) < len(single)

    sizes = Counter(rows[i].source for i in near)
    whole = sum(n**0.7 for n in sizes.values())
    want = Counter()
    for i in near:
        n = sizes[rows[i].source]
        rate, uniform, k = round(len(near) * n**0.7 / whole / n, 9), md5_number(23, i) / 2**60, 0
        total = term = math.exp(-rate)
        while total <= uniform:
            k += 1
            term = term * rate / k
            total += term
        want[i] = k
    mixed = run("mixture", near)
    assert Counter(mixed) == +want

    path, pattern = tokenizer()
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    last = stages["tokens"](spark, spark.createDataFrame([rows[i] for i in mixed], docs.schema), TABLES).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter((i, tuple(library.encode_ordinary(rows[i].text))) for i in mixed)


def test_op4_model_of_whole_code_points(spark):
    """Scores of each language by all its other documents, against the definition; no symbols are folded."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("абв гдж") for _ in range(60)), "ru") for i in range(6)] + [(10 + i, "".join(rng.choice("ab c") for _ in range(60)), "en") for i in range(90)]
    rows += [(200, "日本語 " * 9 + "本日", "ja"), (201, "日本 語本 日語 " * 4, "ja"), (202, "x y " * 12, None)]

    def points(t):
        return ["^", "^", *re.sub(r"\s+", " ", t), "$"]

    def orders(texts):
        """Counts of trigrams, and how many different symbols stand before each bigram and each symbol."""
        c3 = Counter(tuple(s[i - 2 : i + 1]) for s in texts for i in range(2, len(s)))
        c2 = Counter(g[1:] for g in c3)
        return c3, c2, Counter(g[1:] for g in c2)

    def discount(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [0, *[min(max(x, 0.05), most) for x, most in zip(raw, (0.95, 1.9, 2.9))]]

    def model(others, every):
        counts, d = dict(zip((3, 2, 1), orders(others))), dict(zip((3, 2, 1), map(discount, orders(every))))
        after = {k: defaultdict(list) for k in counts}
        for k, c in counts.items():
            for g, v in c.items():
                after[k][g[:-1]].append(v)

        def p(g):
            k = len(g)
            low = p(g[1:]) if k > 1 else 1 / 2**21
            seen = after[k].get(g[:-1])
            if not seen:
                return low
            c = counts[k][g]
            return (c - d[k][min(c, 3)] + sum(d[k][min(v, 3)] for v in seen) * low) / sum(seen)

        return p

    def score(own, others, every):
        p = model(others, every)
        for context in {tuple(own[i - 2 : i]) for i in range(2, len(own))}:  # it is a distribution
            symbols = {x for s in others for x in s}
            assert sum(p((*context, x)) for x in symbols) + (2**21 - len(symbols)) * p((*context, "?")) == pytest.approx(1.0)
        return -sum(math.log(p(tuple(own[i - 2 : i + 1]))) for i in range(2, len(own))) / (len(own) - 2)

    got = {r.doc_id: r.log_ppl for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, lang in rows:
        want = score(points(t), [points(u) for j, u, other in rows if other == lang and j != i], [points(u) for _, u, other in rows if other == lang])
        assert got[i] == pytest.approx(want, abs=2e-6)
    cyrillic = quality.point_trigrams("абв")
    assert len({int(g) & quality.ONE for g in [*cyrillic, *quality.point_trigrams("日")]}) == 5  # four letters and the end


def test_op6_null_and_repeated_ids(spark):
    """Texts of one doc_id, null too, are documents of their own; exact repeats of a row are one."""
    length, rng = 40, random.Random(6)

    def noise(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    passages = [noise(90) for _ in range(3)]
    rows = [(rng.choice([None, None, 5, 6]), noise(30 + 7 * i) + passages[i % 3] + noise(200)) for i in range(24)]
    rows += [(None, None), (None, ""), rows[0], rows[0], (9, passages[0] * 2)]
    got = {(r.doc_id, r.kept_sha256, r.n_removed) for r in suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length).collect()}
    seen, want = set(), set()
    for _, _, _, i, t in sorted({(i is not None, i or 0, int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), i, t or "") for i, t in rows}, key=lambda x: x[:3]):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        want.add((i, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest(), sum(gone)))
    assert got == want
