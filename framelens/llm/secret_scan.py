"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: the literals that any match must
contain, each an AND of its trigrams, alternatives joined by OR. The texts of a batch of rows are indexed: for
every trigram that some query asks for, the list of texts that have it, found in one pass over the bytes.
A rule's postings are intersected and united, and its expression runs only over the candidates. A rule without
mandatory trigrams scans all texts. Each batch has an index of its own, so nothing is shuffled and memory
is bounded by the batch.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framelens.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    """kind; expression; group that must have ``least`` characters (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Rules in the order of their kinds: fixed values. The first three are the base; (?i:) folds ASCII letters only.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("repo_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
BASE = 3

#: Bytes of text in one index.
INDEX_BYTES = 8 << 20


def _fold(text: str) -> bytes:
    return text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def trigram_query(pattern: str) -> list[frozenset[bytes]]:
    """Sets of trigrams (ASCII letters in lower case): a text that matches has all of at least one set.

    [] means that nothing is mandatory.
    """
    MANY = 64

    def strings(tree) -> list[tuple[list[str], bool]]:
        """The pieces of a sequence: each the texts it may be, and whether these are all it can be."""
        pieces: list[tuple[list[str], bool]] = []
        for op, arg in tree:
            if op is C.LITERAL:
                pieces.append(([chr(arg)], True))
            elif op is C.SUBPATTERN:
                pieces += strings(arg[3])
            elif op is C.BRANCH:
                ways = [strings(t) for t in arg[1]]
                if all(all(exact for _, exact in w) for w in ways):
                    texts = [t for w in ways for t in joined(w)]
                    pieces.append((texts, True) if len(texts) <= MANY else ([], False))
                else:
                    pieces.append(([], False))
            elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
                pieces.append(([chr(a) for _, a in arg], True))
            elif op is C.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                inner = strings(arg[2])
                if all(exact for _, exact in inner):
                    pieces.append((["", *joined(inner)], True))
                else:
                    pieces.append(([], False))
            else:
                pieces.append(([], False))
        return pieces

    def joined(pieces) -> list[str]:
        out = [""]
        for texts, _ in pieces:
            out = [a + b for a in out for b in texts]
        return out

    runs, run = [], [""]
    for texts, exact in [*strings(parser.parse(pattern)), ([], False)]:
        if exact and len(run) * len(texts) <= MANY:
            run = [a + b for a in run for b in texts]
            continue
        runs.append(run)
        run = [t for t in texts] if exact else [""]
    best: list[frozenset[bytes]] = []
    for run in runs:
        sets = [frozenset(f[i : i + 3] for i in range(len(f) - 2)) for f in map(_fold, run)]
        if all(sets) and (not best or min(map(len, sets)) > min(map(len, best))):
            best = list(dict.fromkeys(sets))
    return best


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Index:
    """The postings of the wanted trigrams over a batch of texts."""

    def __init__(self, wanted: np.ndarray):
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        self.slot[wanted] = np.arange(len(wanted), dtype=np.int16)
        self.number = {int(c): i for i, c in enumerate(wanted)}

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """A Boolean row for each wanted trigram and column for each text."""
        out = np.zeros((len(self.number), len(texts)), dtype=bool)
        if not texts:
            return out
        sizes = np.array([len(t) + 2 for t in texts])
        data = np.frombuffer(b"\0\0".join(texts) + b"\0\0", dtype=np.uint8).copy()
        data[(data >= 65) & (data <= 90)] += 32
        codes = data[:-2].astype(np.int32) << 16
        codes |= data[1:-1].astype(np.int32) << 8
        codes |= data[2:]
        slots = self.slot[codes]
        at = np.flatnonzero(slots >= 0)
        out[slots[at], np.searchsorted(np.cumsum(sizes), at, side="right")] = True
        return out


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches; those whose group is too short are dropped."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # ASCII rules for case folding and \s: no letter outside ASCII counts as one inside.
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        wanted = np.array(sorted({_code(t) for q in queries for s in q for t in s}), dtype=np.int64)
        index = Index(wanted)

        def block(ids: list, texts: list[str]) -> pd.DataFrame:
            have = index.postings([t.encode() for t in texts])
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, expression, query) in enumerate(zip(rules, compiled, queries)):
                if query:
                    hits = np.zeros(len(texts), dtype=bool)
                    for together in query:
                        hits |= np.logical_and.reduce(have[[index.number[_code(t)] for t in together]], axis=0)
                    which = np.flatnonzero(hits)
                else:
                    which = range(len(texts))
                for i in which:
                    found[i] += [(a, k, b) for a, b in matches(rule, expression, texts[i])]
            rows = []
            for i, spans in zip(ids, found):
                spans.sort()
                told = [(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in spans]
                base = ",".join(s for k, s in told if k < BASE)
                rows.append((i, *(sum(k == j for k, _ in told) for j in range(BASE)), hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in told)))
            return pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"]):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= INDEX_BYTES:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield block(ids, texts)

    return scan


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` has kind:start:end of every match (code points, end exclusive), by start and then by the order of
    the rules, joined by commas; ``base_sha256`` is the digest of those of the first three rules. A null text
    counts as empty and has none; repeated rows are scanned alike; an empty table gives no rows. Other
    columns are ignored.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInPandas(_scan(tuple(rules)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
