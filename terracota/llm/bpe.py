"""Byte-level BPE in two tiers: a minimal perfect hash finds whole pre-tokens of the vocabulary, a heap merges the rest.

A text is cut at white space into chunks that the pre-token pattern never crosses, so a worker tokenizes
each distinct chunk once and looks it up afterwards. Distinct pre-tokens of a batch go to the hash together, as
arrays. The hash has a displacement for each bucket of about two keys; slots are checked against the token's
own bytes, so a word outside the vocabulary never matches.

Cases: null encodes as the empty text (no ids); bytes that ranks don't hold can't occur, as every byte has a rank;
lone surrogates can't occur in a Spark string; long texts and long words cost n log n; of pairs that tie in rank the leftmost merges
first; rows that repeat are encoded row by row; an empty table gives an empty result; extra columns are ignored, or kept by `encoded`
as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain, pairwise

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracota.llm.common import by_text, shared

#: White_Space of Unicode, which is narrower than \s of the re module. Fixed values.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word with the blank before it, or blanks but for the last before a word.
CHUNK = re.compile(f"[{BLANK}]?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
PUNCTUATION = frozenset(".,;:!?|")
#: Chunks, and words, that a worker remembers before it starts afresh, and the longest ones worth remembering.
MEMO, MEMO_CHARS = 500_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class PerfectHash:
    """Minimal perfect hash over the tokens, by displacement: a bucket's d sends its keys to free slots, mixed into their hashes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.keys = list(ranks)
        n = self.n = len(self.keys)
        self.buckets = n // 2 + 1
        bucket, mixed = self._parts(self.keys)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free, self.shift, self.at = np.ones(n, bool), np.zeros(self.buckets, np.int64), np.zeros(n, np.int64)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)]:
            own = order[starts[b] : starts[b + 1]]
            for first in range(0, 1 << 24, 64):
                slots = self._slots(mixed[own][:, None], np.arange(first, first + 64))
                d = next((d for d in np.flatnonzero(free[slots].all(0)) if len(set(slots[:, d].tolist())) == len(own)), None)
                if d is not None:
                    self.shift[b], free[slots[:, d]], self.at[slots[:, d]] = first + d, False, own
                    break
            else:
                raise ValueError("no displacement found; are two tokens equal?")
        lone = np.flatnonzero(sizes == 1)  # these take the slots that are left: the shift is minus the slot, less one
        left = np.flatnonzero(free)
        self.shift[lone], self.at[left] = -left - 1, order[starts[lone]]
        self.ranks = np.array([ranks[k] for k in self.keys], np.int64)

    def _parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        return (h[:, 0] % np.uint64(self.buckets)).astype(np.int64), h[:, 1]

    def _slots(self, mixed: np.ndarray, d: np.ndarray) -> np.ndarray:
        v = (mixed ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((v ^ (v >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def find(self, words: list[bytes]) -> list[int]:
        """Rank of each word, -1 if it isn't a token."""
        if not words:
            return []
        bucket, mixed = self._parts(words)
        d = self.shift[bucket]
        at = self.at[np.where(d < 0, -d - 1, self._slots(mixed, d))]
        return [int(r) if self.keys[i] == w else -1 for i, r, w in zip(at.tolist(), self.ranks[at].tolist(), words, strict=True)]


class Merges:
    """What two neighbouring ids merge to: a table for two bytes, for other ids a dictionary for each left one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = [ranks[bytes([i])] for i in range(256)]
        none: dict[int, int] = {}
        self.right = [none] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    if self.right[a] is none:
                        self.right[a] = {}
                    self.right[a][b] = rank
        self.bytes = [[self.right[a].get(b, -1) for b in self.single] for a in self.single]


def merge(word: bytes, merges: Merges) -> list[int]:
    """Ids of a pre-token that isn't a token: lowest-ranked pair first, leftmost of equals, from a heap over linked pieces."""
    n, single, two, right = len(word), merges.single, merges.bytes, merges.right
    ids = [single[b] for b in word]
    bits, push, pop = n.bit_length(), heapq.heappush, heapq.heappop
    low = (1 << bits) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    want = [two[a][b] for a, b in pairwise(word)]  # what piece i and its right neighbour merge to
    want.append(-1)
    heap = [r << bits | i for i, r in enumerate(want) if r >= 0]
    heapq.heapify(heap)
    while heap:
        top = pop(heap)
        r, i = top >> bits, top & low
        if want[i] != r:
            continue  # the pair is no longer there
        j = after[i]
        k = after[i] = after[j]
        ids[i] = r
        want[j] = -1
        if k < n:
            before[k] = i
            want[i] = x = right[r].get(ids[k], -1)
            if x >= 0:
                push(heap, x << bits | i)
        else:
            want[i] = -1
        if (p := before[i]) >= 0:
            want[p] = x = right[ids[p]].get(r, -1)
            if x >= 0:
                push(heap, x << bits | p)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


#: Pre-token patterns that have this alternative, after none but such as begin with a quote's mark, take letters with the blank before them as one.
LETTERS, QUOTED, MARKS = r" ?\p{L}+", "'", r" ?[^\s\p{L}\p{N}]+"


class Codec:
    """Encoder and decoder: tokens by id, their perfect hash, the merges, and what a worker has met so far."""

    def __init__(self, hashed: PerfectHash, merges: Merges, pattern: str):
        self.hashed, self.merges, self.cut = hashed, merges, regex.compile(pattern)
        self.bytes = dict(zip(hashed.ranks.tolist(), hashed.keys, strict=True))
        self.digits = {i: str(i) for i in self.bytes}
        options = pattern.split("|")
        at = options.index(LETTERS) if LETTERS in options else 0
        self.plain = at > 0 and MARKS in options and all(x.startswith(QUOTED) for x in options[:at])
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _cut(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk. Words of letters alone, or with one mark of punctuation after them, need no pattern."""
        if self.plain:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word[-1:] in PUNCTUATION and word[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.cut.findall(chunk)

    def _tokenize(self, chunks: list[str]) -> list[tuple[int, ...]]:
        parts = list(map(self._cut, chunks))
        if len(self.words) > MEMO:
            self.words.clear()
        known = self.words
        new = list({w for p in parts for w in p if w not in known})
        raw = [w.encode() for w in new]
        ids = {w: (r,) if r >= 0 else tuple(merge(b, self.merges)) for w, b, r in zip(new, raw, self.hashed.find(raw), strict=True)}
        out = [tuple(chain.from_iterable([known[w] if w in known else ids[w] for w in p])) for p in parts]
        known.update((w, x) for w, x in ids.items() if len(w) <= MEMO_CHARS)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        cut, known = list(map(CHUNK.findall, texts)), self.chunks
        new = list({c for chunks in cut for c in chunks if c not in known})
        found = dict(zip(new, self._tokenize(new), strict=True))
        known.update((c, ids) for c, ids in found.items() if len(c) <= MEMO_CHARS)
        get = (lambda c: known[c] if c in known else found[c]) if any(len(c) > MEMO_CHARS for c in new) else known.__getitem__
        return [list(chain.from_iterable(map(get, chunks))) for chunks in cut]

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _codec(spark: SparkSession, path: str, pattern: str):
    """Sent once: some MB, bounded by the vocabulary. A worker keeps the codec, and so its memo, from task to task."""
    ranks = read_ranks(path)
    return shared(spark, Codec(PerfectHash(ranks), Merges(ranks), pattern))


def encoded(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of every whole text as array<int>. path: a rank file; pattern: its pre-token pattern."""
    codec = _codec(docs.sparkSession, path, pattern)

    def make():
        own = codec()
        return lambda texts: {"ids": own.encode([t or "" for t in texts])}

    return docs.withColumn(ids_col, by_text(docs.sparkSession, make, "ids array<int>")(F.col(text_col))["ids"])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, its ids decoded again.

    packed: with a column tokens, the ids as little-endian 32-bit words, as training jobs read them; else ids stay in the task.
    """
    codec = _codec(docs.sparkSession, path, pattern)

    def make():
        own = codec()
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def work(texts):
            ids = own.encode([t or "" for t in texts])
            out = {"n_tokens": list(map(len, ids)), "ids_sha256": [sha(own.listed(x).encode()) for x in ids], "decoded_sha256": [sha(own.decode(x)) for x in ids]}
            return out | ({"tokens": [np.array(x, "<u4").tobytes() for x in ids]} if packed else {})

        return work

    run = by_text(docs.sparkSession, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens binary" * packed)
    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r")).select("doc_id", "r.*")
