"""Near copies by b-bit MinHash.

A document's set is that of its distinct shingles. Equal sets are merged first. Each set has K minima of K hash functions; ROWS minima
in a row make a band, and sets that share a band are candidates: at a similarity of 0.85 a pair shares none of the 32 bands with a
probability of 7e-9. The low B bits of the minima are packed into a signature. Two signatures agree in a share of c + (1 - c) s of
their places, c = 2^-B for chance; a pair whose agreeing places, counted by bits, are so few that a true link would have them with a
probability below RISK isn't looked at further. All others are confirmed, or not, on their full sets.

A bucket is not paired out. Its leader, the member with the most company in all of its buckets, meets each member, and those
pairs are compared on full sets. Members that the leader links are connected. A member that it doesn't link may still link to
another: such pairs are compared inside tasks by size, signature and a bound from the leader, |x & y| <= |x & y & leader| + min(|x - leader|,
|y - leader|), and what survives is confirmed there, on the leader's shingles that both have and those outside it, unless links found before already
connect the two. So a task gives fewer rows than it has members, however many pairs it looks at. Crowds are cut into blocks for that, a task for each
pair of blocks. This compares every open pair of a crowd, at some nanoseconds each, so time grows with the square of the members of one bucket
that their leader doesn't link; memory and rows don't.

Cases: documents without words, or with a null text, have empty sets and link with nothing; fewer words than a shingle has are one
shingle; rows that repeat, and rows with equal sets, share a component; a null id takes part, but is never the smallest, and such a
row is kept only if its component has no id; a very long text is read a slice at a time; an empty table gives an empty result; extra columns
are ignored, whatever their names. Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracota.llm.common import BROADCAST_ROWS, bounded_broadcast, by_text, keyed_join, written
from terracota.llm.simhash import components

SHINGLE, PERCENT, BANDS, ROWS, B, RISK = 5, 85, 32, 5, 2, 1e-9
K = BANDS * ROWS
#: The least and greatest number of members in a block of a crowd, and bytes of its sets; pairs of a hot leader that share a copy of its set.
CROWD, MOST_BLOCK, BLOCK_BYTES, COPY = 512, 4096, 64_000_000, 256
#: Words that a worker remembers, bytes of a text read at once, hashes that meet all functions at once.
WORDS, SLICE, CHUNK = 300_000, 4_000_000, 4096
_odd = random.Random(42)
FACTORS = np.array([_odd.getrandbits(64) | 1 for _ in range(K)], np.uint64)
PLACES = np.array([_odd.getrandbits(64) | 1 for _ in range(64)], np.uint64)
LOW_BITS = 0x5555555555555555


def least_matches(k: int = K, bits: int = B, percent: int = PERCENT, risk: float = RISK) -> int:
    """Fewest agreeing places of k that are worth a look: a pair at the least similarity has fewer with a probability below risk."""
    c = 2.0**-bits
    p, below = c + (1 - c) * percent / 100, 0.0
    for n in range(k + 1):
        below += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        if below >= risk:
            return n
    return k


def word_hashes(text: str | None, known: dict) -> np.ndarray:
    """64-bit hashes of the words; known: hashes so far, of a worker."""
    data, at, out = (text or "").encode("utf-8", "replace").lower(), 0, []  # bytes: ASCII letters and blanks only
    blank = re.compile(rb"[\x20\x09-\x0d]")
    while at < len(data):
        found = blank.search(data, at + SLICE) if len(data) - at > SLICE else None
        end = found.start() if found else len(data)
        words = data[at:end].split()
        at = end if end > at else len(data)
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, known: dict, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    h = word_hashes(text, known)
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s += h[j : j + n] * PLACES[j]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(K, 2**64 - 1, np.uint64)
    for at in range(0, len(s), CHUNK):
        out = np.minimum(out, (s[None, at : at + CHUNK] * FACTORS[:, None]).min(1))
    return out


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def sketch(text: str | None, known: dict) -> tuple[int, bytes, np.ndarray | None, np.ndarray | None]:
    """Size and digest of the set; band hashes and packed signature, None for an empty set."""
    s = shingles(text, known)
    if not len(s):
        return 0, b"", None, None
    m = minima(s)
    bands = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        bands = (bands ^ (bands >> np.uint64(31))) * PLACES[j] + m.reshape(BANDS, ROWS)[:, j]
    bands = (bands ^ (bands >> np.uint64(29))) * PLACES[ROWS] + np.arange(BANDS, dtype=np.uint64)
    each = 64 // B
    low = (m & np.uint64(2**B - 1)).reshape(-1, each) << (np.uint64(B) * np.arange(each, dtype=np.uint64))
    return len(s), digest(s), bands.view(np.int64), np.bitwise_or.reduce(low, 1).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n, key, bands, sig) of each row; row: the same for rows of equal id and text."""

    def make():
        known: dict = {}
        return lambda texts: dict(zip(("n", "key", "bands", "sig"), map(list, zip(*(sketch(t, known) for t in texts), strict=True)), strict=True)) if texts else {"n": [], "key": [], "bands": [], "sig": []}

    run = by_text(docs.sparkSession, make, "n long, key binary, bands array<long>, sig array<long>")
    rows = docs.select(F.col(id_col).alias("doc_id"), _row(id_col, text_col).alias("row"), run(F.col(text_col)).alias("r"))
    return rows.select("doc_id", "row", "r.n", "r.key", "r.bands", "r.sig")


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def leader_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) with row, n and sig of both: each member b of each bucket with the bucket's leader a, once. sets: (key, row, n, bands, sig)."""
    keyed = sets.select("key", F.explode("bands").alias("x"))
    buckets = written(keyed.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(keyed_join(keyed, buckets, "x", BANDS * sets.count()), "members")
    company = members.groupBy("key").agg(F.sum("n").alias("company")).join(sets.select("key", F.struct("row", "n", "sig").alias("own")), "key")
    met = written(members.select("x", "key").join(company, "key").select("x", F.struct("company", "key", "own").alias("m")), "met")
    leaders = written(met.groupBy("x").agg(F.max("m").alias("leader"), F.count("*").alias("n")), "leaders")
    pairs = keyed_join(met, leaders, "x", met.count()).where("leader.key <> m.key").groupBy(F.col("leader.key").alias("a"), F.col("m.key").alias("b")).agg(F.first("leader.own").alias("a_"), F.first("m.own").alias("b_"))
    return pairs.select("a", "b", *(F.col(f"{e}_.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("row", "n", "sig")))


def _compared(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
    for a, b in pairs:
        a, b = a.view(np.uint64), b.view(np.uint64)
        found = np.searchsorted(b, a)
        found[found == len(b)] = 0
        both = b[found] == a
        alone = np.ones(len(b), bool)
        alone[found[both]] = False
        yield {"inter": int(both.sum()), "bits": np.packbits(both).tobytes(), "rest": b[alone].tobytes()}


def full_sets(docs: DataFrame, id_col: str, text_col: str, needed: DataFrame) -> DataFrame:
    """(key, set) for needed(key, row): the sorted hashes of a set as bytes, read again from one of its texts."""

    def make():
        known: dict = {}

        def work(texts):
            found = [shingles(t, known) for t in texts]
            return {"key": [digest(s) for s in found], "set": [s.tobytes() for s in found]}

        return work

    rows = docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    rows = rows.join(bounded_broadcast(needed.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"])
    run = by_text(docs.sparkSession, make, "key binary, set binary")
    found = rows.select("row", run(F.col("text")).alias("r")).select("row", "r.key", "r.set")
    return found.join(bounded_broadcast(needed), ["row", "key"], "left_semi").drop("row")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with inter, the size of the intersection of their full sets, bits, which of a's shingles b has, and rest, b's other ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                both = ((np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)) for a, b in zip(part["sa"], part["sb"], strict=True))
                found = list(_compared(both))
                extra = [pa.array([f[c] for f in found], t) for c, t in (("inter", pa.int64()), ("bits", pa.binary()), ("rest", pa.binary()))]
                kept = [c for c in part.schema.names if c not in ("sa", "sb")]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *extra], [*kept, "inter", "bits", "rest"])

    # a leader's set is copied for each COPY of its pairs, so none of them meet in one task
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / COPY).cast("int").alias("copies"))
    copies = sets.withColumnsRenamed({"key": "a", "set": "sa"}).join(counts, "a")
    copies = copies.select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    ours = pairs.join(bounded_broadcast(counts), "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    met = ours.join(sets.withColumnsRenamed({"key": "b", "set": "sb"}), "b").join(copies, ["a", "copy"]).drop("copy")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema), "inter long, bits binary, rest binary"])
    return met.select(*pairs.columns, "sa", "sb").mapInArrow(run, schema)


def open_pairs(n, sig, linked, bits, own, least: int, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each member: which of the later ones may link to it. bits: bytes, a row a member, of the leader's shingles that it has; own: how many others it has, at most."""
    sig = sig.view(np.uint64)
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        j = j[(100 * small >= percent * large) & ~(linked[i] & linked[j])]
        x = sig[j] ^ sig[i]
        j = j[np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LOW_BITS)).sum(1) <= K - least]
        if not len(j):
            continue
        most = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64) + np.minimum(own[i], own[j])
        most = np.minimum(most, np.minimum(n[i], n[j]))
        yield i, j[100 * most >= percent * (n[i] + n[j] - most)]


def _cell(key, rows):  # Spark takes hints here for another kind of function
    t = rows.combine_chunks()
    n, side, linked = t["n"].to_numpy(), t["side"].to_numpy(), np.asarray(t["linked"].to_pylist(), bool)
    sig = np.asarray(t["sig"].combine_chunks().flatten(), np.int64).reshape(len(n), -1)
    raw = t["bits"].to_pylist()
    bits = np.frombuffer(b"".join(x.ljust(max(map(len, raw)), b"\0") for x in raw), np.uint8).reshape(len(n), -1)
    rest = [np.frombuffer(x, np.uint64) for x in t["rest"].to_pylist()]
    own = np.array([len(x) for x in rest], np.int64)  # how many shingles lie outside the leader
    keys, a, b = t["key"].to_pylist(), [], []
    within = key[1].as_py() == key[2].as_py()
    root = np.where(linked, np.argmax(linked), np.arange(len(n)))  # what the leader links is connected

    def confirmed(i, j):
        x, y = sorted((rest[i], rest[j]), key=len)
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int(np.bitwise_count(bits[i] & bits[j]).sum(dtype=np.int64)) + (int((y[at] == x).sum()) if len(x) else 0)
        return 100 * both >= PERCENT * (n[i] + n[j] - both)

    for i, js in open_pairs(n, sig, linked, bits, own, least_matches()):
        for j in js if within else js[side[js] != side[i]]:
            if root[i] != root[j] and confirmed(i, j):
                a.append(min(keys[i], keys[j]))
                b.append(max(keys[i], keys[j]))
                root[root == root[j]] = root[i]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def crowd_links(members: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that connect what is linked among members(leader, m, bytes, key, n, sig, linked, bits, rest) of one leader; m and bytes: how many it has, and those of their sets."""
    blocks = F.greatest(F.ceil(F.col("m") / MOST_BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.least(F.ceil(F.col("m") / crowd), F.lit(32))).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "n", "sig", "linked", "bits", "rest")
    return rows.groupBy("leader", "i", "j").applyInArrow(_cell, "a binary, b binary")


def set_links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct sets(key, row, n, bands, sig) that connect all that are linked."""
    met = written(leader_pairs(sets), "leader-pairs")
    ends = [met.select(F.col(c).alias("key"), F.col(f"{c}_row").alias("row")).distinct() for c in "ab"]
    own_sets = written(full_sets(docs, id_col, text_col, written(ends[0].unionByName(ends[1]).distinct(), "needed")), "sets")
    linked = (100 * F.col("inter")) >= (PERCENT * (F.col("a_n") + F.col("b_n") - F.col("inter")))
    stars = written(compared(met.select("a", "b", "a_n", "b_n", "b_sig"), own_sets).withColumn("linked", linked).drop("inter"), "stars")

    # members of one leader that it doesn't all link
    size = F.length("bits") + F.length("rest")
    undecided = stars.groupBy("a").agg(F.count_if(~F.col("linked")).alias("alone"), F.count("*").alias("n"), F.sum(size).alias("bytes")).where("alone > 0 and n > 1").drop("alone")
    rows = keyed_join(stars.select("a", "b", "b_n", "b_sig", "linked", "bits", "rest"), written(undecided, "undecided"), "a", met.count())
    rows = rows.select(F.col("a").alias("leader"), F.col("n").alias("m"), "bytes", F.col("b").alias("key"), F.col("b_n").alias("n"), F.col("b_sig").alias("sig"), "linked", "bits", "rest")
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return stars.where("linked").select(*ends).unionByName(crowd_links(rows, crowd)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; component_id is the smallest id reachable over links."""
    rows = written(sketches(docs, id_col, text_col), "sketches")
    some = rows.where("n > 0")
    sets = some.groupBy("key").agg(F.min("doc_id").alias("own"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    sets = written(sets, "distinct-sets")
    links = written(set_links(docs, sets.select("key", "row", "n", "bands", "sig"), id_col, text_col, crowd), "links")
    roots = written(components(links), "roots").withColumnRenamed("fp", "key")
    linked = roots.join(sets.select("key", "own"), "key")
    least = linked.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("n"))
    found = keyed_join(linked, written(least, "least"), "root", linked.count()).select("key", "least")
    groups = sets.select("key", F.col("own"), F.col("copies").alias("n")).join(bounded_broadcast(written(found, "linked")), "key", "left")
    groups = written(groups.select("key", "n", F.coalesce("least", "own").alias("component_id")), "groups")
    ours = keyed_join(some.select("doc_id", F.col("n").alias("n_shingles"), "key"), groups, "key", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return ours.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
