"""Near copies by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is 1 if over half of the text's shingle hashes have it. Two fingerprints
link at RADIUS or fewer differing bits. Table v of the 2^(RADIUS+1) - 1 tables keeps bit i if the inner product
of v and a fixed code of i is odd. The codes of at most RADIUS differing bits span less than all RADIUS + 1
dimensions, so some v is orthogonal to all of them: that table drops every differing bit and the pair shares a
bucket, for certain.

Equal fingerprints are merged before anything is compared, so groups of exact copies cost one row. Buckets are counted with
partial aggregates before their members meet. In a bucket all pairs are compared while it has at most BUCKET members. Members of
larger buckets are joined exactly another way: two fingerprints are within 2r bits if and only if they share a midpoint within r bits
of both, so all members of a midpoint link to one of them and no pairs are listed. Nothing is capped or sampled.

Cases: null, empty and word-free texts have fingerprint zero, linked like any other; rows that repeat link to themselves; a very
long text is hashed SLICE shingles at a time; a bit set in exactly half of the hashes is 0; an empty table gives an empty result;
a null id takes part, but is never the smallest; extra columns are ignored, or kept as they are, whatever their names.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracota.llm.common import BROADCAST_ROWS, bounded_broadcast, by_text, keyed_join, row_key, unused, written

SHINGLE, RADIUS, BUCKET, SEED, SLICE = 4, 4, 256, 42, 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text, SLICE shingles at a time."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    k = min(k, len(words))
    n, counts = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = words[at : min(at + SLICE, n) + k - 1]
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., fp long), a row for each row of docs."""
    run = by_text(docs.sparkSession, lambda: lambda texts: {"fp": [fingerprint(t) for t in texts]}, "fp long")
    return docs.select(F.col(id_col).alias("doc_id"), *keep, run(F.col(text_col)).alias("r")).select("doc_id", *keep, "r.fp")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering tables' masks as signed longs. Codes of the 64 bits are dealt evenly over the nonzero vectors, in a fixed random order."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    random.Random(SEED).shuffle(codes)
    full = [sum(1 << i for i in range(64) if (codes[i] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints fps(fp) whose graph has the same components as all pairs within radius."""
    tables = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("x"))
    sizes = keyed.groupBy("x").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = written(sizes, "buckets")
    two = sizes.where("n = 2")  # the least and the greatest are the pair
    members = written(keyed_join(keyed, sizes.where("n > 2").select("x", "n"), "x", len(tables) * fps.count()), "members")
    small = members.where(F.col("n") <= bucket)
    near = small.selectExpr("x", "fp a").join(small.selectExpr("x", "fp b"), "x").where("a < b").select("x", "a", "b")
    near = (two.select("x", "a", "b").unionByName(near) if bucket > 1 else near).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    # a pair counts in the first table that it shares, so that it comes once
    pair = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*(F.when(pair.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks(radius))))
    near = near.where(first == F.col("x.t")).select("a", "b")
    crowd = members.where(F.col("n") > bucket).select("fp").distinct()
    if bucket == 1:
        crowd = crowd.unionByName(two.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    return near.unionByName(midpoint_links(crowd, radius))


def midpoint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges over shared midpoints: the exact way for crowded buckets, linear in their members."""
    flips = [sum(1 << i for i in c) for r in range(radius // 2 + 1) for c in itertools.combinations(range(64), r)]
    flips = F.array(*(F.lit(f - (1 << 64) if f >> 63 else f) for f in flips))
    near = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    centre = near.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    return near.join(centre, "mid").where("fp > a").select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, root) for each end of an edge, root the smallest of its component, by alternating large-star and small-star steps.

    Each step links nodes to the smallest of their neighbours; a node's neighbours are never gathered, only their minimum. Up to
    BROADCAST_ROWS edges the minima are broadcast; beyond, nodes with a large share of all edges meet a broadcast, the others a shuffle.
    """
    count = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = written(edges.distinct(), "edges")
    state = count(edges)

    def meet(rows, table):
        n = 2 * state[0]
        return rows.join(F.broadcast(table), "a") if n <= BROADCAST_ROWS else keyed_join(rows, written(table, "minima"), "a", n)

    for _ in range(rounds):
        both = edges.unionByName(edges.selectExpr("b a", "a b"))  # a: node, b: neighbour
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = meet(both.where("b > a"), least).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.selectExpr("b a", "a b")  # a: node, b: a smaller neighbour
        if state[0] > BROADCAST_ROWS // 2:
            down = written(down, "down")
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = meet(down, least).select(F.col("m").alias("a"), "b").where("a < b").unionByName(least.selectExpr("m a", "a b"))
        edges = written(small.distinct(), "edges")
        before, state = state, count(edges)
        if before == state:
            return edges.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("root")).unionByName(edges.select(F.col("a").alias("fp"), F.col("a").alias("root")).distinct())
    raise RuntimeError(f"components were not stable after {rounds} rounds")


def groups(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, n, first) of the distinct fingerprints of fps(fp, row): n rows have it; first: the least row of its component. row may be any type that has an order."""
    distinct = written(fps.groupBy("fp").agg(F.min("row").alias("own"), F.count("*").alias("n")), "distinct")
    roots = written(components(links(distinct.select("fp"), radius, bucket)), "roots")
    linked = roots.join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("own").alias("first"))
    found = linked.join(bounded_broadcast(written(least, "least")), "root").select("fp", "first")
    return written(distinct.join(bounded_broadcast(written(found, "linked")), "fp", "left").select("fp", "n", F.coalesce("first", "own").alias("first")), "found")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; component_id is the smallest id reachable over links."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    found = groups(fps.select("fp", F.col("doc_id").alias("row")), radius, bucket)
    out = keyed_join(fps, found, "fp", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (null ids last, then null texts first, then by text hash); rows that repeat stay once."""
    key = unused(docs, "key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    fps = written(fingerprints(keyed, id_col, text_col, [key]), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("key"))
    found = groups(fps.select("fp", row.alias("row")))
    rows = keyed_join(fps, found.select("fp", "n", F.col("first.key").alias("first")), "fp", fps.count())
    later = written(rows.where(F.col(key) != F.col("first")).select(key).distinct(), "later")
    repeated = written(rows.where(F.col(key) == F.col("first")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated")
    out = keyed.join(bounded_broadcast(later), key, "left_anti")
    if not repeated.isEmpty():
        same = bounded_broadcast(repeated)
        out = out.join(same, key, "left_anti").unionByName(keyed.join(same, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)
