"""Hard negatives by anchor spanning-tree bounds.

Anchors are sorted by label and place in space and cut into blocks of at most BLOCK. A block has a minimum spanning tree of its
anchors and the origin, whose score with anything is zero. For a candidate c, the score of a child anchor lies within (length of the edge)
* |c| of its parent's score, so each edge carries the parent's score, or the bounds of it, on to the child. Only where these bounds
meet the window that the child still looks for is the candidate scored anew, exactly; there the bounds shrink to the score.

Two passes: positives, where the window is "at least the fifth best so far" among candidates of the anchor's label, then negatives,
with a window for each positive: between 50 % and 95 % of its score, and at least the third best so far inside. Tasks keep
a few best rows an anchor, window functions take the best of all tasks. Blocks go to all tasks ROUND_BYTES at a time, each round
reading all rows, so what a broadcast and the driver hold has a bound, and work is that of the stated anchors against all rows.

Scores are whole numbers, exact below 2^63, beyond which they saturate. Cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors count as if zeros followed; an empty vector scores zero with all; of equal scores
the smaller id comes first; rows that repeat count each by itself, as candidates and as anchors, but an anchor's own id is never its positive;
an anchor without positives, and a positive without rows in its window, give no row; a positive's score below zero has an
empty window; no anchors, or an empty table, give an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracota.llm.common import shared, written
from terracota.sources.shared import new_path

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
#: Anchors of one tree, anchors that one task makes trees of, bytes of blocks that one pass over all rows carries, rows scored at once.
BLOCK, PART, ROUND_BYTES, BATCH = 512, 8192, 32_000_000, 4096
EXACT = 2.0**53


def prepared(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part; every seventh id moves to the next label."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256 * x) < float("inf")))
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    out = rows.select(i.alias("vec_id"), F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), vec.alias("v"), finite.alias("finite"))
    return out.where("vec_id is not null and label is not null and v is not null and finite").drop("finite")


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of the vectors, padded with zeros to dim."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths, flat = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten(), np.float64)
    if not (lengths == dim).all():
        out = np.zeros((len(lengths), dim))
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return np.floor(256 * out)
    return np.floor(256 * flat).reshape(-1, dim)


def tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows and the origin, by Prim: order of the rows, parent of each as a place in that order (-1: origin), edge lengths."""
    m = len(a)
    near, parent, open_ = np.sqrt((a * a).sum(1)), np.full(m, -1), np.ones(m, bool)
    order, parents, edges = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m)
    for k in range(m):
        i = int(np.where(open_, near, np.inf).argmin()) if np.isfinite(near[open_]).any() else int(np.flatnonzero(open_)[0])
        order[k], parents[k], edges[k], open_[i] = i, parent[i], near[i], False
        d = np.sqrt(((a - a[i]) ** 2).sum(1))
        nearer = open_ & (d < near)
        near[nearer], parent[nearer] = d[nearer], k
    return order, parents, edges


def blocks_of(anchors: DataFrame, n: int, dim: int, block: int = BLOCK) -> DataFrame:
    """(size, block): pickled blocks of anchors that share a label, with their trees. Neighbours in space share a block where they can."""
    code = F.transform(F.slice("v", 1, 16), lambda x: x > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about PART anchors
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, labels, a = t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], dim)
        cuts = np.flatnonzero(np.diff(labels)) + 1
        for at, end in zip([0, *cuts], [*cuts, len(labels)], strict=True):
            for k in range(at, end, block):
                part = slice(k, min(k + block, end))
                order, parents, edges = tree(a[part])
                box = {"label": int(labels[k]), "ids": ids[part][order], "a": a[part][order], "parent": parents, "edge": edges}
                box["children"] = np.bincount(parents[parents >= 0], minlength=len(order))
                data = pickle.dumps(box)
                yield pa.RecordBatch.from_pydict({"size": pa.array([len(data)], pa.int64()), "block": pa.array([data], pa.binary())})

    parts = max(1, -(-n // PART))
    placed = anchors.withColumn("code", code).repartitionByRange(parts, "label", "code", "v", "vec_id").sortWithinPartitions("label", "code", "v", "vec_id").drop("code")
    return placed.mapInArrow(run, "size long, block binary")


def product(x: np.ndarray, a: np.ndarray, limit: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers with a. limit: no partial sum is above it."""
    if limit < EXACT:
        return (x @ a).astype(np.int64)
    if limit < 2.0**62:
        return x.astype(np.int64) @ a.astype(np.int64)
    total = np.array([sum(int(p) * int(q) for p, q in zip(row, a, strict=True)) for row in x], object)
    return np.clip(total, -(2**63), 2**63 - 1).astype(np.int64)


def walk(block: dict, x: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of the block, in the order of its tree: its place, which rows of x were scored, and their scores.

    wanted(k, lo, hi): which rows' bounds meet the window of anchor k.
    """
    a, parent, edge, left = block["a"], block["parent"], block["edge"], block["children"].copy()
    norms = np.sqrt((x * x).sum(1))
    size = np.sqrt((a * a).sum(1))
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(len(a)):
        p = int(parent[k])
        reach = (edge[k] * (1 + 1e-9) + size[k] * 1e-12) * norms + 1  # outward by more than floating point can err
        lo, hi = (known[p][0] - reach, known[p][1] + reach) if p >= 0 else (-reach, reach)
        i = np.flatnonzero(wanted(k, lo, hi)) if limit < 2.0**62 else np.arange(len(x))
        s = product(x, a[k], limit)[i] if 2 * len(i) > len(x) else product(x[i], a[k], limit)
        if left[k]:
            lo[i] = hi[i] = s
            known[k] = lo, hi
        if p >= 0:
            left[p] -= 1
            if not left[p]:
                del known[p]
        yield k, i, s


def batched(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of about BATCH rows each."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            held.append(b.slice(at, BATCH))
            n += held[-1].num_rows
            if n >= BATCH:
                t, held, n = pa.Table.from_batches(held), [], 0
                yield t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], dim)
    if n:
        t = pa.Table.from_batches(held)
        yield t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], dim)


def best(old: tuple | None, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first rows by score, then smaller id."""
    if old is not None:
        ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
    order = np.lexsort((ids, ~scores))[:most]  # ~ turns the order of whole numbers round
    return ids[order], scores[order]


def _emit(found: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
    keys = [k for k, (ids, _) in found.items() for _ in ids]
    if keys:
        columns = [np.array([k[j] for k in keys], np.int64) for j in range(len(names))]
        columns += [np.concatenate([ids for ids, _ in found.values()]).astype(np.int64), np.concatenate([s for _, s in found.values()]).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "vec_id", "score"])


def positives(get: Callable, dim: int, most: int) -> Callable:
    """For mapInArrow: (a, vec_id, score), the best rows of each anchor's label that a task has; a: number of the anchor."""

    def run(batches):
        blocks, found = get(), {}
        for ids, labels, x in batched(batches, dim):
            for label in np.unique(labels):
                own = np.flatnonzero(labels == label)
                xs, own_ids = x[own], ids[own]
                for block in blocks:
                    if block["label"] != label:
                        continue
                    first = block["first"]

                    def wanted(k, lo, hi, first=first):
                        old = found.get((first + k,))
                        return hi >= old[1][-1] if old is not None and len(old[1]) == most else np.ones(len(hi), bool)

                    for k, i, s in walk(block, xs, wanted):
                        other = own_ids[i] != block["ids"][k]
                        if other.any():
                            found[first + k,] = best(found.get((first + k,)), own_ids[i][other], s[other], most)
        yield from _emit(found, ["a"])

    return run


def negatives(get: Callable, dim: int, most: int) -> Callable:
    """For mapInArrow: (a, slot, vec_id, score), the best rows of other labels in the window of each positive that a task has."""

    def run(batches):
        blocks, found = get(), {}
        for ids, labels, x in batched(batches, dim):
            for block in blocks:
                other = np.flatnonzero(labels != block["label"])
                if not len(other):
                    continue
                xs, other_ids, first, windows = x[other], ids[other], block["first"], block["windows"]

                def least(k, slot, low, first=first):
                    old = found.get((first + k, slot))
                    return max(low, int(old[1][-1])) if old is not None and len(old[1]) == most else low

                def wanted(k, lo, hi, windows=windows, least=least):
                    out = np.zeros(len(lo), bool)
                    for slot, low, high in windows[k]:
                        if low <= high:
                            out |= (hi >= least(k, slot, low)) & (lo <= high)
                    return out

                for k, i, s in walk(block, xs, wanted):
                    for slot, low, high in windows[k]:
                        inside = (s >= least(k, slot, low)) & (s <= high) if low <= high else np.zeros(0, bool)
                        if inside.any():
                            found[first + k, slot] = best(found.get((first + k, slot)), other_ids[i][inside], s[inside], most)
        yield from _emit(found, ["a", "slot"])

    return run


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest whole s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _first(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def _rounds(blocks: DataFrame) -> Iterator[list[dict]]:
    """Blocks, ROUND_BYTES at a time, with the number of their first anchor. One partition of them is in the driver at once."""
    held, size, first = [], 0, 0
    for row in blocks.toLocalIterator():
        if held and size + row["size"] > ROUND_BYTES:
            yield held
            held, size, first = [], 0, 0
        held.append(pickle.loads(row["block"]) | {"first": first})
        size, first = size + row["size"], first + len(held[-1]["ids"])
    if held:
        yield held


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = rows.sparkSession
    rows = prepared(rows, id_col, vec_col, label_col)
    anchors = rows.where(F.col("vec_id") % every == 0)
    n, dim = rows.agg(F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    path = new_path(spark, "hard-negatives")
    for number, blocks in enumerate(_rounds(written(blocks_of(anchors, n, dim, block), "anchor-blocks"))):
        found = rows.mapInArrow(positives(shared(spark, blocks), dim, n_positives), "a long, vec_id long, score long")
        found = written(_first(found, ["a"], n_positives).select("a", "n", "vec_id", "score"), "positives")
        windows: dict[int, list] = {}
        for r in found.collect():  # n_positives an anchor of this round
            windows.setdefault(r["a"], []).append((r["n"], *window_of(r["score"], low, high)))
        names = np.concatenate([b["ids"] for b in blocks]).tolist()
        for b in blocks:
            b["windows"] = [windows.get(b["first"] + k, []) for k in range(len(b["ids"]))]
        mined = rows.mapInArrow(negatives(shared(spark, blocks), dim, n_negatives), "a long, slot long, vec_id long, score long")
        mined = _first(mined, ["a", "slot"], n_negatives).select("a", F.col("slot").alias("n"), F.col("n").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        anchor_ids = spark.createDataFrame(list(enumerate(names)), "a long, anchor_id long")
        out = found.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).join(mined, ["a", "n"]).join(F.broadcast(anchor_ids), "a")
        out.select(*(x.split()[0] for x in schema.split(", "))).write.parquet(f"{path}/round={number}")
    return spark.read.schema(schema).parquet(*(f"{path}/round={k}" for k in range(number + 1)))


#: The same result by all scores, for DuckDB.
ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score FROM r a JOIN r c ON a.vec_id % 50 = 0),
p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
