"""Quality by a factorisation machine: pairs of hashed words, structure statistics and metadata interact through low-rank factors.

Features are sparse: a bucket for each distinct lower-cased word (value 1 / sqrt of their number), and for each structure
statistic, and the length the table states (n_chars), one bin. score = logistic(b + sum w_i x_i + sum over pairs i < j of
<v_i, v_j> x_i x_j); the pairs cost linear time, as they are half of |sum v_i x_i|^2 - sum |v_i x_i|^2.

Learning: about SAMPLE labelled rows (all, if fewer), chosen by a hash of the id among those not held out; their features,
not their texts, go to the driver, where a few epochs of Adam fit the weights. Scoring is a column over every whole text.

Cases: null and empty texts have only their bins as features and get a score, as do texts whose stated length is null; no usable
label at all gives 0.5 everywhere; a very long text costs memory in proportion to itself; rows that repeat get equal scores, ties
need no order; an empty table gives an empty result; extra columns are ignored, whatever their names; an id's labels count once, by
their mean, and of rows that repeat an id one is learned from, that with the least text, so the sample stays as small if an id
holds a third of the rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracota.llm.common import held_out, shared, text_batches
from terracota.llm.stats import base_stats

SAMPLE, WORDS, BINS, FACTORS = 4000, 1 << 13, 16, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.03, 1e-4, 7
UPPER, DIGITS, MARKS, PIPES = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"), re.compile(rb"[!?]"), re.compile(rb"(?<![^\x20\n])\|(?![^\x20\n])")
#: Structure statistics, in order; each has BINS bins after those of the words.
SHAPES = ("length", "stated", "word_chars", "symbols", "dup_lines", "repeats", "twins", "variety", "upper", "digits", "marks", "pipes", "lines")
SIZE = WORDS + BINS * len(SHAPES)


def features(text: str | None, stated: float | None, memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values) of a whole text's features."""
    words, chars, symbols, dup_lines, repeats = base_stats(text)
    raw, n = (text or "").encode("utf-8", "replace"), max(1, len(words))
    lower = set(raw.lower().split())
    for w in lower:
        if w not in memo:
            if len(memo) > 500_000:
                memo.clear()
            memo[w] = zlib.crc32(w) % WORDS
    buckets = np.array(sorted({zlib.crc32(w) % WORDS if w not in memo else memo[w] for w in lower}), np.int64)
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines, size = raw.count(b"\n") + 1, max(1, len(raw))
    share = lambda x: BINS * x**0.5  # noqa: E731  finer near zero
    bins = (
        2 * np.log2(1 + len(words)) / 2,
        -1 if stated is None or stated != stated else np.log2(1 + max(0, stated)),
        chars / n,
        share(min(1, symbols / n)),
        share(dup_lines / lines),
        share(repeats / n),
        share(twins / n),
        BINS * len(lower) / n,
        share(len(UPPER.findall(raw)) / size),
        share(len(DIGITS.findall(raw)) / size),
        share(min(1, len(MARKS.findall(raw)) / n)),
        share(min(1, len(PIPES.findall(raw)) / n)),
        np.log2(lines),
    )
    shapes = [WORDS + BINS * i + min(BINS - 1, 1 + int(b)) if b >= 0 else WORDS + BINS * i for i, b in enumerate(bins)]
    return np.append(buckets, shapes), np.append(np.full(len(buckets), 1 / max(1, len(buckets)) ** 0.5), np.ones(len(shapes)))


class Machine:
    def __init__(self):
        self.bias, self.w, self.v, self.memo = 0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)), {}

    def spread(self) -> None:
        """Small random factors, from which learning starts; all zero, pairs would never move."""
        self.v = np.random.default_rng(SEED).normal(0, 0.05, (SIZE, FACTORS))

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (np.square(sums).sum(1) - np.add.reduceat(np.square(vx).sum(1), starts))
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + pairs, sums, vx

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        rng, moments = np.random.default_rng(SEED), [(np.zeros_like(x), np.zeros_like(x)) for x in (np.zeros(1), self.w, self.v)]
        bias, step = np.zeros(1), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                index, value = (np.concatenate([rows[i][k] for i in own]) for k in (0, 1))
                sizes = np.array([len(rows[i][0]) for i in own])
                self.bias = float(bias[0])
                margin, sums, vx = self.margins(index, value, np.cumsum(sizes) - sizes)
                error = (1 / (1 + np.exp(-margin)) - labels[own]) / len(own)
                each = np.repeat(error, sizes) * value
                touched, place = np.unique(index, return_inverse=True)
                gw = np.bincount(place, each, len(touched))
                inner = np.repeat(sums, sizes, axis=0) - vx
                gv = np.column_stack([np.bincount(place, each * inner[:, f], len(touched)) for f in range(FACTORS)])
                step += 1
                gradients = (np.array([error.sum()]), gw + DECAY * self.w[touched], gv + DECAY * self.v[touched])
                for (m, s), x, g, rows_ in zip(moments, (bias, self.w, self.v), gradients, (slice(None), touched, touched), strict=True):
                    m[rows_] = 0.9 * m[rows_] + 0.1 * g
                    s[rows_] = 0.99 * s[rows_] + 0.01 * g * g
                    x[rows_] -= RATE * m[rows_] / (1 - 0.9**step) / (np.sqrt(s[rows_] / (1 - 0.99**step)) + 1e-6)
        self.bias = float(bias[0])

    def score(self, texts: list[str | None], stated: list[float | None]) -> np.ndarray:
        rows = [features(t, s, self.memo) for t, s in zip(texts, stated, strict=True)]
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(i) for i, _ in rows])
        margin, _, _ = self.margins(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Learns from about sample labelled rows; held-out rows are never read."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(~held_out(F.col("id")) & F.col("y").isin(0.0, 1.0)).groupBy("id").agg(F.avg("y").alias("y"))
    machine, n = Machine(), known.count()
    if not n:
        return machine
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for batch in batches:
            rows = [features(t if isinstance(t, str) else None, s, memo) for t, s in zip(batch["text"], batch["stated"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "index": [i.astype(np.int32) for i, _ in rows], "value": [v.astype(np.float32) for _, v in rows]})

    text_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(length_col).cast("double").alias("stated"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct("text", "stated")).alias("t")).select("id", "y", "t.*")
    found = one.mapInPandas(collect, f"id {texts.schema['id'].dataType.simpleString()}, y double, index array<int>, value array<float>")
    found = sorted(found.collect(), key=lambda r: r["id"])  # at most about sample rows
    if found:
        machine.spread()
        machine.learn([(np.array(r["index"], np.int64), np.array(r["value"], np.float64)) for r in found], np.array([r["y"] for r in found]))
    return machine


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", length_col: str = "n_chars") -> Column:
    """Score column of every whole text. The machine's weights have a fixed size and are broadcast."""
    text_batches(docs.sparkSession)
    own = shared(docs.sparkSession, machine)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, stated in batches:
            yield pd.Series(own().score([t if isinstance(t, str) else None for t in texts], list(stated)))

    return run(F.col(text_col), F.col(length_col).cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    score = scored(docs, fit(docs, labels, id_col, text_col, length_col, label_col), text_col, length_col)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
