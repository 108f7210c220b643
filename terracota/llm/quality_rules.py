"""Robust multivariate outliers: a minimum-covariance-determinant estimate for each language and source.

Each text gives five statistics; their transforms (logs and square-root ratios) form a vector. For each (lang, source) the
estimate is the mean and covariance of the share CORE of vectors whose covariance has the least determinant. It is sought from
STARTS random sets of D + 1 vectors and from the medians, by concentration steps: take the CORE nearest by the present estimate,
estimate anew. No step can raise the determinant, so steps go on until it stays. The vectors are those of the rows that pass the base
rule. Groups with under LEAST of them take their language's estimate, and languages with under LEAST that of all.

Equal vectors are one vector with a weight. Groups of up to SAMPLE different vectors are settled in one task, exactly. Of larger ones a
sample of about SAMPLE vectors, each taken with a chance in proportion to its rows, gives the
BEST starts with the least determinants; a vector with many rows is always in it, so no sample is empty. From these, steps over all rows go on as aggregates: one for the CORE quantile of the
distances, one for the sums of the rows within it. After two steps the start with the least determinant goes on alone. The quantile is
right to one in ACCURACY of the rows, and rows that tie with it count in part, so the core has CORE of the rows to that
precision; as it isn't exact, a step may raise a determinant, and the least one seen is kept. `settled` is false in rows whose estimate still moved
after STEPS steps. Estimates stay tables, a row a group; the driver reads only how many still move. A group always has an estimate: its own, its
language's or that of all; a run that lacks one ends with an error rather than keep the group's rows.

RIDGE keeps coordinates apart that are constant in most rows, such as repeated lines: its squares are added to the covariance's
diagonal before determinants and distances are taken, as in the minimum regularised covariance determinant. The estimates are scaled
for consistency and reweighted once. A row is rejected if its squared distance is beyond the chi-square quantile of
1 - REJECT, times SLACK for the tails that real statistics have (README has what it costs).

Cases: null and empty texts have no words and fail the base rule; rows that fail it aren't judged by distance (d2 may be null); null
lang and source are groups of their own; rows that repeat count as often as they occur, and ties share the core's last place; a very
long text is one vector; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracota.llm.common import BROADCAST_ROWS, by_text, keyed_join, written
from terracota.llm.stats import base_stats

MIN_WORDS, MAX_REPEAT = 50, 50
CORE, LEAST, REJECT, SLACK, RIDGE = 0.75, 200, 1e-4, 2.0, (0.3, 0.05, 0.03, 0.08, 0.12)
SAMPLE, STARTS, BEST, STEPS, ACCURACY, SETTLED, SEED = 500, 100, 3, 20, 10_000, 1e-6, 11
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Number of coordinates, and the chi-square quantiles with so many degrees at CORE, 0.975 and 1 - REJECT. Fixed values.
D, CHI_CORE, CHI_CLEAN, CHI_REJECT = 5, 6.6257, 12.8325, 25.7448
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
FIT = "k string, start int, n long, log_det double, mean array<double>, root array<double>, done boolean"
FIT_COLUMNS = [c.split()[0] for c in FIT.split(", ")]


def statistics(docs: DataFrame, text_col: str = "text") -> Column:
    """Struct of STATS as a column."""

    def work(texts):
        rows = [base_stats(t) for t in texts]
        return {"n_words": [len(r[0]) for r in rows]} | {k: [r[i] for r in rows] for i, k in enumerate(("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), 1)}

    return by_text(docs.sparkSession, lambda: work, STATS)(F.col(text_col))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words"), F.log(F.greatest("word_chars", F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def distance() -> Column:
    """Squared length of root * (x - mean); root: the inverse covariance's lower root, row by row."""
    d = [F.col(x) - F.get("mean", F.lit(i)) for i, x in enumerate(X)]
    rows = [reduce(lambda a, b: a + b, (F.get("root", F.lit(i * D + j)) * d[j] for j in range(i + 1))) for i in range(D)]
    return reduce(lambda a, b: a + b, (r * r for r in rows))


def consistent(share: float, quantile: float) -> float:
    """What makes the covariance of the share of normal rows within the quantile that of all."""
    return share / chi_square(quantile, D + 2)


def ridged(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.square(RIDGE))


def root(cov: np.ndarray) -> np.ndarray:
    """Inverse of the Cholesky factor: its product with x - mean has the Mahalanobis length. Also for stacks of covariances."""
    return np.linalg.inv(np.linalg.cholesky(ridged(cov)))


def cores(x: np.ndarray, w: np.ndarray, mean: np.ndarray, cov: np.ndarray, core: float = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A concentration step for each (mean, cov) of a stack: (log determinants, means, covariances) of the nearest rows x of weights w."""
    d2 = np.square(np.einsum("sij,snj->sni", root(cov), x[None] - mean[:, None])).sum(2)
    order = np.argsort(d2, axis=1, kind="stable")
    own = w[order]
    upto = np.cumsum(own, axis=1)
    used = np.clip(core * w.sum() - (upto - own), 0, own)  # the last row counts in part
    near = x[order]
    total = used.sum(1)
    mean = np.einsum("sn,snj->sj", used, near) / total[:, None]
    d = near - mean[:, None]
    cov = consistent(CORE, CHI_CORE) * np.einsum("sn,sni,snj->sij", used, d, d) / total[:, None, None]
    return np.linalg.slogdet(ridged(cov))[1], mean, cov


def least_determinants(x: np.ndarray, w: np.ndarray, starts: int = STARTS, best: int = BEST, core: float = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to best different (log determinant, mean, covariance) of a share core of rows x with weights w, least first."""
    order = np.lexsort(x.T[::-1])
    x, w, rng = x[order], w[order].astype(float), np.random.default_rng(SEED)
    sets = [x[rng.choice(len(x), min(len(x), D + 1), replace=False)] for _ in range(starts)]
    middle = np.repeat(x, np.maximum(1, np.minimum(w, 50)).astype(int), axis=0)
    spread = np.quantile(middle, 0.75, axis=0) - np.quantile(middle, 0.25, axis=0)
    mean = np.array([*(s.mean(0) for s in sets), np.median(middle, axis=0)])
    cov = np.array([*((s - s.mean(0)).T @ (s - s.mean(0)) / len(s) for s in sets), np.diag(np.square(spread / 1.349))])
    for _ in range(2):
        value, mean, cov = cores(x, w, mean, cov, core)
    keep = np.argsort(value, kind="stable")[:10]
    value, mean, cov = value[keep], mean[keep], cov[keep]
    for _ in range(200):
        before = value
        value, mean, cov = cores(x, w, mean, cov, core)
        if (before - value <= 1e-12).all():
            break
    ranked = np.argsort(value, kind="stable")
    keep = ranked[np.append(True, np.diff(value[ranked]) > 1e-9)][:best]
    return value[keep], mean[keep], cov[keep]


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """FIT rows of one group's sample(k, n, x..., w, whole); done where the sample is the whole group."""
    n, w = int(rows["n"].iloc[0]), rows["w"].to_numpy()
    done = bool(rows["whole"].all())
    value, mean, cov = least_determinants(rows[X].to_numpy(), w, best=1 if done else BEST)
    return pd.DataFrame({"k": rows["k"].iloc[0], "start": range(len(value)), "n": n, "log_det": value, "mean": list(mean), "root": [r.reshape(-1) for r in root(cov)], "done": done})


def _estimator(core: float, scale: float):
    """Function from sums of one start, of the rows within the quantile and of those on it, to its FIT row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        inside = rows.loc[~rows["edge"], "rows"].sum()
        share = [min(1.0, max(0.0, (core * n - inside) / c)) if edge and core < 1 else 1.0 for edge, c in zip(rows["edge"], rows["rows"], strict=True)]
        total = (rows["rows"] * share).sum()
        if not total:
            share, total = [1.0] * len(rows), rows["rows"].sum()
        mean = sum(f * np.array(s) for f, s in zip(share, rows["s"], strict=True)) / total
        cov = np.zeros((D, D))
        for (i, j), v in zip(PAIRS, sum(f * np.array(p) for f, p in zip(share, rows["p"], strict=True)) / total, strict=True):
            cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
        cov *= scale
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "start": rows["start"].iloc[0], "n": n, "log_det": np.linalg.slogdet(ridged(cov))[1], "mean": [mean], "root": [root(cov).reshape(-1)], "done": False})

    return run


def _met(points: DataFrame, fits: DataFrame, total: int) -> DataFrame:
    """points(k, x...) with each fit(k, start, n, mean, root) of their group, and the distance d2."""
    packed = fits.groupBy("k").agg(F.max("n").alias("n"), F.collect_list(F.struct("start", "mean", "root")).alias("fits"))  # at most BEST a group
    packed = written(packed, "fits")
    met = points.join(F.broadcast(packed), "k") if packed.count() * BEST * 10 <= BROADCAST_ROWS else keyed_join(points, packed, "k", total)
    return met.select("k", "n", *X, F.explode("fits").alias("f")).select("k", "n", *X, "f.*").withColumn("d2", distance())


def _sums(rows: DataFrame) -> DataFrame:
    products = F.array(*(F.sum(F.col(X[i]) * F.col(X[j])) for i, j in PAIRS))
    return rows.groupBy("k", "start", "edge").agg(F.max("n").alias("n"), F.count("*").alias("rows"), F.array(*map(F.sum, X)).alias("s"), products.alias("p"))


def concentrated(points: DataFrame, fits: DataFrame, total: int) -> DataFrame:
    """One concentration step of every fit over all points of its group."""
    met = _met(points, fits, total).withColumn("fit", F.struct("k", "start")).withColumnRenamed("n", "size")
    cuts = met.groupBy("fit").agg(F.percentile_approx("d2", F.lit(CORE), F.lit(ACCURACY)).alias("cut"), F.count("*").alias("n"))
    cuts = written(cuts, "cuts")
    near = met.join(F.broadcast(cuts.drop("n")), "fit") if cuts.count() * 10 <= BROADCAST_ROWS else keyed_join(met, cuts, "fit", BEST * total).drop("n")
    near = near.where(F.col("d2") <= F.col("cut")).withColumn("edge", F.col("d2") == F.col("cut")).drop("fit").withColumnRenamed("size", "n")
    return written(_sums(near).groupBy("k", "start").applyInPandas(_estimator(CORE, consistent(CORE, CHI_CORE)), FIT), "fits")


def sampled(points: DataFrame) -> DataFrame:
    """(k, n, x..., w, whole): of each group of points(k, n, x...) all different vectors with their numbers of rows if there are at most SAMPLE of them (whole), else about SAMPLE, taken
    in proportion to their rows and weighted by what they stand for."""
    vectors = written(points.groupBy("k", "n", *X).agg(F.count("*").alias("w")), "vectors").withColumnRenamed("n", "size")
    kinds = written(vectors.groupBy("k").agg(F.count("*").alias("n")), "kinds")
    met = vectors.join(F.broadcast(kinds), "k") if kinds.count() * 10 <= BROADCAST_ROWS else keyed_join(vectors, kinds, "k", vectors.count())
    whole = F.col("n") <= SAMPLE
    share = F.when(whole, 1.0).otherwise(F.least(F.lit(1.0), F.col("w") * SAMPLE / F.col("size")))
    chosen = F.pmod(F.xxhash64(*X), F.lit(1_000_000)) < 1_000_000 * share
    return met.where(chosen).select("k", F.col("size").alias("n"), *X, (F.col("w") / share).alias("w"), whole.alias("whole"))


def fit(points: DataFrame, total: int) -> DataFrame:
    """(k, mean, root, settled) of each group of points(k, n, x...): n rows in the group."""
    found = written(sampled(points).groupBy("k").applyInPandas(_starts, FIT), "starts")
    done, now = found.where("done").withColumn("settled", F.lit(True)), found.where("not done")
    if not now.isEmpty():
        open_points = points.select("k", *X).join(F.broadcast(now.select("k").distinct()), "k", "left_semi") if now.count() * 10 <= BROADCAST_ROWS else points.select("k", *X)
        for step in range(STEPS):
            before, now = now, concentrated(open_points, now, total)
            if step == 1:  # the least determinant goes on alone
                now = written(now.groupBy("k").agg(F.min_by(F.struct(*FIT_COLUMNS[1:]), F.struct("log_det", "start")).alias("f")).select("k", "f.*"), "fits")
            elif step > 1:
                was = before.select("k", F.struct(*FIT_COLUMNS[1:]).alias("was"))
                both = now.select("k", F.struct(*FIT_COLUMNS[1:]).alias("f")).join(was, "k").withColumn("moved", F.col("was.log_det") - F.col("f.log_det"))
                kept = both.select("k", F.when(F.col("moved") >= 0, F.col("f")).otherwise(F.col("was")).alias("f"), (F.col("moved") <= SETTLED).alias("settled"))
                now = written(kept.select("k", "f.*", "settled"), "fits")
                if now.where("not settled").isEmpty():
                    break
        done = done.unionByName(now)
    clean = _met(points.select("k", *X), done.select(*FIT_COLUMNS), total).where(F.col("d2") <= CHI_CLEAN).withColumn("edge", F.lit(False))
    own = _sums(clean).groupBy("k", "start").applyInPandas(_estimator(1.0, consistent(0.975, CHI_CLEAN)), FIT).select("k", "mean", "root")
    # a core without any row within the clean quantile, as a single point's, keeps its estimate as it is
    return done.select("k", F.col("mean").alias("raw_mean"), F.col("root").alias("raw_root"), "settled").join(own, "k", "left").select("k", F.coalesce("mean", "raw_mean").alias("mean"), F.coalesce("root", "raw_root").alias("root"), "settled")


def levels(good: DataFrame) -> DataFrame:
    """(g, n, use, keys) of each group g of good(g, l): the key of the estimate that it uses, and of those that its rows take part in, with their sizes."""
    sizes = written(good.groupBy("g", "l").agg(F.count("*").alias("n")), "sizes")
    langs = written(sizes.groupBy("l").agg(F.sum("n").alias("ln"), F.min("n").alias("least")), "langs")
    total = F.lit(langs.agg(F.coalesce(F.sum("ln"), F.lit(0))).first()[0])
    whole = F.lit(not langs.where(F.col("ln") < LEAST).isEmpty())
    langs = F.broadcast(langs) if langs.count() <= BROADCAST_ROWS else langs
    own, lang = F.concat(F.lit("g"), "g"), F.concat(F.lit("l"), "l")
    use = F.when(F.col("n") >= LEAST, own).when(F.col("ln") >= LEAST, lang).otherwise("all")
    one = lambda when, k, n: F.when(when, F.struct(k.alias("k"), n.cast("long").alias("n")))
    parts = F.array(one(F.col("n") >= LEAST, own, F.col("n")), one((F.col("ln") >= LEAST) & (F.col("least") < LEAST), lang, F.col("ln")), one(whole, F.lit("all"), total))
    return written(sizes.join(langs, "l").select("g", "n", use.alias("use"), F.filter(parts, lambda p: p.isNotNull()).alias("keys")), "levels")


def with_statistics(rows: DataFrame) -> DataFrame:
    """rows(..., STATS) with the base rule's answer."""
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, settled, kept) for each row."""
    group = F.to_json(F.struct(F.col(lang_col).alias("lang"), F.col(source_col).alias("source")))
    found = docs.select(F.col(id_col).alias("doc_id"), group.alias("g"), F.to_json(F.struct(F.col(lang_col).alias("lang"))).alias("l"), statistics(docs, text_col).alias("r")).select("doc_id", "g", "l", "r.*")
    rows = written(with_statistics(found).withColumns(dict(zip(X, vector(), strict=True))), "statistics")
    good = rows.where(~F.col("base_failed"))
    groups = levels(good)
    total, small = good.count(), groups.count() * 10 <= BROADCAST_ROWS
    join = (lambda a, b, how="inner": a.join(F.broadcast(b), "g", how)) if small else (lambda a, b, how="inner": keyed_join(a, b, "g", total, how))
    points = join(good.select("g", *X), groups.select("g", "n", "keys")).select(*X, F.explode("keys").alias("k")).select(*X, "k.*")
    fits = written(fit(points, 3 * total), "estimates").withColumnRenamed("k", "use")
    known = written(groups.join(F.broadcast(fits) if small else fits, "use", "left").select("g", "n", "mean", "root", "settled"), "group-estimates")
    if not known.where("root is null").isEmpty():
        raise RuntimeError("a group of rows has no estimate")
    out = join(rows, known, "left").withColumn("d2", distance())
    names = [c.split()[0] for c in STATS.split(", ")]
    return out.select("doc_id", *names, "base_failed", "d2", "settled", (~F.col("base_failed") & (F.col("d2") <= CHI_REJECT * SLACK)).alias("kept"))


def chi_square(x: float, degrees: int) -> float:
    """Distribution function, by the series of the incomplete gamma function; the tests hold the fixed quantiles against it."""
    a, h = degrees / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= h / (a + i)
        total += term
    return total * math.exp(a * math.log(h) - h - math.lgamma(a)) if x > 0 else 0.0
