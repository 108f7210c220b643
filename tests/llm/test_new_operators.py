"""Hard negatives, source divergence and MinHash near copies, against SQL and brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from terracota.llm import divergence, hard_negatives, minhash, queries
from terracota.sources.shared import written

SF = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return sorted(map(str, df.select(columns).collect()))


def from_sql(sql, columns, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    from pyspark.sql import Row

    return sorted(str(Row(**dict(zip(columns, r, strict=True)))) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_divergence"])
def test_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert expected and sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(expected, key=str)


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(seed, n):
    """Clusters of near vectors, equal ones, negative scores, odd values and lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * 0.02 * rng.integers(0, 3, (n, 1))
    rows = [(int(i), [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    odd = [(50, None, 1), (100, [1.0] * 7 + [float("nan")], 1), (101, [1.0] * 7 + [float("inf")], 1), (150, [1.0] * 7 + [None], 2), (200, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    short = [(n + 1, [0.5, 0.25], 1), (n + 2, [2.0] * 8, 2)]
    return rows + odd + short + rows[7:9] + [(50 * (n // 50 + 1), [0.5, -0.5], 3)]


def test_hard_negatives_odd_rows(spark, monkeypatch):
    """Small trees, several rounds, ties and repeated rows: all as SQL over all scores has it."""
    rows = vectors(3, 1500)
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema)
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": pa.array([r[2] for r in rows], pa.int32())})
    expected = from_sql(hard_negatives.ORACLE, MINED, embeddings=table)
    assert len(expected) > 50
    for block, size, parts in ((512, 32_000_000, 1), (3, 500, 5)):
        monkeypatch.setattr(hard_negatives, "ROUND_BYTES", size)
        own = df.repartition(parts).selectExpr("*", "1 AS score", "'x' AS v", "2 AS a", "3 AS finite")
        assert rows_of(hard_negatives.hard_negatives(own, block=block), MINED) == expected
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0 == hard_negatives.hard_negatives(df.where("vec_id % 50 > 0")).count()
    empty = spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [1.0], 2)], schema)
    assert [tuple(r) for r in hard_negatives.hard_negatives(empty).collect()] == [(0, 2, 1, 1, 0, 0)]  # 0 is of the next label


def test_bounds_leave_rows_out_and_are_exact():
    """Children of near anchors score few rows anew, and never leave out one that their window holds; large values stay exact."""
    rng = np.random.default_rng(1)
    centre = np.floor(rng.normal(size=(20, 16)) * 100)
    a = np.repeat(centre, 6, 0) + rng.integers(-1, 2, (120, 16))
    x = np.concatenate([centre + rng.integers(-3, 4, centre.shape), np.floor(rng.normal(size=(2000, 16)) * 100)])
    order, parents, edges = hard_negatives.tree(a)
    block = {"a": a[order], "parent": parents, "edge": edges, "children": np.bincount(parents[parents >= 0], minlength=len(a))}
    exact = a[order] @ x.T
    low = np.sort(exact, axis=1)[:, -5]
    scored = 0
    for k, i, s in hard_negatives.walk(block, x, lambda k, lo, hi: hi >= low[k]):
        assert (s == exact[k][i]).all() and set(np.flatnonzero(exact[k] >= low[k])) <= set(i)
        scored += len(i)
    assert scored < 0.4 * exact.size
    # the tree's length is the least: no shorter one by brute force over a few points
    few = a[:5]
    points = np.concatenate([np.zeros((1, 16)), few])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    trees = (t for t in itertools.combinations(itertools.combinations(range(6), 2), 5) if _spans(t))
    assert hard_negatives.tree(few)[2].sum() == pytest.approx(min(sum(d[i, j] for i, j in t) for t in trees))
    big = np.array([[2.0**40, 1.0], [2.0**62, 3.0]])
    assert hard_negatives.product(big[:1], np.array([2.0**20, 1.0]), 2.0**61).tolist() == [2**60 + 1] and hard_negatives.product(big, np.array([8.0, 1.0]), 2.0**66).tolist() == [2**43 + 1, 2**63 - 1]


def _spans(edges):
    root = list(range(6))
    for i, j in edges:
        a, b = root[i], root[j]
        if a == b:
            return False
        root = [a if r == b else r for r in root]
    return True


def test_windows():
    for p in range(-60, 400):
        low, high = hard_negatives.window_of(p)
        assert [n for n in range(-100, 450) if 50 * p <= 100 * n <= 95 * p] == list(range(low, high + 1))


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_odd_rows(spark):
    """Nulls, groups without terms, sources alone in their language, non-ASCII terms, ties and repeats, in one cell and in many: as SQL has it."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "été", "Été", "x1y", "日本", "delta-epsilon", "a", "zz", "q_r"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), f"s{rng.randint(0, 6)}") for i in range(300)]
    rows += [(1, None, "en", "none"), (2, "", "en", ""), (3, "123 !!", "xx", "alone"), (4, "rare", "xx", "other"), (5, "rare", None, None)] + rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n", "'x' AS term", "2 AS place", "'y' AS item")
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "text", "lang", "source"))})
    for least in (2, 30):
        expected = from_sql(divergence.ORACLE.replace(">= 30", f">= {least}"), AUDIT, documents=table)
        assert len(expected) > 100
        for block, cell, parts in ((1024, 4096, 1), (2, 3, 7)):
            assert rows_of(divergence.divergence(df.repartition(parts), least_docs=least, block=block, cell=cell), AUDIT) == expected
    assert divergence.divergence(df.limit(0)).count() == 0
    none = divergence.divergence(df, least_docs=10_000).collect()
    assert none and all(r["part"] == "pair" and r["value"] == 0 for r in none)


def test_long_texts_and_shares():
    text = ("word Élan x " * 50).encode()
    old, divergence.SLICE = divergence.SLICE, 37
    try:
        assert b"".join(divergence.slices(text)) == text and [w for p in divergence.slices(text) for w in p.translate(divergence.TERMS).split()] == text.translate(divergence.TERMS).split()
    finally:
        divergence.SLICE = old
    assert [w.decode() for w in "Ab1É_ç-Z".encode().translate(divergence.TERMS).split()] == [w.translate(str.maketrans("ABZ", "abz")) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "Ab1É_ç-Z")]


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**17, 10**18, 10**6), (0, 7, 3), (5, 0, 0)], "n long, total long, v long")
    assert [r[0] for r in df.select(divergence.share("n")).collect()] == [1 + 10**9 * (10**17 + 5) // (10**18 + 5 * 10**6), 1 + 10**9 * 5 // 22, None]


def plain_components(texts, percent=85):
    """(set size, smallest id reachable) of each id, comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        k = min(5, len(w))
        sets[i] = {" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_minhash_equals_all_pairs(spark):
    """Crowds of near copies, chains over changes side by side without their base, boilerplate, copies and short texts; with joins and with blocks."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for size, n, changes in ((100, 60, 1), (150, 60, 6), (60, 20, 1), (300, 30, 4)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            own = list(base)
            for at in rng.sample(range(size), rng.randint(1, changes)):
                own[at] = word()
            texts.append(" ".join(own))
    common = " ".join(word() for _ in range(80))
    texts += [common + " " + " ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(60)]
    texts += ["one two three", "One TWO\tthree", "one two", "", None, "  \n", "x", texts[0], texts[0].upper(), "é à", "É à"]
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    expected = plain_components(rows)
    assert 100 < len({c for _, c in expected.values()}) < len(rows) - 50
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n", "3 AS bands", "4 AS row")
    for crowd in (1000, 2):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, crowd=crowd).collect()}
        assert found == {i: (n, c, i == c) for i, (n, c) in expected.items()}


def test_minhash_rows_grow_with_members(spark, monkeypatch):
    """A crowd whose members are nearly, but not, linked: no step has a row for each two of them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base, texts = [word() for _ in range(300)], []
    for _ in range(120):
        own = list(base)
        for at in rng.sample(range(300), 6):
            own[at] = word()
        texts.append(" ".join(own))
    rows = list(enumerate(texts, 1))
    counts = {}
    monkeypatch.setattr(minhash, "written", lambda df, name: counts.update({name: (out := written(df, name)).count()}) or out)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_components(rows) and len({c for _, c in found.values()}) > 40
    assert max(counts.values()) <= minhash.BANDS * len(rows) and "open-pairs" not in counts and counts["links"] < len(rows) * 2


def test_minhash_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u v"), (None, None), (3, None), (4, "w " * 100_000)]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 3, None, True), (None, 0, None, True), (3, 0, 3, True), (4, 1, 4, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures():
    """The estimate from the low bits is that of the sets; the bound on agreeing places has the stated risk; long texts are read in slices."""
    rng = np.random.default_rng(2)
    for share in (0.3, 0.85):
        errors = []
        for _ in range(40):
            both, one, two = (rng.integers(0, 2**63, int(n)).astype(np.uint64) for n in (400 * share, 200 * (1 - share), 200 * (1 - share)))
            m, n = (minhash.minima(np.unique(np.concatenate([both, x]))) for x in (one, two))
            agree = ((m & np.uint64(3)) == (n & np.uint64(3))).mean()
            errors.append((agree - 0.25) / 0.75 - len(both) / (len(both) + len(one) + len(two)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    least = minhash.least_matches()
    p = 0.25 + 0.75 * 0.85
    assert (rng.binomial(minhash.K, p, 1_000_000) >= least).all() and 0.5 < (least / minhash.K - 0.25) / 0.75 < 0.75
    text = " ".join(f"w{i}" for i in range(3000))
    whole, old = minhash.shingles(text, {}), minhash.SLICE
    minhash.SLICE = 100
    try:
        assert (minhash.shingles(text, {}) == whole).all() and len(whole) == 2996
    finally:
        minhash.SLICE = old
