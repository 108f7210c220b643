"""Source divergence audit: how far the word distributions of a language's sources are apart, by Gustavson row accumulation.

Terms are counted inside tasks a language and source at a time, so the shuffle gets a row for each term of a task, not for each word. Each
group (language, source) then is a sparse row of shares p, its baseline z standing for the terms that it lacks. The distance of groups
g and h, the sum of |p - q| over the V kept terms of the language, is

    V |zg - zh|  +  sum over g's terms (|p - zh| - |zg - zh|)  +  sum over h's terms (|q - zg| - |zg - zh|)
                 +  sum over terms of both (|p - q| - |p - zh| - |q - zg| + |zg - zh|)

The two sums over one group's terms come from its sorted shares and their running sums. The last goes row by row: each group scatters
its terms through the term-major index (term -> groups that have it) into a dense accumulator with a place for each peer, so no pair of
postings becomes a row. Terms are dealt into buckets and groups into blocks of GROUPS, a cell for each bucket and pair of
blocks; a cell gives one row of sums a group, and sums of all cells are added. All of it is whole numbers.

Cases: null text, language and source count as empty texts; a group without terms has shares of zero counts; a language without kept
terms has distances 0 and no `term` rows; ties in value go by UTF-8 order; rows that repeat count as often as they occur; a very long text is
read a slice at a time; a source that is the only one of its language has no `pair` rows; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracota.llm.common import bounded_broadcast, keyed_join, written

LEAST_DOCS, PRIOR, UNIT, TOP = 30, 5, 10**9, 50
#: Groups of a block, postings of a cell at least and at most, counts that a task holds before it passes them on, bytes of a text read at once.
GROUPS, CELL, MOST_CELL, HELD, SLICE = 1024, 4096, 2_000_000, 300_000, 4_000_000
#: A-Z in lower case, letters and all bytes beyond ASCII as they are, any other byte a blank.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def slices(text: bytes) -> Iterator[bytes]:
    """A text cut between terms, about SLICE bytes each."""
    at, gap = 0, re.compile(b"[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]")
    while len(text) - at > SLICE:
        found = gap.search(text, at + SLICE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of each (lang, source) of a task; docs: in how many of its texts a term occurs."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def passed_on():
        rows = [(*key, term, n, docs[term]) for key, (counts, docs) in held.items() for term, n in counts.items()]
        lang, source, term, n, docs = zip(*rows, strict=True)
        # bytes become text inside Arrow, as they are cut only at ASCII
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            text, own = text.as_py(), set()
            for part in slices(text) if len(text) > SLICE else (text,):
                words = part.translate(TERMS).split()
                counts.update(words)
                own.update(words)
            docs.update(own)
            size += len(counts)
            if size > HELD:
                yield passed_on()
                held, size = {}, 0
    if size:
        yield passed_on()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) of all texts, added up."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: str = "total", kept: str = "v") -> Column:
    """1 + floor(UNIT (n + PRIOR) / (total + PRIOR v)), exact beyond 64 bits; null where v is 0."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (F.col(n) if isinstance(n, str) else n).cast("decimal(20,0)") + F.lit(UNIT * PRIOR).cast("decimal(12,0)")
    below = (F.col(total) + PRIOR * F.col(kept)).cast("decimal(20,0)")
    return F.when(F.col(kept) > 0, (1 + F.call_function("div", whole, below)).cast("long"))


def cell_sums(lang, g_block, h_block, bucket, rows: pd.DataFrame) -> Iterator[dict]:
    """A row of sums for each group of one block against all of the other. rows: (side, place, z, term, p), a row without a term for each group of either side."""
    sides = []
    for side in (0, 1):
        own = rows[rows["side"] == side] if g_block != h_block else rows
        heads = own[own["term"].isna()].sort_values("place")
        posts = own[own["term"].notna()]
        sides.append((heads["place"].to_numpy(), heads["z"].to_numpy(), posts["place"].to_numpy(), posts["term"].to_numpy(), posts["p"].to_numpy()))
    (gs, zg, g_at, g_term, g_p), (hs, zh, h_at, h_term, h_p) = sides
    codes = pd.factorize(np.concatenate([g_term, h_term]))[0]
    g_code, h_code = codes[: len(g_term)], codes[len(g_term) :]
    h_row = np.searchsorted(hs, h_at)
    # the term-major index of the peers
    order = np.argsort(h_code, kind="stable")
    peer, q = h_row[order], h_p[order]
    begin = np.searchsorted(h_code[order], np.arange(codes.max(initial=-1) + 2))

    def alone(p, own_z, z):
        """Sum of |p - z| - |own_z - z| for each z, from the sorted p and their running sums."""
        p = np.sort(p)
        run, k = np.concatenate([[0], np.cumsum(p)]), np.searchsorted(p, z)
        return z * k - run[k] + (run[-1] - run[k]) - z * (len(p) - k) - len(p) * np.abs(own_z - z)

    by_peer = np.argsort(h_row, kind="stable")
    cuts = np.searchsorted(h_row[by_peer], np.arange(len(hs) + 1))
    theirs = np.stack([alone(h_p[by_peer[cuts[j] : cuts[j + 1]]], zh[j], zg) for j in range(len(hs))], 1)  # (group, peer)
    g_order = np.argsort(g_at, kind="stable")
    g_cuts = np.searchsorted(g_at[g_order], [*gs, np.inf])
    for i in range(len(gs)):
        mine = g_order[g_cuts[i] : g_cuts[i + 1]]
        sums = theirs[i] + alone(g_p[mine], zg[i], zh)
        code, p = g_code[mine], g_p[mine]
        n = begin[code + 1] - begin[code]
        at = np.repeat(begin[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
        p, j = np.repeat(p, n), peer[at]
        np.add.at(sums, j, np.abs(p - q[at]) - np.abs(p - zh[j]) - np.abs(q[at] - zg[i]) + np.abs(zg[i] - zh[j]))
        keep = hs > gs[i]
        yield {"lang": lang, "g": int(gs[i]), "hs": hs[keep], "sums": sums[keep]}


def _cell(key, rows):  # Spark takes hints here for another kind of function
    lang, gb, hb, bucket = (k.as_py() for k in key)
    out = list(cell_sums(lang, gb, hb, bucket, rows.to_pandas()))
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "g": pa.array([r["g"] for r in out], pa.int64()), "hs": pa.array([r["hs"] for r in out], pa.list_(pa.int64())), "sums": pa.array([r["sums"] for r in out], pa.list_(pa.int64()))})


def pair_sums(groups: DataFrame, posts: DataFrame, block: int = GROUPS, cell: int = CELL) -> DataFrame:
    """(lang, g, h, s) for g < h: what the distance has besides V |zg - zh|. groups: (lang, place, z, n_groups, n_posts); posts: (lang, place, z, n_groups, n_posts, term, p)."""
    blocks = F.ceil(F.col("n_groups") / block).cast("int")
    most = F.least(F.lit(MOST_CELL), F.greatest(F.lit(cell), 4 * F.pow(F.least(F.col("n_groups"), F.lit(block)), 2)))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_posts") / most)).cast("int")

    def dealt(rows: DataFrame, bucket: Column) -> DataFrame:
        """A row for each pair of blocks, and each bucket, that its group takes part in; side 0 is the lower block."""
        own = (F.col("place") / block).cast("int")
        rows = rows.withColumns({"own": own, "bucket": bucket}).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return rows.select("lang", F.least("own", "other").alias("gb"), F.greatest("own", "other").alias("hb"), "bucket", (F.col("own") > F.col("other")).cast("int").alias("side"), "place", "z", "term", "p")

    heads = groups.withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")})
    cells = dealt(posts, F.pmod(F.xxhash64("term"), buckets)).unionByName(dealt(heads, F.explode(F.sequence(F.lit(0), buckets - 1).cast("array<bigint>"))))
    sums = cells.groupBy("lang", "gb", "hb", "bucket").applyInArrow(_cell, "lang string, g long, hs array<long>, sums array<long>")
    sums = sums.select("lang", "g", F.explode(F.arrays_zip("hs", "sums")).alias("x")).select("lang", "g", F.col("x.hs").alias("h"), F.col("x.sums").alias("s"))
    return sums.groupBy("lang", "g", "h").agg(F.sum("s").alias("s"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = GROUPS, cell: int = CELL) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the distance to each other source, `term` the terms that the source has more of than its language."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("n_sources")).where(F.col("docs") >= least_docs)
    kept = written(kept.select(F.struct("lang", "term").alias("key"), "lang_n", F.col("n_sources").alias("n")), "kept-terms")
    langs = kept.groupBy("key.lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"), F.sum("n").alias("n_posts"))
    own = counts.select("lang", "source", "term", F.col("n").alias("own_n"), F.struct("lang", "term").alias("key"))
    own = written(keyed_join(own, kept, "key", counts.count()).select("lang", "source", "term", "own_n", "lang_n"), "kept-counts")
    names = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    groups = names.join(own.groupBy("lang", "source").agg(F.sum("own_n").alias("total")), ["lang", "source"], "left").join(bounded_broadcast(langs), "lang", "left")
    groups = groups.fillna(0, ["total", "v", "lang_total", "n_posts"])
    per_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"place": F.row_number().over(per_lang.orderBy("source")) - 1, "n_groups": F.count("*").over(per_lang)})
    groups = written(groups.withColumns({"place": F.col("place").cast("long"), "z": F.coalesce(share(F.lit(0)), F.lit(0))}), "groups")
    rows = own.join(bounded_broadcast(groups), ["lang", "source"]).withColumn("p", share("own_n"))
    rows = written(rows.withColumn("q", share("lang_n", "lang_total")), "shares")

    sums = pair_sums(groups.where("n_groups > 1").select("lang", "place", "z", "n_groups", "n_posts"), rows.where("n_groups > 1").select("lang", "place", "z", "n_groups", "n_posts", "term", "p"), block, cell)
    sums = written(sums.select("lang", F.col("g").alias("place"), F.col("h").alias("peer"), "s"), "pair-sums")
    both = sums.unionByName(sums.select("lang", F.col("peer").alias("place"), F.col("place").alias("peer"), "s"))
    ends = bounded_broadcast(groups.select("lang", "place", "source", "z", "v"))
    peers = ends.select("lang", F.col("place").alias("peer"), F.col("source").alias("item"), F.col("z").alias("peer_z"))
    pairs = both.join(ends, ["lang", "place"]).join(bounded_broadcast(peers), ["lang", "peer"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * F.abs(F.col("z") - F.col("peer_z")) + F.col("s")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


#: The same result by every term of every pair, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, id, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) // CAST(g.total + 5 * v.v AS HUGEINT) AS BIGINT) AS p,
  1 + CAST(1000000000 * CAST(k.lang_n + 5 AS HUGEINT) // CAST(v.total + 5 * v.v AS HUGEINT) AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= 50
"""
