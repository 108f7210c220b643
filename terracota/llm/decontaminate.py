"""Benchmark passages in documents by winnowing.

Words are hashed, GRAM of them make a k-gram, and a text keeps the least k-gram hash of every WINDOW of them in a row. Any span
of GRAM + WINDOW - 1 = 13 words that two texts share has the same least hash in both, so every shared span leaves a
shared fingerprint. Fingerprints of documents and benchmark items are joined by hash. Each hit is extended to the 13-word spans
whose least hash it is; a span is shared if the words themselves agree, by 128 bits of hash of all 13. An item of fewer than SPAN
words is one span, whose fingerprint is the hash of all its words, looked up among all k-grams of that length.

Work is linear in the words of both sides, also where a text repeats itself: a place in a document meets one distinct span, and a
distinct span one set of items, known by a digest, so neither places nor items are paired. Hashes that find candidates are of words
lower-cased in full, which only adds candidates; spans lower-case A-Z alone. Texts of candidates are read a second time; others
never leave the scan. Rows are told apart by id and 128 bits of their text. Fingerprints, spans and answers are broadcast up to
BROADCAST_ROWS rows (keys and numbers, under 100 bytes each), beyond that joined by shuffle, spans and rows of a large share of all
apart from the others.

Cases: null and empty texts have no words and no hits; an item without words has no window; items with a null id still mark words
as hit but count as no item; items and documents that repeat are answered row by row; ties can't occur but between equal spans, which
are one; a very long text is linear work in one row; an empty benchmark leaves all documents clean, an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracota.llm.common import BROADCAST_ROWS, bounded_broadcast, keyed_join, row_key, unused, written

GRAM, SPAN = 8, 13
#: Characters between words once A-Z are lower case, and the same where case is kept. Fixed values.
BETWEEN, BETWEEN_CASED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def exact_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), BETWEEN), "")


def cased_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_CASED), "")


def _bound(x: Column, body) -> Column:
    """body(x) with x computed once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _pairs(a: Column, n: int, join) -> Column:
    """join of each element with the one n places on, while there is one."""
    rest = lambda x: F.greatest(F.size(x) - n, F.lit(0))
    return _bound(a, lambda x: F.zip_with(F.slice(x, F.lit(1), rest(x)), F.slice(x, F.lit(n + 1), rest(x)), join))


def k_grams(hashes: Column, k: int) -> Column:
    """Hash of each k neighbouring words' hashes, by doubling."""
    out, width = hashes, 1
    while width < k:
        step = min(width, k - width)
        out, width = _pairs(out, step, lambda a, b: F.xxhash64(a, b)), width + step
    return out


def minima(grams: Column, window: int) -> Column:
    """Least of each window of k-grams, by doubling."""
    out, width = grams, 1
    while width < window:
        step = min(width, window - width)
        out, width = _pairs(out, step, lambda a, b: F.least(a, b)), width + step
    return out


def word_hashes(text: Column) -> Column:
    return F.transform(cased_words(text), lambda w: F.xxhash64(F.lower(w)))


def prints(hashes: Column, length: int, span: int = SPAN, gram: int = GRAM) -> Column:
    """Fingerprint of each span of that length, in order: the least k-gram hash in it, or the hash of a span shorter than SPAN."""
    return minima(k_grams(hashes, gram), span - gram + 1) if length == span else k_grams(hashes, length)


def spans(words: str, length: int, found: Column) -> Column:
    """Array of (length, fingerprint, two hashes of the words, place from 1) of the spans of an array column of words."""

    def one(h: Column, i: Column) -> Column:
        own = F.slice(words, i + 1, F.lit(length))
        return F.struct(F.lit(length).alias("k"), h.alias("h"), F.xxhash64(own).alias("a"), F.xxhash64(F.lit(1), own).alias("b"), (i + 1).alias("s"))

    return F.transform(found, one)


def _contamination(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, span: int, gram: int) -> DataFrame:
    """(key, n_hit, n_items, items_sha256, n) of the distinct rows(key, text) that have hits; n: how many rows have the key."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    items = items.withColumn("w", exact_words(F.col("item_text"))).withColumn("m", F.size("w")).where("m > 0")
    items = written(items.withColumn("hashes", word_hashes(F.col("item_text"))).withColumn("length", F.least("m", F.lit(span))).drop("item_text"), "items")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most span values
    if not lengths:
        return None
    cut = lambda k: F.explode(spans("w", k, prints(F.col("hashes"), k, span, gram))).alias("x")
    own = reduce(DataFrame.unionByName, (items.where(F.col("length") == k).select("item_id", cut(k)) for k in lengths))
    own = written(own.select("item_id", "x.k", "x.h", "x.a", "x.b").distinct(), "item-spans")
    known = own.select("k", "h").distinct()
    # items that have a span, as a set: its size and the exclusive or of two hashes
    digest = [F.count("item_id").alias("c"), F.bit_xor(F.xxhash64("item_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("y")]
    sets = written(own.groupBy("k", "a", "b").agg(*digest).select(F.struct("k", "a", "b").alias("span"), F.struct("c", "x", "y").alias("items")), "item-sets")
    chosen = sets.groupBy("items").agg(F.min("span").alias("span"))
    members = chosen.join(own.select(F.struct("k", "a", "b").alias("span"), "item_id"), "span").where("item_id is not null").select("items", "item_id").distinct()
    members = written(members, "item-members")

    mark = lambda k: F.transform(F.array_distinct(prints(F.col("hashes"), k, span, gram)), lambda h: F.struct(F.lit(k).alias("k"), h.alias("h")))
    marks = rows.select("key", word_hashes(F.col("text")).alias("hashes")).select("key", F.explode(F.concat(*map(mark, lengths))).alias("f")).select("key", "f.k", "f.h")
    candidates = written(marks.join(bounded_broadcast(known), ["k", "h"], "left_semi").select("key").distinct(), "candidates")
    texts = rows.join(bounded_broadcast(candidates), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    texts = written(texts, "candidate-texts")
    places = texts.select("key", exact_words(F.col("text")).alias("w"), word_hashes(F.col("text")).alias("hashes"))
    places = places.select("key", F.explode(F.concat(*(spans("w", k, prints(F.col("hashes"), k, span, gram)) for k in lengths))).alias("x"))
    places = places.select("key", "x.k", "x.h", "x.s", F.struct("x.k", "x.a", "x.b").alias("span")).join(bounded_broadcast(known), ["k", "h"], "left_semi").select("key", "k", "s", "span")
    if sets.count() <= BROADCAST_ROWS:
        hits = places.join(F.broadcast(sets), "span")
    else:
        places = written(places, "places")
        sizes = places.groupBy("span").agg(F.count("*").alias("n"))
        hits = keyed_join(places, written(sets.join(sizes, "span"), "sized-sets"), "span", places.count())
    hits = written(hits.select("key", "s", (F.col("s") + F.col("k") - 1).alias("e"), "items"), "hits")
    before = F.coalesce(F.max("e").over(Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s") - 1, before))
    hit_words = hits.select("key", "s", "e").distinct().withColumn("new", new).groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))
    hit_items = hits.select("key", "items").distinct().join(bounded_broadcast(members), "items").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    hit_items = hit_items.select("key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids").cast("binary"), 256).alias("items_sha256"))
    return written(hit_words.join(hit_items, "key", "left").join(texts.select("key", "n"), "key"), "answers")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs."""
    rows = _keyed(docs, id_col, text_col)
    found = _contamination(rows, benchmark, item_col, item_text_col, span, gram)
    out = rows.select("doc_id", "key", F.size(cased_words(F.col("text"))).cast("long").alias("n_words"))
    if found is None:
        out = out.withColumns({"n_hit": F.lit(None).cast("long"), "n_items": F.lit(None).cast("long"), "items_sha256": F.lit(None).cast("string")})
    elif found.count() <= BROADCAST_ROWS:
        out = out.join(F.broadcast(found), "key", "left")
    else:
        out = keyed_join(out, found, "key", rows.count(), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items_sha256": F.coalesce("items_sha256", none)})
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones. Rows are judged by their own text, whatever rows share their id."""
    rows = _keyed(docs, id_col, text_col)
    found = _contamination(rows, benchmark, "item_id", "text", SPAN, GRAM)
    if found is None:
        return docs
    key = unused(docs, "key")
    # only rows with hits are counted in words
    words = F.size(cased_words(F.col("text"))).alias("n_words")
    hit = rows.join(bounded_broadcast(found.select("key", "n_hit")), "key").select("key", "n_hit", words)
    bad = written(hit.where(20 * F.col("n_hit") >= F.col("n_words")).select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row_key(id_col, text_col)).join(bounded_broadcast(bad), key, "left_anti").drop(key)


#: The same result by plain 13-word windows, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""
