"""URL verdicts: host rules first, a character language-model ratio for the rest.

Two variable-order Markov models, of accepted and of rejected URLs, give each character's probability after up to ORDER - 1
characters, with Witten-Bell interpolation down to single characters and a flat floor. A URL's score is the mean over its
characters of log p(accepted) - log p(rejected), to DIGITS decimals. The models learn from the URLs that rules settle, but for
three in sixteen, chosen by hash; on those the threshold is set: the score that at most LOST of the accepted URLs
fall below, and never above zero.

Everything is counted over all URLs: distinct URLs are cut into n-grams, and counts of n-grams, their suffixes and
contexts are aggregates. Probabilities exist for each distinct n-gram of the corpus; that table is broadcast if it has
at most BROADCAST_ROWS rows (about 40 bytes each), else n-grams of a large share of all, such as those at the start of every URL,
meet a broadcast and the others a shuffle. ORACLE has the same results in SQL.

Cases: null URLs and those without "://" have an empty host and path, no rule, a null score and are allowed; so is everything
without a rule if either class has no URL; a URL is learned from once, however often it occurs, and repeated rows get equal answers;
a score that ties with the threshold is allowed; a very long URL is so many n-grams; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracota.llm.common import BROADCAST_ROWS, keyed_join, written

ORDER, ALPHABET, LOST, DIGITS = 5, 256.0, 0.01, 4
#: Verdict, host and path of each rule. Fixed values.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with rest (what follows ://, host lower-cased), host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    tail = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract("tail", "^[^/?#]*", 0), UPPER, UPPER.lower())
    out = pages.withColumn("tail", tail).withColumn("host", host).withColumn("path", F.regexp_extract("tail", "^[^/?#]*([^?#]*)", 1))
    return out.withColumn("rest", F.concat("host", F.substr("tail", F.length("host") + 1))).drop("tail")


def held(rest: Column) -> Column:
    """True on the URLs that set the threshold: three in sixteen."""
    return F.substr(F.md5(rest.cast("binary")), F.lit(1), F.lit(1)).isin("0", "1", "2")


def _first(rules, value) -> Column:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
    return F.coalesce(*(F.when(fits(r), F.lit(value(r))) for r in ordered))


def _sums(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n"))


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, llr) for each n-gram of grams(g, a, r, n): a, r are its counts among accepted and rejected URLs, n that among all."""
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = written(_sums(levels[k + 1], F.expr(f"right(g, {k})")), f"grams{k}")
    lower = None
    for k in range(1, order + 1):
        seen = levels[k].groupBy(F.expr(f"left(g, {k - 1})").alias("c")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        own = levels[k].withColumn("c", F.expr(f"left(g, {k - 1})")).join(seen, "c")
        if lower is None:
            own = own.withColumns({"qa": F.lit(1 / ALPHABET), "qr": F.lit(1 / ALPHABET)})
        else:
            own = own.withColumn("s", F.expr(f"right(g, {k - 1})")).join(lower.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "s")
        p = lambda x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"q{x}"))
        lower = written(own.select("g", p("a").alias("pa"), p("r").alias("pr")), f"model{k}")
    return lower.select("g", (F.log("pa") - F.log("pr")).alias("llr"))


def threshold(scores: DataFrame, lost: float = LOST) -> float | None:
    """The least score that over lost of the held-out accepted URLs don't exceed, at most zero; None if either class has no URL to learn from.

    Scores have DIGITS decimals, so the window runs over some ten thousand distinct ones, however many URLs there are.
    """
    kinds = scores.agg(F.count_if((F.col("ruled") == "block") & ~F.col("held")).alias("block"), F.count_if((F.col("ruled") == "allow") & F.col("held")).alias("allow")).first()
    if not kinds["block"] or not kinds["allow"]:
        return None
    counts = scores.where(F.col("held") & (F.col("ruled") == "allow")).groupBy("score").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("score")))
    return min(0.0, upto.where(F.col("upto") > lost * kinds["allow"]).agg(F.min("score")).first()[0])


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages."""
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rows = rows.withColumn("rule", _first(rules, lambda r: r[1] + r[2])).withColumn("ruled", _first(rules, lambda r: r[0]))
    urls = rows.where("rest <> ''").groupBy("rest", "ruled").agg(F.count("*").alias("rows"))
    padded = F.concat(F.lit("\x02" * (order - 1)), F.col("rest"), F.lit("\x03"))
    cut = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order}}}))"), F.lit(1))
    urls = written(urls.withColumn("held", held(F.col("rest"))).withColumn("grams", cut), "urls")
    learn = lambda v: F.when((F.col("ruled") == v) & ~F.col("held"), 1).otherwise(0)
    counted = urls.select(F.explode("grams").alias("g"), learn("allow").alias("a"), learn("block").alias("r"), F.lit(1).alias("n"))
    grams = written(_sums(counted, F.col("g")), "grams")
    found = log_ratios(grams, order)
    each = urls.select("rest", "ruled", "held", "rows", F.explode("grams").alias("g"))
    sizes = grams.agg(F.count("*").alias("grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    if sizes["grams"] <= BROADCAST_ROWS:
        each = each.join(F.broadcast(found), "g")
    else:
        each = keyed_join(each, written(found.join(grams.select("g", "n"), "g"), "ratios"), "g", sizes["total"])
    scores = each.groupBy("rest", "ruled", "held", "rows").agg(F.round(F.avg("llr"), DIGITS).alias("score"))
    scores = written(scores, "scores")
    cut = threshold(scores)
    known = keyed_join(rows.where("rest <> ''"), scores.select("rest", F.col("rows").alias("n"), "score"), "rest", scores.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    names = ["page_id", "host", "path", "rule", "ruled", "score"]
    out = known.select(names).unionByName(rows.where("rest = ''").withColumn("score", F.lit(None).cast("double")).select(names))
    model = F.when(F.col("score") < F.lit(cut), "block").otherwise("allow") if cut is not None else F.lit("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "score")


def _level(k: int) -> str:
    """SQL of the probabilities of k-grams, from those of (k - 1)-grams."""
    lower = f"JOIN m{k - 1} AS q ON q.g = right(x.g, {k - 1})" if k > 1 else ""
    one = lambda c: f"CASE WHEN n{c} > 0 THEN (x.{c} + t{c} * {'q.p' + c if k > 1 else 1 / ALPHABET}) / (n{c} + t{c}) ELSE {'q.p' + c if k > 1 else 1 / ALPHABET} END AS p{c}"
    seen = f"SELECT left(g, {k - 1}) AS c, sum(a) AS na, sum(r) AS nr, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE r > 0) AS tr FROM g{k} GROUP BY 1"
    return f"m{k} AS (SELECT x.g, {one('a')}, {one('r')} FROM g{k} AS x JOIN ({seen}) AS s ON s.c = left(x.g, {k - 1}) {lower})"


def _rule_sql(value) -> str:
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"


#: The same result for DuckDB.
ORACLE = f"""
WITH t AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (SELECT page_id, tail, translate(regexp_extract(tail, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
rows AS (SELECT page_id, host, path, host || substr(tail, length(host) + 1) AS rest, {_rule_sql(lambda r: r[1] + r[2])} AS rule, {_rule_sql(lambda r: r[0])} AS ruled FROM h),
urls AS (SELECT rest, any_value(ruled) AS ruled, substr(md5(rest), 1, 1) IN ('0', '1', '2') AS held FROM rows WHERE rest <> '' GROUP BY rest),
each AS (SELECT rest, ruled, held, substr(p, unnest(range(1, length(p) - {ORDER - 2})), {ORDER}) AS g FROM (SELECT *, repeat(chr(2), {ORDER - 1}) || rest || chr(3) AS p FROM urls)),
g{ORDER} AS (SELECT g, count(*) FILTER (WHERE ruled = 'allow' AND NOT held) AS a, count(*) FILTER (WHERE ruled = 'block' AND NOT held) AS r FROM each GROUP BY g),
{", ".join(f"g{k} AS (SELECT right(g, {k}) AS g, sum(a) AS a, sum(r) AS r FROM g{k + 1} GROUP BY 1)" for k in range(ORDER - 1, 0, -1))},
{", ".join(map(_level, range(1, ORDER + 1)))},
scores AS (SELECT rest, any_value(ruled) AS ruled, any_value(held) AS held, round(avg(ln(pa) - ln(pr)), {DIGITS}) AS score FROM each JOIN m{ORDER} USING (g) GROUP BY rest),
upto AS (SELECT score, count(*) OVER (ORDER BY score) AS upto, count(*) OVER () AS n FROM scores WHERE held AND ruled = 'allow'),
cut AS (SELECT CASE WHEN min(score) IS NOT NULL AND (SELECT count(*) FROM scores WHERE ruled = 'block' AND NOT held) > 0 THEN least(0, min(score)) END AS cut FROM upto WHERE upto > {LOST} * n)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score < cut THEN 'block' ELSE 'allow' END) AS verdict, score FROM (SELECT rows.*, score FROM rows LEFT JOIN scores USING (rest)), cut
"""


def reference_scores(urls: list[tuple[str, str | None, bool]], order: int = ORDER) -> dict[str, float]:
    """The scores of (rest, ruled, held) rows by plain recursion, for tests on a few URLs."""
    from math import log

    counts: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
    pad = lambda u: "\x02" * (order - 1) + u + "\x03"
    for u, ruled, held in urls:
        if ruled and not held:
            for i in range(len(u) + 1):
                for k in range(1, order + 1):
                    g = pad(u)[i + order - k : i + order]
                    counts[ruled][g] = counts[ruled].get(g, 0) + 1

    def p(c, g):
        if not g:
            return 1 / ALPHABET
        follow = [n for x, n in c.items() if len(x) == len(g) and x[:-1] == g[:-1]]
        return (c.get(g, 0) + len(follow) * p(c, g[1:])) / (sum(follow) + len(follow)) if follow else p(c, g[1:])

    ratio = lambda g: log(p(counts["allow"], g)) - log(p(counts["block"], g))
    return {u: reduce(lambda s, i: s + ratio(pad(u)[i : i + order]), range(len(u) + 1), 0.0) / (len(u) + 1) for u, _, _ in urls}
