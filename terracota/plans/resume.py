"""A collection that goes on where it stopped: what earlier runs have read is kept between them, and a run reads new pages only.

A folder holds links/version=... (search, page, pos, link, and a row without pos for each result page that was read) and
adverts/version=... (raw listings, one an address), and a commit log with a line for each run that ended. Runs that failed have no line, and
what they wrote isn't read. Result pages and adverts whose page isn't stored yet stay open, for a later run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terracota.operators.crawl_log import pending
from terracota.operators.html import RESULT_LINKS, select_all
from terracota.operators.joins import bounded_broadcast, dealt_if_many
from terracota.operators.links import absolute
from terracota.plans.collect import ADDRESSES, adverts_of, one_page_each, result_pages, with_links, with_totals
from terracota.schema import RAW
from terracota.sources.commits import commit, commits, new_version
from terracota.sources.shared import written
from terracota.sources.snapshots import search_frontier

LINKS = "search string, page long, pos int, link string"
ADVERTS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW) + ", extract_status string"


def _kept(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    runs = [f"{path}/{part}/version={r['version']}" for r in commits(spark, path).select("version").collect()]  # a row a run
    return spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)


def collect_more(pages: DataFrame, of: DataFrame, path: str, parts: int | None = None) -> dict[str, int]:
    """Reads the result pages and adverts of the searches `of` that no earlier run has read, and keeps them below path; returns how many it read.

    pages: all that is stored by now; only those still open are parsed. Counts: n_result_pages, n_adverts, n_links.
    """
    spark, version = pages.sparkSession, new_version()
    links, adverts = _kept(spark, path, "links", LINKS), _kept(spark, path, "adverts", ADVERTS)
    key = F.concat_ws("\n", F.col("page").cast("string"), "search")
    first = result_pages(pages, of)
    frontier = search_frontier(with_totals(first, of)).withColumn("key", key)
    open_ = frontier.join(bounded_broadcast(written(pending(frontier, links.where("pos is null").withColumn("key", key), "key"), "open"), limit=ADDRESSES), "key", "left_semi").drop("key")
    open_ = written(open_, "open-pages")
    seen = Observation()
    results = select_all(one_page_each(first, open_.select("url").distinct(), parts), {"links": RESULT_LINKS}, ["url"])
    results = results.select("url", F.transform("links", lambda x: absolute(x, F.col("url"))).alias("links")).join(bounded_broadcast(open_, limit=ADDRESSES), "url")
    # a row without pos says that the page was read
    rows = results.select("search", "page", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "links")).alias("pos", "link"))
    rows = rows.select("search", "page", F.when(F.col("pos") > 0, F.col("pos") - 1).alias("pos"), "link")
    rows = rows.observe(seen, F.count_if(F.col("pos").isNull()).alias("n_result_pages"), F.count("pos").alias("n_links"))
    rows.write.parquet(f"{path}/links/version={version}")

    new = spark.read.schema(LINKS).parquet(f"{path}/links/version={version}")
    wanted = links.unionByName(new).where("pos is not null").select(F.col("link").alias("url"))
    wanted = dealt_if_many(wanted, wanted.count(), "url")
    wanted = written(pending(wanted, adverts, "url"), "wanted-adverts")
    counted = Observation()
    found = adverts_of(pages, wanted, parts=parts).where("extract_status <> 'no_page'").observe(counted, F.count(F.lit(1)).alias("n_adverts"))
    found.write.parquet(f"{path}/adverts/version={version}")
    counts = {"n_result_pages": int(seen.get.get("n_result_pages", 0)), "n_links": int(seen.get.get("n_links", 0)), "n_adverts": int(counted.get.get("n_adverts", 0))}
    commit(spark, path, version, version, **counts)
    return counts


def collected(spark: SparkSession, path: str) -> DataFrame:
    """Raw listings with search, page and pos of all runs that ended: the same rows as one run over all pages gives."""
    links = _kept(spark, path, "links", LINKS).where("pos is not null")
    return with_links(links, _kept(spark, path, "adverts", ADVERTS))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, n_result_pages, n_links, n_adverts) of the runs that ended."""
    return commits(spark, path).select(F.col("version").alias("run"), *(F.col(f"counts.{c}").alias(c) for c in ("n_result_pages", "n_links", "n_adverts")))
