"""The collection job: search pages to raw listings, raw listings to typed ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracota.functions import clean
from terracota.functions.address import split_address
from terracota.operators.html import LAST_PAGE, RESULT_LINKS, Rule, extract_listings, select_all, spread, total_pages
from terracota.operators.joins import bounded_broadcast, dealt, dealt_if_many, salted_join
from terracota.operators.links import absolute, exploded
from terracota.operators.profile import drop_sparse, with_struct
from terracota.schema import RAW_COLUMNS
from terracota.sources.shared import written
from terracota.sources.snapshots import first_page, search_frontier, write_snapshot

SEARCHES = "search string, template string, total int"
#: Addresses that a broadcast may have: a table of these takes the driver some hundred times their length until it is sent.
ADDRESSES = 20_000
#: Beginnings of addresses that pages are sifted by.
BEGINNINGS = 100


def searches(spark: SparkSession, *rows: tuple) -> DataFrame:
    """(search, template, total) of (name, template) or (name, template, total); template names the page as {pagina}. Without a total, it is looked for."""
    return spark.createDataFrame([(*r, None)[:3] for r in rows], SEARCHES)


def result_links(pages: DataFrame, keep: list[str], rule: Rule = RESULT_LINKS, parts: int | None = None) -> DataFrame:
    """keep and links, the absolute advert links of each result page in order; repeats stay. rule: CARD_LINKS for pages of the card form."""
    found = select_all(pages, {"links": rule}, list(dict.fromkeys([*keep, "url"])), parts=parts)
    return found.select(*keep, F.transform("links", lambda x: absolute(x, F.col("url"))).alias("links"))


def count_pages(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """(url, total): how many result pages a search page announces."""
    return select_all(pages, {"buttons": LAST_PAGE}, ["url"], parts=parts).select("url", total_pages(F.col("buttons")).alias("total"))


def with_totals(pages: DataFrame, of: DataFrame) -> DataFrame:
    """The searches `of` with total as given, else as the stored first page of the search announces it; null where that page isn't stored.

    Part of the job's own plan: first pages are picked and read by executors, and no total passes through the driver.
    """
    open_ = first_page(of.where("total is null"))
    if open_.isEmpty():  # no page need be looked at
        return of.where("total is not null")
    found = count_pages(one_page_each(result_pages(pages, of), open_.select("url").distinct()))
    return of.where("total is not null").unionByName(open_.drop("total").join(found, "url", "left").select("search", "template", "total"))


def result_pages(pages: DataFrame, of: DataFrame) -> DataFrame:
    """pages without those that no search of `of` can have as a result page, as their address begins as no template does; all pages, if templates begin in many ways.

    So adverts take no part in the joins that look for result pages.
    """
    begins = [r[0] for r in of.select(F.substring_index("template", "{pagina}", 1)).where("template is not null").distinct().limit(BEGINNINGS + 1).collect()]
    return pages if len(begins) > BEGINNINGS else pages.where(reduce(lambda a, b: a | b, (F.col("url").startswith(F.lit(b)) for b in begins), F.lit(False)))


def one_page_each(pages: DataFrame, urls: DataFrame, parts: int | None = None, stored_only: bool = False) -> DataFrame:
    """(url, html) of the stored pages of urls(url), each address once. Of several pages with one address that with the least page_id counts (without
    page_id, the least hash of the page), and of those that share this too, the one with the least hash.

    Only keys meet; hashes are taken of pages with shared numbers alone. parts: the pages are dealt into so many tasks, by address into more of them if there are many.
    stored_only: html is empty where there is a page, and pages don't move.
    """
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(2**63 - 1)) if "page_id" in pages.columns else F.xxhash64("html")
    html = F.when(F.col("html").isNotNull(), "") if stored_only else F.col("html")
    pages = pages.select("url", page_id.alias("page_id"), F.xxhash64("html").alias("hash"), html.alias("html"))
    urls = written(urls.select("url"), "urls")
    n_urls = urls.count()
    keys = pages.select("url", "page_id")
    if n_urls > ADDRESSES and parts:  # no semi-join, which Spark would move below the dealing, into a few tasks that sort all keys
        keys = dealt(keys, n_urls, parts, "url").join(dealt(urls, n_urls, parts, "url").distinct().hint("merge"), "url")
    else:
        keys = keys.join(bounded_broadcast(urls, n_urls, ADDRESSES), "url", "left_semi")
    # the least number of an address, and whether it might have several pages
    wanted = written(keys.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")), "wanted")
    n = {r["several"]: r["n"] for r in wanted.groupBy((F.col("n") > 1).alias("several")).agg(F.count("*").alias("n")).collect()}
    one = _at_most(pages, wanted.where("n = 1").select("url", F.col("page_id").alias("least")), "page_id", n.get(False, 0), parts).select("url", "html")
    if n.get(False, 0) <= ADDRESSES and not stored_only:
        one = spread(one, parts)
    if not n.get(True):
        return one
    many = _at_most(pages, wanted.where("n > 1").select("url", F.col("page_id").alias("least")), "page_id", n[True], parts).select("url", "hash", "html")
    least = written(many.groupBy("url").agg(F.min("hash").alias("least")), "least")
    return one.unionByName(_at_most(many, least, "hash", n[True]).select("url", "html").dropDuplicates(["url"]))


def _at_most(rows: DataFrame, least: DataFrame, column: str, n: int, parts: int | None = None) -> DataFrame:
    """rows whose column isn't above that of their address in least(url, least), of n rows. The address is the only key, so rows that are laid out by it stay where they are."""
    if n > ADDRESSES and parts:  # tasks hold their addresses, and pages pass by
        rows, least = dealt(rows, n, parts, "url"), least.hint("shuffle_hash")
    else:
        least = bounded_broadcast(least, n, ADDRESSES)
    return rows.alias("r").join(least.alias("l"), F.expr(f"r.url = l.url AND r.{column} <= l.least"), "left_semi")


def found_links(pages: DataFrame, frontier: DataFrame, parts: int | None = None) -> DataFrame:
    """(search, page, pos, link) of the stored result pages of frontier(search, page, url), in one pass over these pages."""
    frontier = written(frontier, "frontier")
    results = one_page_each(pages, frontier.select("url").distinct(), parts)
    each = select_all(results, {"links": RESULT_LINKS}, ["url"])
    each = each.select("url", F.transform("links", lambda x: absolute(x, F.col("url"))).alias("links"))
    return exploded(each.join(bounded_broadcast(frontier, limit=ADDRESSES), "url"), "links", ["search", "page"])


def adverts_of(pages: DataFrame, urls: DataFrame, fields: list[str] | None = None, parts: int | None = None, failures: bool = False) -> DataFrame:
    """Raw listings of the stored pages of urls(url), each address parsed once."""
    return extract_listings(one_page_each(pages, urls, parts, fields is not None and not fields), fields, failures=failures)


def counted_links(links: DataFrame, total: int) -> DataFrame:
    """(url, n): how many of the total links lead to each address."""
    return dealt_if_many(links.select(F.col("link").alias("url")), total, "url").groupBy("url").agg(F.count("*").alias("n"))


def with_links(links: DataFrame, adverts: DataFrame, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Raw listings with search, page and pos: a row for each of links(search, page, pos, link), with its advert. A link without a stored page has its url alone.
    counts, total: counted_links and the number of links, if known."""
    total = links.count() if total is None else total
    out = salted_join(links.withColumnRenamed("link", "url"), adverts, "url", "left", sizes=counted_links(links, total) if counts is None else counts, total=total)
    empty = F.array().cast("array<string>")
    return out.withColumns({"extract_status": F.coalesce("extract_status", F.lit("no_page")), "caracteristicas": F.coalesce("caracteristicas", empty), "fotos": F.coalesce("fotos", empty)})


def collect_listings(pages: DataFrame, of: DataFrame, fields: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Raw listings with search, page and pos: result pages of the searches `of`, their links, and the stored page behind each link.

    of: searches(search, template, total), whose missing totals are looked for. A link without a stored page gives a row with its url alone.
    Adverts are parsed once each, however many links lead to them. fields: the advert fields to read; with [] none is,
    and no advert is parsed, which is all that counts need. Only keys meet; a link that very many pages have meets copies of its advert.
    """
    return _collected(pages, of, fields, parts)[0]


def _collected(pages: DataFrame, of: DataFrame, fields: list[str] | None, parts: int | None) -> tuple[DataFrame, int]:
    """The listings, and how many they are."""
    results = result_pages(pages, of)
    found = written(found_links(results, search_frontier(with_totals(results, of)), parts), "links")
    total = found.count()
    counts = written(counted_links(found, total), "counted-links")
    adverts = adverts_of(pages, counts.select("url"), fields, parts)
    return with_links(found, written(adverts, "adverts"), counts, total), total


def write_collection(pages: DataFrame, of: DataFrame, path: str, date: str, parts: int | None = None, files: int | None = None) -> dict[str, int]:
    """The whole run: collects the searches and publishes the day, records in page and link order; returns its counts, taken while it is written.
    files: how many the day has, or more if it is large.

    Counts: n_records, n_ok, n_no_page, n_failed, n_pages (result pages with links) and n_valid (records with ten values or more).
    """
    status = lambda s: F.count_if(F.col("extract_status") == s)
    rows, total = _collected(pages, of, None, parts)
    values = sum((F.col(c).isNotNull().cast("int") for c in RAW_COLUMNS), F.lit(0))
    counts = {"n_ok": status("ok"), "n_no_page": status("no_page"), "n_failed": status("failed"), "n_pages": F.count_if(F.col("pos") == 0), "n_valid": F.count_if(values >= 10)}
    return write_snapshot(rows, path, date, ["search", "page", "pos"], files, counts, total)


def listings_of(pages: DataFrame, urls: DataFrame, url_col: str = "url", fields: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Raw listings of the given addresses."""
    urls = written(urls.select(F.col(url_col).alias("url")).distinct(), "urls")
    n = urls.count()
    if n <= ADDRESSES or not parts:
        return extract_listings(pages.join(bounded_broadcast(urls, n, ADDRESSES), "url", "left_semi"), fields, parts=parts)
    # tasks hold their addresses, and pages pass by, once and unsorted
    return extract_listings(dealt(pages, n, parts, "url").join(urls.hint("shuffle_hash"), "url", "left_semi"), fields)


def total_records(listings: DataFrame) -> DataFrame:
    """(n_records): how many records a collection has."""
    return listings.agg(F.count("*").alias("n_records"))


def records_per_page(listings: DataFrame) -> DataFrame:
    return listings.groupBy("page").agg(F.count("*").alias("n_records"))


def as_json(df: DataFrame, columns: list[str] | None = None):
    """Rows as JSON text with null keys kept."""
    return F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})


def typed(listings: DataFrame) -> DataFrame:
    """Typed columns beside the address parts."""
    out = with_struct(listings, split_address("endereco"))
    return out.withColumns({
        "area_m2": clean.area("metragem"), "banheiros": clean.count("banheiros"), "vagas": clean.count("vagas"), "quartos": clean.count("quartos"), "preco": clean.money("valor_venda"),
        "condominio_valor": clean.condo_fee("condominio"), "condominio_status": clean.fee_status("condominio"), "iptu_valor": clean.property_tax("iptu"), "iptu_status": clean.fee_status("iptu"),
        "publicado": clean.publish_date("data_criacao"), "n_fotos": clean.photo_count("fotos"),
    })


def clean_listings(listings: DataFrame, thresh: int = 10) -> DataFrame:
    """Rows with enough values, typed."""
    return typed(drop_sparse(listings, thresh))
