"""Links of flat markup by regular expression: no Python, the scan and the links are one stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A card's first link; the part in brackets is the address.
CARD_LINK = r'<li><a href="([^"]*)"'


def links(html: Column, pattern: str = CARD_LINK) -> Column:
    return F.coalesce(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def absolute(link: Column, url: Column) -> Column:
    """A link without http begins at its page's site."""
    site = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.when(link.startswith("http"), link).otherwise(F.concat(site, link))


def exploded(pages: DataFrame, links_col: str, keep: list[str]) -> DataFrame:
    """keep, pos, link: a row for each link in page order; pages without any give none."""
    return pages.select(*keep, F.posexplode(links_col).alias("pos", "link"))
