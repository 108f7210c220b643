"""Stored pages laid out by address: a bucketed, sorted table, so that joins on the address move no page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, unless told otherwise.
BUCKETS = 64


def write_pages(pages: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """pages(page_id, url, html) as a table of the session's catalog, dealt into buckets by address and sorted inside by address and number; at path, else in the warehouse.

    Pages move once, here, by an exchange of as many partitions as buckets; each bucket is one file. Choose buckets so that one holds some
    hundred MB: a bucket is the smallest part that a join reads. An existing table of that name is replaced.
    """
    dealt = pages.select("page_id", "url", "html").repartition(buckets, "url")
    writer = dealt.write.format("parquet").bucketBy(buckets, "url").sortBy("url", "page_id").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def stored_pages(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def add_pages(pages: DataFrame, table: str) -> None:
    """Further pages into the same buckets: a further file in each."""
    spec = pages.sparkSession.sql(f"DESCRIBE FORMATTED {table}").where(F.col("col_name") == "Num Buckets").first()
    buckets = int(spec["data_type"])
    dealt = pages.select("page_id", "url", "html").repartition(buckets, "url")
    dealt.write.format("parquet").bucketBy(buckets, "url").sortBy("url", "page_id").mode("append").saveAsTable(table)
