"""Pages that arrive as files become listings as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terracota.operators.html import extract_listings
from terracota.schema import PAGES


def page_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(path)


def write_listings(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends raw listings of the pages to path, exactly once, until no page is left."""
    return extract_listings(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
