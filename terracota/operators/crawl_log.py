"""Summaries of request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crawl_summary(requests: DataFrame, by: list[str]) -> DataFrame:
    """Counts and durations; durations are of finished requests, null without any."""
    done = F.when(F.col("finished"), F.col("duration_ms"))
    return requests.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count_if("finished").alias("n_finished"), F.count_if(~F.col("finished")).alias("n_failed"), F.count_if(F.col("retry_count") > 0).alias("n_retried"),
        F.min(done).alias("min_ms"), F.max(done).alias("max_ms"), F.avg(done).alias("avg_ms"), F.sum(done).alias("sum_ms"),
    )


def status_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status").agg(F.count("*").alias("n"))


def retry_histogram(requests: DataFrame) -> DataFrame:
    return requests.groupBy("retry_count").agg(F.count("*").alias("n"))


def pending(requests: DataFrame, handled: DataFrame, key: str = "unique_key") -> DataFrame:
    """Keys of requests that aren't handled, once each."""
    return requests.select(key).distinct().join(handled.select(key).distinct(), key, "left_anti")
