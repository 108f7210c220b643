"""Commit log of a folder: what a job has written counts once, and only if, a line of the log says so.

A job writes into a folder of its own, which nobody reads yet, and then adds one line to path/commits. A job that fails adds none, so what was
there before stays what readers see; lines that come later replace earlier ones of the same key. Each line is a file of its own that
appears whole, by a rename.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "key string, version string, counts map<string,bigint>"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def new_version() -> str:
    """A name for what one job writes; later ones come later in order."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def commit(spark: SparkSession, path: str, key: str, version: str, **counts: int) -> None:
    line = spark.range(0, 1, 1, 1).select(F.lit(json.dumps({"key": key, "version": version, "counts": counts})).alias("value"))
    line.write.mode("append").text(f"{path}/commits")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the log; none where there is no log."""
    return spark.read.schema(COMMITS).json(f"{path}/commits") if exists(spark, f"{path}/commits") else spark.createDataFrame([], COMMITS)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each key."""
    return commits(spark, path).groupBy("key").agg(F.max_by(F.struct("version", "counts"), "version").alias("c")).select("key", "c.*")


def drop_superseded(spark: SparkSession, path: str, folder: str = "snapshot_date={key}/version={version}") -> int:
    """Deletes the folders of lines that later ones replaced; how many. Only for times when nobody reads them."""
    log = commits(spark, path)
    old = log.join(current(spark, path).select("key", "version"), ["key", "version"], "left_anti").select("key", "version").collect()  # a row a rerun
    for r in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder.format(key=r['key'], version=r['version'])}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(old)
