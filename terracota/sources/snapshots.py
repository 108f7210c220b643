"""Dated snapshots of raw listings: write, commit, read, find the newest, put together; and the list of search pages.

A snapshot is a folder snapshot_date=yyyy-MM-dd/version=... of JSON lines below one path, and a line in that path's commit log: a write that
fails leaves the day as it was, and an empty day is a day. Older snapshots are files *_yyyy-MM-dd.json of one JSON array each, which
functions read with arrays=True. What is no listing, a broken record or one without url, is never read as one: it is quarantined with its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terracota.operators.joins import TASK_ROWS, bounded_broadcast
from terracota.schema import PAGES, RAW
from terracota.sources.commits import commit, current, new_version
from terracota.sources.shared import written

#: The date in the name of a snapshot's folder, or of an older snapshot's file.
DATED = r"(?:/snapshot_date=|_)(\d{4}-\d{2}-\d{2})(?:/[^?]*|\.json)$"
BROKEN = "_broken"
#: Records of a compressed file, which one task reads.
FILE_ROWS = 500_000
PARSED = T.StructType([*(T.StructField(f.name, f.dataType) for f in RAW), T.StructField(BROKEN, T.StringType())])


def _lines(spark: SparkSession, path: str, date: str | None) -> DataFrame | None:
    """(file, block, id, text) of the committed days' lines; id counts the lines of a task without gaps. None without any."""
    days = current(spark, path)
    days = (days.where(F.col("key") == date) if date else days).select("key", "version").collect()  # a row a day
    if not days:
        return None
    text = spark.read.text([f"{path}/snapshot_date={d['key']}/version={d['version']}" for d in days])
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))


def _elements(spark: SparkSession, path: str, date: str | None) -> DataFrame:
    """(file, line, text) of older files' array elements; a file that is no array is one element."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=f"*_{date}.json" if date else "*.json").select(F.col("_metadata.file_path").alias("file"), F.ltrim("value").alias("text"))
    whole = whole.withColumn("items", F.when(F.col("text").startswith("["), F.from_json("text", "array<string>")))
    return whole.select("file", F.posexplode(F.coalesce("items", F.array("text"))).alias("line", "text")).withColumn("line", F.col("line").cast("long") + 1)


def _parsed(df: DataFrame) -> DataFrame:
    """df with r, the record in its text, and reason, why it is no listing (null: it is one)."""
    record = F.when(F.ltrim("text").startswith("{"), F.from_json("text", PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    reason = F.when(F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull(), "broken").when(F.col("r.url").isNull(), "no url")
    # inside a generator a record is parsed once, however many filters and columns above read it
    return df.select("*", F.explode(F.array(record)).alias("r")).withColumn("reason", reason)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("snapshot_date", F.regexp_extract("file", DATED, 1).try_cast("date"))


def _listings(df: DataFrame, *more: str) -> DataFrame:
    return _parsed(df).where("reason is null").select(*(F.col(f"r.{f.name}") for f in RAW), *more)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, block long, id long, text string")


def read_snapshots(spark: SparkSession, path: str, date: str | None = None, arrays: bool = False) -> DataFrame:
    """Raw listings with snapshot_date, of all snapshots below path or of one date: other dates' files aren't opened.

    The schema is given, so all-null columns keep their types. arrays: path has older files, of one JSON array each. Records that are no
    listings are left out; quarantined() has them.
    """
    found = _elements(spark, path, date) if arrays else _lines(spark, path, date)
    return _listings(_dated(_nothing(spark) if found is None else found), "snapshot_date")


def quarantined(spark: SparkSession, path: str, date: str | None = None, arrays: bool = False) -> DataFrame:
    """(snapshot_date, file, line, record, reason) of the records that are no listings: broken, or without url. line: from 1; of an array, the element."""
    if arrays:
        bad = _parsed(_elements(spark, path, date)).where("reason is not null")
    else:
        found = _lines(spark, path, date)
        lines = _nothing(spark) if found is None else found
        # a task numbers its lines without gaps: the first number of each block of a file, and the lines of the blocks before it, give the place
        bad = with_places(_parsed(lines).where("reason is not null and trim(text) <> ''"), lines, "file").withColumnRenamed("place", "line")
    return _dated(bad).select("snapshot_date", "file", "line", F.col("text").alias("record"), "reason")


def with_places(rows: DataFrame, lines: DataFrame, *within: str) -> DataFrame:
    """rows of lines(file, block, id, ...) with place, that of the line, from 1, in each file or, without within, in all files by name. Lines don't move: blocks, a row a split, meet them."""
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    window = Window.partitionBy(*within).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("before")), "blocks")
    found = rows.join(bounded_broadcast(blocks), ["file", "block"])
    return found.withColumn("place", F.col("before") + F.col("id") - F.col("first") + 1).drop("before", "first")


def read_again(records: DataFrame) -> DataFrame:
    """Raw listings with snapshot_date of those quarantined records that are listings by now, once their record was mended."""
    return _listings(records.withColumn("text", F.col("record")).drop("reason"), "snapshot_date")


def newest_date(spark: SparkSession, path: str) -> str:
    """Greatest date among the committed days, or else in the names of older files; only names are read."""
    found = current(spark, path).agg(F.max("key")).first()[0]
    if not found:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
        found = names.select(F.regexp_extract("path", DATED, 1).alias("d")).where("d <> ''").agg(F.max("d")).first()[0]
    if not found:
        raise ValueError(f"no dated snapshot in {path}")
    return found


def read_newest(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """The newest snapshot alone; no rows if that day was empty."""
    return read_snapshots(spark, path, newest_date(spark, path), arrays)


def newest(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Rows of the greatest date. The date is found first and becomes a literal, so partitions are pruned at planning."""
    return df.where(F.col(date_col) == F.lit(df.agg(F.max(date_col)).first()[0]))


def write_snapshot(df: DataFrame, path: str, date: str, order: list[str] | None = None, files: int | None = None, counts: dict[str, Column] | None = None, n_rows: int = 0, compression: str | None = None) -> dict[str, int]:
    """JSON lines of one day, null keys kept, text outside ASCII as it is; returns n_records and the counts, taken from the rows as they are written.

    A rerun replaces its own date alone, and only once it is whole: readers see the earlier rows until then, and after a failure. order: columns by
    which the files, read by name, have the records; rows are dealt into files by ranges of all these columns, so a page
    of very many records is no task of its own. counts: aggregates of df by name; the commit log keeps them. n_rows: how many rows there are, if
    known; many of them are dealt into more files than `files`. compression: of the lines (gzip); files then have FILE_ROWS records at most, as none of them can be split.
    """
    spark, version, seen = df.sparkSession, new_version(), Observation()
    if order:
        ranges = max(files or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
        df = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # observed above the last exchange: what lies below it also runs for the sample that ranges are taken from
    rows = df.observe(seen, F.count(F.lit(1)).alias("n_records"), *(c.alias(name) for name, c in (counts or {}).items()))
    out = as_listings(rows).write.option("ignoreNullFields", "false")
    if compression:
        out = out.option("compression", compression).option("maxRecordsPerFile", FILE_ROWS)
    out.json(f"{path}/snapshot_date={date}/version={version}")
    found = {name: int(seen.get.get(name) or 0) for name in ("n_records", *(counts or {}))}
    commit(spark, path, date, version, **found)
    return found


def days(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_date, n_records) of the committed days, from the log alone."""
    return current(spark, path).select(F.col("key").cast("date").alias("snapshot_date"), F.col("counts.n_records").alias("n_records"))


def appended(*snapshots: DataFrame) -> DataFrame:
    """All rows of snapshots, repeats kept; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), snapshots)


def run_date(at: Column | None = None) -> Column:
    """The date of a run as yyyy-MM-dd: of the time given, so that a run can be repeated, else today's."""
    return F.date_format(F.current_date() if at is None else at, "yyyy-MM-dd")


def as_listings(df: DataFrame) -> DataFrame:
    """Records in the raw schema: its columns in order, cast to their types, null where df lacks one. Other columns are left out."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW))


def listings_from_rows(spark: SparkSession, rows: list) -> DataFrame:
    """A few records given as rows or dictionaries, in the raw schema."""
    return spark.createDataFrame(rows, RAW)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def frontier(spark: SparkSession, template: str, total: int) -> DataFrame:
    """(page, url) for pages 1 to total; template names the page as {pagina}. No pages, no rows."""
    pages = spark.range(1, max(0, total) + 1).withColumnRenamed("id", "page")
    return pages.withColumn("url", _page_url(F.lit(template), F.col("page")))


def _page_url(template: Column, page: Column) -> Column:
    return F.replace(template, F.lit("{pagina}"), page.cast("string"))


def first_page(searches: DataFrame) -> DataFrame:
    """searches with url, the address of each one's first page."""
    return searches.withColumn("url", _page_url(F.col("template"), F.lit(1)))


def search_frontier(searches: DataFrame) -> DataFrame:
    """(search, page, url) for pages 1 to total of each of searches(search, template, total); a total of null, zero or below gives no pages."""
    some = searches.where("total > 0").withColumn("page", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))))
    return some.select("search", F.col("page").cast("long").alias("page"), _page_url(F.col("template"), F.col("page")).alias("url"))
