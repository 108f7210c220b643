"""Joins that no frequent key can stall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracota.sources.shared import written

#: Rows that a broadcast side may have: sides are keys, numbers and short texts, of at most some hundred bytes a row.
BROADCAST_ROWS = 200_000
#: A key of over 1 / HOT of all rows is hot; there are fewer than HOT of them.
HOT = 1000
#: Rows that a task of a large join has, about.
TASK_ROWS = 100_000


def bounded_broadcast(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit (BROADCAST_ROWS) rows; else with one for a shuffled join, as Spark takes a few columns of a table that
    compresses well for a small one, however many rows it has. rows: its count, if known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= (BROADCAST_ROWS if limit is None else limit) else df.hint("merge")


def dealt(df: DataFrame, rows: int, least: int | None = None, *keys: str) -> DataFrame:
    """df dealt by keys into a task for each TASK_ROWS of rows, and least tasks or more; where least is None it stays as it is laid out."""
    return df if least is None else df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def dealt_if_many(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys if it has many rows: a table of keys compresses so well that one split has millions of them, which an aggregate would hold at once."""
    return dealt(df, rows, 1 if rows > 10 * TASK_ROWS else None, *keys)


def keyed_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table(key, n, ...), a row a key; n: how many of the total rows have that key.

    Hot keys (fewer than HOT, by their share) meet a broadcast and the others a shuffle, so that no task gets all rows of a hot key.
    """
    hot = table.where(F.col("n") > total / HOT)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("n") <= total / HOT), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def salted_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", per_copy: int = 10_000, sizes: DataFrame | None = None, total: int = 0) -> DataFrame:
    """rows joined (inner or left) with table(key, ...), a row a key, whose rows may be wide; how many of rows have a key is in its column n, or in sizes(key, n).

    A row of table is copied for each per_copy of its rows, which are dealt to the copies by their hash; nothing wide is broadcast,
    and no task gets more than about per_copy rows of a key, unless these rows are equal. Without such keys it is a plain join. With sizes, table moves once.
    total: how many rows there are, if known; many of them are dealt into more tasks.
    """
    if sizes is None:
        sizes, table = table.select(key, "n"), table.drop("n")
    copies, salt = (_unused(c, rows, table) for c in ("copies", "salt"))
    several = written(sizes.where(F.col("n") > per_copy).select(key, F.ceil(F.col("n") / per_copy).cast("int").alias(copies)), "hot-keys")
    if not (n := several.count()):
        return dealt_if_many(rows, total, key).join(table.hint("merge") if total > BROADCAST_ROWS else table, key, how)
    several = bounded_broadcast(several, n)
    copy = F.pmod(F.xxhash64(*rows.columns), F.coalesce(copies, F.lit(1))).cast("int")
    ours = rows.join(several, key, "left").withColumn(salt, copy).drop(copies)
    theirs = table.join(several, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop(copies)
    if total > BROADCAST_ROWS:
        theirs = theirs.hint("merge")
    return dealt_if_many(ours, total, key, salt).join(theirs, [key, salt], how).drop(salt)


def _unused(name: str, *tables: DataFrame) -> str:
    while any(name.lower() == c.lower() for t in tables for c in t.columns):
        name += "_"
    return name
