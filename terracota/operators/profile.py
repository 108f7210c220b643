"""Table profiles and filters of the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracota.schema import RAW_COLUMNS


def preview(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """First n rows in a stated order."""
    return df.orderBy(by).limit(n)


def _by_column(df: DataFrame, name: str, measure) -> DataFrame:
    """One aggregate over all columns, then a row for each."""
    one = df.agg(*(measure(F.col(c)).cast("long").alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias(name)) for c in df.columns))).alias("r")).select("r.*")


def null_profile(df: DataFrame) -> DataFrame:
    return _by_column(df, "n_null", lambda c: F.count_if(c.isNull()))


def column_info(df: DataFrame) -> DataFrame:
    """(column_name, n_not_null, type)."""
    types = F.create_map(*(F.lit(x) for pair in df.dtypes for x in pair))
    return _by_column(df, "n_not_null", F.count).withColumn("type", types[F.col("column_name")])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def drop_sparse(df: DataFrame, thresh: int = 10, columns: list[str] | None = None) -> DataFrame:
    """Rows with at least thresh values among columns (the raw ones); empty lists and texts are values."""
    return df.na.drop(thresh=thresh, subset=columns or [c for c in RAW_COLUMNS if c in df.columns])


def missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def keys_missing(df: DataFrame, column: str, key: str = "url") -> DataFrame:
    return missing(df, column).select(key)


def keys_where(df: DataFrame, column: str, value, key: str = "url") -> DataFrame:
    return df.where(F.col(column) == F.lit(value)).select(key)


def with_struct(df: DataFrame, value) -> DataFrame:
    """df with the fields of a struct expression as columns: no join on a row index."""
    name = "parts"
    while name in df.columns:
        name += "_"
    return df.select("*", value.alias(name)).select(*(F.col(f"`{c}`") for c in df.columns), f"{name}.*")
