"""What the text operators share: tables in the shared folder, joins and broadcasts of checked size, objects for tasks, Arrow batches of texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracota.operators.joins import BROADCAST_ROWS, bounded_broadcast, keyed_join  # noqa: F401  the operators take them from here
from terracota.sources.shared import written  # noqa: F401

#: Rows of text sent to a Python worker at once, and characters that one call of an operator's function handles.
BATCH_ROWS = 256
BATCH_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores where df has a column called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """Text that tells rows apart by id and whole text (128 bits of it); equal rows share one, nulls have their own."""
    return F.concat(F.when(F.col(id_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(id_col).cast("string"))), F.lit(":"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("-")))


def shared(spark: SparkSession, value) -> Callable:
    """Function that gives value inside tasks. It is broadcast as pickled bytes with its class's code, so executors need no copy of this package;
    a worker unpickles it once and keeps it from task to task. Spark frees the broadcast when the column that uses it is no longer referred to."""
    box = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    def get():
        held = box.value
        if isinstance(held[0], bytes):
            held[0] = pickle.loads(held[0])
        return held[0]

    return get


def text_batches(spark: SparkSession) -> None:
    """Rows of text are large: send few of them to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def by_text(spark: SparkSession, make: Callable[[], Callable[[list[str | None]], dict]], schema: str) -> Callable[[Column], Column]:
    """A column function: text -> struct. make() runs once a task and gives the function from a list of texts to a dict of columns."""
    text_batches(spark)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for batch in batches:
            texts, out, part, chars = [t if isinstance(t, str) else None for t in batch], [], [], 0
            for t in texts:
                part.append(t)
                chars += len(t or "")
                if chars > BATCH_CHARS:
                    out.append(pd.DataFrame(work(part)))
                    part, chars = [], 0
            if part or not out:
                out.append(pd.DataFrame(work(part)))
            yield pd.concat(out, ignore_index=True)

    return run


def held_out(doc_id: Column) -> Column:
    """True on the rows that no model may learn from: crc32 of the id as text is divisible by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
