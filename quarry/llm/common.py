"""Helpers that the operators of this package share."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import fresh_path


def text_of(name: str = "text") -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, unlike ``lower``."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


# Rows of a few numbers or digests that a task writes at least.
ROWS_PER_FILE = 100_000


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Work that is used more than once is done once this way, and a lost executor costs at most its
    own tasks, since the files do not go with it. A narrow table known to have at most so many ``rows`` is written by no
    more tasks than they fill, though by one for each core: a file of a few rows costs more than they do.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_FILE)))
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a few numbers, or one word, up to which a side may be broadcast: some tens of megabytes at most.
BROADCAST_ROWS = 200_000


def small(saved_table: DataFrame) -> DataFrame:
    """A saved table with a broadcast hint if it has few enough rows, else as it is, for a shuffle join."""
    return F.broadcast(saved_table) if saved_table.count() <= BROADCAST_ROWS else saved_table
