"""The table of reviews: ``doc_id``, ``summary``, ``text``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import BuildSettings, jdbc_options
from quarry.functions.text import combined_text, not_blank

REVIEWS_SCHEMA = T.StructType(
    [
        T.StructField("Id", T.LongType(), False),
        T.StructField("Summary", T.StringType(), True),
        T.StructField("Text", T.StringType(), True),
    ]
)


def _renamed(reviews: DataFrame) -> DataFrame:
    return reviews.select(
        F.col("Id").cast("long").alias("doc_id"),
        F.col("Summary").alias("summary"),
        F.col("Text").alias("text"),
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _renamed(spark.read.schema(REVIEWS_SCHEMA).parquet(path))


def jdbc_scan_options(
    table: str,
    lowest: int,
    highest: int,
    partitions: int,
    env: Mapping[str, str] | None = None,
    settings: BuildSettings = BuildSettings(),
) -> dict[str, str]:
    """Options of a range-partitioned scan: each task reads one stretch of ids, no paging."""
    return jdbc_options(env) | {
        "dbtable": table,
        "partitionColumn": '"Id"',
        "lowerBound": str(lowest),
        "upperBound": str(highest),
        "numPartitions": str(partitions),
        "fetchsize": str(settings.fetch_rows),
    }


def read_reviews_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return _renamed(spark.read.format("jdbc").options(**options).load())


def documents(
    reviews: DataFrame,
    sep: str = "\n\n",
    mode: str = "clean",
    keep_blank: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id`` and ``combined_text`` of each review that has any text, and the columns to ``keep``."""
    if not keep_blank and mode == "clean":
        # On the parts, so that the filter moves down to the scan without the concatenation.
        reviews = reviews.filter(not_blank("summary") | not_blank("text"))
    docs = reviews.select("doc_id", combined_text("summary", "text", sep, mode).alias("combined_text"), *keep)
    if not keep_blank and mode == "compat":
        docs = docs.filter(F.col("combined_text") != "")
    return docs


def document_by_id(reviews: DataFrame, doc_id: int) -> DataFrame:
    """The review with this id, or no row; the filter reaches the scan."""
    return reviews.filter(F.col("doc_id") == doc_id)


def documents_by_id(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    return reviews.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def page(docs: DataFrame, size: int, after: int | None = None) -> DataFrame:
    """The next rows in id order behind the id ``after``; however far in, a page costs its own rows."""
    rest = docs if after is None else docs.filter(F.col("doc_id") > after)
    return rest.orderBy("doc_id").limit(size)


def sample_one(docs: DataFrame) -> DataFrame:
    return docs.orderBy("doc_id").limit(1)
