"""A corpus pipeline over ``documents``: quality, exact copies, near copies, benchmark passages, packing.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns a
DataFrame, which is written as Parquet and read again for the next one. All but the last return the columns of
``documents``. ``run`` applies them to ``documents`` and returns the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import saved
from quarry.llm.decontaminate import drop_contaminated
from quarry.llm.exact_copies import drop_exact_copies
from quarry.llm.near_copies import drop_near_copies
from quarry.llm.packing import encode_stream, packed_pieces
from quarry.llm.quality import drop_rejected
from quarry.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more."""
    ship_package(spark)
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    ship_package(spark)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of five-word shingles, the document with the smallest id."""
    ship_package(spark)
    return drop_near_copies(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; each document ends with id 1."""
    ship_package(spark)
    return packed_pieces(encode_stream(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1), length=2048)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

# The classifier cannot be said in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
