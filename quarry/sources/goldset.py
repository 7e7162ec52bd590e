"""Gold sets: wide tables with an id and one judgement column per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def judgements(gold: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(corpus_id, doc_id, label)`` of the judged rows; a corpus per query column."""
    available = [c for c in gold.columns if c != "doc_id"]
    names = available if names is None else list(names)
    unknown = [name for name in names if name not in available]
    if unknown:
        raise ValueError(f"gold set has no column {unknown}; it has {available}")
    long = gold.unpivot(
        "doc_id", [F.col(_quoted(name)).alias(name) for name in names], "corpus_id", "label"
    )
    return long.filter(F.col("label").isNotNull()).select("corpus_id", "doc_id", "label")


def judged_reviews(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Judgements with the review they are about; ids unknown to the reviews drop out."""
    return broadcast_if_small(labels).join(reviews, "doc_id").select(
        "corpus_id", "doc_id", "summary", "text", "label"
    )


def judgement_counts(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows, YES and NO per query, of the judged ids that have a review; any other label is in the total only."""
    known = labels.join(reviews.select("doc_id"), "doc_id", "left_semi")
    return known.groupBy("corpus_id").agg(
        F.count("*").alias("total_docs"),
        F.count_if(F.col("label") == "YES").alias("relevant_docs"),
        F.count_if(F.col("label") == "NO").alias("irrelevant_docs"),
    )


def label_map(labels: DataFrame) -> DataFrame:
    """One label per query and document. Where a gold set repeats an id, exactly ``YES`` wins, then exactly ``NO``, then the
    last of the others in alphabetical order.
    """
    standing = F.when(F.col("label") == "YES", 2).when(F.col("label") == "NO", 1).otherwise(0)
    return labels.groupBy("corpus_id", "doc_id").agg(F.max_by("label", F.struct(standing, "label")).alias("label"))
