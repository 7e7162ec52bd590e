"""Precision of search results against gold labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small

SEARCH_TYPES = ("semantic", "hybrid")


def judged(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits with the label of their document, ``UNKNOWN`` where there is none, and ``relevant``."""
    return (
        hits.join(broadcast_if_small(labels), ["corpus_id", "doc_id"], "left")
        .withColumn("label", F.coalesce("label", F.lit("UNKNOWN")))
        .withColumn("relevant", F.col("label") == "YES")
    )


def precision_at_k(
    hits: DataFrame,
    labels: DataFrame,
    queries: DataFrame,
    cutoffs: Sequence[int],
    search_types: Sequence[str] = SEARCH_TYPES,
) -> DataFrame:
    """Relevant hits and precision for each query, search type and cutoff ``k``.

    ``hits`` say by ``k`` which search they belong to. The divisor is ``k``, however few hits there
    are; a query without hits has precision 0.
    """
    key = ["corpus_id", "query_id", "search_type", "k"]
    report = (
        queries.select("corpus_id", "query_id")
        .withColumn("search_type", F.explode(F.lit(list(search_types))))
        .withColumn("k", F.explode(F.lit([int(k) for k in cutoffs])))
    )
    found = (
        judged(hits, labels)
        .filter(F.col("rank") <= F.col("k"))
        .groupBy(*key)
        .agg(F.count_if("relevant").alias("relevant_in_top_k"))
    )
    relevant = F.coalesce("relevant_in_top_k", F.lit(0))
    return report.join(found, key, "left").select(
        *key,
        relevant.alias("relevant_in_top_k"),
        F.when(F.col("k") > 0, relevant / F.col("k")).otherwise(0.0).alias("precision_at_k"),
    )


def ranking_metrics(
    hits: DataFrame,
    labels: DataFrame,
    queries: DataFrame,
    cutoffs: Sequence[int],
    search_types: Sequence[str] = SEARCH_TYPES,
) -> DataFrame:
    """``recall``, ``reciprocal_rank``, ``average_precision`` and ``ndcg`` for each query, search type and cutoff ``k``.

    ``hits`` say by ``k`` which search they belong to. Recall divides by all relevant documents of the query's corpus, average
    precision and the ideal gain by those of them that fit into ``k``. Without any, all four are 0.
    """
    key = ["corpus_id", "query_id", "search_type", "k"]
    report = (
        queries.select("corpus_id", "query_id")
        .withColumn("search_type", F.explode(F.lit(list(search_types))))
        .withColumn("k", F.explode(F.lit([int(k) for k in cutoffs])))
    )
    relevant = labels.filter(F.col("label") == "YES").groupBy("corpus_id").agg(F.count("*").alias("n_relevant"))
    # A window holds at most k hits.
    up_to_here = Window.partitionBy(*key).orderBy("rank")
    places = (
        judged(hits, labels)
        .filter(F.col("rank") <= F.col("k"))
        .withColumn("found", F.sum(F.col("relevant").cast("int")).over(up_to_here))
        .filter("relevant")
    )
    found = places.groupBy(*key).agg(
        F.count("*").alias("n_found"),
        F.min("rank").alias("first"),
        F.sum(F.col("found") / F.col("rank")).alias("precisions"),
        F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"),
    )
    fits = F.least("n_relevant", F.col("k").cast("long"))
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("long"), fits), F.lit(0.0), lambda sum_, rank: sum_ + 1 / F.log2(rank + 1)
    )

    def or_zero(value):
        return F.when(F.col("n_found") > 0, value).otherwise(F.lit(0.0))

    return report.join(found, key, "left").join(broadcast_if_small(relevant), "corpus_id", "left").select(
        *key,
        or_zero(F.col("n_found") / F.col("n_relevant")).alias("recall"),
        or_zero(1 / F.col("first")).alias("reciprocal_rank"),
        or_zero(F.col("precisions") / fits).alias("average_precision"),
        or_zero(F.col("gain") / ideal).alias("ndcg"),
    )


def compare(precision: DataFrame) -> DataFrame:
    """Semantic and hybrid precision side by side, and what the blend adds."""
    wide = (
        precision.groupBy("corpus_id", "query_id", "k")
        .pivot("search_type", list(SEARCH_TYPES))
        .agg(F.max("precision_at_k"))
    )
    return wide.select(
        "corpus_id",
        "query_id",
        "k",
        F.col("semantic").alias("semantic_precision"),
        F.col("hybrid").alias("hybrid_precision"),
        (F.col("hybrid") - F.col("semantic")).alias("improvement"),
    )
