"""Score arithmetic and ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SCORE_DECIMALS
from quarry.functions.text import _column

QUERY_KEYS = ("corpus_id", "query_id")


def rounded(score: Column | str, decimals: int = SCORE_DECIMALS) -> Column:
    return F.round(_column(score), decimals)


def max_normalised(score: Column | str, highest: Column | str) -> Column:
    """``score`` over the highest score; the divisor is 1 if nothing scored above zero."""
    highest = _column(highest)
    return _column(score) / F.when(highest > 0, highest).otherwise(F.lit(1.0))


def blend(semantic: Column | str, lexical: Column | str, weight: float) -> Column:
    return F.lit(1.0 - weight) * _column(semantic) + F.lit(weight) * _column(lexical)


def at_least(score: Column | str, minimum: float | None) -> Column:
    """Scores of ``minimum`` or more. NaN is the largest double in Spark, so it is ruled out."""
    score = _column(score)
    number = ~F.isnan(score)
    return number if minimum is None else number & (score >= F.lit(float(minimum)))


def top_k(
    hits: DataFrame, k: int, keys: Sequence[str] = QUERY_KEYS, shards: Column | None = None
) -> DataFrame:
    """The ``k`` best rows per key by score, then id, with a ``rank`` counted from 1.

    With ``shards``, a first pass keeps the best ``k`` per key and shard, so that the many
    partial lists of one busy query are merged by several tasks and not by one.
    """
    order = [F.desc("score"), F.asc("doc_id")]
    if shards is not None:
        window = Window.partitionBy(*keys, "_shard").orderBy(*order)
        hits = (
            hits.withColumn("_shard", shards)
            .withColumn("rank", F.row_number().over(window))
            .filter(F.col("rank") <= k)
            .drop("_shard", "rank")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def best_of_task(hits: DataFrame, k: int, keys: Sequence[str] = QUERY_KEYS) -> DataFrame:
    """The ``k`` best rows per key of each task, without a shuffle or a sort of all rows."""
    order = [*keys, "score", "doc_id"]
    ascending = [True] * len(keys) + [False, True]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch])
            ranked = rows.sort_values(order, ascending=ascending)
            kept = ranked.groupby(list(keys), sort=False, dropna=False).head(max(k, 0))
        if kept is not None:
            yield kept

    return hits.mapInPandas(run, hits.schema)


def last_entry_wins(hits: DataFrame, keys: Sequence[str] = QUERY_KEYS) -> DataFrame:
    """One row per key and document: of repeated entries, the lowest score, which came last."""
    window = Window.partitionBy(*keys, "doc_id").orderBy(F.asc("score"))
    return (
        hits.withColumn("_entry", F.row_number().over(window))
        .filter(F.col("_entry") == 1)
        .drop("_entry")
    )
