"""Hybrid search: semantic candidates re-ranked by a blend with BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import SearchSettings
from quarry.functions.scores import blend, max_normalised, rounded, top_k
from quarry.operators.lexical import Lexicon, document_scores
from quarry.operators.semantic import nearest
from quarry.session import broadcast_if_small, materialise

PAIR = ["corpus_id", "query_id", "doc_id"]


def hybrid_candidates(
    index: DataFrame, lex: Lexicon, queries: DataFrame, k: int
) -> DataFrame:
    """The ``k`` best semantic hits of each query with ``semantic``, ``place`` (their rank), ``bm25``
    and ``best``, the highest BM25 score of the query over its whole corpus.

    BM25 is summed over the corpus once. That pass keeps the score of a candidate by its id and lets
    all other documents of a query share one NULL group, of which only the maximum survives.
    """
    candidates = materialise(
        nearest(index, queries, k).select(
            *PAIR, F.col("score").alias("semantic"), F.col("rank").alias("place")
        ),
        "candidates",
    )
    marked = broadcast_if_small(candidates.select(*PAIR, F.lit(True).alias("candidate")))
    summed = (
        document_scores(lex, queries)
        .join(marked, PAIR, "left")
        .withColumn("doc_id", F.when(F.col("candidate"), F.col("doc_id")))
        .drop("candidate")
    )
    # Summed up map-side, a query has at most one row more per task than it has candidates.
    merged = (
        candidates.unionByName(summed, allowMissingColumns=True)
        .groupBy(*PAIR)
        .agg(*[F.max(name).alias(name) for name in ("semantic", "place", "bm25")])
    )
    hit = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "semantic", "place", "bm25"))
    found = merged.groupBy("corpus_id", "query_id").agg(
        F.max("bm25").alias("best"), F.collect_list(hit).alias("hits")
    )
    return found.select("corpus_id", "query_id", "best", F.inline("hits")).withColumn(
        "bm25", F.coalesce("bm25", F.lit(0.0))
    )


def semantic_hits(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates as they were found."""
    return found.filter(F.col("place") <= k).select(
        *PAIR, F.col("semantic").alias("score"), F.col("place").alias("rank")
    )


def hybrid_hits(found: DataFrame, settings: SearchSettings) -> DataFrame:
    """The first candidates, as many as the settings ask for, ranked by the blended score."""
    considered = found.filter(F.col("place") <= settings.top_k * settings.oversample)
    lexical = max_normalised("bm25", "best")
    scored = considered.select(
        *PAIR, rounded(blend("semantic", lexical, settings.bm25_weight)).alias("score")
    )
    return top_k(scored, settings.top_k)


def hybrid(
    index: DataFrame, lex: Lexicon, queries: DataFrame, settings: SearchSettings
) -> DataFrame:
    """``(corpus_id, query_id, doc_id, score, rank)`` by the blended score.

    A document outside the semantic candidates is never found, however good its BM25 score.
    """
    depth = settings.top_k * settings.oversample
    return hybrid_hits(hybrid_candidates(index, lex, queries, depth), settings)
