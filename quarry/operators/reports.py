"""Health checks, index reports and result lists with their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import norm
from quarry.session import broadcast_if_small, materialise
from quarry.sources.store import StoredIndex, index_counts, with_corpus


def with_documents(hits: DataFrame, reviews: DataFrame) -> DataFrame:
    """Hits with summary and text. The reviews are scanned once and only those hit are kept; they
    are never shuffled while the hits are few.
    """
    hits = materialise(hits, "hits")
    ids = broadcast_if_small(hits.select("doc_id").distinct())
    found = reviews.select("doc_id", "summary", "text").join(ids, "doc_id", "left_semi")
    return hits.join(found, "doc_id", "left")


def hits_per_query(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``total_results`` of every query of every corpus, 0 if nothing was found."""
    key = ["corpus_id", "query_id"]
    counts = hits.groupBy(*key).agg(F.count("*").alias("total_results"))
    return with_corpus(queries).select(*key).join(counts, key, "left").select(
        *key, F.coalesce("total_results", F.lit(0)).alias("total_results")
    )


def nested_results(hits: DataFrame) -> DataFrame:
    """One row per query with its hits in rank order; at most ``k`` hits per query."""
    hit = F.struct("rank", "doc_id", "score", "summary", "text")
    return hits.groupBy("corpus_id", "query_id").agg(
        F.count("*").alias("total_results"), F.sort_array(F.collect_list(hit)).alias("results")
    )


def index_report(index: StoredIndex) -> DataFrame:
    """One row about the index: size, kind, model, dimension and BM25, from its commits."""
    s = index.settings
    row = (s.n_docs, "exact inner product", s.model, s.dimension, s.n_texts == s.n_docs, s.use_bm25)
    return index.documents.sparkSession.createDataFrame(
        [row],
        "total_documents long, index_type string, embedding_model string, embedding_dimension int,"
        " bm25_available boolean, bm25_enabled boolean",
    )


def norm_report(docs: DataFrame) -> DataFrame:
    lengths = docs.select(norm("embedding").alias("n"))
    return lengths.agg(
        F.count("n").alias("n_vectors"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm")
    )


def health_checks(reviews: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``(check_name, ok, detail)``: is there data, is there an index, do its sizes agree.

    This is the thorough check, which counts the saved rows again.
    """
    counts = index_counts(docs).select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("index_has_rows").alias("check_name"),
                    (F.col("n_rows") > 0).alias("ok"),
                    F.col("n_rows").alias("detail"),
                ),
                F.struct(
                    F.lit("vectors_match_rows").alias("check_name"),
                    (F.col("n_vectors") == F.col("n_rows")).alias("ok"),
                    F.col("n_vectors").alias("detail"),
                ),
                F.struct(
                    F.lit("ids_are_unique").alias("check_name"),
                    (F.col("n_ids") == F.col("n_rows")).alias("ok"),
                    F.col("n_ids").alias("detail"),
                ),
                F.struct(
                    F.lit("texts_match_rows").alias("check_name"),
                    (F.col("n_texts") == F.col("n_rows")).alias("ok"),
                    F.col("n_texts").alias("detail"),
                ),
            )
        ).alias("c")
    ).select("c.*")
    source = reviews.agg(F.count("*").alias("detail")).select(
        F.lit("reviews_have_rows").alias("check_name"), (F.col("detail") > 0).alias("ok"), "detail"
    )
    return source.unionByName(counts)


def checks_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if("ok").alias("passed"), F.count("*").alias("total")
    )
