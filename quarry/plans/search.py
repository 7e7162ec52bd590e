"""Search over an index, for any number of queries at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import SearchSettings
from quarry.functions.scores import at_least
from quarry.functions.text import not_blank
from quarry.operators.embed import Embedder
from quarry.operators.hybrid import hybrid, hybrid_candidates, hybrid_hits, semantic_hits
from quarry.operators.lexical import bounded_matches
from quarry.operators.reports import with_documents
from quarry.operators.semantic import QUERIES_PER_PASS, nearest
from quarry.plans.build import check_model
from quarry.session import in_passes, materialise
from quarry.sources.store import StoredIndex, with_corpus

HIT_COLUMNS = ["corpus_id", "query_id", "doc_id", "score", "rank", "search_type"]


def prepared(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Queries with corpus and vector. Without an embedder they bring ``query_vector`` along."""
    queries = with_corpus(queries)
    if embedder is not None and "query_vector" not in queries.columns:
        queries = embedder.embed(queries, "query_text", "query_vector")
    return queries


def check_queries(queries: DataFrame) -> None:
    """Raise if a query is blank."""
    blank = queries.filter(~not_blank("query_text"))
    row = blank.select("query_id").first()
    if row is not None:
        raise ValueError(f"query {row.query_id!r} is blank")


def stored_settings(index: StoredIndex) -> SearchSettings:
    """What the index was saved with; the defaults for documents that were never saved."""
    kept = index.settings
    if kept is None:
        return SearchSettings()
    return SearchSettings(use_bm25=kept.use_bm25, bm25_weight=kept.bm25_weight)


def search(
    index: StoredIndex,
    queries: DataFrame,
    embedder: Embedder | None = None,
    settings: SearchSettings | None = None,
    top_k: int | None = None,
    min_score: float | None = None,
    use_bm25: bool | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """The best documents of each query: ``corpus_id, query_id, doc_id, score, rank, search_type``.

    ``queries`` has ``query_id`` and ``query_text`` or ``query_vector``. Without ``settings``, those saved with the index
    hold; ``top_k``, ``min_score`` and ``use_bm25`` override them for this call. Hybrid search needs a lexicon and
    query texts; without them the search is semantic, and ``search_type`` says so. Queries beyond what one
    pass takes are searched in passes.

    ``where`` is a condition on columns kept in the index. Only documents that meet it are ranked; word statistics and the best
    BM25 score remain those of the whole corpus.

    The minimum applies after ranking. Ranks run from the best score down, so it cuts off the tail.
    """
    if embedder is not None:
        check_model(index, embedder)
    settings = stored_settings(index) if settings is None else settings
    settings = replace(
        settings,
        top_k=settings.top_k if top_k is None else top_k,
        min_score=settings.min_score if min_score is None else min_score,
        use_bm25=settings.use_bm25 if use_bm25 is None else use_bm25,
    )
    if "query_text" in queries.columns:
        check_queries(queries)
    asked = prepared(queries, embedder)
    documents = index.documents if where is None else index.documents.filter(where)
    combine = settings.use_bm25 and index.lexicon is not None and "query_text" in asked.columns
    if combine and settings.top_k > 0:
        hits = in_passes(
            asked, QUERIES_PER_PASS, lambda some: hybrid(documents, index.lexicon, some, settings), "hybrid"
        )
    else:
        hits = nearest(documents, asked, settings.top_k)
    return _finished(hits, settings, "hybrid" if combine else "semantic")


def _finished(hits: DataFrame, settings: SearchSettings, search_type: str) -> DataFrame:
    return (
        hits.filter(at_least("score", settings.min_score))
        .withColumn("search_type", F.lit(search_type))
        .select(*HIT_COLUMNS)
    )


def search_both(
    index: StoredIndex,
    queries: DataFrame,
    embedder: Embedder | None = None,
    settings: SearchSettings | None = None,
    cutoffs: Sequence[int] | None = None,
) -> DataFrame:
    """Semantic and hybrid hits of the same queries, for each cutoff ``k``.

    Corpus and postings are read once, at the depth of the largest cutoff. Each cutoff then ranks its
    own share of the candidates: a hybrid search for ten looks at fewer of them than one for fifteen.
    """
    if index.lexicon is None:
        raise ValueError("this index has no lexicon")
    if embedder is not None:
        check_model(index, embedder)
    settings = stored_settings(index) if settings is None else settings
    check_queries(queries)
    cutoffs = [settings.top_k] if cutoffs is None else list(cutoffs)
    depth = max(cutoffs) * settings.oversample
    asked = prepared(queries, embedder)
    found = in_passes(
        asked,
        QUERIES_PER_PASS,
        lambda some: materialise(hybrid_candidates(index.documents, index.lexicon, some, depth), "found"),
        "found",
    )
    parts = []
    for k in cutoffs:
        at_k = replace(settings, top_k=k)
        for hits, kind in ((semantic_hits(found, k), "semantic"), (hybrid_hits(found, at_k), "hybrid")):
            parts.append(_finished(hits, at_k, kind).withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def lexical_search(index: StoredIndex, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """The best documents by BM25 alone."""
    if index.lexicon is None:
        raise ValueError("this index has no lexicon")
    check_queries(queries)
    hits = in_passes(
        with_corpus(queries), QUERIES_PER_PASS, lambda some: bounded_matches(index.lexicon, some, top_k), "lexical"
    )
    return hits.withColumn("search_type", F.lit("bm25")).select(*HIT_COLUMNS)


def search_with_documents(
    index: StoredIndex, queries: DataFrame, reviews: DataFrame, embedder: Embedder | None = None, **kwargs
) -> DataFrame:
    """``search`` with the summary and text of each hit."""
    return with_documents(search(index, queries, embedder, **kwargs), reviews)
