"""Gold-set evaluation: an index per judged query column, all of them in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from quarry.config import EVALUATION, SearchSettings
from quarry.operators.embed import Embedder
from quarry.operators.evaluate import precision_at_k
from quarry.plans.build import build_index
from quarry.plans.search import search_both, stored_settings
from quarry.session import broadcast_if_small, fresh_path
from quarry.sources.goldset import judgements, label_map
from quarry.sources.reviews import documents
from quarry.sources.store import StoredIndex


def gold_documents(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """``corpus_id, doc_id, combined_text``: the judged reviews once per query they are judged for."""
    judged_ids = broadcast_if_small(labels.select("corpus_id", "doc_id"))
    docs = documents(reviews, sep=" ", keep_blank=True)
    return docs.join(judged_ids, "doc_id").select("corpus_id", "doc_id", "combined_text")


def index_gold_set(
    gold: DataFrame,
    reviews: DataFrame,
    embedder: Embedder,
    names: Sequence[str] | None = None,
    path: str | None = None,
    search_settings: SearchSettings = EVALUATION,
    buckets: int | None = None,
) -> tuple[StoredIndex, DataFrame]:
    """Index the judged reviews of each query column; returns the index and the labels.

    Vectors, document lengths and term weights are those of the column's own corpus.
    """
    labels = label_map(judgements(gold, names))
    path = path or fresh_path(gold.sparkSession, "gold")
    docs = gold_documents(labels, reviews)
    index, _ = build_index(docs, embedder, path, search_settings, buckets)
    return index, labels


def evaluate(
    index: StoredIndex,
    labels: DataFrame,
    queries: DataFrame,
    cutoffs: Sequence[int] = (EVALUATION.top_k,),
    embedder: Embedder | None = None,
    settings: SearchSettings | None = None,
) -> DataFrame:
    """Precision of semantic and hybrid search for every query and cutoff, with the weight the index was saved with."""
    settings = replace(EVALUATION, bm25_weight=stored_settings(index).bm25_weight) if settings is None else settings
    hits = search_both(index, queries, embedder, settings, cutoffs)
    return precision_at_k(hits, labels, queries, cutoffs)
