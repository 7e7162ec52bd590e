"""Index builds: whole and incremental, with a quarantine for rows that fail."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quarry.config import SearchSettings
from quarry.operators.embed import Embedder
from quarry.session import fresh_path
from quarry.sources.store import (
    StoredIndex,
    append_batch,
    check_buckets,
    choose_buckets,
    commits,
    load_index,
    read_documents,
    with_corpus,
)


@dataclass(frozen=True)
class BuildStats:
    documents: int
    errors: int
    seconds: float

    @property
    def documents_per_second(self) -> float:
        return self.documents / self.seconds if self.seconds > 0 else 0.0


def embedded(docs: DataFrame, embedder: Embedder, max_errors: int | None = None) -> DataFrame:
    """Documents with their vector: the rows of an index, with all columns of ``docs``.

    With ``max_errors``, rows that fail get an ``error`` instead, and a task that alone has more of them ends the job.
    """
    docs = with_corpus(docs)
    if max_errors is None:
        rows = embedder.embed(docs, "combined_text", "embedding")
    else:
        rows = embedder.embed_checked(docs, "combined_text", "embedding", "error", max_errors)
    first = ["corpus_id", "doc_id", "combined_text", "embedding"]
    return rows.select(*first, *[f"`{c}`" for c in rows.columns if c not in first])


def build_index(
    docs: DataFrame,
    embedder: Embedder,
    path: str,
    search: SearchSettings = SearchSettings(),
    buckets: int | None = None,
    max_errors: int | None = None,
) -> tuple[StoredIndex, BuildStats]:
    """Embed ``docs(doc_id, combined_text)`` and save the index at ``path``, which must be new.

    Further columns are kept, to filter by. Every row is written once, together with its vector. Without any row there is no
    index. With ``max_errors``, rows that fail stay beside the index (``failed_rows``), up to that many.
    """
    spark = docs.sparkSession
    started = time.perf_counter()
    if commits(spark, path):
        raise FileExistsError(f"there already exists an index at {path}")
    if not search.use_bm25:
        buckets = 0
    else:
        buckets = check_buckets(spark, choose_buckets(docs) if buckets is None else buckets)
    done = append_batch(
        embedded(docs, embedder, max_errors),
        path,
        uuid.uuid4().hex,
        embedder.name,
        embedder.dimension,
        search,
        buckets,
        max_errors,
    )
    seconds = time.perf_counter() - started
    return load_index(spark, path), BuildStats(done.n_docs, done.n_failed, seconds)


def not_yet_indexed(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents whose id is not in the index, each id once."""
    known = with_corpus(index).select("corpus_id", "doc_id")
    fresh = with_corpus(docs).join(known, ["corpus_id", "doc_id"], "left_anti")
    return fresh.dropDuplicates(["corpus_id", "doc_id"])


def add_documents(
    docs: DataFrame, embedder: Embedder, path: str, batch: str | None = None, max_errors: int | None = None
) -> int:
    """Embed and append what the index at ``path`` lacks, with its postings; running it again adds nothing.

    The word statistics are merged with those of before, so the grown index searches like one that was built whole. A
    ``batch`` that was committed before is not added again.
    """
    spark = docs.sparkSession
    index = load_index(spark, path)
    check_model(index, embedder)
    kept = index.settings
    search = SearchSettings(use_bm25=kept.use_bm25, bm25_weight=kept.bm25_weight)
    rows = embedded(not_yet_indexed(docs, read_documents(spark, path)), embedder, max_errors)
    batch = batch or uuid.uuid4().hex
    if any(row.batch == batch for row in commits(spark, path)):
        return 0
    done = append_batch(
        rows, path, batch, embedder.name, embedder.dimension, search, kept.buckets, max_errors, unique=True
    )
    return done.n_docs


def check_model(index: StoredIndex, embedder: Embedder) -> None:
    """Raise if vectors of this embedder do not go with those of the index."""
    kept = index.settings
    if kept is not None and (kept.model, kept.dimension) != (embedder.name, embedder.dimension):
        raise ValueError(
            f"the index was built with {kept.model} of dimension {kept.dimension}, "
            f"not {embedder.name} of dimension {embedder.dimension}"
        )


def scratch_index(docs: DataFrame, embedder: Embedder, **kwargs) -> StoredIndex:
    """An index in the scratch folder, for one session."""
    index, _ = build_index(docs, embedder, fresh_path(docs.sparkSession, "index"), **kwargs)
    return index


