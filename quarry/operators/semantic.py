"""Exact search by inner product: the best ``k`` documents of every query.

The score of each pair is computed once and thrown away unless it is among the best seen by its
task, so a scan emits at most ``k`` rows per query and task and never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import SCORE_DECIMALS
from quarry.functions.scores import top_k
from quarry.session import in_passes

# Queries sent to every task at once. At 768 dimensions this is 25 MB.
QUERIES_PER_PASS = 4096
# Queries multiplied at a time, so that a score matrix stays within some tens of megabytes.
QUERIES_PER_TILE = 256
# Shares into which the partial results of one query are split before the final merge.
MERGE_SHARDS = 256


def _matrix(vectors: pa.ListArray, dimension: int | None = None) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // len(vectors) if len(vectors) else 0
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(vectors) and ((lengths != width).any() or dimension not in (None, width)):
        raise ValueError(f"vectors of length {sorted(set(lengths.tolist()))}, expected {dimension or width}")
    return flat.reshape(len(vectors), width)


class _Best:
    """The best ``k`` (score, id) pairs seen so far for each of a set of queries."""

    def __init__(self, positions: np.ndarray, vectors: np.ndarray, k: int):
        self.positions = positions
        self.vectors = vectors
        self.k = k
        self.scores = np.full((len(positions), k), -np.inf)
        self.ids = np.full((len(positions), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, documents: np.ndarray) -> None:
        for start in range(0, len(self.positions), QUERIES_PER_TILE):
            tile = slice(start, start + QUERIES_PER_TILE)
            self._add_tile(tile, ids, documents)

    def _add_tile(self, tile: slice, ids: np.ndarray, documents: np.ndarray) -> None:
        k = self.k
        scores = np.round(self.vectors[tile] @ documents.T, SCORE_DECIMALS)
        scores[np.isnan(scores)] = -np.inf
        worst, worst_id = self.scores[tile, -1:], self.ids[tile, -1:]
        enters = (scores > worst) | ((scores == worst) & (ids[None, :] < worst_id))
        enters &= scores > -np.inf
        if scores.shape[1] > k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:].min(axis=1)
            enters &= scores >= kth[:, None]
        row, col = np.nonzero(enters)
        if not len(row):
            return
        kept = np.arange(worst.shape[0])
        all_rows = np.concatenate([np.repeat(kept, k), row])
        all_scores = np.concatenate([self.scores[tile].ravel(), scores[row, col]])
        all_ids = np.concatenate([self.ids[tile].ravel(), ids[col]])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        all_rows = all_rows[order]
        place = np.arange(len(order)) - np.searchsorted(all_rows, all_rows)
        first = order[place < k]
        self.scores[tile] = all_scores[first].reshape(-1, k)
        self.ids[tile] = all_ids[first].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(self.scores > -np.inf)
        return self.positions[row], self.ids[row, col], self.scores[row, col]


class _Scorer:
    """Scores Arrow batches of documents against a query table held in memory."""

    def __init__(self, queries: pa.Table, k: int):
        queries = queries.combine_chunks()
        self.query_ids = queries["query_id"]
        self.k = k
        corpus = queries["corpus_id"].to_pylist()
        vectors = queries["query_vector"].combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        matrix = _matrix(vectors)
        self.dimension = matrix.shape[1]
        self.best: dict[str, _Best] = {}
        for name in sorted(set(corpus)):
            positions = np.array([i for i, c in enumerate(corpus) if c == name])
            self.best[name] = _Best(positions, matrix[positions], k)

    def add(self, batch: pa.RecordBatch | pa.Table) -> None:
        if batch.num_rows == 0:
            return
        corpus = batch.column("corpus_id")
        ids = batch.column("doc_id").to_numpy()
        vectors = batch.column("embedding")
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        documents = _matrix(vectors, self.dimension)
        for name, best in self.best.items():
            here = pc.equal(corpus, name).to_numpy(zero_copy_only=False)
            if here.all():
                best.add(ids, documents)
            elif here.any():
                best.add(ids[here], documents[here])

    def result(self) -> Iterator[pa.RecordBatch]:
        for name, best in self.best.items():
            positions, ids, scores = best.rows()
            query_ids = self.query_ids.take(pa.array(positions, pa.int64()))
            table = pa.table(
                {
                    "corpus_id": pa.array([name] * len(ids), pa.string()),
                    "query_id": query_ids,
                    "doc_id": pa.array(ids, pa.int64()),
                    "score": pa.array(scores, pa.float64()),
                }
            )
            yield from table.to_batches()


def _hit_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("corpus_id", T.StringType()),
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan(index: DataFrame, queries: pa.Table, k: int, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(queries, k)
        for batch in batches:
            scorer.add(batch)
        yield from scorer.result()

    return index.mapInArrow(run, schema)


def nearest(
    index: DataFrame, queries: DataFrame, k: int, queries_per_pass: int = QUERIES_PER_PASS
) -> DataFrame:
    """``(corpus_id, query_id, doc_id, score, rank)`` of the ``k`` best documents per query.

    A query sees the documents of its own corpus. Scores that are not numbers never rank; with
    fewer than ``k`` documents all of them are returned. More queries than go with a task are searched in
    passes over the index.
    """
    schema = _hit_schema(queries)
    index = index.select("corpus_id", "doc_id", "embedding").filter("embedding is not null")
    queries = queries.select("corpus_id", "query_id", "query_vector").filter(
        "query_vector is not null"
    )

    def one_pass(some: DataFrame) -> DataFrame:
        table = some.toArrow()
        if k <= 0 or table.num_rows == 0:
            none = index.sparkSession.createDataFrame([], schema)
            return none.withColumn("rank", F.lit(0))
        shards = F.pmod(F.spark_partition_id(), F.lit(MERGE_SHARDS))
        return top_k(_scan(index, table, k, schema), k, shards=shards)

    return in_passes(queries, queries_per_pass, one_pass, "nearest")
