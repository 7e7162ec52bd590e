"""Continuous index build over a folder that receives review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.config import SearchSettings
from quarry.operators.embed import Embedder
from quarry.plans.build import add_documents, embedded
from quarry.sources.store import append_batch, check_buckets, choose_buckets, commits, with_corpus


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100, pattern: str = "*"
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def index_stream(
    docs: DataFrame,
    embedder: Embedder,
    path: str,
    checkpoint: str,
    once: bool = True,
    search: SearchSettings = SearchSettings(),
    buckets: int | None = None,
    max_errors: int | None = None,
) -> StreamingQuery:
    """Embed arriving ``docs(doc_id, combined_text)`` and add them to the index at ``path``, which the first rows begin.

    Each micro-batch is a batch of the index under its own name, through the same code as ``add_documents``, so a batch that
    is repeated after a failure is committed once, and other batches may be added in between. The number of
    buckets is what the first rows ask for until they are full; give ``buckets`` if more will follow. ``once`` handles what is
    there and stops.

    With ``max_errors``, rows that cannot be embedded stay beside the index (``failed_rows``), and the budget holds for the whole
    stream, not per micro-batch: the failures of committed micro-batches are summed from their commit rows, and a micro-batch
    that would go beyond what is left commits nothing and ends the stream with an error.
    """

    def add(rows: DataFrame, number: int) -> None:
        batch = f"stream-{number}"
        done = commits(rows.sparkSession, path)
        left = None if max_errors is None else max_errors - sum(row.n_failed for row in done)
        if done:
            add_documents(rows, embedder, path, batch, max_errors=left)
            return
        if rows.isEmpty():
            return
        fresh = with_corpus(rows).dropDuplicates(["corpus_id", "doc_id"])
        size = check_buckets(rows.sparkSession, buckets or choose_buckets(rows)) if search.use_bm25 else 0
        append_batch(
            embedded(fresh, embedder, left),
            path,
            batch,
            embedder.name,
            embedder.dimension,
            search,
            size,
            max_errors=left,
            unique=True,
        )

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
