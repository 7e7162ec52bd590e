"""The saved index: a folder of Parquet tables that grows by batches.

* ``documents``: ``corpus_id, doc_id, combined_text, embedding`` and the columns kept for filters, by ``batch`` and ``status``
  (``ok``, or ``failed`` with the reason as ``error``),
* ``postings``: of all batches, in buckets of ``doc_id`` and sorted by term: sums per document need no shuffle, and row
  groups without a wanted term are skipped. A batch for which the buckets are too full goes to ``postings-n``, with more of them,
* ``terms``, ``corpora``: the word statistics as of each batch,
* ``commits``: a row per batch with its counts and the settings, written last.

Every call that adds a batch is an attempt with a name of its own, and writes documents, postings and statistics under
it; the commit row names the attempt. Readers take only files of committed attempts, so a batch that broke off at any
point, and is then tried again, counts once. One writer at a time.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CORPUS, SearchSettings
from quarry.operators.lexical import (
    Lexicon,
    corpora,
    document_frequencies,
    merged_corpora,
    merged_frequencies,
    postings,
    term_weights,
)

# A bucket is read by one task, so their number goes by the length of the texts.
CHARACTERS_PER_BUCKET = 16_000_000
# Buckets that hold this many times as much take no more batches.
FULL_BUCKET = 2

POSTINGS_COLUMNS = "corpus_id STRING, doc_id BIGINT, term STRING, tf BIGINT, dl BIGINT, batch STRING, attempt STRING"
COMMIT_COLUMNS = (
    "number long, batch string, n_docs long, n_vectors long, n_texts long, n_failed long,"
    " model string, dimension int, use_bm25 boolean, bm25_weight double, buckets int, attempt string, n_characters long"
)


@dataclass(frozen=True)
class StoredIndex:
    documents: DataFrame
    lexicon: Lexicon | None
    # Counts and settings; None for documents that were never saved.
    settings: Row | None


def with_corpus(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``corpus_id``; without one, everything is a single corpus."""
    if "corpus_id" in docs.columns:
        return docs
    return docs.withColumn("corpus_id", F.lit(DEFAULT_CORPUS))


def choose_buckets(docs: DataFrame) -> int:
    """Buckets for an index that begins with ``docs``, from the length of their texts; within Spark's limit."""
    spark = docs.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fewest = min(partitions, spark.sparkContext.defaultParallelism)
    characters = docs.agg(F.sum(F.length("combined_text").cast("long"))).first()[0] or 0
    return min(most, max(fewest, math.ceil(characters / CHARACTERS_PER_BUCKET)))


def check_buckets(spark: SparkSession, buckets: int) -> int:
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    if not 1 <= buckets <= most:
        raise ValueError(f"{buckets} buckets; Spark takes 1 to {most}")
    return buckets


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def commits(spark: SparkSession, path: str) -> list[Row]:
    """The commits of an index in their order; as many rows as it has batches."""
    if not _exists(spark, f"{path}/commits"):
        return []
    found = spark.read.schema(COMMIT_COLUMNS).parquet(f"{path}/commits")
    return sorted(found.collect(), key=lambda row: row.number)


def _totals(done: list[Row]) -> Row:
    last = done[-1].asDict()
    sums = {name: sum(row[name] for row in done) for name in ("n_docs", "n_vectors", "n_texts", "n_failed")}
    return Row(**last | sums)


def buckets_with_room(spark: SparkSession, done: list[Row], buckets: int, characters: int) -> int:
    """Buckets for a batch of so many characters: the present ones until they are full, then enough for the whole index.

    Every new number is more than ``FULL_BUCKET`` times the one before, so there are few, and no bucket outgrows a task.
    """
    if not done or not buckets:
        return buckets
    held = sum(row.n_characters or 0 for row in done if row.buckets == buckets)
    if held + characters <= FULL_BUCKET * buckets * CHARACTERS_PER_BUCKET:
        return buckets
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    whole = sum(row.n_characters or 0 for row in done) + characters
    return min(most, math.ceil(whole / CHARACTERS_PER_BUCKET))


def _postings_folder(path: str, done: list[Row], buckets: int) -> str:
    first = done[0].buckets if done else buckets
    return f"{path}/postings" if buckets == first else f"{path}/postings-{buckets}"


def _postings_table(spark: SparkSession, folder: str, buckets: int) -> str:
    """The name under which the catalog knows the postings in ``folder``; one name per folder."""
    name = f"quarry_postings_{hashlib.md5(folder.encode()).hexdigest()}"
    location = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({POSTINGS_COLUMNS}) USING parquet "
        f"CLUSTERED BY (doc_id) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    spark.catalog.refreshTable(name)
    return name


def _segment(batch: str, attempt: str) -> str:
    return f"batch={batch}/attempt={attempt}"


def _statistics(spark: SparkSession, path: str, commit: Row) -> tuple[DataFrame, DataFrame]:
    where = _segment(commit.batch, commit.attempt)
    return spark.read.parquet(f"{path}/terms/{where}"), spark.read.parquet(f"{path}/corpora/{where}")


def _before_commit() -> None:
    """Called between the last file of an attempt and its commit row; tests break off here."""


def _add_words(
    spark: SparkSession, docs: DataFrame, path: str, batch: str, attempt: str, done: list[Row], buckets: int
) -> None:
    """Postings of one attempt, and the word statistics as they are with it."""
    folder = _postings_folder(path, done, buckets)
    name = _postings_table(spark, folder, buckets)
    # The same hash and number of partitions as the buckets, so each task writes one file.
    fresh = postings(docs, buckets, unique=True).withColumn("batch", F.lit(batch)).withColumn("attempt", F.lit(attempt))
    fresh.write.bucketBy(buckets, "doc_id").sortBy("term").format("parquet").mode("append").option(
        "path", folder
    ).saveAsTable(name)
    spark.catalog.refreshTable(name)
    posted = spark.table(name).filter((F.col("batch") == batch) & (F.col("attempt") == attempt))
    sizes, frequencies = corpora(docs, posted), document_frequencies(posted)
    if done:
        old_terms, old_sizes = _statistics(spark, path, done[-1])
        sizes = merged_corpora(old_sizes, sizes)
        frequencies = merged_frequencies(old_terms, frequencies)
    where = _segment(batch, attempt)
    sizes.write.parquet(f"{path}/corpora/{where}")
    stats = spark.read.parquet(f"{path}/corpora/{where}")
    term_weights(frequencies, stats).write.parquet(f"{path}/terms/{where}")


def append_batch(
    rows: DataFrame,
    path: str,
    batch: str,
    model: str,
    dimension: int,
    search: SearchSettings,
    buckets: int,
    max_errors: int | None = None,
    unique: bool = False,
) -> Row:
    """Add embedded ``rows`` to the index at ``path`` and commit them; the first batch makes the index.

    The call is an attempt of its own: what it writes is read only once its commit row exists, so a call that broke off
    leaves nothing that counts, and the same batch may simply be added again. Rows with an ``error`` stay beside the index. More of them than ``max_errors``, a vector that is missing, or an id twice
    is an error, and nothing is committed. ``unique`` says that the ids are known to be new.
    """
    spark = rows.sparkSession
    done = commits(spark, path)
    if any(row.batch == batch for row in done):
        return next(row for row in done if row.batch == batch)
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    good = F.col("error").isNull()
    seen = Observation()
    counts = [
        F.count_if(good).alias("n_docs"),
        F.count_if(good & F.col("embedding").isNotNull()).alias("n_vectors"),
        F.count_if(good & F.col("combined_text").isNotNull()).alias("n_texts"),
        F.count_if(~good).alias("n_failed"),
        F.sum(F.when(good, F.length("combined_text").cast("long"))).alias("n_characters"),
    ]
    attempt = uuid.uuid4().hex
    target = f"{path}/documents/{_segment(batch, attempt)}"
    rows.observe(seen, *counts).withColumn("status", F.when(good, "ok").otherwise("failed")).write.partitionBy(
        "status"
    ).mode("overwrite").parquet(target)
    n = {name: seen.get.get(name, 0) for name in ("n_docs", "n_vectors", "n_texts", "n_failed")}
    characters = seen.get.get("n_characters") or 0
    if max_errors is not None and n["n_failed"] > max_errors:
        raise RuntimeError(f"{n['n_failed']} rows failed to embed, more than {max_errors}; see {target}")
    if n["n_docs"] == 0:
        if done:
            return Row(**done[-1].asDict() | n)
        raise ValueError("no documents to index")
    if n["n_vectors"] != n["n_docs"]:
        raise ValueError(f"index is inconsistent: {n['n_docs']} rows, {n['n_vectors']} vectors")
    written = spark.read.parquet(target).filter("status = 'ok'")
    if not unique and not written.groupBy("corpus_id", "doc_id").count().filter("count > 1").isEmpty():
        raise ValueError(f"index is inconsistent: an id occurs twice in {target}")
    if search.use_bm25:
        docs = written.select("corpus_id", "doc_id", "combined_text")
        buckets = buckets_with_room(spark, done, buckets, characters)
        _add_words(spark, docs, path, batch, attempt, done, buckets)
    number = done[-1].number + 1 if done else 1
    kept = (search.use_bm25, search.bm25_weight, buckets, attempt, characters)
    row = (number, batch, *n.values(), model, dimension, *kept)
    _before_commit()
    commit = spark.createDataFrame([row], COMMIT_COLUMNS)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return commit.first()


def _batches(rows: DataFrame, done: list[Row]) -> DataFrame:
    """Rows of committed attempts only. On partition columns the condition prunes folders of other attempts."""
    committed = [f"{row.batch}/{row.attempt}" for row in done]
    return rows.filter(F.concat_ws("/", "batch", "attempt").isin(committed)).drop("attempt")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The committed documents."""
    rows = _batches(spark.read.parquet(f"{path}/documents"), commits(spark, path))
    return rows.filter("status = 'ok'").drop("batch", "status", "error")


def failed_rows(spark: SparkSession, path: str) -> DataFrame:
    """``corpus_id, doc_id, combined_text, error`` of the rows beside the index."""
    rows = _batches(spark.read.parquet(f"{path}/documents"), commits(spark, path))
    return rows.filter("status = 'failed'").select("corpus_id", "doc_id", "combined_text", "error")


def index_counts(docs: DataFrame) -> DataFrame:
    """One row: rows, vectors, distinct ids and texts, counted from the documents. All four agree in a sound index."""
    text = F.col("combined_text") if "combined_text" in docs.columns else F.lit(None)
    rows = with_corpus(docs).groupBy("corpus_id", "doc_id").agg(
        F.count("*").alias("n"), F.count("embedding").alias("v"), F.count(text).alias("t")
    )
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_vectors"),
        F.count("*").alias("n_ids"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_texts"),
    )


def load_old_index(spark: SparkSession, path: str) -> StoredIndex:
    """An index of the older form, a folder of documents alone: searched without BM25."""
    return StoredIndex(with_corpus(spark.read.parquet(f"{path}/documents")), None, None)


def load_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index at ``path``, from its commits; without texts for all rows it comes without BM25.

    A folder without a commit is no index. Counts come from the commits, so neither texts nor vectors are read.
    """
    done = commits(spark, path)
    if not done:
        raise FileNotFoundError(f"no index at {path}")
    settings = _totals(done)
    lex = None
    if settings.use_bm25 and settings.n_texts == settings.n_docs:
        parts = []
        for n in dict.fromkeys(row.buckets for row in done):
            posted = spark.table(_postings_table(spark, _postings_folder(path, done, n), n))
            parts.append(_batches(posted, done).drop("batch"))
        terms, sizes = _statistics(spark, path, done[-1])
        counted = sizes.agg(F.sum("n_docs")).first()[0]
        if counted != settings.n_docs:
            raise ValueError(f"lexicon of {counted} documents does not match {settings.n_docs} at {path}")
        lex = Lexicon(reduce(DataFrame.unionByName, parts), terms, sizes, True, tuple(parts))
    return StoredIndex(read_documents(spark, path), lex, settings)
