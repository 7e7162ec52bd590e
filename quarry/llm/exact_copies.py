"""Exact duplicates by a heavy-hitter split.

A third of all rows may be copies of one text, and a shuffle by digest would bring them to one task. So
the frequent digests are found first, with a Misra-Gries summary of fixed size (``approx_top_k``, whose
sketch is merged across tasks). The summary only nominates: the nominees are counted exactly, with sums
inside each task before the shuffle, and their winners are broadcast, at most ``HEAVY_DIGESTS`` rows of
some hundred bytes each. Rows of heavy digests then get their answer where they are. All others share
no frequent digest and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import saved, text_of

# Nominees that are broadcast, and counters of the summary. Of n rows, a digest with more than some
# 4 n / HEAVY_COUNTERS copies cannot be missing from the summary; those below make no hot task.
HEAVY_DIGESTS = 512
HEAVY_COUNTERS = 8192


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the whole text in UTF-8, lower-case hex; a null text counts as empty."""
    return F.sha2(F.encode(text_of(text), "UTF-8"), 256)


def heavy_digests(rows: DataFrame) -> DataFrame:
    """``digest`` of at most ``HEAVY_DIGESTS`` nominees."""
    top = F.expr(f"approx_top_k(digest, {HEAVY_DIGESTS}, {HEAVY_COUNTERS})")
    return rows.agg(top.alias("top")).select(F.explode("top.item").alias("digest"))


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null equals empty. Of equal texts, the largest ``doc_id``
    stays. Null ids count as smaller than all others; a group with null ids alone keeps null. Rows that
    repeat both id and text all say ``kept``; ``drop_exact_copies`` leaves one of them. An empty table
    gives an empty result. Only ids and digests are shuffled.
    """
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest")), "digests")
    nominees = heavy_digests(rows)
    winners = (
        rows.join(F.broadcast(nominees), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    winners = saved(winners, "heavy")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    hot = marked.filter(F.col("group_size").isNotNull())
    group = Window.partitionBy("digest")
    rest = (
        rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("group_size", F.count("*").over(group))
    )
    return hot.unionByName(rest).select(
        F.col("doc_id").alias(doc_id),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("null")))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all its columns as they were.

    The texts are shuffled once: the join with the kept ids and the removal of repeated rows go by the
    same key.
    """
    key = "__exact_copies_key"
    kept = (
        exact_copies(docs, doc_id, text)
        .filter("kept")
        .select(_row_key(F.col(doc_id), F.col("text_sha256")).alias(key))
        .distinct()
    )
    tagged = docs.withColumn(key, _row_key(F.col(doc_id), text_digest(text)))
    return tagged.join(kept, key).dropDuplicates([key]).select(*[f"`{c}`" for c in docs.columns])
