"""A clustered (inverted-file) vector index, and exact search that skips clusters by a bound.

Build: a coarse quantiser of ``lists`` unit centres is fitted by spherical k-means on a bounded sample (``FIT_SAMPLE``
rows, taken by hash order, so the same at every run). Every vector goes to the centre of largest inner product, and
the index is written partitioned by ``list`` and ``part``: a list with more than ``LIST_ROWS`` rows is split into
several parts by document hash, so a hot cluster becomes several equal files. Per list the index keeps its size, its
largest vector norm and its angular radius (the largest angle between the centre and a member).

Approximate search: each query goes to its ``probes`` nearest lists. The queries of a pass (``QUERIES_PER_PASS``, a
bounded table) go to every task; the scan names only the lists that some query probes, so Parquet partition pruning
leaves the files of all other clusters unread. Each task keeps the best ``k`` per query and list; Spark merges them.

Exact search: for a query at angle ``a`` to a centre, every member of a list of radius ``r`` and largest norm ``R``
scores at most ``|q| R cos(max(0, a - r))`` (and at most 0 beyond a right angle). A first pass reads the lists of
largest bound until they hold ``k`` documents, which gives each query a ``k``-th score; a second pass reads, per query,
only the lists whose bound still reaches it. The result equals the full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scores import top_k
from quarry.operators.semantic import MERGE_SHARDS, QUERIES_PER_PASS, _Best, _hit_schema, _matrix
from quarry.session import fresh_path, in_passes

LISTS = 32
FIT_SAMPLE = 20_000
ITERATIONS = 10
LIST_ROWS = 200_000
SEED = 11
# Scores are rounded; a bound is raised by this much so that rounding never skips a list it should read.
SLACK = 1e-6


@dataclass
class ClusteredIndex:
    path: str
    centres: np.ndarray  # (lists, dimension), unit rows
    sizes: np.ndarray  # rows per list
    radius: np.ndarray  # largest angle between centre and member, radians
    longest: np.ndarray  # largest member norm
    total: int

    def read(self, lists: list[int] | None = None) -> DataFrame:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        stored = spark.read.parquet(self.path)
        return stored if lists is None else stored.filter(F.col("list").isin(lists))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, lists): the largest inner product any member of a list can have with each query."""
        norms = np.linalg.norm(queries, axis=1)
        cosine = (queries @ self.centres.T) / np.where(norms > 0, norms, 1)[:, None]
        angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        closest = np.maximum(angle - self.radius[None, :], 0.0)
        reach = np.where(closest < math.pi / 2, np.cos(closest), 0.0)
        return norms[:, None] * self.longest[None, :] * reach + SLACK


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def fit_centres(documents: DataFrame, lists: int = LISTS, sample: int = FIT_SAMPLE, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centres by spherical k-means over at most ``sample`` vectors taken in hash order; zero vectors do not count."""
    picked = (
        documents.filter(F.col("embedding").isNotNull())
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)))
        .limit(sample)
        .select("embedding")
        .toArrow()
    )
    vectors = picked.column("embedding").combine_chunks()
    x = _unit(_matrix(vectors)) if len(vectors) else np.zeros((0, 1))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if len(x) == 0:
        raise ValueError("no vector to fit centres on")
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(iterations):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    return centres


def build_clustered(documents: DataFrame, lists: int = LISTS, path: str | None = None) -> ClusteredIndex:
    """Write ``documents`` (``corpus_id, doc_id, embedding``) as a clustered index; rows without a vector are left out.

    A zero vector goes to list 0 and scores 0 with every query.
    """
    spark = documents.sparkSession
    documents = documents.select("corpus_id", "doc_id", "embedding").filter(F.col("embedding").isNotNull())
    centres = fit_centres(documents, lists)
    dimension = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dimension)
            norms = np.linalg.norm(x, axis=1)
            products = x @ centres.T
            chosen = products.argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            cosine = products[np.arange(len(x)), chosen] / np.where(norms > 0, norms, 1)
            cosine = np.where(norms > 0, cosine, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chosen, pa.int32()), pa.array(cosine), pa.array(norms)],
                names=[*batch.schema.names, "list", "cosine", "norm"],
            )

    schema = T.StructType(
        [*documents.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("cosine", T.DoubleType()),
         T.StructField("norm", T.DoubleType())]
    )
    assigned = documents.mapInArrow(assign, schema)
    staged = fresh_path(spark, "clustered-staged")
    assigned.write.parquet(staged)
    assigned = spark.read.parquet(staged)
    stats = {
        r.list: r
        for r in assigned.groupBy("list")
        .agg(F.count("*").alias("n"), F.min("cosine").alias("c"), F.max("norm").alias("r"))
        .collect()
    }
    sizes = np.array([stats[i].n if i in stats else 0 for i in range(len(centres))], dtype=np.int64)
    radius = np.array([math.acos(max(-1.0, min(1.0, stats[i].c))) if i in stats else 0.0 for i in range(len(centres))])
    longest = np.array([stats[i].r if i in stats else 0.0 for i in range(len(centres))])
    parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // LIST_ROWS))) for n in sizes]), F.col("list") + 1)
    path = path or fresh_path(spark, "clustered")
    (
        assigned.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
        .drop("cosine", "norm")
        .repartition("list", "part")
        .write.partitionBy("list", "part")
        .parquet(path)
    )
    return ClusteredIndex(path, centres, sizes, radius, longest, int(sizes.sum()))


def _scan(index: ClusteredIndex, asked: pa.Table, visits: dict[int, np.ndarray], k: int) -> DataFrame:
    """Best ``k`` per query of the lists each one visits (``visits``: list -> positions of queries in ``asked``)."""
    schema = _hit_schema_of(asked)
    corpus = asked.column("corpus_id").to_pylist()
    ids = asked.column("query_id")
    matrix = _matrix(asked.column("query_vector").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, str], _Best] = {}
        for batch in batches:
            lists = batch.column("list").to_numpy(zero_copy_only=False)
            names = np.array(batch.column("corpus_id").to_pylist(), dtype=object)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column("embedding"), matrix.shape[1])
            for number in np.unique(lists):
                positions = visits.get(int(number))
                if positions is None:
                    continue
                here = lists == number
                for name in set(names[here].tolist()):
                    mine = positions[[corpus[p] == name for p in positions]]
                    if not len(mine):
                        continue
                    rows = here & (names == name)
                    key = (int(number), name)
                    if key not in best:
                        best[key] = _Best(mine, matrix[mine], k)
                    best[key].add(docs[rows], vectors[rows])
        for (_, name), kept in best.items():
            positions, doc_ids, scores = kept.rows()
            yield from pa.table(
                {
                    "corpus_id": pa.array([name] * len(doc_ids), pa.string()),
                    "query_id": ids.take(pa.array(positions, pa.int64())),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "score": pa.array(scores, pa.float64()),
                }
            ).to_batches()

    wanted = sorted(visits)
    return index.read(wanted).select("corpus_id", "doc_id", "embedding", "list").mapInArrow(run, schema)


def _hit_schema_of(asked: pa.Table):
    from pyspark.sql.pandas.types import from_arrow_type

    return T.StructType(
        [
            T.StructField("corpus_id", T.StringType()),
            T.StructField("query_id", from_arrow_type(asked.schema.field("query_id").type)),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _visits(choice: np.ndarray) -> dict[int, np.ndarray]:
    """list -> positions of the queries for which ``choice[query, list]`` holds."""
    return {int(j): np.flatnonzero(choice[:, j]) for j in np.flatnonzero(choice.any(axis=0))}


def _prepared(queries: DataFrame) -> DataFrame:
    return queries.select("corpus_id", "query_id", "query_vector").filter("query_vector is not null")


def probe_search(index: ClusteredIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """``corpus_id, query_id, doc_id, score, rank``: each query's best ``k`` in its ``probes`` nearest lists."""
    schema = _hit_schema(queries)

    def one_pass(some: DataFrame) -> DataFrame:
        asked = some.toArrow()
        if k <= 0 or asked.num_rows == 0:
            return some.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
        matrix = _matrix(asked.column("query_vector").combine_chunks())
        near = np.argsort(-(matrix @ index.centres.T), axis=1, kind="stable")[:, :probes]
        choice = np.zeros((len(matrix), len(index.centres)), dtype=bool)
        np.put_along_axis(choice, near, True, axis=1)
        hits = _scan(index, asked, _visits(choice), k)
        return top_k(hits, k, shards=F.pmod(F.spark_partition_id(), F.lit(MERGE_SHARDS)))

    return in_passes(_prepared(queries), QUERIES_PER_PASS, one_pass, "probed")


@dataclass
class Skipped:
    """Rows of lists read, against rows of all lists times queries, over all passes of ``exact_search``."""

    read: int = 0
    whole: int = 0

    @property
    def share(self) -> float:
        return self.read / self.whole if self.whole else 0.0


def exact_search(index: ClusteredIndex, queries: DataFrame, k: int, skipped: Skipped | None = None) -> DataFrame:
    """``corpus_id, query_id, doc_id, score, rank``: the same rows as a full scan (``operators.semantic.nearest``), read
    from the lists whose bound can still reach each query's ``k``-th score. ``skipped`` receives the rows read."""
    schema = _hit_schema(queries)
    skipped = skipped if skipped is not None else Skipped()

    def one_pass(some: DataFrame) -> DataFrame:
        asked = some.toArrow()
        if k <= 0 or asked.num_rows == 0:
            return some.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
        matrix = _matrix(asked.column("query_vector").combine_chunks())
        bound = index.bounds(matrix)
        order = np.argsort(-bound, axis=1, kind="stable")
        # First the lists of largest bound until they hold k rows.
        held = np.cumsum(index.sizes[order], axis=1)
        first = np.zeros_like(bound, dtype=bool)
        enough = np.minimum((held < k).sum(axis=1) + 1, len(index.centres))
        for row, count in enumerate(enough):
            first[row, order[row, :count]] = True
        hits = top_k(_scan(index, asked, _visits(first), k), k)
        found = hits.toArrow()
        kth = np.full(len(matrix), -np.inf)
        keys = zip(asked.column("corpus_id").to_pylist(), asked.column("query_id").to_pylist())
        position = {key: i for i, key in enumerate(keys)}
        counts = np.zeros(len(matrix), dtype=np.int64)
        got = zip(found.column("corpus_id").to_pylist(), found.column("query_id").to_pylist(), found.column("score").to_pylist())
        for name, qid, score in got:
            i = position[(name, qid)]
            counts[i] += 1
            kth[i] = score if counts[i] == 1 else min(kth[i], score)
        kth[counts < k] = -np.inf
        second = (bound >= kth[:, None]) & ~first
        skipped.read += int((index.sizes[None, :] * (first | second)).sum())
        skipped.whole += int(index.total * len(matrix))
        spark = some.sparkSession
        earlier = spark.createDataFrame(found.drop(["rank"]), schema)
        if not second.any():
            return top_k(earlier, k)
        more = _scan(index, asked, _visits(second), k)
        return top_k(earlier.unionByName(more), k, shards=F.pmod(F.spark_partition_id(), F.lit(MERGE_SHARDS)))

    return in_passes(_prepared(queries), QUERIES_PER_PASS, one_pass, "exact")
