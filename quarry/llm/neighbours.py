"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by ``PROJECTIONS`` Gaussian projections, ``floor((a . v + b) / w)``; the tuple of
these cells is the vector's bucket in that table. A query does not only look in its own bucket: it visits the
``PROBES`` buckets whose cells differ by -1 or +1 in some projections, in the order of their estimated chance to hold a
neighbour (the sum of squared distances to the crossed cell borders, generated lowest first with a heap over the sorted
border distances). Candidates of all tables are merged, their exact distances computed in double precision, and the
nearest ranked.

In Spark: buckets are rows (table, key, vector key); the probes of the queries are rows of the same form, and an
equi-join on (table, key) gives the candidates, with no pair built outside shared buckets. Vectors that are equal are
one indexed point: a hot vector with a third of all rows is one row in each table, and its members (at most ``K + 1``
smallest ids are ever needed) are ranked in salted windows. The width ``w`` is fitted on a bounded sample
(``SAMPLE`` rows): ``WIDTH_FACTOR`` times their median distance to their tenth nearest row of the whole table, found by
an exact scan. Each bucket is scored where it lies: Spark groups the indexed points and the probes that visit them by
bucket, and only each query's ``K + 1`` nearest points of the bucket leave it, so no (query, candidate) pair is shuffled. A query that finds fewer
than ``K`` neighbours is answered exactly, by a scan of all rows in blocks of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.codebooks import usable
from quarry.llm.common import saved

TABLES, PROJECTIONS, PROBES = 8, 8, 32
WIDTH_FACTOR, SAMPLE, SEED = 2.5, 256, 17
K = 10
# Salts of the windows that rank members of one vector, and queries per block of the exact scan.
SALTS, QUERY_BLOCK = 64, 1024


def squared_distance(a: str, b: str) -> Column:
    """Sum of squared component differences in double precision, in component order."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


class Hashing:
    """Projections, offsets and width of all tables, with bucket keys and probe sequences."""

    def __init__(self, dims: int, width: float, tables: int = TABLES, projections: int = PROJECTIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.width, self.projections = width, projections
        self.a = rng.standard_normal((tables, projections, dims))
        self.b = rng.uniform(0.0, width, (tables, projections))
        # Odd multipliers that fold a tuple of cells into one 64-bit key; equal keys of unequal cells only add candidates.
        self.fold = rng.integers(1, 2**62, (tables, projections), dtype=np.int64) | 1

    def positions(self, vectors: np.ndarray) -> np.ndarray:
        """(n, tables, projections) positions in units of the width."""
        return (np.einsum("tpd,nd->ntp", self.a, vectors) + self.b[None]) / self.width

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.fold[table]).sum(axis=-1)

    def probes(self, position: np.ndarray, count: int) -> list[np.ndarray]:
        """The home cells and the ``count - 1`` most promising perturbed ones, best first."""
        m = self.projections
        home = np.floor(position)
        low = position - home
        border = np.concatenate([low, 1.0 - low])
        step = np.concatenate([-np.ones(m), np.ones(m)])
        order = np.argsort(border, kind="stable")
        z = border[order]
        found = [home]
        heap = [(z[0] * z[0], (0,))]
        while heap and len(found) < count:
            score, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (score - z[last] ** 2 + z[last + 1] ** 2, chosen[:-1] + (last + 1,)))
                heapq.heappush(heap, (score + z[last + 1] ** 2, chosen + (last + 1,)))
            axes = order[list(chosen)] % m
            if len(set(axes.tolist())) < len(chosen):
                continue
            cells = home.copy()
            cells[axes] += step[order[list(chosen)]]
            found.append(cells)
        return found


def _vectors(column: pd.Series, dims: int) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, dims))
    return np.stack(column.to_numpy()).astype(np.float64).reshape(len(column), dims)


def _best(ranked: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return ranked.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= k).drop("_r")


def nearest_neighbours(
    table: DataFrame,
    queries: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    probes: int = PROBES,
) -> DataFrame:
    """For every row where ``queries`` holds: ``query_id, rank, vec_id, score``, its ``k`` nearest rows found.

    Nearness is Euclidean distance on the original components in double precision, ``score`` that distance; ties go to
    the smaller ``vec_id``, null ids last. A query's own ``vec_id`` is never its neighbour (rows repeating it neither).
    Rows whose vector is null, all zeros, or holds a null or non-finite component take no part, as queries or
    candidates; so do vectors whose length differs from the longest. A query with fewer than ``k`` other rows gets them
    all. Equal vectors are equal candidates, ranked by id. Extra columns of ``table`` are not carried. An empty table,
    or no query, gives no rows.
    """
    spark = table.sparkSession
    rows = table.filter(usable(vector) & F.exists(vector, lambda x: x != 0)).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.when(queries, True).otherwise(False).alias("asks"), F.col(vector).alias("v")
    )
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = saved(
        rows.filter(F.size("v") == dims).withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v").cast("long")}), "ann-rows"
    )
    point = ["h1", "h2"]
    id_order = [F.col("vec_id").asc_nulls_last()]
    # Members of each vector that can ever be ranked: the k + 1 smallest ids, first per salt, then per vector.
    salted = _best(rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))), [*point, "salt"], id_order, k + 1)
    members = saved(_best(salted.select(*point, "vec_id"), point, id_order, k + 1), "ann-members")
    points = saved(rows.groupBy(*point).agg(F.first("v").alias("v")), "ann-points")

    # The width: a bounded sample of rows, each with its tenth nearest row found by a full scan.
    sample = rows.orderBy(F.xxhash64("h1", "h2", "vec_id")).limit(SAMPLE).select(
        F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("qv")
    )
    tenth = exact_scan(rows, sample, K).groupBy("query_id", "q1", "q2").agg(F.max("score").alias("d"))
    middle = tenth.agg(F.median("d")).first()[0]
    hashing = Hashing(dims, WIDTH_FACTOR * middle if middle else 1.0)

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.floor(hashing.positions(_vectors(batch["v"], dims)))
            for t in range(cells.shape[1]):
                keys = hashing.keys(cells[:, t], t)
                yield pd.DataFrame({"t": t, "key": keys, "c1": batch["h1"], "c2": batch["h2"], "v": batch["v"]})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            positions = hashing.positions(_vectors(batch["v"], dims))
            for t in range(positions.shape[1]):
                visits, owners = [], []
                for row, position in enumerate(positions[:, t]):
                    cells = hashing.probes(position, probes)
                    visits.extend(cells)
                    owners.extend([row] * len(cells))
                if visits:
                    keys = hashing.keys(np.array(visits), t)
                    picked = batch.iloc[owners]
                    yield pd.DataFrame({"t": t, "key": keys, "q1": picked["h1"].to_numpy(), "q2": picked["h2"].to_numpy(),
                                        "qv": picked["v"].to_numpy()})

    def nearest_in_bucket(found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        """Per query that visits this bucket, the bucket's k + 1 nearest points, ties at the last place included."""
        if found.empty or asking.empty:
            return pd.DataFrame({"q1": [], "q2": [], "c1": [], "c2": [], "d": []})
        asking = asking.drop_duplicates(["q1", "q2"])
        c = _vectors(found["v"], dims)
        out = []
        for q1, q2, qv in zip(asking["q1"], asking["q2"], asking["qv"]):
            d = np.sqrt(((c - np.asarray(qv, dtype=np.float64)) ** 2).sum(axis=1))
            if len(d) > k + 1:
                bound = np.partition(d, k)[k]
                near = np.flatnonzero(d <= bound)
            else:
                near = np.arange(len(d))
            out.append(pd.DataFrame({"q1": q1, "q2": q2, "c1": found["c1"].to_numpy()[near],
                                     "c2": found["c2"].to_numpy()[near], "d": d[near]}))
        return pd.concat(out, ignore_index=True)

    indexed = points.mapInPandas(buckets, f"t int, key long, c1 long, c2 long, v {points.schema['v'].dataType.simpleString()}")
    asked = rows.filter("asks").select(*point, "v").dropDuplicates(point)
    visits = asked.mapInPandas(probed, f"t int, key long, q1 long, q2 long, qv {rows.schema['v'].dataType.simpleString()}")
    near = (
        indexed.groupBy("t", "key")
        .cogroup(visits.groupBy("t", "key"))
        .applyInPandas(nearest_in_bucket, "q1 long, q2 long, c1 long, c2 long, d double")
        .groupBy("q1", "q2", "c1", "c2")
        .agg(F.min("d").alias("d"))
    )
    ranked = near.join(members.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "vec_id"), ["c1", "c2"])
    order = [F.col("score"), F.col("vec_id").asc_nulls_last()]
    kept = _best(ranked.select("q1", "q2", "c1", "c2", "vec_id", F.col("d").alias("score")), ["q1", "q2"], order, k + 1)
    asking = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    query_points = points.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("qv"))
    found = (
        asking.dropDuplicates()
        .join(kept, ["q1", "q2"])
        .filter(~F.col("vec_id").eqNullSafe(F.col("query_id")))
        .select("query_id", "q1", "q2", "c1", "c2", "vec_id", "score")
    )
    found = _best(found, ["query_id", "q1", "q2"], order, k)
    # The reported score: the exact measure, summed in component order by Spark.
    found = (
        found.join(points.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "v"), ["c1", "c2"])
        .join(query_points, ["q1", "q2"])
        .select("query_id", "q1", "q2", "vec_id", F.sqrt(squared_distance("qv", "v")).alias("score"))
    )
    found = saved(found, "ann-found")
    # Queries that found fewer than k: exactly, against all rows, in blocks.
    others = rows.agg(F.count("*")).first()[0]
    short = (
        asking.dropDuplicates()
        .join(found.groupBy("query_id", "q1", "q2").agg(F.count("*").alias("n")), ["query_id", "q1", "q2"], "left")
        .filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.lit(others - 1)))
        .select("query_id", "q1", "q2")
    )
    exact = exact_scan(rows, short.join(query_points, ["q1", "q2"]), k)
    answered = found.join(short, ["query_id", "q1", "q2"], "left_anti").unionByName(exact)
    window = Window.partitionBy("query_id", "q1", "q2").orderBy(*order)
    return answered.select(
        "query_id", F.row_number().over(window).cast("int").alias("rank"), "vec_id", "score"
    )


def exact_scan(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, q1, q2, vec_id, score`` of each query's ``k`` nearest rows by a full scan.

    ``queries`` (``query_id, q1, q2, qv``) go to the tasks in blocks of ``QUERY_BLOCK``; each task keeps its ``k`` best per
    query, and these are merged by Spark.
    """
    spark = rows.sparkSession
    schema = "query_id long, q1 long, q2 long, vec_id long, score double"
    total = queries.count()
    if total == 0:
        return spark.createDataFrame([], schema)
    numbered = saved(queries.withColumn("_b", F.floor(F.rand(SEED) * F.lit((total + QUERY_BLOCK - 1) // QUERY_BLOCK))), "ann-short")
    results = []
    for (block,) in numbered.select("_b").distinct().collect():
        got = numbered.filter(F.col("_b") == block).collect()
        ids = [r.query_id for r in got]
        q = np.array([r.qv for r in got], dtype=np.float64)
        keys = [(r.q1, r.q2) for r in got]

        def scan(batches: Iterator[pd.DataFrame], q=q, ids=ids, keys=keys) -> Iterator[pd.DataFrame]:
            best: list[list[tuple]] = [[] for _ in ids]
            for batch in batches:
                v = _vectors(batch["v"], q.shape[1])
                vid = batch["vec_id"]
                ranks = vid.to_numpy(dtype="float64", na_value=np.inf)
                for i, own in enumerate(ids):
                    d = np.sqrt(((v - q[i]) ** 2).sum(axis=1))
                    pick = np.flatnonzero(ranks != own)
                    take = pick[np.lexsort((ranks[pick], d[pick]))[:k]]
                    best[i] = sorted(
                        best[i] + [(float(d[j]), None if pd.isna(vid.iat[j]) else int(vid.iat[j])) for j in take],
                        key=lambda s: (s[0], s[1] is None, s[1] or 0),
                    )[:k]
            out = [(ids[i], keys[i][0], keys[i][1], v_id, score) for i in range(len(ids)) for score, v_id in best[i]]
            yield pd.DataFrame(out, columns=["query_id", "q1", "q2", "vec_id", "score"]).astype({"vec_id": "Int64"})

        partial = rows.select("vec_id", "v").mapInPandas(scan, schema)
        results.append(_best(partial, ["query_id", "q1", "q2"], [F.col("score"), F.col("vec_id").asc_nulls_last()], k))
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    return merged
