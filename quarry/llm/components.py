"""Connected components of a graph that is a table of edges.

Two steps take turns: every node hands its larger neighbours over to its smallest one, then every node hands its smaller
neighbours over to the smallest of them. Paths halve, so the rounds grow as the logarithm of the longest path, and
what is left are stars. Each round is written to the shared folder, so lineage stays short. The smallest neighbour comes from
an aggregate and a join, never from a window, so that no task holds the edges of a hub. No round has more edges than the one
before, so it is written by as many tasks as those fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import saved


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with ``a < b``."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.union(least.select(F.col("m").alias("a"), "b"))


def _round(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple]:
    """``edges``, of which there are at most ``most``, saved, with their number and a sum of their hashes."""
    seen = Observation()
    state = [F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))").alias("h")]
    kept = saved(edges.observe(seen, *state), "edges", most)
    return kept, (seen.get.get("n", 0), seen.get.get("h"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node of the component.

    Loops and repeated edges do no harm; edges with a null end are left out. No edges, no rows.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links, state = _round(links.distinct())
    while True:
        links, after = _round(_small_star(_large_star(links)).distinct(), state[0])
        if after == state:
            break
        state = after
    roots = links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
