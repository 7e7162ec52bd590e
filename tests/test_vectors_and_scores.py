import math

import pytest
from pyspark.sql import functions as F

from quarry.functions.scores import at_least, best_of_task, blend, last_entry_wins, max_normalised, top_k
from quarry.functions.vectors import inner_product, l2_normalise, norm


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, -1.0])], "a array<float>, b array<float>")
    row = df.select(
        norm("a").alias("n"), inner_product("a", "b").alias("p"), l2_normalise("a").alias("u")
    ).first()
    assert row.n == 5.0 and row.p == -1.0
    assert row.u == pytest.approx([0.6, 0.8])


def test_zero_vector_is_left_alone(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "a array<float>")
    assert df.select(l2_normalise("a").alias("u")).first().u == [0.0, 0.0]


def test_minimum_drops_nan_and_negative_scores(spark):
    df = spark.createDataFrame([(0.0,), (-0.1,), (float("nan"),), (0.5,)], "score double")
    assert sorted(r.score for r in df.filter(at_least("score", 0.0)).collect()) == [0.0, 0.5]
    assert df.filter(at_least("score", None)).count() == 3


def test_normalising_by_a_maximum_that_is_not_positive(spark):
    df = spark.createDataFrame([(2.0, 4.0), (0.0, 0.0), (-1.0, -1.0)], "s double, m double")
    assert [r.x for r in df.select(max_normalised("s", "m").alias("x")).collect()] == [0.5, 0.0, -1.0]


def test_blend(spark):
    df = spark.createDataFrame([(0.5, 1.0)], "a double, b double")
    assert df.select(blend("a", "b", 0.3).alias("x")).first().x == pytest.approx(0.65)


@pytest.mark.parametrize("shards", [None, 3])
def test_top_k_breaks_ties_by_id(spark, shards):
    rows = [("c", 1, i, 1.0) for i in range(9, 0, -1)] + [("c", 1, 50, 2.0), ("c", 2, 1, 0.1)]
    df = spark.createDataFrame(rows, "corpus_id string, query_id int, doc_id long, score double")
    shard = None if shards is None else F.pmod("doc_id", F.lit(shards))
    got = top_k(df, 3, shards=shard).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got) == [
        (1, 1, 50), (1, 2, 1), (1, 3, 2), (2, 1, 1),
    ]


def test_of_repeated_documents_the_lowest_score_stays(spark):
    rows = [("c", 1, 7, 0.9), ("c", 1, 7, 0.2), ("c", 1, 8, 0.5)]
    df = spark.createDataFrame(rows, "corpus_id string, query_id int, doc_id long, score double")
    assert {r.doc_id: r.score for r in last_entry_wins(df).collect()} == {7: 0.2, 8: 0.5}
    assert math.isclose(last_entry_wins(df).agg(F.sum("score")).first()[0], 0.7)


def test_best_of_task_keeps_queries_without_ids(spark):
    rows = [("c", None, k, float(k)) for k in range(3)] + [(None, 4, k, float(k)) for k in range(3)] + [("c", 4, 0, 1.0)]
    hits = spark.createDataFrame(rows, "corpus_id string, query_id long, doc_id long, score double").coalesce(1)
    got = {tuple(r) for r in best_of_task(hits, 2).collect()}
    assert got == {("c", None, 2, 2.0), ("c", None, 1, 1.0), (None, 4, 2, 2.0), (None, 4, 1, 1.0), ("c", 4, 0, 1.0)}
