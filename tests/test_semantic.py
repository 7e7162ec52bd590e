import numpy as np
import pytest

from quarry.operators.semantic import nearest

INDEX = "corpus_id string, doc_id long, embedding array<float>"
QUERY = "corpus_id string, query_id long, query_vector array<float>"


def _random(spark, n, q, corpora=("a",), seed=1):
    rng = np.random.default_rng(seed)
    docs = [(corpora[i % len(corpora)], i, rng.normal(size=8).tolist()) for i in range(n)]
    queries = [(corpora[i % len(corpora)], i, rng.normal(size=8).tolist()) for i in range(q)]
    return spark.createDataFrame(docs, INDEX).repartition(5), spark.createDataFrame(queries, QUERY)


def _brute_force(index, queries, k):
    docs = index.collect()
    out = set()
    for q in queries.collect():
        v = np.array(q.query_vector)
        scored = [
            (-round(float(np.dot(v, d.embedding)), 9), d.doc_id) for d in docs if d.corpus_id == q.corpus_id
        ]
        out |= {(q.query_id, i, r) for r, (_, i) in enumerate(sorted(scored)[:k], start=1)}
    return out


def _found(df):
    return {(r.query_id, r.doc_id, r.rank) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 5, 500])
def test_equals_brute_force(spark, k):
    index, queries = _random(spark, 300, 7, ("a", "b"))
    assert _found(nearest(index, queries, k)) == _brute_force(index, queries, k)


def test_large_query_sets_take_passes_and_agree(spark):
    index, queries = _random(spark, 200, 23, ("a", "b"))
    passes = nearest(index, queries, 4, queries_per_pass=9)
    assert _found(passes) == _found(nearest(index, queries, 4))


def test_vectors_are_never_shuffled(spark, tmp_path):
    """Nor copied, with more queries than one pass takes."""
    path = str(tmp_path / "i")
    _random(spark, 50, 1)[0].write.parquet(path)
    index, (_, queries) = spark.read.parquet(path), _random(spark, 1, 4097)
    plan = nearest(index, queries.limit(4096), 2)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below and "Generate" not in below
    assert nearest(index, queries, 2).count() == 2 * 4097


def test_copies_are_ranked_by_id(spark):
    docs = [("a", i, [1.0, 0.0]) for i in range(400)] + [("a", 1000, [0.0, 1.0])]
    index = spark.createDataFrame(docs, INDEX).repartition(7)
    queries = spark.createDataFrame([("a", 1, [1.0, 0.0])], QUERY)
    assert _found(nearest(index, queries, 5)) == {(1, i, i + 1) for i in range(5)}


def test_fewer_documents_than_k_and_no_k(spark):
    index, queries = _random(spark, 3, 2)
    assert nearest(index, queries, 10).count() == 6
    assert nearest(index, queries, 0).count() == 0


def test_nan_never_ranks(spark):
    docs = [("a", 1, [float("nan"), 0.0]), ("a", 2, [-1.0, 0.0])]
    queries = spark.createDataFrame([("a", 1, [1.0, 0.0])], QUERY)
    got = nearest(spark.createDataFrame(docs, INDEX), queries, 5).collect()
    assert [(r.doc_id, r.rank, r.score) for r in got] == [(2, 1, -1.0)]


def test_vectors_of_another_length_are_an_error(spark):
    docs = [("a", 1, [1.0, 0.0, 0.0])]
    queries = spark.createDataFrame([("a", 1, [1.0, 0.0])], QUERY)
    with pytest.raises(Exception, match="expected 2"):
        nearest(spark.createDataFrame(docs, INDEX), queries, 5).collect()


def test_only_ids_and_vectors_are_read(spark, tmp_path):
    index, queries = _random(spark, 20, 2)
    index.selectExpr("*", "'long text' AS combined_text").write.parquet(str(tmp_path / "i"))
    plan = nearest(spark.read.parquet(str(tmp_path / "i")), queries, 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "combined_text" not in text and "MapInArrow" in text


def test_shares_of_one_index_merge_to_the_same_result(spark):
    index, queries = _random(spark, 100, 3)
    parts = [index.filter(f"doc_id % 2 = {i}") for i in (0, 1)]
    merged = parts[0].unionByName(parts[1])
    assert _found(nearest(merged, queries, 6)) == _found(nearest(index, queries, 6))
