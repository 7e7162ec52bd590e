import math

import pytest

from quarry.operators.embed import HashedWords
from quarry.operators.evaluate import compare, judged, precision_at_k, ranking_metrics
from quarry.plans.goldset import evaluate, gold_documents, index_gold_set
from quarry.sources.goldset import judged_reviews, judgement_counts, judgements, label_map

EMBEDDER = HashedWords(32)


@pytest.fixture
def gold(spark):
    rows = [(5, "YES", "NO"), (6, "NO", "YES"), (7, None, "yes"), (1, None, "NO"), (99, "YES", None)]
    return spark.createDataFrame(rows, "doc_id long, `dog got sick` string, refund string")


def test_judgements_by_column_name(gold):
    long = judgements(gold)
    assert long.count() == 3 + 4
    assert {r.doc_id for r in judgements(gold, ["dog got sick"]).collect()} == {5, 6, 99}
    with pytest.raises(ValueError, match="no column"):
        judgements(gold, ["other"])


def test_counts_take_exact_labels_and_known_reviews_only(gold, reviews):
    counts = judgement_counts(judgements(gold), reviews).collect()
    got = {r.corpus_id: (r.total_docs, r.relevant_docs, r.irrelevant_docs) for r in counts}
    assert got == {"dog got sick": (2, 1, 1), "refund": (4, 1, 2)}


def test_join_with_reviews(gold, reviews):
    rows = judged_reviews(judgements(gold), reviews).collect()
    assert {(r.corpus_id, r.doc_id) for r in rows} == {
        ("dog got sick", 5), ("dog got sick", 6), ("refund", 5), ("refund", 6), ("refund", 7), ("refund", 1),
    }
    texts = {r.doc_id: r.combined_text for r in gold_documents(judgements(gold), reviews).collect()}
    assert texts[1] == "" and texts[5] == "Great dog food my dog loves this food"


def test_repeated_judgements_become_one(spark):
    rows = [("c", 1, "NO"), ("c", 1, "YES"), ("c", 1, "yes"), ("c", 2, "NO"), ("c", 2, "maybe"), ("c", 3, "x"), ("c", 3, "y")]
    got = label_map(spark.createDataFrame(rows, "corpus_id string, doc_id long, label string")).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, "YES"), (2, "NO"), (3, "y")]


def test_ranking_metrics(spark):
    hits = spark.createDataFrame(
        [("c", 1, d, 0.5, r, "semantic", 4) for r, d in enumerate([9, 1, 8, 2], start=1)],
        "corpus_id string, query_id long, doc_id long, score double, rank int, search_type string, k int",
    )
    labels = spark.createDataFrame(
        [("c", 1, "YES"), ("c", 2, "YES"), ("c", 3, "YES"), ("c", 9, "NO")], "corpus_id string, doc_id long, label string"
    )
    queries = spark.createDataFrame([("c", 1), ("c", 2), ("d", 1)], "corpus_id string, query_id long")
    got = {(r.corpus_id, r.query_id): r for r in ranking_metrics(hits, labels, queries, [4], ["semantic"]).collect()}
    row = got["c", 1]
    assert row.recall == pytest.approx(2 / 3) and row.reciprocal_rank == 0.5
    assert row.average_precision == pytest.approx((1 / 2 + 2 / 4) / 3)
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert row.ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal)
    for empty in (got["c", 2], got["d", 1]):
        assert (empty.recall, empty.reciprocal_rank, empty.average_precision, empty.ndcg) == (0, 0, 0, 0)


def test_precision_divides_by_k(spark):
    hits = spark.createDataFrame(
        [("c", 1, d, 0.5, r, "semantic", 3) for r, d in enumerate([1, 2, 3, 4], start=1)],
        "corpus_id string, query_id long, doc_id long, score double, rank int, search_type string, k int",
    )
    labels = spark.createDataFrame(
        [("c", 1, "YES"), ("c", 2, "yes"), ("c", 4, "YES")], "corpus_id string, doc_id long, label string"
    )
    queries = spark.createDataFrame([("c", 1), ("c", 2)], "corpus_id string, query_id long")
    got = precision_at_k(hits, labels, queries, [3, 0], ["semantic"]).collect()
    result = {(r.query_id, r.k): (r.relevant_in_top_k, r.precision_at_k) for r in got}
    assert result == {(1, 3): (1, 1 / 3), (2, 3): (0, 0.0), (1, 0): (0, 0.0), (2, 0): (0, 0.0)}
    assert {r.doc_id: r.label for r in judged(hits, labels).collect()}[3] == "UNKNOWN"


def test_whole_evaluation(spark, gold, reviews):
    index, labels = index_gold_set(gold, reviews, EMBEDDER, buckets=2)
    assert {r.corpus_id: r.n_docs for r in index.lexicon.corpora.collect()} == {"dog got sick": 2, "refund": 4}
    queries = spark.createDataFrame(
        [("dog got sick", 1, "dog food"), ("refund", 2, "refund")],
        "corpus_id string, query_id long, query_text string",
    )
    report = evaluate(index, labels, queries, [1, 15], EMBEDDER)
    got = {(r.query_id, r.k, r.search_type): r.precision_at_k for r in report.collect()}
    assert got[1, 1, "semantic"] == got[1, 1, "hybrid"] == got[2, 1, "hybrid"] == 1.0
    assert got[2, 15, "semantic"] == pytest.approx(1 / 15)
    assert all(r.improvement == r.hybrid_precision - r.semantic_precision for r in compare(report).collect())


def test_gold_set_without_reviews(spark, gold, reviews):
    with pytest.raises(ValueError, match="no documents"):
        index_gold_set(gold, reviews.limit(0), EMBEDDER, buckets=2)
