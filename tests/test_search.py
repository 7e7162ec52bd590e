import pytest

from quarry.config import SearchSettings
from quarry.operators.embed import HashedWords
from quarry.operators.reports import (
    checks_passed,
    health_checks,
    hits_per_query,
    index_report,
    nested_results,
    norm_report,
    with_documents,
)
from quarry.plans.build import scratch_index
from quarry.plans.search import lexical_search, search, search_both, search_with_documents
from quarry.sources.reviews import documents
from quarry.sources.store import StoredIndex
from tests.test_lexical import okapi

EMBEDDER = HashedWords(32)
TEXTS = {i: f"word{i % 5} word{i % 3} filler " + "rare " * (i == 19) for i in range(20)}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, combined_text string")
    return scratch_index(docs, EMBEDDER, buckets=3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [(1, "word1 filler"), (2, "WORD2 word0"), (3, "nothing known"), (4, "rare")],
        "query_id long, query_text string",
    )


def _rows(df):
    return {(r.query_id, r.doc_id, r.score, r.rank) for r in df.collect()}


def test_weight_zero_is_semantic(index, queries):
    settings = SearchSettings(top_k=6, bm25_weight=0.0)
    assert _rows(search(index, queries, EMBEDDER, settings)) == _rows(
        search(index, queries, EMBEDDER, settings, use_bm25=False)
    )


def test_hybrid_score_from_its_parts(index, queries):
    k = 4
    semantic = {
        (r.query_id, r.doc_id): r.score
        for r in search(index, queries, EMBEDDER, top_k=3 * k, use_bm25=False, min_score=-1.0).collect()
    }
    lexical = okapi(TEXTS, {r.query_id: r.query_text for r in queries.collect()})
    best = {}
    for (q, _), s in lexical.items():
        best[q] = max(best.get(q, 0.0), s)
    got = search(index, queries, EMBEDDER, top_k=k, min_score=-1.0).collect()
    for q in (1, 2, 3, 4):
        scored = sorted(
            (-round(0.7 * s + 0.3 * lexical.get((q, d), 0.0) / (best.get(q, 0) or 1), 9), d)
            for (query, d), s in semantic.items()
            if query == q
        )[:k]
        assert [(r.doc_id, -r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [
            (d, pytest.approx(s)) for s, d in scored
        ]
    assert {r.search_type for r in got} == {"hybrid"}


def test_candidates_limit_what_can_be_found(spark):
    docs = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, "a"), (4, "b " * 50 + "a")], "doc_id long, combined_text string"
    )
    small = scratch_index(docs, EMBEDDER, buckets=2)
    # Document 4 has by far the best BM25 score but is the least similar of the four.
    query = spark.createDataFrame([(1, "a a b")], "query_id long, query_text string")
    assert lexical_search(small, query, 1).first().doc_id == 4
    settings = SearchSettings(top_k=1, bm25_weight=1.0, min_score=None)
    assert search(small, query, EMBEDDER, settings).first().doc_id in (1, 2, 3)


def test_batch_equals_single(index, queries):
    single = set()
    for row in queries.collect():
        single |= _rows(search(index, queries.filter(f"query_id = {row.query_id}"), EMBEDDER))
    assert _rows(search(index, queries, EMBEDDER)) == single


def test_both_equals_each(index, queries):
    both = search_both(index, queries, EMBEDDER, cutoffs=[2, 5])
    for k in (2, 5):
        for kind, bm25 in (("semantic", False), ("hybrid", True)):
            part = both.filter(f"k = {k} AND search_type = '{kind}'")
            assert _rows(part) == _rows(search(index, queries, EMBEDDER, top_k=k, use_bm25=bm25))


def test_ranks_are_contiguous_under_a_threshold(index, queries):
    ranks = {}
    for r in search(index, queries, EMBEDDER, min_score=0.3).collect():
        assert r.score >= 0.3
        ranks.setdefault(r.query_id, []).append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_without_lexicon_it_falls_back_and_says_so(index, queries):
    bare = StoredIndex(index.documents, None, index.settings)
    assert {r.search_type for r in search(bare, queries, EMBEDDER).collect()} == {"semantic"}
    with pytest.raises(ValueError):
        lexical_search(bare, queries)


def test_blank_queries_are_rejected(spark, index):
    for text in ("", "  \t ", None):
        bad = spark.createDataFrame([(7, text)], "query_id long, query_text string")
        with pytest.raises(ValueError, match="blank"):
            search(index, bad, EMBEDDER)


def test_case_does_not_matter(spark, index):
    a = spark.createDataFrame([(1, "Word1 FILLER")], "query_id long, query_text string")
    b = spark.createDataFrame([(1, "word1 filler")], "query_id long, query_text string")
    assert _rows(search(index, a, EMBEDDER)) == _rows(search(index, b, EMBEDDER))


def test_bm25_alone(index, queries):
    got = lexical_search(index, queries, 2).collect()
    assert {r.search_type for r in got} == {"bm25"}
    assert [(r.doc_id, r.rank) for r in got if r.query_id == 4] == [(19, 1)]
    assert not [r for r in got if r.query_id == 3]


def test_sums_per_document_need_no_shuffle(index, queries):
    from quarry.operators.lexical import document_scores
    from quarry.sources.store import with_corpus

    plan = document_scores(index.lexicon, with_corpus(queries))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning(doc_id" not in plan
    # The scan is asked for the terms, so it can skip what lacks them.
    assert "PushedFilters: [In(term," in plan


def test_more_queries_than_a_pass_takes(spark, index, queries, monkeypatch):
    import quarry.plans.search as plans

    expected = {k: _rows(f(index, queries)) for k, f in _searches().items()}
    monkeypatch.setattr(plans, "QUERIES_PER_PASS", 2)
    for k, f in _searches().items():
        assert _rows(f(index, queries)) == expected[k]


def _searches():
    return {
        "hybrid": lambda i, q: search(i, q, EMBEDDER, top_k=4),
        "lexical": lambda i, q: lexical_search(i, q, 3),
        "both": lambda i, q: search_both(i, q, EMBEDDER, cutoffs=[3]).filter("search_type = 'hybrid'"),
    }


def test_hits_with_documents(spark, reviews):
    small = scratch_index(documents(reviews), EMBEDDER, buckets=2)
    query = spark.createDataFrame([(1, "dog food"), (2, "refund")], "query_id long, query_text string")
    hits = search_with_documents(small, query, reviews, EMBEDDER, top_k=1).orderBy("query_id").collect()
    assert [(r.doc_id, r.summary) for r in hits] == [(5, "Great dog food"), (6, "Refund please")]
    unknown = spark.createDataFrame([("all", 1, 99, 0.5, 1)], "corpus_id string, query_id long, doc_id long, score double, rank int")
    assert with_documents(unknown, reviews).first().text is None
    nested = nested_results(with_documents(search(small, query, EMBEDDER), reviews)).collect()
    assert all([h.rank for h in r.results] == list(range(1, r.total_results + 1)) for r in nested)


def test_counts_reports_and_checks(spark, index, queries, reviews):
    counts = hits_per_query(search(index, queries, EMBEDDER, min_score=0.99), queries)
    assert {r.corpus_id for r in counts.collect()} == {"all"}
    assert {r.query_id: r.total_results for r in counts.collect()}[3] == 0
    report = index_report(index).first()
    assert (report.total_documents, report.embedding_dimension, report.bm25_available) == (20, 32, True)
    norms = norm_report(index.documents).first()
    assert norms.min_norm == pytest.approx(1, abs=1e-6) and norms.max_norm == pytest.approx(1, abs=1e-6)
    checks = health_checks(reviews, index.documents)
    assert checks_passed(checks).first().asDict() == {"passed": 5, "total": 5}
    empty = health_checks(reviews.limit(0), index.documents.limit(0))
    assert {r.check_name for r in empty.collect() if not r.ok} == {"reviews_have_rows", "index_has_rows"}
