import math
from collections import Counter

import pytest

from quarry.operators.lexical import (
    Scored,
    best_matches,
    bounded_matches,
    document_scores,
    lexicon,
    normalised_scores,
)

DOCS = {
    1: "the dog ate the food",
    2: "the cat ate",
    3: "The dog and THE cat and the dog",
    4: "a refund for the food",
    5: "",
}
QUERIES = {1: "dog food", 2: "dog dog", 3: "unknown", 4: "the", 5: "Refund the unknown CAT"}


def okapi(docs, queries, k1=1.5, b=0.75, epsilon=0.25):
    words = {i: text.lower().split() for i, text in docs.items()}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = epsilon * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    scores = {}
    for q, text in queries.items():
        for i, ws in words.items():
            tf = Counter(ws)
            shared = [w for w in text.lower().split() if w in tf]
            if shared:
                scores[q, i] = sum(
                    idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / avgdl)) for w in shared
                )
    return scores


def _frames(spark, docs, queries, corpus="c"):
    return (
        spark.createDataFrame([(corpus, i, t) for i, t in docs.items()], "corpus_id string, doc_id long, combined_text string"),
        spark.createDataFrame([(corpus, i, t) for i, t in queries.items()], "corpus_id string, query_id long, query_text string"),
    )


def _scores(df):
    return {(r.query_id, r.doc_id): r.bm25 for r in df.collect()}


@pytest.mark.parametrize("docs", [DOCS, {1: "a b", 2: "a"}, {i: "a b" for i in range(5)}])
def test_equals_the_formula(spark, docs):
    d, q = _frames(spark, docs, QUERIES | {9: "a", 10: "b a a"})
    expected = okapi(docs, QUERIES | {9: "a", 10: "b a a"})
    got = _scores(document_scores(lexicon(d), q))
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, abs=1e-12)


def test_floor_is_used_for_frequent_words(spark):
    d, _ = _frames(spark, DOCS, QUERIES)
    idf = {r.term: r.idf for r in lexicon(d).terms.collect()}
    assert idf["the"] != pytest.approx(math.log(1.5 / 4.5)) and idf["the"] < idf["refund"]


def test_too_many_query_terms_take_the_salted_join(spark, monkeypatch):
    import quarry.operators.lexical as module

    monkeypatch.setattr(module, "POSTINGS_PER_TASK", 1)
    d, q = _frames(spark, DOCS, QUERIES)
    lex = lexicon(d)
    salted = _scores(document_scores(lex, q, broadcast_rows=0))
    direct = _scores(document_scores(lex, q))
    assert salted.keys() == direct.keys()
    assert all(salted[key] == pytest.approx(direct[key]) for key in direct)


def test_corpora_have_statistics_of_their_own(spark):
    first, q1 = _frames(spark, DOCS, QUERIES, "one")
    second, q2 = _frames(spark, {1: "dog dog", 2: "bird"}, QUERIES, "two")
    got = document_scores(lexicon(first.unionByName(second)), q1.unionByName(q2))
    one = _scores(got.filter("corpus_id = 'one'"))
    assert one == pytest.approx(okapi(DOCS, QUERIES))
    two = _scores(got.filter("corpus_id = 'two'"))
    assert two == pytest.approx(okapi({1: "dog dog", 2: "bird"}, QUERIES))


def test_empty_documents_count_for_the_average_length(spark):
    d, _ = _frames(spark, DOCS, QUERIES)
    row = lexicon(d).corpora.first()
    assert row.n_docs == 5 and row.avgdl == pytest.approx(21 / 5)


def test_normalised_and_best(spark):
    d, q = _frames(spark, DOCS, QUERIES)
    lex = lexicon(d)
    norm = normalised_scores(document_scores(lex, q)).collect()
    assert max(r.bm25_norm for r in norm if r.query_id == 1) == 1.0
    best = best_matches(lex, q, 1).collect()
    expected = okapi(DOCS, QUERIES)
    for row in best:
        top = max(v for (query, _), v in expected.items() if query == row.query_id)
        assert row.score == pytest.approx(top) and row.rank == 1
    assert {r.query_id for r in best} == {1, 2, 4, 5}


def _rows(df):
    return sorted((r.corpus_id, r.query_id, r.doc_id, r.score, r.rank) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 10])
def test_bounded_matches_equal_best_matches(spark, k):
    d, q = _frames(spark, DOCS, QUERIES)
    lex = lexicon(d)
    assert _rows(bounded_matches(lex, q, k)) == _rows(best_matches(lex, q, k))


def test_bounds_leave_documents_of_frequent_words_unsummed(spark):
    words = [f"w{i}" for i in range(40)]
    docs = {i: f"the and of {words[i % 40]} {words[(i * 7) % 40]}" + (" zebra stripes" if i % 1500 == 0 else "") for i in range(12000)}
    queries = {1: "the zebra", 2: "of stripes and", 3: "zebra"}
    d, q = _frames(spark, docs, queries)
    lex = lexicon(d)
    scored = Scored()
    assert _rows(bounded_matches(lex, q, 5, scored)) == _rows(best_matches(lex, q, 5))
    assert scored.whole > 30_000
    # 8 documents with a rare word lie in at most 8 of 47 blocks; the rest hold only frequent words and are not summed.
    assert scored.postings < 0.25 * scored.whole
