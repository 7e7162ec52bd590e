import pytest

import quarry.sources.store as store
from quarry.operators.embed import HashedWords
from quarry.operators.lexical import best_matches, document_scores
from quarry.plans.build import add_documents, build_index
from quarry.plans.search import lexical_search, search
from quarry.session import fresh_path
from quarry.sources.store import buckets_with_room, commits, load_index, with_corpus

EMBEDDER = HashedWords(16)


def _docs(spark, ids):
    return spark.createDataFrame([(i, f"text number {i} of {i % 7}") for i in ids], "doc_id long, combined_text string")


def test_full_buckets_take_no_more_batches(spark, monkeypatch):
    monkeypatch.setattr(store, "CHARACTERS_PER_BUCKET", 100)
    path, other = fresh_path(spark, "g"), fresh_path(spark, "g")
    build_index(_docs(spark, range(10)), EMBEDDER, path, buckets=2)
    for end in (12, 60, 64, 300):
        assert add_documents(_docs(spark, range(end)), EMBEDDER, path) > 0
    assert add_documents(_docs(spark, range(300)), EMBEDDER, path) == 0
    done = commits(spark, path)
    buckets = [row.buckets for row in done]
    # The small batches stay with the buckets of before; the large ones get enough for the whole index.
    assert buckets[0] == buckets[1] == 2 and buckets[1] < buckets[2] == buckets[3] < buckets[4]
    for n in set(buckets):
        held = sum(row.n_characters for row in done if row.buckets == n)
        assert held <= store.FULL_BUCKET * n * 100

    build_index(_docs(spark, range(300)), EMBEDDER, other, buckets=3)
    grown, whole = load_index(spark, path), load_index(spark, other)
    assert len(grown.lexicon.parts) == 3 and len(whole.lexicon.parts) == 1
    queries = spark.createDataFrame([(1, "number 7"), (2, "text of 3 3"), (3, "of 250")], "query_id long, query_text string")

    def rows(df):
        return sorted((r.query_id, r.doc_id, round(r[-1], 9)) for r in df.collect())

    asked = with_corpus(queries)
    names = ["query_id", "doc_id", "bm25"]
    assert rows(document_scores(grown.lexicon, asked).select(names)) == rows(
        document_scores(whole.lexicon, asked).select(names)
    )
    names = ["query_id", "doc_id", "rank", "score"]
    assert rows(search(grown, queries, EMBEDDER).select(names)) == rows(search(whole, queries, EMBEDDER).select(names))
    assert rows(best_matches(grown.lexicon, asked, 5).select(names)) == rows(
        best_matches(whole.lexicon, asked, 5).select(names)
    )
    assert rows(lexical_search(grown, queries, 5).select(names)) == rows(lexical_search(whole, queries, 5).select(names))


@pytest.mark.parametrize("held, fresh, expected", [(100, 100, 1), (0, 2_000, 21), (100, 101, 3)])
def test_buckets_with_room(spark, monkeypatch, held, fresh, expected):
    monkeypatch.setattr(store, "CHARACTERS_PER_BUCKET", 100)
    done = [store.Row(buckets=1, n_characters=held or 100)]
    assert buckets_with_room(spark, done, 1, fresh) == expected
    assert buckets_with_room(spark, [], 7, fresh) == 7
