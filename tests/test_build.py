import shutil

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.config import BuildSettings, ModelSettings, SearchSettings, index_location, jdbc_options
from quarry.operators.embed import HashedWords, StoredVectors
from quarry.operators.reports import index_report
from quarry.operators.semantic import nearest
from quarry.plans.build import add_documents, build_index, scratch_index
from quarry.plans.search import lexical_search, prepared, search, stored_settings
from quarry.session import fresh_path, scratch_dir
from quarry.sources.reviews import (
    document_by_id,
    documents,
    documents_by_id,
    jdbc_scan_options,
    page,
    read_reviews,
    sample_one,
)
from quarry.sources.store import (
    COMMIT_COLUMNS,
    commits,
    failed_rows,
    index_counts,
    load_index,
    load_old_index,
    read_documents,
)
from quarry.streaming.build import index_stream, read_stream

EMBEDDER = HashedWords(16)
ENV = {"DB_USER": "u", "password": "p", "dbname": "d"}


def _docs(spark, ids):
    return spark.createDataFrame([(i, f"text number {i}") for i in ids], "doc_id long, combined_text string")


def _all(df):
    return sorted(map(tuple, df.select("doc_id", "combined_text", "embedding").collect()))


def test_save_and_load(spark):
    path = fresh_path(spark, "t")
    index, stats = build_index(_docs(spark, range(30)), EMBEDDER, path, buckets=3)
    assert stats.documents == 30 and stats.documents_per_second > 0
    loaded = load_index(spark, path)
    assert _all(loaded.documents) == _all(index.documents)
    assert loaded.settings.model == "hashed-words-16" and loaded.settings.bm25_weight == 0.3
    query = spark.createDataFrame([(1, "number 7")], "query_id long, query_text string")
    assert search(loaded, query, EMBEDDER).collect() == search(index, query, EMBEDDER).collect()


def test_a_build_needs_a_fresh_path(spark):
    path = fresh_path(spark, "t")
    build_index(_docs(spark, range(3)), EMBEDDER, path)
    with pytest.raises(FileExistsError, match="already exists"):
        build_index(_docs(spark, range(3)), EMBEDDER, path)


def test_missing_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_index(spark, str(tmp_path / "none"))


def test_repeated_ids_are_found_and_leave_no_index(spark):
    path = fresh_path(spark, "t")
    with pytest.raises(ValueError, match="an id occurs twice"):
        build_index(_docs(spark, [1, 1, 2]), EMBEDDER, path)
    with pytest.raises(FileNotFoundError):
        load_index(spark, path)
    counts = index_counts(EMBEDDER.embed(_docs(spark, [1, 1, 2]), "combined_text", "embedding")).first()
    assert (counts.n_rows, counts.n_vectors, counts.n_ids, counts.n_texts) == (3, 3, 2, 3)


def test_rows_without_a_vector_are_an_error(spark):
    vectors = EMBEDDER.embed(_docs(spark, [1, 2]), "combined_text", "embedding").drop("combined_text")
    with pytest.raises(Exception, match="no stored vector for 3"):
        scratch_index(_docs(spark, [1, 2, 3]), StoredVectors(vectors, 16))
    some = scratch_index(_docs(spark, [1, 2, 3]), StoredVectors(vectors, 16, missing="drop"))
    assert some.settings.n_docs == 2


def test_a_build_that_broke_off_is_no_index(spark):
    """Without a commit, whatever else is there."""
    path = fresh_path(spark, "t")
    build_index(_docs(spark, range(4)), EMBEDDER, path)
    shutil.rmtree(f"{path.removeprefix('file:')}/commits")
    with pytest.raises(FileNotFoundError):
        load_index(spark, path)


def test_an_old_index_is_searched_without_bm25(spark):
    path = fresh_path(spark, "t")
    docs = EMBEDDER.embed(_docs(spark, range(4)), "combined_text", "embedding").drop("combined_text")
    docs.write.parquet(f"{path}/documents")
    old = load_old_index(spark, path)
    assert old.lexicon is None
    query = spark.createDataFrame([(1, "number 2")], "query_id long, query_text string")
    assert search(old, query, EMBEDDER).first().search_type == "semantic"


def test_bm25_can_be_left_out(spark):
    index = scratch_index(_docs(spark, range(4)), EMBEDDER, search=SearchSettings(use_bm25=False))
    assert index.lexicon is None


def test_buckets_are_checked_before_embedding(spark):
    with pytest.raises(ValueError, match="200000 buckets"):
        build_index(_docs(spark, range(3)), _Picky(16), fresh_path(spark, "t"), buckets=200_000)


def _same(spark, path, other, queries=("number 25", "text number 3 25", "number")):
    """Both indexes give the same hits, hybrid and by words."""
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query_text string")
    for find in (lambda i: search(i, asked, EMBEDDER, top_k=5), lambda i: lexical_search(i, asked, 5)):
        assert sorted(find(load_index(spark, path)).collect()) == sorted(find(load_index(spark, other)).collect())


def test_incremental_equals_whole(spark):
    path, other = fresh_path(spark, "t"), fresh_path(spark, "t")
    build_index(_docs(spark, range(0, 20)), EMBEDDER, path, buckets=3)
    assert add_documents(_docs(spark, [*range(15, 30), 29]), EMBEDDER, path) == 10
    assert add_documents(_docs(spark, range(15, 30)), EMBEDDER, path) == 0
    build_index(_docs(spark, range(30)), EMBEDDER, other, buckets=3)
    assert _all(read_documents(spark, path)) == _all(read_documents(spark, other))
    grown = load_index(spark, path)
    assert grown.lexicon.corpora.first().n_docs == grown.settings.n_docs == 30
    _same(spark, path, other)


def test_a_batch_is_committed_once(spark):
    path = fresh_path(spark, "t")
    build_index(_docs(spark, range(5)), EMBEDDER, path)
    assert add_documents(_docs(spark, range(5, 8)), EMBEDDER, path, batch="b") == 3
    assert add_documents(_docs(spark, range(8, 9)), EMBEDDER, path, batch="b") == 0
    assert load_index(spark, path).settings.n_docs == 8


def test_a_lexicon_that_does_not_match_is_refused(spark):
    path = fresh_path(spark, "t")
    build_index(_docs(spark, range(5)), EMBEDDER, path)
    last = commits(spark, path)[-1]
    spark.createDataFrame([Row(**last.asDict() | {"number": 2})], COMMIT_COLUMNS).write.mode("append").parquet(f"{path}/commits")
    with pytest.raises(ValueError, match="does not match"):
        load_index(spark, path)


def test_stored_settings_hold(spark):
    path = fresh_path(spark, "t")
    build_index(_docs(spark, range(9)), EMBEDDER, path, SearchSettings(bm25_weight=0.9))
    index = load_index(spark, path)
    assert stored_settings(index).bm25_weight == 0.9
    query = spark.createDataFrame([(1, "number 7")], "query_id long, query_text string")
    given = search(index, query, EMBEDDER, SearchSettings(bm25_weight=0.9)).collect()
    assert search(index, query, EMBEDDER).collect() == given
    assert search(index, query, EMBEDDER, SearchSettings()).collect() != given
    with pytest.raises(ValueError, match="hashed-words-16"):
        search(index, query, HashedWords(8))


def test_reports_read_neither_texts_nor_vectors(spark):
    index = scratch_index(_docs(spark, range(9)), EMBEDDER)
    plan = index_report(index)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.replace("embedding_", "") and "combined_text" not in plan


class _Picky(HashedWords):
    def encoder(self):
        encode = super().encoder()

        def strict(texts):
            if any(t.endswith(("3", "7")) for t in texts):
                raise ValueError("no")
            return encode(texts)

        return strict


def test_quarantine_and_its_limit(spark):
    path = fresh_path(spark, "q")
    index, stats = build_index(_docs(spark, range(10)), _Picky(16), path, max_errors=2)
    assert (stats.documents, stats.errors) == (8, 2) and index.documents.filter("embedding is null").count() == 0
    failed = {(r.doc_id, r.error) for r in failed_rows(spark, path).collect()}
    assert failed == {(3, "ValueError: no"), (7, "ValueError: no")}
    query = spark.createDataFrame([(1, "number 3 x")], "query_id long, query_text string")
    assert 3 not in {r.doc_id for r in search(index, query, _Picky(16)).collect()}
    other = fresh_path(spark, "q")
    with pytest.raises(Exception, match="2 rows failed"):
        build_index(_docs(spark, range(10)).repartition(1), _Picky(16), other, max_errors=1)
    with pytest.raises(FileNotFoundError):
        load_index(spark, other)


def test_a_task_ends_early(spark, tmp_path):
    """Long before the last row, once it alone has too many failures."""
    seen = str(tmp_path / "seen")

    class Counting(_Picky):
        rows_per_call = 1

        def encoder(self):
            encode = super().encoder()

            def counted(texts):
                with open(seen, "a") as out:
                    out.write("x" * len(texts))
                return encode(texts)

            return counted

    docs = _docs(spark, [13] * 3 + list(range(100, 600))).coalesce(1)
    with pytest.raises(Exception, match="3 rows failed"):
        build_index(docs, Counting(16), fresh_path(spark, "q"), max_errors=2, buckets=2)
    assert len(open(seen).read()) < 100


def test_stream_grows_like_any_index(spark, tmp_path):
    source, path, other = str(tmp_path / "in"), fresh_path(spark, "s"), fresh_path(spark, "s")
    schema = _docs(spark, []).schema

    def run():
        stream = read_stream(spark, source, schema, files_per_batch=1)
        index_stream(stream, EMBEDDER, path, f"{path}/checkpoint", buckets=3).awaitTermination()
        return _all(read_documents(spark, path))

    _docs(spark, range(10)).coalesce(2).write.parquet(source)
    assert len(run()) == 10
    assert add_documents(_docs(spark, range(5, 15)), EMBEDDER, path) == 5
    _docs(spark, range(12, 20)).coalesce(2).write.mode("append").parquet(source)
    assert len(run()) == 20
    assert add_documents(_docs(spark, range(18, 30)), EMBEDDER, path) == 10
    build_index(_docs(spark, range(30)), EMBEDDER, other, buckets=3)
    assert run() == _all(read_documents(spark, other))
    _same(spark, path, other)


def test_search_within_a_filter(spark):
    docs = _docs(spark, range(40)).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    index = scratch_index(docs, EMBEDDER)
    query = spark.createDataFrame([(1, "number 7"), (2, "text")], "query_id long, query_text string")
    hits = search(index, query, EMBEDDER, where="lang = 'a'")
    assert hits.count() == 20 and all(r.doc_id % 2 == 0 for r in hits.collect())
    plan = nearest(index.documents.filter("lang = 'a'"), prepared(query, EMBEDDER), 3)
    assert "EqualTo(lang,a)" in plan._jdf.queryExecution().executedPlan().toString()


def test_review_sources(spark, tmp_path, reviews):
    path = str(tmp_path / "reviews")
    reviews.selectExpr("doc_id AS Id", "summary AS Summary", "text AS Text").write.parquet(path)
    read = read_reviews(spark, path)
    assert sorted(map(str, read.collect())) == sorted(map(str, reviews.collect()))
    assert [r.summary for r in document_by_id(read, 4).collect()] == ["s"]
    assert document_by_id(read, 99).count() == 0
    assert documents_by_id(read, spark.createDataFrame([(4,), (4,), (99,)], "doc_id long")).count() == 1
    assert [r.doc_id for r in page(documents(read), 2, 3).collect()] == [4, 5]
    assert sample_one(documents(read)).first().doc_id == 3
    plan = document_by_id(read, 4)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Id,4)" in plan


def test_settings():
    assert ModelSettings().max_seq_length == 512 and BuildSettings().embed_rows == 256
    s = SearchSettings()
    assert (s.top_k, s.min_score, s.use_bm25, s.bm25_weight) == (10, 0.0, True, 0.3)
    assert index_location("/x/", "a/b-c") == "/x/a_b-c"


def test_database_options():
    options = jdbc_options(ENV)
    assert options["url"] == "jdbc:postgresql://localhost:5432/d" and options["user"] == "u"
    assert jdbc_options(ENV | {"DB_HOST": "h", "port": "1"})["url"].startswith("jdbc:postgresql://h:1/")
    with pytest.raises(ValueError, match="DB_PASSWORD"):
        jdbc_options({"DB_USER": "u", "DB_NAME": "d"})
    scan = jdbc_scan_options("reviews", 1, 1000, 8, ENV)
    assert scan["numPartitions"] == "8" and scan["partitionColumn"] == '"Id"' and scan["fetchsize"] == "500"


def test_scratch_is_removed_on_request(spark, monkeypatch):
    import quarry.session as session

    monkeypatch.setattr(session, "_made", {})
    kept = session.materialise(_docs(spark, range(3)), "t")
    assert kept.count() == 3 and session.clear_scratch(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])
    assert session.clear_scratch(spark) == 0


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def _lexicon_rows(spark, path):
    index = load_index(spark, path)
    lex = index.lexicon
    posted = sorted(tuple(r) for r in lex.postings.select("doc_id", "term", "tf", "dl").collect())
    terms = sorted((r.term, r.df, round(r.idf, 12)) for r in lex.terms.collect())
    sizes = sorted((r.corpus_id, r.n_docs, r.n_words) for r in lex.corpora.collect())
    docs = sorted(r.doc_id for r in index.documents.collect())
    return index.settings.n_docs, posted, terms, sizes, docs


@pytest.mark.parametrize("where", ["postings", "corpora", "term_weights", "_before_commit"])
def test_a_batch_that_broke_off_counts_once_when_tried_again(spark, monkeypatch, where):
    import quarry.sources.store as store

    untroubled = fresh_path(spark, "t")
    build_index(_docs(spark, range(6)), EMBEDDER, untroubled)
    add_documents(_docs(spark, range(6, 11)), EMBEDDER, untroubled, batch="b")

    path = fresh_path(spark, "t")
    build_index(_docs(spark, range(6)), EMBEDDER, path)

    def broken(*args, **kwargs):
        raise RuntimeError("lost executor")

    with monkeypatch.context() as patched:
        patched.setattr(store, where, broken)
        with pytest.raises(RuntimeError, match="lost executor"):
            add_documents(_docs(spark, range(6, 11)), EMBEDDER, path, batch="b")
    assert load_index(spark, path).settings.n_docs == 6
    assert add_documents(_docs(spark, range(6, 11)), EMBEDDER, path, batch="b") == 5
    assert _lexicon_rows(spark, path) == _lexicon_rows(spark, untroubled)
    assert add_documents(_docs(spark, range(6, 11)), EMBEDDER, path, batch="b") == 0


def test_a_stream_keeps_one_error_budget(spark, tmp_path):
    source, path = str(tmp_path / "in"), fresh_path(spark, "s")
    schema = _docs(spark, []).schema

    def run():
        stream = read_stream(spark, source, schema, files_per_batch=1)
        index_stream(stream, _Picky(16), path, f"{path}/checkpoint", buckets=2, max_errors=3).awaitTermination()

    _docs(spark, range(10)).coalesce(1).write.parquet(source)
    run()
    assert load_index(spark, path).settings.n_docs == 8
    assert {r.doc_id for r in failed_rows(spark, path).collect()} == {3, 7}
    _docs(spark, range(20, 30)).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="rows failed"):
        run()
    assert load_index(spark, path).settings.n_docs == 8
    assert {r.doc_id for r in failed_rows(spark, path).collect()} == {3, 7}
