"""The registered queries: those with SQL against DuckDB, the pipeline against a plain version."""

import os
import zlib

import pytest

import corpus_pipeline
from quarry.llm.queries import ORACLES, QUERIES
from quarry.llm.quality import score_quality
from quarry.session import ship_package

from .plain import WORD, hits, near_classes

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for view in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    got = QUERIES[name](spark, FOLDER).toArrow()
    expected = con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)

    def rows(found):
        return sorted(map(repr, zip(*[found[c].to_pylist() for c in columns])))

    assert rows(got) == rows(expected)


def test_token_count_query(spark):
    got = QUERIES["op1_token_counts"](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got.join(documents, "doc_id").filter("n_tokens >= n_words and n_words > 0").count() == documents.count()


def test_main_text_query(spark):
    """In these pages the article is what lies in its element."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for row in QUERIES["op6_main_text"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split("</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(part for part in parts if part)


def test_quality_query(spark):
    folder = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in QUERIES["op7_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(scores[r.doc_id].predicted, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(scores[r.doc_id].held_out for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_pipeline(spark):
    ship_package(spark)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in score_quality(documents, labels).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in documents.collect() if r.doc_id in good}
    last = {text: max(i for i, t in texts.items() if t == text) for text in texts.values()}
    texts = {i: t for t, i in last.items()}
    texts = {i: texts[i] for i, (_, root) in near_classes(list(texts.items()), 5, 80).items() if i == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i, t in texts.items() if not hits(t, items, 10)[1]}
    assert all(WORD.findall(texts[i]) for i in clean)
    pieces = corpus_pipeline.run(spark, FOLDER).orderBy("sequence_id", "offset").collect()
    assert {p.doc_id for p in pieces} == clean
    lengths = {p.doc_id: 0 for p in pieces}
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert all(lengths[p.doc_id] == p.doc_tokens for p in pieces)
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
