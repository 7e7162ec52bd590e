"""The clustered index: exact search equals the full scan while reading fewer lists; probing reads only its lists."""

import numpy as np
import pytest

from quarry.operators.clustered import Skipped, build_clustered, exact_search, probe_search
from quarry.operators.semantic import nearest
from quarry.session import ship_package


@pytest.fixture(scope="module")
def vectors(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(900):
        v = centres[i % 6] * 3 + rng.standard_normal(16)
        rows.append(("a" if i % 5 else "b", i, v.tolist()))
    rows += [("a", 5000, [0.0] * 16), ("a", 5001, None), ("b", 5002, rows[0][2])]  # zero, none, a repeated vector
    docs = spark.createDataFrame(rows, "corpus_id string, doc_id long, embedding array<double>")
    queries = spark.createDataFrame(
        [(c, q, (centres[q % 6] * 3 + rng.standard_normal(16)).tolist()) for q in range(40) for c in ("a", "b")]
        + [("a", 99, None)],
        "corpus_id string, query_id long, query_vector array<double>",
    )
    return docs, queries, build_clustered(docs, lists=8)


def rows(df):
    return sorted((r.corpus_id, r.query_id, r.doc_id, round(r.score, 9), r.rank) for r in df.collect())


def test_exact_search_equals_the_full_scan_and_skips(vectors):
    docs, queries, index = vectors
    skipped = Skipped()
    assert rows(exact_search(index, queries, 10, skipped)) == rows(nearest(docs, queries, 10))
    assert 0 < skipped.share < 0.6


def test_probing_every_list_equals_the_full_scan(vectors):
    docs, queries, index = vectors
    assert rows(probe_search(index, queries, 10, probes=8)) == rows(nearest(docs, queries, 10))


def test_probing_few_lists_finds_most(vectors):
    docs, queries, index = vectors
    exact = {}
    for r in nearest(docs, queries, 10).collect():
        exact.setdefault((r.corpus_id, r.query_id), set()).add(r.doc_id)
    found = {}
    for r in probe_search(index, queries, 10, probes=2).collect():
        found.setdefault((r.corpus_id, r.query_id), set()).add(r.doc_id)
    recall = np.mean([len(found.get(q, set()) & ids) / len(ids) for q, ids in exact.items()])
    assert recall >= 0.9


def test_a_probe_reads_only_its_lists(vectors):
    _, _, index = vectors
    from pyspark.sql import functions as F

    probed = index.read([2, 5])
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = [r[0] for r in probed.select(F.input_file_name()).distinct().collect()]
    assert files and all("/list=2/" in f or "/list=5/" in f for f in files)
    assert index.sizes.sum() == index.total == 902


def test_no_queries(vectors):
    _, queries, index = vectors
    assert exact_search(index, queries.limit(0), 10).count() == 0
