"""Nearest neighbours (op11), the conversation prefix trie (op12) and vector codes (op13) against plain versions."""

import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm.codebooks import compress_vectors, hilbert_keys, vector_codes
from quarry.llm.neighbours import nearest_neighbours
from quarry.llm.prefix_trie import DoubleArray, prefix_trie, rebuilt_conversations
from quarry.llm.queries import QUERIES
from quarry.session import ship_package

from .plain_trie import rebuilt, trie

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_neighbours(rows, k=10, every=100):
    """``{query: [(vec_id, distance)]}`` by comparing every usable row."""
    usable = [
        (i, np.array(v, dtype=np.float64))
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    out = {}
    for q, qv in usable:
        if q is None or q % every:
            continue
        found = sorted(
            ((float(np.sqrt(((v - qv) ** 2).sum())), i) for i, v in usable if i != q),
            key=lambda s: (s[0], s[1] is None, s[1] or 0),
        )
        out[q] = [(i, d) for d, i in found[:k]]
    return out


def got_neighbours(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@needs_tables
def test_neighbour_recall_against_brute_force(spark):
    got = got_neighbours(QUERIES["op11_nearest"](spark, FOLDER))
    table = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    expected = brute_neighbours([(r["vec_id"], r["embedding"]) for r in table])
    assert got.keys() == expected.keys()
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 10 for q in expected])
    assert recall >= 0.9
    for q, hits in got.items():
        exact = dict((i, d) for i, d in brute_neighbours([(r["vec_id"], r["embedding"]) for r in table], k=10**6)[q])
        assert all(d == pytest.approx(exact[i], abs=1e-12) for i, d in hits)


def test_neighbours_of_awkward_rows(spark):
    ship_package(spark)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 300)]
    rows += [(1000 + 5 * i, [0.5] * 8) for i in range(40)]  # one vector many times, queries among them
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [1.0, None] + [0.0] * 6), (2300, [float("nan")] * 8)]
    rows += [(2400, [float("inf")] + [1.0] * 7), (None, [0.5] * 8), (100, rows[99][1])]  # a repeated row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(7))
    got = got_neighbours(nearest_neighbours(df, df["vec_id"] % 100 == 0))
    expected = brute_neighbours(rows)
    assert set(got) == set(expected)
    for q in (1000, 1100):
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
    assert all(len(v) == 10 for v in got.values())
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nearest_neighbours(empty, empty["vec_id"] % 100 == 0).count() == 0


def test_few_rows_answer_with_all(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = got_neighbours(nearest_neighbours(df, df["vec_id"] == 0))
    assert [i for i, _ in got[0]] == [2, 1]


@needs_tables
def test_prefix_trie_against_plain(spark):
    ship_package(spark)
    table = pq.read_table(f"{FOLDER}/conversations.parquet").to_pylist()
    got = QUERIES["op12_prefix_trie"](spark, FOLDER).select(*NODE).collect()
    expected = trie(rebuilt([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table]))
    assert sorted((tuple(r) for r in got), key=repr) == expected


def test_prefix_trie_of_awkward_conversations(spark):
    long_text = "w" * 200_000
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", None), (0, None, None, "first"),
        (1, 5, "user", "x"), (2, 0, "user", "hi"), (5, 0, "system", long_text), (5, 1, "user", "ü"),
        (6, 0, "user", "other"), (7, 0, "user", "other"), (7, 0, "user", "other"),
        (None, 0, "user", "lost"), (-3, 0, "user", "neg"), (-5, 0, "user", "neg"), (10, 0, "user", "hi"),
        (11, 0, "user", "hi"), (12, 0, "user", "hi"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = df.withColumn("pos", F.lit(9)).withColumn("turns", F.lit("x")).withColumn("key", F.lit(1))
    got = prefix_trie(rebuilt_conversations(clashing)).select(*NODE).collect()
    assert sorted((tuple(r) for r in got), key=repr) == trie(rebuilt(rows))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(rebuilt_conversations(empty)).count() == 0


def test_double_array_walks_every_prefix():
    sequences = sorted({(1,), (1, 2), (1, 2, 3), (2, 1), (3,), ()} | {(4, i) for i in range(1, 50)})
    arrays = DoubleArray(list(sequences))
    seen = {}
    for s in sequences:
        for depth, state in enumerate(arrays.walk(s)):
            assert seen.setdefault(state, s[:depth]) == s[:depth]
    assert len(seen) == len({s[:d] for s in sequences for d in range(len(s) + 1)})


def plain_codes(rows, parts, entries, rounds, scale=256):
    kept = sorted(
        ((i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows
         if v is not None and all(x is not None and math.isfinite(x) for x in v)),
        key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[2]),
    )
    width = len(kept[0][2]) // parts
    split = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    book = [[list(split[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = [[list(c) for c in bp] for bp in book]
        for p in range(parts):
            groups = {}
            for s in split:
                groups.setdefault(nearest(p, s[p])[0], []).append(s[p])
            for e, members in groups.items():
                new[p][e] = [sum(col) // len(members) for col in zip(*members)]
        book = new
    out = {}
    for (i, l, _), s in zip(kept, split):
        found = [nearest(p, s[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), l)
    return out, book


def test_codes_against_plain_kmeans(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(i % 3) if i % 7 else None, (rng.integers(-3, 3, 8) / 64).tolist()) for i in rng.permutation(700)]
    rows += [(900, 1, None), (901, 1, [0.1, None] + [0.0] * 6), (902, 2, [float("nan")] * 8), (903, 2, [float("inf")] * 8)]
    rows += [(5000, 2, rows[0][2])] * 3  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit(1)).withColumn("v", F.lit("x"))
    codes, book = compress_vectors(df, parts=4, entries=16, rounds=2)
    expected, plain_book = plain_codes(rows, 4, 16, 2)
    assert book.tolist() == plain_book
    got = codes.collect()
    assert len(got) == 703 and {r.vec_id for r in got} == set(expected)
    assert sum(r.vec_id == 5000 for r in got) == 3
    assert all((r.code, r.error) == expected[r.vec_id][:2] for r in got)
    table = vector_codes(df, parts=4, entries=16, rounds=2).collect()
    by_label = {}
    for r in got:
        by_label[r.label] = by_label.get(r.label, 0) + r.error
    assert all(r.label_error == by_label[expected[r.vec_id][2]] for r in table)
    assert len({r.codebooks_sha256 for r in table}) == 1


def test_codes_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, [0.5, -0.5]), (2, 0, [0.25, 0.0])], "vec_id long, label int, embedding array<float>")
    codes, book = compress_vectors(df, parts=2, entries=64, rounds=2)
    assert book.shape == (2, 2, 1)
    assert {r.vec_id: r.code for r in codes.collect()} == {1: "0000", 2: "0101"}
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes(empty).count() == 0


def test_hilbert_keys_follow_the_curve():
    points = np.array([[x, y] for x in range(4) for y in range(4)])
    order = sorted(range(16), key=lambda i: bytes(hilbert_keys(points, 2)[i]))
    path = points[order]
    assert all(np.abs(path[i + 1] - path[i]).sum() == 1 for i in range(15))
