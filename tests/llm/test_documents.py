import hashlib
import random

import numpy as np
import pytest

from quarry.llm import near_copies as near
from quarry.llm.components import connected_components
from quarry.llm.decontaminate import contamination, drop_contaminated, proximity_matches
from quarry.llm.exact_copies import drop_exact_copies, exact_copies
from quarry.llm.quality import drop_rejected, score_quality, train
from quarry.session import ship_package

from .plain import by, hits, joined, near_classes

SCHEMA = "doc_id long, text string, component_id string, kept int"


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    ship_package(spark)
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def varied(seed, groups, copies, words=400, rate=0.04):
    chance = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    rows = []
    for _ in range(groups):
        base = [chance.choice(vocabulary) for _ in range(chance.randint(2, 90))]
        for _ in range(chance.choice(copies)):
            chosen = chance.random() * rate
            rows.append(" ".join(chance.choice(vocabulary) if chance.random() < chosen else w for w in base))
    ids = list(range(len(rows)))
    chance.shuffle(ids)
    return list(zip(ids, rows))


EDGES = [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One"), (5004, "one"), (5005, "a b"), (5006, "A  B")]


def test_exact_copies(spark):
    rows = [(k % 7 * 3 + k, f"text {k % 5}") for k in range(40)] + EDGES + [(None, "one"), (None, "alone"), (5003, "One")]
    got = exact_copies(table(spark, rows)).collect()
    groups = by(rows, lambda r: r[1] or "")
    expected = []
    for text, members in groups.items():
        ids = [i for i, _ in members if i is not None]
        keep = max(ids) if ids else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        expected += [(i, keep, len(members), i == keep, digest) for i, _ in members]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    left = drop_exact_copies(table(spark, rows))
    assert left.columns == ["doc_id", "text", "component_id", "kept"]
    assert sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert drop_exact_copies(table(spark, [(1, "a"), (1, "a"), (0, "a")])).count() == 1
    assert exact_copies(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"region": 20, "block_nodes": 30}, {"block_shingles": 3000}])
def test_near_copies(spark, limits):
    rows = varied(3, 25, [1, 1, 2, 5]) + EDGES
    hub = [f"h{k}" for k in range(100)]
    chance = random.Random(4)
    for k in range(80):
        rate = chance.random() * 0.05
        rows.append((2000 + k, " ".join(f"z{chance.random()}" if chance.random() < rate else w for w in hub)))
    got = near.near_copies(table(spark, rows), words=4, percent=80, **limits).collect()
    expected = near_classes(rows, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_drop_near_copies(spark):
    rows = varied(5, 15, [1, 2, 4]) + EDGES
    left = near.drop_near_copies(table(spark, rows), words=5, percent=80)
    assert left.columns == ["doc_id", "text", "component_id", "kept"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in near_classes(rows, 5, 80).items() if i == c)
    odd = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u"), (None, "q r s t u"), (3, None), (3, None), (1, "z y x w v u")]
    got = near.drop_near_copies(table(spark, odd)).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(
        map(str, [(1, "a b c d e f"), (None, "q r s t u"), (3, None), (3, None), (1, "z y x w v u")])
    )
    assert near.near_copies(table(spark, odd).limit(0)).count() == 0


def test_exact_links_are_whole():
    chance = np.random.default_rng(1)
    base = chance.choice(10_000, 100, replace=False)
    sets = []
    for _ in range(60):
        size = int(chance.integers(0, 30))
        sets.append(np.unique(np.concatenate([base[size:], chance.choice(10**6, size)])).astype(np.uint64))
    pairs = []
    for a in range(60):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                pairs.append((a, b))
    assert joined(range(60), near.exact_links(sets, 80)) == joined(range(60), pairs)


def template_family(name, members, core, private, seed):
    """Texts with a similarity below 0.8 by words, but for the pairs (0, 1), (2, 3) and so on of the first 40: these reach it."""
    chance = random.Random(seed)
    texts = []
    for k in range(members):
        pair = k // 2 if k < 40 else f"alone{k}"
        own = [f"{name}p{pair}x{j}" for j in range(private)] + [f"{name}u{k}x{j}" for j in range(100 - core - private)]
        words = [f"{name}c{j}" for j in range(core)] + own
        chance.shuffle(words)
        texts.append(" ".join(words))
    return texts


# Of 100 words 87 are common to all: 87 of 113; in a pair 89 of 111.
@pytest.mark.parametrize("limits", [{"block_nodes": 30}, {"block_shingles": 2500}])
def test_near_copies_in_a_template_family(spark, limits):
    rows = list(enumerate(template_family("a", 250, 87, 2, 1)))
    got = near.near_copies(table(spark, rows), words=1, percent=80, region=60, **limits).collect()
    assert {r.doc_id: (100, r.doc_id - r.doc_id % 2 if r.doc_id < 40 else r.doc_id) for r in got} == {
        r.doc_id: (r.n_shingles, r.component_id) for r in got
    }


def test_parts_are_bounded_each_by_its_own_sum(spark):
    same = bytes(4 * near.HASHES)
    rows = [(b"s", b"s%02d" % k, 10, same) for k in range(40)] + [(b"t", b"t%02d" % k, 1000, same) for k in range(8)]
    trees = near.forest(spark.createDataFrame(rows, "root binary, node binary, n_shingles long, values binary"), "root")
    found = near.regions(trees.filter("tree = 0").coalesce(1), 40, "root", shingles=3000).collect()
    parts = by(found, lambda r: bytes(r.region)).values()
    # Rows dealt out by range may part anywhere; none is cut for the sake of the long ones.
    assert all(len(part) <= 3 for part in parts if part[0].node.startswith(b"t"))
    assert max(len(part) for part in parts if part[0].node.startswith(b"s")) > 3


def test_near_copies_without_ids(spark):
    text = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(text)), (None, " ".join([*text[:59], "other"])), (None, "a b c d e")]
    got = near.near_copies(table(spark, [*rows, (7, "f g h i j")]))
    assert sorted((r.doc_id is None, r.component_id) for r in got.collect() if r.doc_id) == [(False, 7)]
    left = near.drop_near_copies(table(spark, rows)).collect()
    assert len(left) == 2 and (None, "a b c d e") in [(r.doc_id, r.text) for r in left]


def test_rarest_shingles_meet():
    chance = np.random.default_rng(3)
    for _ in range(200):
        counts = chance.integers(0, 4, near.CELLS)
        union = chance.integers(0, 2**63, int(chance.integers(1, 60)), dtype=np.uint64)
        a, b = (np.unique(union[chance.random(len(union)) < 0.92]) for _ in range(2))
        common = len(np.intersect1d(a, b))
        if len(a) and len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
            assert len(np.intersect1d(near.rarest(a, 80, counts), near.rarest(b, 80, counts)))


def test_exact_links_with_classes():
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 2, 50, 51, 0)]
    links = near.exact_links(sets, 80, [b"x", b"x", b"y", b"z", b"z", b"x"])
    assert len(links) == 1 and links[0] in [(1, 2), (2, 1), (0, 2), (2, 0), (5, 2), (2, 5)]


def test_components(spark):
    chance = random.Random(6)
    pairs = [(k, k + 1) for k in range(60)] + [(chance.randint(100, 300), chance.randint(100, 300)) for _ in range(120)]
    pairs += [(400, k) for k in range(401, 450)]
    got = connected_components(spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long"))
    nodes = {n for pair in pairs for n in pair if pair[0] != pair[1]}
    assert {r.node: r.root for r in got.collect()} == joined(nodes, [p for p in pairs if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def contaminated_fixture():
    chance = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "É", "x1"]
    def words(n):
        return [chance.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(words(chance.randint(1, 40)))) for k in range(12)]
    items += [(12, "the"), (13, None), (14, "!!"), (None, "a b c d e f g h i j"), (3, "Two The"), (3, "Two The")]
    rows = []
    for k in range(60):
        text = words(chance.randint(0, 80))
        if k % 3 == 0:
            item = (chance.choice(items)[1] or "").split()
            begin = chance.randint(0, max(0, len(item) - 12))
            text[10:10] = item[begin : begin + chance.randint(5, 30)]
        rows.append((k, chance.choice([" ", ", ", "\n"]).join(text).title()))
    return items, [*rows, (60, None), (61, ""), (5, rows[5][1]), (5, "a b c d e f g h i j a"), (None, "the")]


def test_contamination(spark):
    items, rows = contaminated_fixture()
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    named = [("null" if i is None else i, t) for i, t in items]
    for window in (10, 4):
        expected = []
        for i, text in rows:
            words, hit, found = hits(text, named, window)
            digest = hashlib.sha256(",".join(found).encode()).hexdigest()
            expected.append((i, len(words), len(hit), len(found), digest, bool(hit)))
        got = contamination(table(spark, rows), benchmark, window).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    clean = drop_contaminated(table(spark, rows), benchmark)
    assert sorted(map(str, [(r.doc_id, r.text) for r in clean.collect()])) == sorted(
        map(str, [(i, t) for i, t in rows if not hits(t, named, 10)[1]])
    )
    assert clean.columns == ["doc_id", "text", "component_id", "kept"]
    assert contamination(table(spark, rows).limit(0), benchmark).count() == 0
    assert contamination(table(spark, rows), benchmark.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    item = "one rare two three odd four five six seven eight"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    common = "one two three four five six seven eight " * 3
    rows = [(1, f"{common} rare two and then three odd"), (2, f"{common} rare"), (3, f"odd {common} rare"), (4, item)]
    got = proximity_matches(table(spark, rows), benchmark, slop=3)
    assert {r.doc_id for r in got.collect()} == {1, 4}
    exact = proximity_matches(table(spark, rows), benchmark, slop=0)
    assert {r.doc_id for r in exact.collect()} == {4}


def test_quality(spark):
    chance = random.Random(8)
    good = [" ".join(chance.choice(["the", "sea", "was", "calm", "and", "blue"]) for _ in range(40)).capitalize() + "." for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in text.split()) for text in good[:60]]
    texts = good + bad
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (None, good[0]), (0, texts[0])]
    labels = spark.createDataFrame([(k, int(k < 120), "t") for k in range(180)] + [(None, 1, "t"), (5, None, "t")], "doc_id long, quality int, text string")
    docs = table(spark, rows)
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 180]
    assert held and all(r.predicted == int(r.doc_id < 120) for r in held)
    kept = drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    # Neither id nor labels are inputs of a score: the same text has the same score.
    assert len({round(r.score, 9) for r in got if r.doc_id in (None, 0)}) == 1
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_training_with_one_label():
    assert train(np.ones((30, 4)), np.ones(30)).scores(np.ones((1, 4)))[0] > 0.99


def test_the_label_sample_is_bounded(spark):
    from quarry.llm.quality import _sample

    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert 200 < _sample(rows, 300).count() <= 300
    assert _sample(rows, 300).exceptAll(_sample(rows, 301)).count() == 0
    assert _sample(rows, 1000).count() == 1000


def test_words_of_a_block_are_those_of_its_texts(monkeypatch):
    from quarry.llm import quality

    texts = ["", "a b  c", "x" * 100 + " yy " + "z" * 40, "\n \t", "É é!", "THE!!  tail ", "a"]
    whole, counts = quality.tokens_of(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert whole[0] == whole[-1] and len(set(whole.tolist())) == 10
    monkeypatch.setattr(quality, "SLICE", 16)
    quality._powers.cache_clear()
    in_slices, again = quality.tokens_of(texts)
    quality._powers.cache_clear()
    assert (in_slices == whole).all() and (again == counts).all()
    assert len(quality.tokens_of([])[0]) == 0
