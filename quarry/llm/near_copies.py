"""Near-duplicate documents by a MinHash LSH forest, with every link confirmed on full shingle sets.

1. A document's set is its distinct shingles of words. Documents with the same set are one node from here on. A node has
   128 MinHash values: 16 trees of 8.
2. Each tree is an order of all nodes by its eight values. Nodes that agree in the first four lie together, and a pair with a
   similarity of 0.8 does so in some tree with a chance of 0.9998. A region of the order that holds more than ``REGION``
   nodes is cut further down, where neighbours have the shortest common prefix: its depth adapts to how dense it is.
3. Within a region, nodes are compared by sketches (a byte of each value) with pivots: the node that agrees most with the whole
   region takes all that look alike, then the next among the rest. That gives about as many candidate links as nodes, and
   not pairs. Their components bring together all nodes that may be linked.
4. The texts of these components come together, and the exact similarity of full sets decides. A component is searched from node
   to node, each compared with those not reached yet. A component too large for one task is taken apart along each of the 16
   orders again, and the links that are found in the parts are joined.
5. Where such a component is in several classes after that, what the parts have missed is looked for without chance: two sets
   as similar as asked share one of their rarest shingles. Sets that share one meet in one task; those that share one with more
   sets than a task may hold are dealt into tiles by size, and every pair of tiles of like size meets in a task.

So copies never become pairs, no task compares more than ``BLOCK_NODES`` nodes, and nothing but names of files and a table of
counts of fixed size passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import saved, small, text_of
from quarry.llm.components import connected_components
from quarry.llm.memory import release_worker_state

TREES, PREFIX, DEEP = 16, 4, 4
HASHES = TREES * (PREFIX + DEEP)
# Agreement of sketches from which nodes are brought together. It lies 5 standard errors below a similarity of 0.8; the
# exact comparison follows.
LOOKS_ALIKE = 0.6
REGION = 1024
# What one task compares at once: nodes, and shingles of all of them.
BLOCK_NODES, BLOCK_SHINGLES = 4096, 6_000_000
# Cells in which shingles are counted to tell the rare ones.
CELLS = 2**18

_random = np.random.default_rng(20)
MULTIPLIERS = _random.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MASKS = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles. A-Z count as lower case, words are what ASCII white space leaves.

    A text with fewer words is one shingle, one without words has none.
    """
    import xxhash

    split = text.encode().lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, split), dtype=np.uint64, count=len(split))
    width = min(words, len(ids))
    with np.errstate(over="ignore"):
        mixed = np.full(len(ids) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            mixed = (mixed ^ ids[k : len(ids) - width + 1 + k]) * MIX
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    low = (shingles ^ shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for begin in range(0, len(low), 512):
        hashed = (low[begin : begin + 512, None] ^ MASKS) * MULTIPLIERS
        hashed ^= hashed >> np.uint32(15)
        np.minimum(least, (hashed * np.uint32(0x2C1B3C6D)).min(axis=0), out=least)
    return least


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, n_shingles, node, values`` per row: ``h`` is a hash of the text, ``node`` the digest of the set, ``values``
    the signature in big-endian bytes, whose order is that of the values; the last two are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        for batch in batches:
            sizes, nodes, values = [], [], []
            for value in batch.column(2):
                shingles = shingle_set(value.as_py(), words)
                sizes.append(len(shingles))
                nodes.append(set_digest(shingles) if len(shingles) else None)
                values.append(signature(shingles).astype(">u4").tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(values, pa.binary()),
                ],
                names=["doc_id", "h", "n_shingles", "node", "values"],
            )

    whole = text_of(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, h long, n_shingles long, node binary, values binary")


def forest(nodes: DataFrame, *more: str) -> DataFrame:
    """``more, tree, order, node, n_shingles``: the nodes in each tree, ``order`` being the eight values of that tree."""
    size = 4 * (PREFIX + DEEP)
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    placed = nodes.select(*more, "node", "n_shingles", "values", F.explode(trees).alias("tree"))
    return placed.select(*more, "tree", F.expr(f"substring(values, tree * {size} + 1, {size})").alias("order"), "node", "n_shingles")


def _cut(orders: list[bytes], limit: int) -> int:
    """Where to cut ``limit + 1`` nodes in order: the shortest common prefix of neighbours in the second half."""
    rows = np.frombuffer(b"".join(orders[limit // 2 : limit + 1]), dtype=">u4").reshape(-1, PREFIX + DEEP)
    common = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return limit // 2 + 1 + int(np.argmin(common))


def regions(trees: DataFrame, limit: int, *more: str, shingles: int | None = None) -> DataFrame:
    """``region, node``: the parts of each order in which neighbours share the prefix, of at most ``limit`` nodes and, if
    given, ``shingles`` in all of them.

    Regions of one node are left out. Rows are dealt out by range over the whole order, so a dense region may lie in many
    tasks.
    """
    keys = [*more, "tree", "order", "node"]
    columns = keys if shingles is None else [*keys, "n_shingles"]
    ordered = trees.select(*columns).repartitionByRange(*keys).sortWithinPartitions(*keys)
    prefix = 4 * PREFIX

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []
        current, total = None, 0

        def part(size: int) -> tuple[list[bytes], list[bytes]]:
            nonlocal total
            names = [node for _, node, _ in held[:size]]
            where = hashlib.blake2b(repr((current, names[0])).encode(), digest_size=16).digest()
            total -= sum(n for _, _, n in held[:size])
            del held[:size]
            return ([where] * len(names), names) if len(names) > 1 else ([], [])

        def full(more_nodes: int = 0, more_shingles: int = 0) -> bool:
            return len(held) + more_nodes > limit or shingles is not None and total + more_shingles > shingles

        for batch in batches:
            where: list[bytes] = []
            names: list[bytes] = []
            rows = [column.to_pylist() for column in batch.columns]
            if shingles is None:
                rows.append([0] * batch.num_rows)
            for *group, order, node, n in zip(*rows):
                key = (*group, order[:prefix])
                if key != current:
                    for into, found in zip((where, names), part(len(held)) if held else ([], [])):
                        into.extend(found)
                    current = key
                held.append((order, node, n))
                total += n
                while len(held) > 1 and full():
                    size = _cut([order for order, *_ in held], len(held) - 1)
                    last = held[size - 1]
                    for into, found in zip((where, names), part(size)):
                        into.extend(found)
                    # The last node begins the next part too, so that the parts hang together.
                    if size > 1 and not full(1, last[2]):
                        held.insert(0, last)
                        total += last[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.binary()), pa.array(names, pa.binary())], names=["region", "node"]
            )
        if held:
            where, names = part(len(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.binary()), pa.array(names, pa.binary())], names=["region", "node"]
            )

    return ordered.mapInArrow(run, "region binary, node binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """Runs of rows with the same first column, over the bounds of batches. The other columns, as lists."""
    current, held = None, None
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for key, *row in zip(*columns):
            if held is None or key != current:
                if held is not None:
                    yield held
                current, held = key, tuple([] for _ in row)
            for into, value in zip(held, row):
                into.append(value)
    if held is not None:
        yield held


def alike(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all rows that look alike, by pivots; the number of links is about that of the rows."""
    n = len(sketches)
    if n == 2:
        return [(0, 1)] if (sketches[0] == sketches[1]).mean() >= LOOKS_ALIKE else []
    links = []
    rest = np.arange(n)
    owner = np.full(n, -1)
    columns = 256 * np.arange(sketches.shape[1])
    while len(rest):
        few = sketches[rest]
        common = np.bincount((few + columns).ravel(), minlength=256 * sketches.shape[1]).reshape(-1, 256).argmax(axis=1)
        pivot = rest[np.argmax((few == common).sum(axis=1))]
        near = np.flatnonzero((sketches == sketches[pivot]).mean(axis=1) >= LOOKS_ALIKE)
        taken = near[owner[near] >= 0]
        # One link to each group that an earlier pivot took.
        _, one = np.unique(owner[taken], return_index=True)
        fresh = near[owner[near] < 0]
        links += [(pivot, k) for k in (*taken[one], *fresh[fresh != pivot])]
        owner[fresh] = pivot
        owner[pivot] = pivot
        rest = rest[owner[rest] < 0]
    return links


def _edges(batches: Iterator[pa.RecordBatch], links: Callable[..., list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """``links(columns after the node)`` of each group, as edges between nodes."""
    for nodes, *columns in _groups(batches):
        found = links(*columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array([nodes[a] for a, _ in found], pa.binary()), pa.array([nodes[b] for _, b in found], pa.binary())],
            names=["a", "b"],
        )


def candidate_links(nodes: DataFrame, region: int = REGION) -> DataFrame:
    """``a, b``: links between nodes that look alike."""
    # The last byte of each value; of four equal values in a row the first says nothing more.
    found = saved(regions(forest(nodes), region), "regions")
    members = found.join(nodes.select("node", "values"), "node").select("region", "node", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(values: list[bytes]) -> list[tuple[int, int]]:
            return alike(np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), HASHES, 4)[:, :, 3])

        yield from _edges(batches, links)

    together = members.repartition("region").sortWithinPartitions("region", "node")
    return together.mapInArrow(run, "a binary, b binary").distinct()


def exact_links(sets: list[np.ndarray], percent: int, classes: list[bytes] | None = None) -> list[tuple[int, int]]:
    """A tree of links for each component of the sets, where 100 * common >= percent * united.

    Sets of one of the ``classes`` are linked already: they are not compared, and no links between them are returned.
    """
    sizes = np.array([len(s) for s in sets])
    whole, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    mark = np.zeros(len(whole), dtype=np.int32)
    rest = np.argsort(-sizes, kind="stable")
    lists = [ids[b : b + n] for b, n in zip(begins, sizes)]
    links: list[tuple[int, int]] = []
    reached: list[int] = []
    kinds = np.arange(len(sets)) if classes is None else np.unique(np.array(classes, dtype=object), return_inverse=True)[1]

    def reach(found: np.ndarray) -> None:
        nonlocal rest
        mates = np.isin(kinds[rest], kinds[found])
        reached.extend(rest[mates].tolist())
        rest = rest[~mates]

    while len(rest):
        if not reached:
            reach(rest[:1])
            continue
        node = reached.pop()
        # Only sets of like size can be as similar as that.
        fit = rest[(100 * sizes[rest] >= percent * sizes[node]) & (percent * sizes[rest] <= 100 * sizes[node])]
        if not len(fit):
            continue
        mark[lists[node]] = 1
        flat = np.concatenate([lists[k] for k in fit])
        ends = np.cumsum(sizes[fit])
        common = np.add.reduceat(mark[flat], ends - sizes[fit])
        mark[lists[node]] = 0
        near = fit[100 * common >= percent * (sizes[node] + sizes[fit] - common)]
        if len(near):
            links += [(node, int(k)) for k in near]
            reach(near)
    return links


def _texts(docs: DataFrame, placed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``placed(first_id, h, …)``, a saved table, with the texts of these rows; ids may be null."""
    whole = text_of(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    placed = small(placed)
    return rows.join(placed, rows["id"].eqNullSafe(placed["first_id"]) & (rows["hash"] == placed["h"])).drop("id", "hash")


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) % CELLS


def _counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets lie in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts += np.bincount(_cells(np.frombuffer(value.as_py(), dtype=np.uint64)), minlength=CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])

    whole = np.zeros(CELLS, dtype=np.int64)
    summed = sets.select("set").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    whole[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return whole


def rarest(shingles: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """So many of the rarest shingles that any set as similar as ``percent`` has one of them among its own rarest."""
    n = len(shingles)
    size = n + percent * n // -100 + 1
    return shingles[np.lexsort((shingles, counts[_cells(shingles)]))[:size]]


def _tiles(nodes: DataFrame, limit: int, shingles: int) -> DataFrame:
    """``root, class, node, n_shingles, tile``: nodes of a root by size, at most ``limit`` and ``shingles`` in a tile."""
    columns = ["root", "class", "node", "n_shingles"]
    ordered = nodes.select(*columns).repartitionByRange("root", "n_shingles", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tile, count, total = None, None, 0, 0
        for batch in batches:
            tiles = []
            for root, _, node, n in zip(*[column.to_pylist() for column in batch.columns]):
                if root != current or count + 1 > limit or total + n > shingles:
                    current, tile, count, total = root, node, 0, 0
                count, total = count + 1, total + n
                tiles.append(tile)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles, pa.binary())], names=[*columns, "tile"])

    sorted_rows = ordered.sortWithinPartitions("root", "n_shingles", "node")
    return sorted_rows.mapInArrow(run, "root binary, class binary, node binary, n_shingles long, tile binary")


def missed_links(
    docs: DataFrame,
    apart: DataFrame,
    words: int,
    percent: int,
    doc_id: str,
    text: str,
    block_nodes: int,
    block_shingles: int,
) -> DataFrame:
    """``a, b``: exact links that connect the classes of a root, for ``apart(root, class, node, first_id, h, n_shingles)``."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sets = [], []
            for k, (node, value) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4))):
                shingles = shingle_set(value.as_py(), words)
                if len(shingles) and set_digest(shingles) == node:
                    kept.append(k)
                    sets.append(shingles.tobytes())
            taken = batch.take(pa.array(kept, pa.int32()))
            columns = [*taken.columns[:4], pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "class", "node", "n_shingles", "set"])

    texts = _texts(docs, apart, doc_id, text).select("root", "class", "node", "n_shingles", "text")
    found = texts.mapInArrow(own, "root binary, class binary, node binary, n_shingles long, set binary")
    sets = saved(found.dropDuplicates(["node"]), "sets")
    counts = _counts(sets)

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                least = rarest(np.frombuffer(batch.column(4)[k].as_py(), dtype=np.uint64), percent, counts)
                same = batch.slice(k, 1).take(pa.array(np.zeros(len(least), dtype=np.int32)))
                columns = [*same.columns[:4], pa.array(least.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["root", "class", "node", "n_shingles", "token"])

    schema = "root binary, class binary, node binary, n_shingles long, token long"
    tokens = saved(sets.mapInArrow(tokens_of, schema), "tokens")
    met = tokens.groupBy("root", "token").agg(
        F.count("*").alias("n"),
        F.sum("n_shingles").alias("s"),
        F.min("class").alias("c"),
        F.max("class").alias("d"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    )
    met = saved(met.filter("c <> d").withColumn("hot", (F.col("n") > block_nodes) | (F.col("s") > block_shingles)), "met")
    # Shingles that the same nodes share say the same.
    few = saved(met.filter("not hot").groupBy("root", "n", "x", "y").agg(F.min("token").alias("token")), "few")
    blocks = tokens.join(small(few.select("root", "token")), ["root", "token"]).select(
        F.concat_ws("/", F.hex("root"), F.col("token").cast("string")).alias("block"), "node"
    )
    hot = saved(met.filter("hot").select("root", "token"), "hot")
    if not hot.isEmpty():
        many = tokens.join(small(hot), ["root", "token"]).select("root", "class", "node", "n_shingles").distinct()
        tiles = saved(_tiles(many, max(1, block_nodes // 2), block_shingles // 2), "tiles")
        ranges = tiles.groupBy("root", "tile").agg(
            F.min("n_shingles").alias("least"),
            F.max("n_shingles").alias("most"),
            F.min("class").alias("c"),
            F.max("class").alias("d"),
        )
        ranges = saved(ranges, "ranges")
        like = (
            "a.root = b.root and a.tile <= b.tile and least(a.c, b.c) <> greatest(a.d, b.d)"
            f" and 100 * a.most >= {percent} * b.least and 100 * b.most >= {percent} * a.least"
        )
        pairs = ranges.alias("a").join(ranges.alias("b"), F.expr(like)).select(
            F.concat_ws("/", F.hex("a.tile"), F.hex("b.tile")).alias("block"),
            F.explode(F.array_distinct(F.array("a.tile", "b.tile"))).alias("tile"),
        )
        blocks = blocks.union(pairs.join(tiles.select("tile", "node"), "tile").select("block", "node"))
    together = blocks.join(sets.select("node", "class", "set"), "node").select("block", "node", "class", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(classes: list[bytes], sets: list[bytes]) -> list[tuple[int, int]]:
            return exact_links([np.frombuffer(s, dtype=np.uint64) for s in sets], percent, classes)

        yield from _edges(batches, links)

    together = together.repartition("block").sortWithinPartitions("block", "node")
    return together.mapInArrow(run, "a binary, b binary").distinct()


def confirmed_links(
    docs: DataFrame,
    nodes: DataFrame,
    groups: DataFrame,
    words: int,
    percent: int,
    doc_id: str,
    text: str,
    block_nodes: int = BLOCK_NODES,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``a, b``: exact links that connect what is linked within ``groups(node, root)``."""
    n_nodes = nodes.count()
    grouped = saved(groups.join(nodes, "node").select("root", "node", "first_id", "h", "n_shingles", "values"), "groups")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    fits = (F.col("n") <= block_nodes) & (F.col("s") <= block_shingles)
    sized = grouped.join(saved(sizes.select("root", fits.alias("fits")), "sizes", n_nodes), "root")
    blocks = sized.filter("fits").select(F.col("root").alias("block"), "node")
    large = saved(sized.filter(~F.col("fits")).select(*grouped.columns), "large")
    cut = not large.isEmpty()
    if cut:
        parts = regions(forest(large, "root"), block_nodes, "root", shingles=block_shingles)
        blocks = blocks.union(parts.select(F.col("region").alias("block"), "node"))
    placed = saved(blocks.join(grouped.select("node", "first_id", "h"), "node"), "blocks")
    texts = _texts(docs, placed.select("first_id", "h", "block", "node"), doc_id, text).select("block", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Texts become sets as they come; a row of the same id with another text drops out, and so do repeated rows.
            before = None
            for batch in batches:
                kept, sets = [], []
                for k, (block, node, value) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                    if (block, node) == before:
                        continue
                    shingles = shingle_set(value, words)
                    if len(shingles) and set_digest(shingles) == node:
                        kept.append(k)
                        sets.append(shingles.tobytes())
                        before = (block, node)
                taken = batch.take(pa.array(kept, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), pa.array(sets, pa.binary())], names=["block", "node", "set"]
                )

        def links(sets: list[bytes]) -> list[tuple[int, int]]:
            return exact_links([np.frombuffer(s, dtype=np.uint64) for s in sets], percent)

        yield from _edges(own(batches), links)

    together = texts.repartition("block").sortWithinPartitions("block", "node")
    found = together.mapInArrow(run, "a binary, b binary").distinct()
    if not cut:
        return found
    found = saved(found, "links")
    classes = connected_components(found).withColumnRenamed("root", "class")
    large = large.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")).drop("values")
    large = saved(large, "classed", n_nodes)
    several = large.groupBy("root").agg(F.min("class").alias("c"), F.max("class").alias("d")).filter("c <> d").select("root")
    apart = saved(large.join(several, "root", "left_semi"), "apart", n_nodes)
    if apart.isEmpty():
        return found
    return found.union(missed_links(docs, apart, words, percent, doc_id, text, block_nodes, block_shingles))


def _classified(
    docs: DataFrame, words: int, percent: int, doc_id: str, text: str, region: int, block_nodes: int, block_shingles: int
) -> DataFrame:
    """``doc_id, h, n_shingles, root, component_id`` per row; ``root`` names the class and is null for an empty set."""
    signed = saved(signatures(docs, words, doc_id, text), "signatures")
    nodes = saved(
        signed.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h")).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("values").alias("values"),
        )
        .select("node", "first.doc_id", "first.h", "n_shingles", "values")
        .withColumnRenamed("doc_id", "first_id"),
        "nodes",
    )
    groups = connected_components(candidate_links(nodes, region))
    links = confirmed_links(docs, nodes, groups, words, percent, doc_id, text, block_nodes, block_shingles)
    n_nodes = nodes.count()
    linked = saved(connected_components(links), "components", n_nodes)
    classes = saved(
        nodes.select("node", "first_id")
        .join(linked, "node", "left")
        .select("node", "first_id", F.coalesce("root", "node").alias("root")),
        "classes",
        n_nodes,
    )
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = saved(classes.join(least, "root").select("node", "root", "component_id"), "named", n_nodes)
    return signed.select("doc_id", "h", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id",
        "h",
        "n_shingles",
        "root",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_copies(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    region: int = REGION,
    block_nodes: int = BLOCK_NODES,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where ``100 * common shingles >= percent * united shingles``; ``component_id`` is the smallest
    ``doc_id`` that links lead to, and ``kept`` marks it. Null and empty texts, and those of white space, have no shingles
    and are linked with nothing. A null id is larger than all others; where all ids of a component are null, the component
    is null and kept. Rows that repeat an id all say the same; ``drop_near_copies`` leaves one. An empty table gives an
    empty result.
    """
    rows = _classified(docs, words, percent, doc_id, text, region, block_nodes, block_shingles)
    return rows.select(
        F.col("doc_id").alias(doc_id),
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest ``doc_id``; all columns as they were.

    Rows without shingles are in no group and all stay. Of rows that repeat the smallest id within a group, one stays.
    Texts are shuffled only where more rows go than may be broadcast.
    """
    rows = _classified(docs, words, percent, doc_id, text, REGION, BLOCK_NODES, BLOCK_SHINGLES)
    # Null ids last; equal ids by hash of the text.
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h")
    n_rows = docs.count()
    filled = saved(rows.filter("root is not null").select("root", place.alias("place")), "placed", n_rows)
    chosen = filled.groupBy("root").agg(F.min("place").alias("first"))
    going = filled.join(chosen, "root").filter("place <> first").select("place").distinct()
    going = saved(going.select(F.col("place.doc_id").alias("__near_id"), F.col("place.h").alias("__near_hash")), "going", n_rows)
    tagged = docs.withColumn("__near_text", F.xxhash64(text_of(text)))

    def met(other: DataFrame):
        return tagged[doc_id].eqNullSafe(other["__near_id"]) & (tagged["__near_text"] == other["__near_hash"])

    left = tagged.join(small(going), met(going), "left_anti")
    columns = [f"`{c}`" for c in docs.columns]
    repeated = saved(
        filled.groupBy("root", "place").count().join(chosen, "root").filter("place = first and count > 1").select(
            F.col("place.doc_id").alias("__near_id"), F.col("place.h").alias("__near_hash")
        ),
        "repeated",
        n_rows,
    )
    if repeated.isEmpty():
        return left.select(*columns)
    # Rows alike in id and text: one of them stays.
    once = left.join(small(repeated), met(repeated), "left_anti")
    many = left.join(small(repeated), met(repeated), "left_semi").dropDuplicates([doc_id, "__near_text"])
    return once.unionByName(many).select(*columns)
