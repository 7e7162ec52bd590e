"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a random index vector of a few +1 and -1, made from its hash. Its word vector is the sum of the index
vectors of its neighbours over the whole corpus, which are whole numbers, so that the sum does not depend on the order
of tasks. Words share a fixed number of rows of that table, and each task adds up its own copy of it, so memory and
shuffle do not grow with the vocabulary.

A document is described by the vectors of its words and of their shapes (letter case, kind of characters): their means, the
extremes of the means of its stretches, and the share of words that repeat the one before. Two layers turn that into a logit, which is divided
by a temperature that was fitted on rows the layers have not seen. The network is trained in the driver, on
at most ``TRAIN_ROWS`` labelled rows; scoring runs where the documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import saved, text_of
from quarry.llm.memory import release_worker_state

WORDS, SHAPES, DIM, NONZERO = 1 << 14, 1 << 10, 16, 4
REACH = 2
STRETCH = 64
# Labelled rows that the network is fitted on at most. All other figures cover all documents.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 100, 256, 3e-3, 1e-4, 7
FEATURES = 6 * DIM + 2
# What is worked on at once: characters of texts, and bytes.
BLOCK_CHARS, SLICE = 1 << 20, 1 << 20
# Odd, for the polynomial hash of words.
BASE = 0x5851F42D4C957F2D


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Random index vectors: ``NONZERO`` places of each row are +1 or -1."""
    random = np.random.default_rng(seed)
    vectors = np.zeros((rows, DIM), dtype=np.int32)
    places = random.permuted(np.tile(np.arange(DIM), (rows, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(vectors, places, random.choice([-1, 1], size=(rows, NONZERO)).astype(np.int32), axis=1)
    return vectors


WORD_INDEX, SHAPE_INDEX = index_vectors(WORDS, 1), index_vectors(SHAPES, 2)


def _slices(data: np.ndarray, space: np.ndarray) -> Iterator[slice]:
    """Stretches of some ``SLICE`` bytes that end at white space; longer only where a word is."""
    begin = 0
    while begin < len(data):
        end = min(begin + SLICE, len(data))
        if end < len(data):
            back = np.flatnonzero(space[begin:end])
            ahead = np.flatnonzero(space[end:]) if not len(back) else back
            end = begin + int(back[-1]) + 1 if len(back) else end + int(ahead[0]) + 1 if len(ahead) else len(data)
        yield slice(begin, end)
        begin = end


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and their inverses."""
    base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)])) for x in (base, inverse))


def _sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values of each word."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[begins]


def _words(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and row pair of each word of a stretch of bytes.

    A word's row comes from a polynomial hash of its bytes, its shape from letter case and the mark at its end.
    """
    bounds = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begins, ends = bounds[::2], bounds[1::2]
    up, down = _powers(max(len(data), SLICE))
    with np.errstate(over="ignore"):
        hashed = _sums((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], begins, ends) * down[begins]
        hashed = (hashed ^ hashed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    upper = (data >= 65) & (data <= 90)
    n_upper = _sums(upper, begins, ends)
    n_lower = _sums((data >= 97) & (data <= 122), begins, ends)
    kind = np.select(
        [n_upper + n_lower == 0, n_upper == 0, (n_upper == 1) & upper[begins], n_lower == 0], [0, 1, 2, 3], 4
    )
    last = data[ends - 1]
    plain = (last >= 128) | (last >= 48) & (last <= 57) | ((last | 32) >= 97) & ((last | 32) <= 122)
    shapes = kind * 128 + np.where(plain, 0, last & 127)
    rows = (hashed >> np.uint64(40)).astype(np.int64) % WORDS
    return begins, (rows * SHAPES + shapes).astype(np.int32)


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word row * SHAPES + shape row`` of every word of all texts, and the number of words of each text.

    Words are what ASCII white space leaves.
    """
    encoded = [text.encode() for text in texts]
    data = np.frombuffer(b"\n".join(encoded), dtype=np.uint8)
    space = (data == 32) | (data >= 9) & (data <= 13)
    places, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
    for part in _slices(data, space):
        begins, rows = _words(data[part], space[part])
        places.append(begins + part.start)
        ids.append(rows)
    ends = np.cumsum([len(text) + 1 for text in encoded])
    counts = np.diff(np.searchsorted(np.concatenate(places), ends), prepend=0)
    return np.concatenate(ids), counts


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Slices of batches with the tokens of their texts, cut by length."""
    for batch in batches:
        begin, held, size = 0, [], 0
        for k, text in enumerate(batch.column(column)):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= BLOCK_CHARS:
                yield batch.slice(begin, k + 1 - begin), tokens_of(held)
                begin, held, size = k + 1, [], 0
        if held:
            yield batch.slice(begin), tokens_of(held)


def neighbour_sums(ids: np.ndarray, sizes: np.ndarray, into: np.ndarray) -> None:
    """Add the index vectors of each word's neighbours in its own document to the word's row."""
    if not len(ids):
        return
    document = np.repeat(np.arange(len(sizes)), sizes)
    words = ids // SHAPES
    index = WORD_INDEX[words] + SHAPE_INDEX[ids % SHAPES]
    around = np.zeros_like(index)
    for step in range(1, min(REACH, len(ids) - 1) + 1):
        together = (document[step:] == document[:-step])[:, None]
        around[step:] += index[:-step] * together
        around[:-step] += index[step:] * together
    for d in range(DIM):
        into[:, d] += np.bincount(words, weights=around[:, d], minlength=WORDS).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vectors of all ``WORDS`` rows, of length one, from every document."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        sums = np.zeros((WORDS, DIM), dtype=np.int64)
        for _, tokens in _blocks(batches, 0):
            neighbour_sums(*tokens, sums)
        rows = np.flatnonzero(sums.any(axis=1))
        vectors = [sums[k].tobytes() for k in rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(vectors, pa.binary())], ["row", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[row] = sums.get(row, 0) + np.frombuffer(vector, dtype=np.int64)
        vectors = [v.tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(vectors, pa.binary())], ["row", "sums"]
        )

    schema = "row int, sums binary"
    parts = docs.select(text_of(text).alias("text")).mapInArrow(tasks, schema)
    table = np.zeros((WORDS, DIM))
    # At most WORDS rows come to the driver.
    for row in parts.repartition("row").mapInArrow(merged, schema).toLocalIterator():
        table[row["row"]] = np.frombuffer(row["sums"], dtype=np.int64)
    used = table.any(axis=1)
    if used.any():
        table[used] -= table[used].mean(axis=0)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norms, out=np.zeros_like(table), where=norms > 0).astype(np.float32)


def pooled(ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``FEATURES`` numbers for each document; zeros for one without words."""
    result = np.zeros((len(sizes), FEATURES), dtype=np.float32)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return result
    sizes = sizes[filled]
    begins = np.cumsum(sizes) - sizes
    words = ids // SHAPES
    both = np.empty((len(ids), 2 * DIM), dtype=np.float32)
    both[:, :DIM] = vectors[words]
    both[:, DIM:] = SHAPE_INDEX[ids % SHAPES]
    cuts = np.concatenate([np.arange(b, b + n, STRETCH) for b, n in zip(begins, sizes)])
    sums = np.add.reduceat(both, cuts)
    first = np.searchsorted(cuts, begins)
    result[filled, : 2 * DIM] = np.add.reduceat(sums, first) / sizes[:, None]
    means = sums / np.diff(np.append(cuts, len(ids)))[:, None]
    result[filled, 2 * DIM : 4 * DIM] = np.maximum.reduceat(means, first)
    result[filled, 4 * DIM : 6 * DIM] = np.minimum.reduceat(means, first)
    # Neighbours with the same index vector: a word that is repeated.
    same = np.zeros(len(ids), dtype=np.float32)
    same[1:] = words[1:] == words[:-1]
    same[begins] = 0
    result[filled, 6 * DIM] = np.add.reduceat(same, begins) / sizes
    result[filled, 6 * DIM + 1] = np.log1p(sizes)
    return result


@dataclass
class Network:
    """Two layers over standardised features, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def train(features: np.ndarray, labels: np.ndarray) -> Network:
    """Fit the layers on four fifths of the rows and the temperature on the rest.

    Without rows every score is 0.5; with one label alone, or too few rows to fit, it is the share of label 1.
    """
    width = features.shape[1]
    share = float(labels.mean()) if len(labels) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    constant = Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), prior)
    if len(labels) < 20 or labels.min() == labels.max():
        return constant
    random = np.random.default_rng(SEED)
    order = random.permutation(len(labels))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    x, y = features[fit].astype(np.float64), labels[fit].astype(np.float64)
    scale = x.std(axis=0)
    net = Network(
        x.mean(axis=0),
        np.where(scale > 1e-9, scale, 1.0),
        random.normal(0, np.sqrt(2 / width), (width, HIDDEN)),
        np.zeros(HIDDEN),
        random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
        prior,
    )
    x = np.clip((x - net.mean) / net.scale, -8, 8)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        shuffled = random.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for begin in range(0, len(y), BATCH):
            rows = shuffled[begin : begin + BATCH]
            xb, yb = x[rows], y[rows]
            w1, b1, w2, b2 = weights
            hidden = np.maximum(xb @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -40, 40))) - yb) / len(rows)
            back = np.outer(error, w2) * (hidden > 0)
            gradients = [xb.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum(keepdims=True)]
            step += 1
            for w, g, (m, v) in zip(weights, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    # The loss is convex in 1 / temperature.
    logits, y = net.logits(features[held]), labels[held]
    inverse = min(np.geomspace(0.1, 2, 400), key=lambda t: _loss(logits * t, y))
    net.temperature = float(1 / inverse)
    return net


def _features(docs: DataFrame, vectors: np.ndarray, finish, schema: str) -> DataFrame:
    """``finish(features)`` gives the last column for the pooled features; the last column of ``docs`` is the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    at = len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        for rows, tokens in _blocks(batches, at):
            last = finish(pooled(*tokens, shared.value))
            names = [*rows.schema.names[:at], "out"]
            yield pa.RecordBatch.from_arrays([*rows.columns[:at], last], names=names)

    return docs.mapInArrow(run, schema)


def held_out_row(doc_id: str):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of ``rows``: those in the first shares of 65,536 by hash of the id. Only counts come to the driver."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16))
    counts = sorted(rows.groupBy(share.alias("share")).count().collect())
    total = 0
    for first_out, n in counts:
        total += n
        if total > most:
            return rows.filter(share < first_out)
    return rows


def fit_quality(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> Network:
    """Train on labelled documents that are not held out, at most ``TRAIN_ROWS`` of them."""
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(~held_out_row("doc_id"))
        .dropDuplicates(["doc_id"])
    )
    sample = F.broadcast(_sample(saved(known, "labels"), TRAIN_ROWS))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).join(sample, "doc_id")
    rows = rows.select("doc_id", "label", "text")

    def packed(features: np.ndarray) -> pa.Array:
        return pa.array([f.tobytes() for f in features], pa.binary())

    table = _features(rows, vectors, packed, "doc_id long, label int, out binary").toArrow()
    data = sorted(zip(table["doc_id"].to_pylist(), table["label"].to_pylist(), table["out"].to_pylist()))
    if not data:
        return train(np.zeros((0, FEATURES)), np.zeros(0))
    features = np.frombuffer(b"".join(f for _, _, f in data), dtype=np.float32).reshape(len(data), FEATURES)
    return train(features, np.array([label for _, label, _ in data]))


def _scorer(docs: DataFrame, labels: DataFrame, doc_id: str, text: str):
    vectors = word_vectors(docs, text)
    network = fit_quality(docs, labels, vectors, doc_id, text)

    def scored(features: np.ndarray) -> pa.Array:
        return pa.array(network.scores(features), pa.float64())

    return vectors, scored


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    The score depends on the text alone and is higher where label 1 is likelier. Null texts count as empty and get a score
    too; a null id is not held out. Repeated rows are scored each for itself, an empty table gives an empty result.
    """
    vectors, scored = _scorer(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    out = _features(rows, vectors, scored, "doc_id long, score double")
    return out.select(
        F.col("doc_id").alias(doc_id),
        held_out_row("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_rejected(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``, all columns as they were.

    Rows are scored where they are, so nothing is shuffled and repeated rows are no matter.
    """
    vectors, scored = _scorer(docs, labels, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            found = [scored(pooled(*tokens, shared.value)).to_numpy() for _, tokens in _blocks([rows], 0)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.filter(score(text_of(text)) >= threshold)
