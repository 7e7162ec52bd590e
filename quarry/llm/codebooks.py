"""Vector codes by product quantisation over Hilbert-sorted flat blocks.

Vectors become integers (``floor(scale * x)``) and are cut into ``parts`` equal consecutive parts; each part position
has its own codebook of ``entries`` integer vectors. A round assigns every part to its nearest entry and moves each
entry to the floored mean of its parts.

Layout: the vectors are sorted along a Hilbert curve (Spark's range partitioning on the curve's key) and cut into flat
blocks of ``BLOCK`` neighbouring vectors, written once to the shared folder. Each block row holds its ids, its matrix,
and per dimension its smallest and largest value (the box) and its sum. A round sends the small codebook to every
task; per block and part, box distances give each entry a lower and an upper bound, and only entries whose lower
bound is within the smallest upper bound (the shortlist) can be nearest. If one entry is left, the whole block goes
to it and its stored sum is used as it is; otherwise an exact integer kernel compares the block's parts with the
shortlist alone. Per (part, entry) counts and sums are added up by Spark; the new codebook has ``parts * entries``
rows, which is all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Vectors per flat block, and bits per dimension of the Hilbert key.
BLOCK = 256
HILBERT_BITS = 4


def usable(vector: str = "embedding") -> Column:
    """True for a vector that is not null and holds no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``points`` (integers in [0, 2**bits)), as big-endian bytes, in any dimension.

    Skilling's transform to the transposed index, then the bits read from the most significant plane down.
    """
    x = points.astype(np.int64, copy=True)
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= p
            t = (x[~high, 0] ^ x[~high, i]) & p
            x[~high, 0] ^= t
            x[~high, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    planes = [(x >> level) & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, dims), dtype=np.int64)
    return np.stack(column.to_numpy()).astype(np.int64).reshape(len(column), dims)


def _blocks(rows: DataFrame, dims: int, low: int, high: int) -> DataFrame:
    """Flat blocks of ``BLOCK`` rows in Hilbert order: ``block, ids, labels, values, lo, hi, sums``."""
    span = high - low + 1

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["v"], dims)
            cells = ((v - low) << HILBERT_BITS) // span
            keys = hilbert_keys(cells, HILBERT_BITS)
            yield batch.assign(key=[bytes(k) for k in keys])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        number, rest = 0, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            whole = len(rest) - len(rest) % BLOCK
            if whole:
                yield make(rest.iloc[:whole], part, number)
                number += whole // BLOCK
                rest = rest.iloc[whole:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield make(rest, part, number)

    def make(chunk: pd.DataFrame, part: int, first: int) -> pd.DataFrame:
        out = []
        for start in range(0, len(chunk), BLOCK):
            piece = chunk.iloc[start : start + BLOCK]
            v = _matrix(piece["v"], dims)
            out.append(
                (
                    (part << 32) + first + start // BLOCK,
                    piece["vec_id"].astype("Int64").tolist(),
                    piece["label"].astype("Int32").tolist(),
                    v.astype("<i8").tobytes(),
                    v.min(axis=0).astype("<i8").tobytes(),
                    v.max(axis=0).astype("<i8").tobytes(),
                    v.sum(axis=0).astype("<i8").tobytes(),
                )
            )
        return pd.DataFrame(out, columns=["block", "ids", "labels", "values", "lo", "hi", "sums"])

    keyed_rows = rows.mapInPandas(keyed, _keyed_schema(rows))
    ordered = keyed_rows.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").drop("key")
    schema = "block long, ids array<long>, labels array<int>, values binary, lo binary, hi binary, sums binary"
    return saved(ordered.mapInPandas(cut, schema), "flat-blocks")


def _keyed_schema(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", key binary"


def _shortlists(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> list[np.ndarray]:
    """Per part, the entries that can be nearest to some point of the box [lo, hi]."""
    parts, _, width = book.shape
    lo, hi = lo.reshape(parts, 1, width), hi.reshape(parts, 1, width)
    below = np.maximum(np.maximum(lo - book, book - hi), 0)
    least = (below * below).sum(axis=2)
    far = np.maximum(np.abs(book - lo), np.abs(book - hi))
    most = (far * far).sum(axis=2)
    bound = most.min(axis=1, keepdims=True)
    return [np.flatnonzero(row) for row in least <= bound]


def _assign(values: np.ndarray, book: np.ndarray, part: int, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest listed entry of each row's part (ties to the lower index) and its squared distance, in integers."""
    width = book.shape[2]
    x = values[:, part * width : (part + 1) * width]
    diff = x[:, None, :] - book[part, listed][None, :, :]
    dist = (diff * diff).sum(axis=2)
    best = dist.argmin(axis=1)
    return listed[best], dist[np.arange(len(x)), best]


def _unpack(row, dims: int) -> tuple[np.ndarray, ...]:
    n = len(row.ids)
    values = np.frombuffer(row.values, dtype="<i8").reshape(n, dims)
    return values, np.frombuffer(row.lo, dtype="<i8"), np.frombuffer(row.hi, dtype="<i8"), np.frombuffer(row.sums, dtype="<i8")


def _round(blocks: DataFrame, book: np.ndarray, dims: int) -> np.ndarray:
    """The codebook after one assignment and update."""
    parts, entries, width = book.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = np.zeros((parts, entries), dtype=np.int64)
            total = np.zeros((parts, entries, width), dtype=np.int64)
            for row in batch.itertuples(index=False):
                values, lo, hi, block_sum = _unpack(row, dims)
                for part, listed in enumerate(_shortlists(lo, hi, book)):
                    if len(listed) == 1:
                        count[part, listed[0]] += len(values)
                        total[part, listed[0]] += block_sum[part * width : (part + 1) * width]
                        continue
                    nearest, _ = _assign(values, book, part, listed)
                    np.add.at(count[part], nearest, 1)
                    np.add.at(total[part], nearest, values[:, part * width : (part + 1) * width])
            p, e = np.nonzero(count)
            yield pd.DataFrame({"part": p, "entry": e, "n": count[p, e], "total": list(total[p, e])})

    moved = (
        blocks.mapInPandas(sums, "part long, entry long, n long, total array<long>")
        .select("part", "entry", "n", F.posexplode("total").alias("j", "s"))
        .groupBy("part", "entry", "j")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .collect()
    )
    new = book.copy()
    counts: dict[tuple[int, int], int] = {}
    for r in moved:
        counts[(r.part, r.entry)] = r.n
    sums_by = np.zeros_like(book)
    for r in moved:
        sums_by[r.part, r.entry, r.j] = r.s
    for (p, e), n in counts.items():
        new[p, e] = sums_by[p, e] // n
    return new


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all entries' integer components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in book.reshape(-1)).encode()).hexdigest()


def compress_vectors(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of every usable vector and the final codebook (``parts x entries x width`` integers).

    Rows: ``vec_id, label, code, error``: ``code`` is each part's 0-based entry index as two hex digits, in part order;
    ``error`` the summed squared distances of the final assignment. Rows whose vector is null or holds a null or
    non-finite component are dropped; so are vectors whose length differs from the longest one. Components become
    ``floor(scale * x)``. The first codebook is made of the vectors of the ``entries`` smallest ``vec_id`` (nulls last;
    fewer if the table has fewer rows; repeated ids by their vector). Distance ties go to the lower entry index; an entry
    no part chooses stays as it was. Null labels are carried as they are. An empty table gives no rows and an empty
    codebook. The length of a vector must be a multiple of ``parts`` and ``entries`` at most 256, or ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must lie in 1..256 for two hex digits a part")
    spark = table.sparkSession
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = table.filter(usable(vector)).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), ints.alias("v")
    )
    dims_row = rows.agg(F.max(F.size("v")).alias("d"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    dims = dims_row[0]
    if not dims:
        empty = spark.createDataFrame([], "vec_id long, label int, code string, error long")
        return empty, np.zeros((parts, 0, 0), dtype=np.int64)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    rows = rows.filter(F.size("v") == dims)
    width = dims // parts
    low, high = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    book = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    blocks = _blocks(rows, dims, low, high)
    for _ in range(rounds):
        book = _round(blocks, book, dims)
    final = book

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                values, lo, hi, _ = _unpack(row, dims)
                codes = np.zeros((len(values), parts), dtype=np.int64)
                error = np.zeros(len(values), dtype=np.int64)
                for part, listed in enumerate(_shortlists(lo, hi, final)):
                    codes[:, part], dist = _assign(values, final, part, listed)
                    error += dist
                text = ["".join(f"{c:02x}" for c in line) for line in codes.tolist()]
                yield pd.DataFrame(
                    {
                        "vec_id": pd.array(row.ids, dtype="Int64"),
                        "label": pd.array(row.labels, dtype="Int32"),
                        "code": text,
                        "error": error,
                    }
                )

    return blocks.mapInPandas(coded, "vec_id long, label int, code string, error long"), final


def vector_codes(table: DataFrame, **settings) -> DataFrame:
    """``compress_vectors`` as one table: ``vec_id, code, error, label_error, codebooks_sha256``.

    ``label_error`` sums ``error`` over rows of equal label, null labels together; ``codebooks_sha256`` is
    ``codebook_digest`` of the final codebook, the same on every row.
    """
    codes, book = compress_vectors(table, **settings)
    digest = codebook_digest(book)
    per_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return codes.join(per_label, codes["label"].eqNullSafe(per_label["label"]), "left").select(
        codes["vec_id"], "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
