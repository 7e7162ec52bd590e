"""Packing by concatenation: the ids of all documents form one stream, which is cut every ``length`` ids.

The first pass encodes the documents, in order of id, into token files and counts the tokens of each file. The sums
of the files before give each file its place in the stream, so the second pass can cut it without knowing its
neighbours. A sequence that runs over the end of a file comes out in parts, as boundary records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.token_files import TokenFileReader, each_file, write_token_files
from quarry.session import fresh_path

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def encode_stream(
    docs: DataFrame, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """First pass: the token files of the stream, as their manifest."""
    path = fresh_path(docs.sparkSession, "stream")
    return write_token_files(docs, path, tokenizer_file, end_id, doc_id, text)


def cut(place: int, size: int, length: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a document of ``size`` ids that lies at ``place`` in the stream."""
    edges = [0, *range(length - place % length, size, length), size]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def packed_pieces(manifest: DataFrame, length: int = 2048) -> DataFrame:
    """Second pass, one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id is in exactly one piece, and all sequences but the last are full. A document without text still has its
    end id. No documents, no pieces.
    """

    def read(reader: TokenFileReader, place: int) -> Iterator[pa.RecordBatch]:
        for frame in range(len(reader.first) - 1):
            rows = []
            for k, ids in reader.frame(frame):
                for start, size in cut(place, len(ids), length):
                    data = ids[start : start + size].astype("<u4").tobytes()
                    at = place + start
                    rows.append(
                        (reader.doc_ids[k], start, size, zlib.crc32(data), len(ids), at // length, at % length)
                    )
                place += len(ids)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return each_file(manifest, read, PIECES)


def packed_sequences(manifest: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, ids``, padded with ``pad_id`` to ``length``.

    A file's whole sequences are cut from it in place; only its first and last part, the boundary records, are
    shuffled to be put together.
    """

    def read(reader: TokenFileReader, place: int) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        begin = place

        def batch(chunks: list[np.ndarray], sizes: list[int], at: int) -> pa.RecordBatch:
            ids = np.concatenate(chunks).astype(np.int32)
            ends = np.cumsum([0, *sizes])
            return pa.RecordBatch.from_pydict(
                {
                    "sequence_id": pa.array([(at + e) // length for e in ends[:-1]], pa.int64()),
                    "offset": pa.array([(at + e) % length for e in ends[:-1]], pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                }
            )

        for frame in range(len(reader.first) - 1):
            for _, ids in reader.frame(frame):
                waiting.append(ids)
                held += len(ids)
            sizes = [size for _, size in cut(begin, held, length)]
            rest = sizes.pop() if (begin + held) % length else 0
            if sizes:
                ids = np.concatenate(waiting)
                yield batch([ids[: held - rest]], sizes, begin)
                begin += held - rest
                waiting, held = [ids[held - rest :]], rest
        if held:
            yield batch(waiting, [held], begin)

    parts = each_file(manifest, read, "sequence_id long, offset long, ids array<int>")
    whole = F.size("ids") == length
    edges = (
        parts.filter(~whole)
        .groupBy("sequence_id")
        .agg(F.flatten(F.sort_array(F.collect_list(F.struct("offset", "ids")))["ids"]).alias("ids"))
    )
    every = parts.filter(whole).select("sequence_id", "ids").unionByName(edges)
    padding = F.array_repeat(F.lit(pad_id), length - F.size("ids"))
    return every.select(
        "sequence_id", F.size("ids").cast("long").alias("n_tokens"), F.concat("ids", padding).alias("ids")
    )
