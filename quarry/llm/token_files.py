"""Token ids in binary files from which single documents can be read.

A file is a run of independent zstandard frames and ends with a seek table in the public seekable format, a skippable
frame with the sizes and an XXH64 checksum of each frame:

    frame 0 .. n-1   ids of whole documents, one after the other, unsigned little-endian
    frame n          index: for each document its id, whether that is null, and its number of tokens;
                     for each frame its number of documents
    skippable frame  per frame: compressed size, content size, checksum; then frame count, flags, magic

A reader takes the table from the end of the file, the index before it, and then only the frames that hold what it was
asked for. Spark sorts the documents by range, so that the files in the order of their names, and the documents in
each, ascend by id. A file is written under a name of its attempt and moved to its own name when it is whole, so a
repeated task does no harm.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import text_of
from quarry.llm.encode import encoder

# Fixed values of the seekable format: magic of a skippable frame, of the table's end, and the flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 20
LEVEL = 1
MANIFEST = "manifest"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes one file to an open stream. Holds one frame and sixteen bytes for each document."""

    def __init__(self, out, id_width: int):
        import zstandard

        self.out, self.width = out, id_width
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.per_frame: list[int] = []
        self.parts: list[bytes] = []
        self.size = self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.parts.append(data)
        self.size += len(data)
        self.waiting += 1
        if self.size >= FRAME_BYTES:
            self._flush()

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), _checksum(content)))

    def _flush(self) -> None:
        if self.waiting:
            self._frame(b"".join(self.parts))
            self.per_frame.append(self.waiting)
            self.parts, self.size, self.waiting = [], 0, 0

    def close(self) -> None:
        self._flush()
        head = json.dumps(
            {"width": self.width, "documents": len(self.ids), "frames": len(self.per_frame)}
        ).encode()
        index = [
            struct.pack("<I", len(head)),
            head,
            np.array([i or 0 for i in self.ids], dtype="<i8").tobytes(),
            np.array([i is None for i in self.ids], dtype="<u1").tobytes(),
            np.array(self.lengths, dtype="<i8").tobytes(),
            np.array(self.per_frame, dtype="<i8").tobytes(),
        ]
        self._frame(b"".join(index))
        table = b"".join(struct.pack("<III", *row) for row in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class TokenFileReader:
    """Reads a file through its seek table. A frame that does not match its checksum is an error."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.decompressor = zstandard.ZstdDecompressor()
        end = source.size()
        frames, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("not a token file: no seek table at its end")
        rows = self._at(end - 9 - 12 * frames, 12 * frames)
        self.table = list(struct.iter_unpack("<III", rows))
        self.places = np.concatenate([[0], np.cumsum([row[0] for row in self.table])])
        index = self._content(frames - 1)
        (size,) = struct.unpack_from("<I", index)
        head = json.loads(index[4 : 4 + size])
        n, at = head["documents"], 4 + size
        self.width = head["width"]
        raw = np.frombuffer(index, "<i8", n, at)
        null = np.frombuffer(index, "<u1", n, at + 8 * n)
        self.doc_ids = [None if z else int(i) for i, z in zip(raw, null)]
        self.lengths = np.frombuffer(index, "<i8", n, at + 9 * n)
        per_frame = np.frombuffer(index, "<i8", head["frames"], at + 17 * n)
        self.first = np.concatenate([[0], np.cumsum(per_frame)]).astype(int)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _content(self, frame: int) -> bytes:
        packed, size, checksum = self.table[frame]
        content = self.decompressor.decompress(self._at(int(self.places[frame]), packed), max_output_size=size)
        if len(content) != size or _checksum(content) != checksum:
            raise ValueError(f"frame {frame} is damaged")
        return content

    def frame(self, frame: int) -> Iterator[tuple[int, np.ndarray]]:
        """``position, ids`` of each document of one frame."""
        ids = np.frombuffer(self._content(frame), f"<u{self.width}")
        at = 0
        for k in range(self.first[frame], self.first[frame + 1]):
            yield k, ids[at : at + self.lengths[k]]
            at += self.lengths[k]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for frame in range(len(self.first) - 1):
            yield from self.frame(frame)

    def find(self, wanted: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
        """``doc_id, ids`` of the wanted documents; decompresses no other frames."""
        asked = set(wanted)
        hits = [k for k, i in enumerate(self.doc_ids) if i in asked]
        frames = np.searchsorted(self.first, hits, side="right") - 1
        for frame in sorted(set(frames.tolist())):
            for k, ids in self.frame(frame):
                if self.doc_ids[k] in asked:
                    yield self.doc_ids[k], ids


def _encoded(batches: Iterator[pa.RecordBatch], content: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        texts = (text.as_py() for text in batch.column(1))
        for doc_id, ids in zip(batch.column(0), encoder(content).ids(texts)):
            yield doc_id.as_py(), np.frombuffer(ids + end, dtype="<u4")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode every text, put ``end_id`` after it and write the files to ``path``; return their manifest.

    The manifest has a row per file: ``file, part, n_docs, n_tokens``. Null texts are empty texts and have the end id
    alone; null ids come first; rows of one id go by text. An empty table gives no or empty files and reads back
    as no rows. Texts are shuffled once, by range.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as source:
        content = source.read()
    shared = spark.sparkContext.broadcast(content)
    size = json.loads(content)["model"]["vocab"]
    width = 2 if max(max(size.values()), end_id, 65_535) == 65_535 else 4
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.tokens"
        files, root = _filesystem(path)
        files.create_dir(root, recursive=True)
        attempt = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
        tokens = 0
        with files.open_output_stream(attempt) as out:
            writer = TokenFileWriter(out, width)
            for doc, ids in _encoded(batches, shared.value, end_id):
                writer.add(doc, ids)
                tokens += len(ids)
            writer.close()
        files.move(attempt, posixpath.join(root, name))
        row = {"file": [f"{path}/{name}"], "part": [part], "n_docs": [len(writer.ids)], "n_tokens": [tokens]}
        yield pa.RecordBatch.from_pydict(row)

    schema = "file string, part long, n_docs long, n_tokens long"
    ordered.mapInArrow(write, schema).write.parquet(f"{path}/{MANIFEST}")
    return token_manifest(spark, path)


def token_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "file string, part long, n_docs long, n_tokens long"
    return spark.read.schema(schema).parquet(f"{path}/{MANIFEST}")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the tokens of all files before. One row per file, so one small task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return starts.filter("n_docs > 0")


def each_file(manifest: DataFrame, read, schema: str) -> DataFrame:
    """``read(reader, start)`` for each file, which yields record batches. A task per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, place = _filesystem(row["file"])
                with files.open_input_file(place) as source:
                    yield from read(TokenFileReader(source), row["start"])

    starts = with_starts(manifest)
    # Range and not hash: each file a partition of its own.
    return starts.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(run, schema)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """What the files hold, per document: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as unsigned little-endian 32-bit
    numbers.
    """

    def read(reader: TokenFileReader, start: int) -> Iterator[pa.RecordBatch]:
        for frame in range(len(reader.first) - 1):
            found = list(reader.frame(frame))
            lengths = np.array([len(ids) for _, ids in found], dtype=np.int64)
            starts = start + np.concatenate([[0], np.cumsum(lengths)])
            start = int(starts[-1])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([reader.doc_ids[k] for k, _ in found], pa.int64()),
                    "start": starts[:-1],
                    "n_tokens": lengths,
                    "ids_crc32": pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found], pa.int64()),
                }
            )

    return each_file(manifest, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_documents(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """Ids of a few documents, ``doc_id, ids``; of each file only the index and the frames that hold them are read."""

    def read(reader: TokenFileReader, start: int) -> Iterator[pa.RecordBatch]:
        for doc, ids in reader.find(wanted):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "ids": [ids.astype(np.int64)]})

    return each_file(manifest, read, "doc_id long, ids array<long>")
