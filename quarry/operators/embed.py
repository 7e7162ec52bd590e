"""Embedders: a text column in, a vector column out.

Anything with a ``name``, a ``dimension`` and ``embed(df, text_col, out_col)`` will do. The vectors
have length one. ``embed_checked`` adds a second column with the reason where a row failed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import BuildSettings, ModelSettings
from quarry.functions.text import tokens
from quarry.functions.vectors import l2_normalise

VECTOR = "array<float>"
CHECKED = f"struct<vector: {VECTOR}, error: string>"

# Words whose bucket a worker remembers before it starts over.
REMEMBERED_WORDS = 100_000


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame: ...


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, as float32; zero rows stay zero."""
    matrix = np.asarray(matrix, dtype=np.float64)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return (matrix / np.where(lengths > 0, lengths, 1.0)).astype(np.float32)


class _RowWise:
    """Embedding inside a row, without a shuffle: the form that also works on streams.

    Subclasses say how a worker gets its encoder, from a list of texts to a matrix.
    """

    name: str
    dimension: int
    rows_per_call: int = 256
    normalise: bool = True

    def encoder(self) -> Callable[[Sequence[str]], np.ndarray]:
        raise NotImplementedError

    def _vectors(self, encode, texts: Sequence[str]) -> np.ndarray:
        matrix = np.asarray(encode(texts))
        if matrix.shape != (len(texts), self.dimension):
            raise ValueError(
                f"{self.name} gave {matrix.shape} for {len(texts)} texts of dimension {self.dimension}"
            )
        return unit_rows(matrix) if self.normalise else matrix.astype(np.float32)

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        @F.pandas_udf(VECTOR)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = self.encoder()
            for texts in batches:
                texts = texts.fillna("").tolist()
                parts = [
                    self._vectors(encode, texts[i : i + self.rows_per_call])
                    for i in range(0, len(texts), self.rows_per_call)
                ]
                yield pd.Series([row for part in parts for row in part], dtype=object)

        # Declared nondeterministic so that no optimizer rule repeats the call, say for a filter.
        return df.withColumn(out_col, run.asNondeterministic()(F.col(text_col)))

    def embed_checked(
        self, df: DataFrame, text_col: str, out_col: str, error_col: str, max_errors: int | None = None
    ) -> DataFrame:
        """As ``embed``, but a row that fails gets its error and no vector.

        A failing call is repeated row by row, so one bad row does not take its batch along. A task with
        more failures than ``max_errors`` fails, which ends the job early.
        """

        def safely(encode, texts: list[str]) -> list[tuple]:
            try:
                return [(row, None) for row in self._vectors(encode, texts)]
            except Exception as error:
                if len(texts) == 1:
                    return [(None, f"{type(error).__name__}: {error}")]
                return [pair for text in texts for pair in safely(encode, [text])]

        @F.pandas_udf(CHECKED)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encode = self.encoder()
            errors = 0
            for texts in batches:
                texts = texts.fillna("").tolist()
                pairs = []
                for i in range(0, len(texts), self.rows_per_call):
                    done = safely(encode, texts[i : i + self.rows_per_call])
                    pairs += done
                    errors += sum(error is not None for _, error in done)
                    if max_errors is not None and errors > max_errors:
                        raise RuntimeError(f"{errors} rows failed to embed, more than {max_errors}")
                yield pd.DataFrame(pairs, columns=["vector", "error"], dtype=object)

        # One call per row feeds both columns.
        checked = df.withColumn("_checked", run.asNondeterministic()(F.col(text_col)))
        return checked.select(
            *df.columns,
            F.col("_checked.vector").alias(out_col),
            F.col("_checked.error").alias(error_col),
        )


class HashedWords(_RowWise):
    """Bag of words over hashed buckets: deterministic and free of downloads."""

    def __init__(self, dimension: int = 64, max_words: int | None = None):
        self.name = f"hashed-words-{dimension}"
        self.dimension = dimension
        self.max_words = max_words

    def encoder(self) -> Callable[[Sequence[str]], np.ndarray]:
        dimension, max_words = self.dimension, self.max_words

        class Buckets(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= REMEMBERED_WORDS:
                    self.clear()
                digest = hashlib.md5(word.encode()).hexdigest()
                found = self[word] = int(digest[:8], 16) % dimension
                return found

        bucket = Buckets().__getitem__

        def encode(texts: Sequence[str]) -> np.ndarray:
            matrix = np.zeros((len(texts), dimension))
            for row, text in enumerate(texts):
                words = text.lower().split()[:max_words]
                matrix[row] = np.bincount(np.fromiter(map(bucket, words), np.intp, len(words)), minlength=dimension)
            return matrix

        return encode


class SubwordCapped(_RowWise):
    """Another row-wise embedder whose texts are first cut after ``max_seq_length`` sub-words of a tokenizer file.

    The cut follows the tokenizer's own offsets: a text of more tokens (special tokens not added) keeps what lies up to the
    end of its ``max_seq_length``-th token; shorter texts stay whole. The file's content travels with the job, so its path
    needs to exist on the driver only.
    """

    def __init__(self, inner: _RowWise, tokenizer_path: str, max_seq_length: int = ModelSettings().max_seq_length):
        if max_seq_length < 1:
            raise ValueError("max_seq_length must be at least 1")
        self.inner = inner
        self.name = f"{inner.name}-first-{max_seq_length}-subwords"
        self.dimension = inner.dimension
        self.rows_per_call = inner.rows_per_call
        self.normalise = inner.normalise
        self.max_seq_length = max_seq_length
        with open(tokenizer_path, encoding="utf-8") as file:
            self.tokenizer_json = file.read()

    def cut(self) -> Callable[[Sequence[str]], list[str]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        n = self.max_seq_length

        def cut(texts: Sequence[str]) -> list[str]:
            found = tokenizer.encode_batch(list(texts), add_special_tokens=False)
            return [text if len(e.ids) <= n else text[: e.offsets[n - 1][1]] for text, e in zip(texts, found)]

        return cut

    def encoder(self) -> Callable[[Sequence[str]], np.ndarray]:
        cut, inner = self.cut(), self.inner.encoder()
        return lambda texts: inner(cut(texts))


class HashedWordsSql:
    """The same vectors from SQL functions only; costs two shuffles, so it is for batches."""

    def __init__(self, dimension: int = 64, key: str = "doc_id", max_words: int | None = None):
        self.name = f"hashed-words-{dimension}"
        self.dimension = dimension
        self.key = key
        self.max_words = max_words

    def bucket_counts(self, df: DataFrame, text_col: str) -> DataFrame:
        words = tokens(text_col)
        if self.max_words is not None:
            words = F.slice(words, 1, self.max_words)
        digest = F.substring(F.md5(F.col("word").cast("binary")), 1, 8)
        bucket = F.conv(digest, 16, 10).cast("long") % self.dimension
        return (
            df.select(self.key, F.explode_outer(words).alias("word"))
            .filter(F.col("word").isNotNull())
            .groupBy(self.key, bucket.cast("int").alias("bucket"))
            .count()
        )

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        # A document has at most one row per bucket, so the collected list is bounded.
        counts = self.bucket_counts(df, text_col).groupBy(self.key).agg(
            F.map_from_entries(F.collect_list(F.struct("bucket", "count"))).alias("_counts")
        )
        positions = F.sequence(F.lit(0), F.lit(self.dimension - 1))
        dense = F.transform(
            positions,
            lambda i: F.coalesce(F.try_element_at("_counts", i), F.lit(0)).cast("double"),
        )
        return (
            df.join(counts, self.key, "left")
            .withColumn(out_col, dense)
            .withColumn(out_col, l2_normalise(out_col))
            .drop("_counts")
        )


class ModelEmbedder(_RowWise):
    """A sentence-embedding model, loaded once per Python worker.

    ``load(settings)`` runs on the worker and returns an object with
    ``encode(texts, batch_size=..., normalize_embeddings=..., convert_to_numpy=True)``.
    """

    def __init__(
        self,
        load: Callable[[ModelSettings], object],
        dimension: int,
        settings: ModelSettings = ModelSettings(),
        build: BuildSettings = BuildSettings(),
    ):
        self.name = settings.name
        self.dimension = dimension
        self.settings = settings
        self.load = load
        self.rows_per_call = build.embed_rows
        self.normalise = settings.normalize

    def encoder(self) -> Callable[[Sequence[str]], np.ndarray]:
        model = self.load(self.settings)

        def encode(texts: Sequence[str]) -> np.ndarray:
            return model.encode(
                list(texts),
                batch_size=self.rows_per_call,
                normalize_embeddings=self.normalise,
                convert_to_numpy=True,
            )

        return encode


class StoredVectors:
    """Vectors that exist already, joined by id. A row without a vector is an error, unless ``missing`` is ``"drop"``."""

    def __init__(
        self, vectors: DataFrame, dimension: int, name: str = "stored", key: str = "doc_id", missing: str = "error"
    ):
        self.name = name
        self.missing = missing
        self.dimension = dimension
        self.key = key
        self.vectors = vectors

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        vectors = self.vectors.select(self.key, F.col("embedding").cast(VECTOR).alias(out_col))
        if self.missing == "drop":
            return df.join(vectors, self.key)
        found = df.join(vectors, self.key, "left")
        absent = F.raise_error(F.concat(F.lit("no stored vector for "), F.col(self.key).cast("string")))
        return found.withColumn(out_col, F.coalesce(F.col(out_col), absent.cast(VECTOR)))
