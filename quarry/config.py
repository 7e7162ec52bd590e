"""Settings of the engine, and the database options taken from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# The BM25 constants of the Okapi variant.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Scores are rounded to this many decimals before they are ranked, so that the order in which
# a sum was added up on the cluster cannot reorder equal scores. Ties then fall to the lower id.
SCORE_DECIMALS = 9

# The corpus name of an index that holds a single corpus.
DEFAULT_CORPUS = "all"


@dataclass(frozen=True)
class ModelSettings:
    """What a model embedder needs to know; the values are passed on to the model factory."""

    name: str = "sentence-transformers/all-mpnet-base-v2"
    max_seq_length: int = 512
    dtype: str = "float16"
    device: str | None = None
    normalize: bool = True


@dataclass(frozen=True)
class BuildSettings:
    fetch_rows: int = 500
    embed_rows: int = 256
    root: str = "indexes"
    max_errors: int = 10


@dataclass(frozen=True)
class SearchSettings:
    top_k: int = 10
    min_score: float | None = 0.0
    use_bm25: bool = True
    bm25_weight: float = 0.3
    oversample: int = 3


# Gold-set evaluation looks deeper and keeps negative scores.
EVALUATION = SearchSettings(top_k=15, min_score=None)


def jdbc_options(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for Spark's JDBC reader, from ``DB_*`` variables or their bare lower-case names."""
    env = os.environ if env is None else env
    defaults = {"user": "", "password": "", "host": "localhost", "port": "5432", "name": ""}
    bare = {"name": "dbname"}
    found = {
        field: env.get(f"DB_{field.upper()}", env.get(bare.get(field, field), default))
        for field, default in defaults.items()
    }
    missing = [f"DB_{field.upper()}" for field, value in found.items() if not value]
    if missing:
        raise ValueError(f"database settings missing: {', '.join(missing)}")
    return {
        "url": f"jdbc:postgresql://{found['host']}:{found['port']}/{found['name']}",
        "user": found["user"],
        "password": found["password"],
        "driver": "org.postgresql.Driver",
    }


def index_location(root: str, model_name: str) -> str:
    """One folder per model; a slash in a model name must not open a sub-folder."""
    return f"{root.rstrip('/')}/{model_name.replace('/', '_')}"
