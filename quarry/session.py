"""Session helpers: the shared scratch folder, intermediate tables and size checks."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a side may be broadcast. The rows sent are narrow (ids, a term, a few numbers),
# so this stays in the tens of megabytes.
BROADCAST_ROWS = 500_000

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_made: dict[str, list[str]] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions started without ``--py-files``."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='quarry-ship-')}/quarry", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="quarry-")
    return _local_scratch[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the scratch folder; ``clear_scratch`` removes what was written there."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the folders that this application named with ``fresh_path``, its scratch indexes among them.

    For the end of a job: results that were not yet written elsewhere go too. Returns the number of folders.
    """
    removed = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return removed


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back, for results that are used twice."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows. Only counts leave the tasks."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else unchanged for a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def in_passes(queries: DataFrame, size: int, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``run(queries)`` for any number of queries: about ``size`` at a time, the results saved and read together.

    The queries are saved in blocks by hash, so the corpus is scanned once per block and is never shuffled or copied.
    """
    n = queries.count()
    if n <= size:
        return run(queries)
    spark = queries.sparkSession
    # Blocks by hash differ a little in size; four fifths leave room.
    blocks = math.ceil(n / (0.8 * size))
    asked, found = fresh_path(spark, "queries"), fresh_path(spark, name)
    block = F.pmod(F.xxhash64("corpus_id", "query_id"), F.lit(blocks))
    queries.withColumn("_block", block).write.partitionBy("_block").parquet(asked)
    saved = spark.read.parquet(asked)
    schema = None
    for number in range(blocks):
        part = run(saved.filter(F.col("_block") == number).drop("_block"))
        schema = part.schema
        part.write.mode("append").parquet(found)
    return spark.read.schema(schema).parquet(found)
