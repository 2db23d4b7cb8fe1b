"""Helpers shared by the training-data operators: shared storage and hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import discard, shared_dir, spread, stored

__all__ = ["BLANKS", "aside", "bound_batches", "discard", "documents", "filesystem", "parallelism", "release", "shared_dir", "stored", "table", "word_array"]

#: Class of the contract's words: everything but these six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows and bytes of an Arrow batch where the session has Spark's defaults: texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}


def bound_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at once small; a session that says otherwise is left alone."""
    for key, (default, value) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns whose names begin like the operators' own (tw_) renamed, and how to name them as before."""
    own = {c: f"own_{k}_{c}" for k, c in enumerate(docs.columns) if c.lower().startswith("tw_")}
    return docs.withColumnsRenamed(own), lambda df: df.withColumnsRenamed({v: k for k, v in own.items()})


def release() -> None:
    """Give memory that a task has freed back to the system, at the end of its rows.

    Python workers are used again by later stages, which would add theirs to it.
    """
    pa.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system (local, HDFS, S3, GCS) and path of a URI, in any process."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return fs, path


def parallelism(df: DataFrame) -> int:
    """Partitions for an explicit deal of rows: the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def word_array(text):
    """The contract's words ``[^\\x20\\x09-\\x0D]+`` as an array column; null text: none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+")
    return F.filter(parts, lambda w: w != "")
