"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_fallback: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder of this process serves a local master; on a cluster executors
    would not see it, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master or 'the cluster'} share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="tidewatch-"))
            atexit.register(shutil.rmtree, _fallback[0], True)
        root = f"file://{_fallback[0]}"
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root; every call gives another one."""
    return f"{shared_root(spark)}/tidewatch-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove ``stored`` tables that nothing will read again, lazy results included."""
    for table in tables:
        spark = table.sparkSession
        root, files = shared_root(spark), table.inputFiles()
        if files:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            if hadoop.getName().startswith("tidewatch-") and hadoop.getParent().toUri().getPath() == urlparse(root).path:
                hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, at = _hadoop(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def contents(spark: SparkSession, path: str) -> str:
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file that is not there yet; False where another writer has made it.

    It appears whole: a draft is linked (local) or moved (HDFS, which refuses an existing target) to its
    name. Stores whose move overwrites, as S3's does, need a committer of their own.
    """
    fs, at = _hadoop(spark, path)
    _, draft = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        return not fs.exists(at) and fs.rename(draft, at)
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows of an input with fewer splits than cores, such as one small file, to all cores.

    Larger inputs are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Number all rows from 1 in ``order`` without bringing them to one task.

    Rows are dealt by range and numbered within their partition; only the partitions'
    counts are summed in one place.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("tw_part", F.spark_partition_id()), name)
    before = W.orderBy("tw_part").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("tw_part").agg(F.count("*").alias("tw_n")).select("tw_part", F.coalesce(F.sum("tw_n").over(before), F.lit(0)).alias("tw_before"))
    inside = F.row_number().over(W.partitionBy("tw_part").orderBy(*order))
    return dealt.withColumn("tw_inside", inside).join(counts, "tw_part").withColumn(name, F.col("tw_before") + F.col("tw_inside")).drop("tw_part", "tw_inside", "tw_before")
