"""Derived tables written once to the shared checkpoint folder and read back by every query.

The reference generates its player / transaction files once and every analysis reads them.
Here the adapter views are materialised the same way: the first query that needs
``players`` writes it as Parquet under ``<spark.checkpoint.dir>/tables/``; later queries
read that table (column pruning and filter pushdown apply, the adapter's shuffles are not
repeated, lineage is cut so a lost executor only re-reads files).

The table location is keyed by the source files' size / count / modification time (read
through the Hadoop FileSystem API, so it works on HDFS / S3 / ABFS) and a definition
version, mirroring the reference's mtime-keyed data cache: changed inputs get a new table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acqlens.session import shared_folder

# bump when an adapter definition changes so persisted tables are not reused
DEFINITION_VERSION = "2"

_OPENED: dict[tuple, DataFrame] = {}


def _fs_signature(spark: SparkSession, paths: list[str]) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            parts.append(f"{p}:missing")
            continue
        st = fs.getFileStatus(path)
        cs = fs.getContentSummary(path)
        parts.append(f"{p}:{cs.getLength()}:{cs.getFileCount()}:{st.getModificationTime()}")
    return "|".join(parts)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def signature(spark: SparkSession, sources: list[str]) -> str:
    """Short digest of the source files' size, count and modification time."""
    return hashlib.sha1(f"{DEFINITION_VERSION}|{_fs_signature(spark, sources)}".encode()).hexdigest()[:16]


def location(spark: SparkSession, name: str, sources: list[str]) -> str:
    """Folder of the derived table for the present version of its sources."""
    return f"{shared_folder(spark)}/tables/{name}-{signature(spark, [*sources])}"


def materialized(
    spark: SparkSession,
    name: str,
    sources: list[str],
    build: Callable[[], DataFrame],
) -> DataFrame:
    """Read table ``name`` derived from ``sources``; build and publish it first if absent.

    A build is written beside its place and renamed into it, so readers see a whole table or
    none; of two sessions that build at once the first to rename wins and both read its table.
    """
    path = location(spark, name, sources)
    memo = (spark.sparkContext.applicationId, path)
    if memo in _OPENED:
        return _OPENED[memo]
    if not _exists(spark, path):
        draft = f"{path}.{uuid.uuid4().hex[:12]}"
        build().write.parquet(draft)
        jvm = spark.sparkContext._jvm
        src, dst = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path)
        fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if _exists(spark, path) or not fs.rename(src, dst):
            fs.delete(src, True)
    df = spark.read.parquet(path)
    _OPENED[memo] = df
    return df
