"""Aggregates kept per source file: a new or changed file replaces only its own share.

A share is the file's rows reduced to mergeable values (sums, counts, quantile sketches) per group,
written below the shared folder under the file's version (name, size, modification time).  A later
run reads only the files whose version has no share yet, and merges the shares of the files that are
there now; shares of changed or removed files stay unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acqlens.session import shared_folder

VERSION = "version"


def _version(name: str, size: int, modified: int) -> str:
    return hashlib.sha1(f"{name}|{size}|{modified}".encode()).hexdigest()


def _version_column() -> Column:
    m = "_metadata.file_"
    return F.sha1(F.concat_ws("|", f"{m}name", F.col(f"{m}size").cast("string"), F.unix_millis(f"{m}modification_time").cast("string")))


def file_versions(spark: SparkSession, folder: str) -> dict[str, str]:
    """path -> version of the data files in ``folder``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return {f.getPath().toString(): _version(f.getPath().getName(), f.getLen(), f.getModificationTime())
            for f in found if f.isFile() and f.getPath().getName()[0] not in "._"}


def _kept(spark: SparkSession, store: str) -> set[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName().split("=")[1] for f in fs.listStatus(path) if "=" in f.getPath().getName()} if fs.exists(path) else set()


def maintained(spark: SparkSession, name: str, folder: str, schema: T.StructType, share: Callable[[DataFrame, list[str]], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(shares of the files in ``folder``, files read by this call).

    ``share(rows, [version])`` groups rows by the version and by what else it needs.  ``name`` and
    the folder identify the store; a changed ``share`` needs a new name.  A file without rows has no
    share and is looked at again next time.
    """
    store = f"{shared_folder(spark)}/shares/{name}-{hashlib.sha1(folder.encode()).hexdigest()[:12]}"
    versions, kept = file_versions(spark, folder), _kept(spark, store)
    missing = sorted(p for p, v in versions.items() if v not in kept)
    if missing:
        rows = spark.read.schema(schema).parquet(*missing).select("*", _version_column().alias(VERSION))
        share(rows, [VERSION]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(VERSION).parquet(store)
    shape = share(spark.createDataFrame([], schema).withColumn(VERSION, F.lit("")), [VERSION]).schema
    if not _kept(spark, store):
        return spark.createDataFrame([], shape), missing
    typed = T.StructType([*(f for f in shape if f.name != VERSION), T.StructField(VERSION, T.StringType())])
    return spark.read.schema(typed).parquet(store).where(F.col(VERSION).isin(list(versions.values()))), missing
