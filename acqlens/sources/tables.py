"""Readers for the driver's parquet tables and the library's own file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acqlens.schemas import PLAYERS_SCHEMA, TXNS_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (`{sf_dir}/{name}.parquet`).

    Parquet carries its schema, so there is no inference pass; projections and filters
    written downstream are pushed into this scan by Catalyst (ReadSchema / PushedFilters).
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- S1 / S2: CSV scans with explicit schemas --------------------------------------------
def read_players_csv(spark: SparkSession, path: str) -> DataFrame:
    """Acquisition CSV (header, ISO dates) with an explicit schema: no inference pass."""
    return (
        spark.read.schema(PLAYERS_SCHEMA)
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_txns_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(TXNS_SCHEMA)
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV table with a header, one record a line: each line is in one of them.

    ``rows`` has ``schema``; ``rejects`` has the line, the reason (``fields`` where their number is
    wrong, else the first column whose text doesn't convert) and the file.  A line is always parsed
    whole: the CSV reader would parse, and so check, only the columns that a query selects.  Empty
    fields are nulls; empty lines and each file's header, which must be the columns' names, are left out.
    """
    def ddl(fields: list[tuple[str, str]]) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in fields)

    raw, most = "_corrupt_record", len(schema)
    typed = ddl([(f.name, f.dataType.simpleString()) for f in schema.fields] + [(raw, "string")])
    texts = ddl([(f"t{i}", "string") for i in range(most + 1)])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where((F.col("value") != ",".join(schema.names)) & (F.col("value") != ""))
    parsed = lines.select("value", "file", F.from_csv("value", typed, {"dateFormat": "yyyy-MM-dd", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw}).alias("r"),
                          F.from_csv("value", texts, {"nullValue": "\u0001", "emptyValue": ""}).alias("t"))
    wrong = F.col(f"t.t{most - 1}").isNull() | F.col(f"t.t{most}").isNotNull()
    good = F.col(f"r.{raw}").isNull() & ~wrong
    reason = F.when(wrong, "fields")
    for i, f in enumerate(schema.fields):
        reason = reason.when(F.col(f"r.{f.name}").isNull() & (F.col(f"t.t{i}") != ""), f.name)
    return (parsed.where(good).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]),
            parsed.where(~good).select(F.col("value").alias("line"), reason.otherwise("other").alias("reason"), "file"))


# --- S3: dataset sink ------------------------------------------------------------------
def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a table; CSV gets a header, Parquet is the default. Overwrites the target.

    With ``partition_by`` only the partitions that ``df`` has rows of are replaced, the files of the
    others stay as they are.  Rows are brought together by partition first, salted by their hash so
    that one large partition is written by many tasks.
    """
    if partition_by:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(16))
        df = df.repartition(*partition_by, salt)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


# --- S6: metrics records -----------------------------------------------------------------
def save_metrics(metrics: DataFrame, path: str) -> None:
    """Append one run's metrics (model, metric, value) as JSON lines: a run history."""
    metrics.coalesce(1).write.mode("append").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """Read the metrics history with an explicit schema; ``None`` when nothing was saved yet."""
    from acqlens.schemas import METRICS_SCHEMA

    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(METRICS_SCHEMA).json(path)
