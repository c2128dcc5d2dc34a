"""Small dimension tables (S7) built from configuration values.

These are bounded by the configuration (a handful of channels / countries / scenarios), so
joining them with ``F.broadcast`` is safe at any fact-table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from acqlens import constants as K
from acqlens.schemas import SCENARIO_SCHEMA


def channel_dim(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [T.StructField("acquisition_channel", T.StringType())]
        + [T.StructField(n, T.DoubleType()) for n in K.CHANNEL_ATTRIBUTE_NAMES]
    )
    rows = [(ch, *vals) for ch, vals in K.CHANNEL_ATTRIBUTES.items()]
    return spark.createDataFrame(rows, schema)


def country_dim(spark: SparkSession) -> DataFrame:
    schema = "country string, engagement double"
    return spark.createDataFrame(list(K.COUNTRY_ENGAGEMENT.items()), schema)


def saturation_dim(spark: SparkSession, scales: dict[str, float] | None = None) -> DataFrame:
    scales = K.CHANNEL_SATURATION if scales is None else scales
    return spark.createDataFrame(
        [(ch, float(v)) for ch, v in scales.items()], "acquisition_channel string, saturation double"
    )


def min_spend_dim(spark: SparkSession, mins: dict[str, float] | None = None) -> DataFrame:
    """Per-channel minimum spend; the budget page default is 1,000 for every channel."""
    mins = {ch: 1000.0 for ch in K.CHANNELS} if mins is None else mins
    return spark.createDataFrame(
        [(ch, float(v)) for ch, v in mins.items()], "acquisition_channel string, min_spend double"
    )


# Fixed scenario fixture: (scenario_id, budget, max channel share).
SCENARIO_ROWS: list[tuple[int, float, float]] = [
    (1, 100000.0, 0.40),
    (2, 30000.0, 0.60),
    (3, 900000.0, 0.25),
    (4, 50000.0, 0.20),
    (5, 4000.0, 0.40),
    (6, 50000.0, 0.10),
    (7, 0.0, 0.40),
    (8, 50000.0, 1.50),
]


def scenarios(spark: SparkSession, rows: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """Budget scenarios. Rows 1-6 are the fixture; 7 and 8 exercise the bad-budget/bad-share guards."""
    return spark.createDataFrame(rows or SCENARIO_ROWS, SCENARIO_SCHEMA)
