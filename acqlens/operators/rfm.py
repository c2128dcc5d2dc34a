"""RFM summaries from transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.operators.ranks import exact_medians

RFM_COLUMNS = ["frequency", "recency", "T", "monetary_value"]


def rfm_summary(
    txns: DataFrame,
    observation_end: str,
    user_col: str = "user_id",
    date_col: str = "transaction_date",
    amount_col: str = "transaction_amount",
) -> DataFrame:
    """Per buyer: frequency, recency, T (days) and the mean purchase-day value after the first day.

    Two keyed aggregates, both with map-side partial aggregation: (user, day) -> day sums,
    then user -> summary.  The first day's value is taken with ``min_by`` inside the same
    aggregate (no window, no join), so a customer with a third of all rows is reduced to
    one row per calendar day before it is keyed by customer alone.
    """
    end = F.lit(observation_end).cast("date")
    days = (
        txns.select(
            F.col(user_col).alias("user_id"),
            F.to_date(date_col).alias("d"),
            F.col(amount_col).alias("amt"),
        )
        .filter(F.col("d") <= end)  # pushed into the scan as a date range
        .groupBy("user_id", "d")
        .agg(F.sum("amt").alias("s"))
    )
    per_user = days.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("d").alias("first_day"),
        F.max("d").alias("last_day"),
        F.sum("s").alias("total"),
        F.min_by("s", "d").alias("first_value"),
    )
    return per_user.select(
        "user_id",
        (F.col("n_days") - 1).cast("long").alias("frequency"),
        F.datediff("last_day", "first_day").cast("long").alias("recency"),
        F.datediff(end, "first_day").cast("long").alias("T"),
        F.when(
            F.col("n_days") > 1, (F.col("total") - F.col("first_value")) / (F.col("n_days") - 1)
        ).otherwise(F.lit(0.0)).alias("monetary_value"),
    )


def repeat_buyers(rfm: DataFrame) -> DataFrame:
    return rfm.filter(F.col("frequency") > 0)


def rfm_with_channel(rfm: DataFrame, players: DataFrame) -> DataFrame:
    """Left join on the user key, right side pruned to two columns."""
    return rfm.join(players.select("user_id", "acquisition_channel"), "user_id", "left")


def channel_rfm(rfm: DataFrame, players: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Exact median RFM of repeat buyers per channel.

    Left join + drop-null-channel is an inner join (Catalyst removes the outer side);
    medians go through the distributed rank path, never a per-channel collect.
    """
    joined = rfm_with_channel(repeat_buyers(rfm), players).filter(F.col("acquisition_channel").isNotNull())
    return exact_medians(joined, RFM_COLUMNS, ["acquisition_channel"], n_buckets)


def channel_profile(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """look up the median profile of each requested channel (a keyed join on a table of
    requests instead of one filter per call; unknown channels get NULLs)."""
    return requests.select("acquisition_channel").join(profiles, "acquisition_channel", "left")
