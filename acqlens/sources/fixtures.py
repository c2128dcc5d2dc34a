"""Adapter views: the player / transaction model derived from the driver's TPC-H style tables.

Definitions follow FIXTURES.md §2.  The physical shape matters at scale:

- orders are first collapsed to (customer, day) with a partial (map-side) aggregate, so a
  customer that owns a third of all orders is reduced to at most one row per calendar day
  before anything is keyed by customer alone;
- the 90-day window needs each customer's first day; that is a window over the *day-level*
  table (bounded by the number of distinct days per customer), partitioned by customer, and
  the following per-customer aggregate reuses the same hash partitioning (one exchange);
- the customer attributes are joined once on the key; AQE picks broadcast or sort-merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.functions import expressions as X
from acqlens.schemas import PLAYER_COLUMNS
from acqlens.sources.tables import read_table


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def order_days(orders: DataFrame) -> DataFrame:
    """(u, d, n, s, nf): orders per customer and day, amount sum, orders with status F."""
    return (
        orders.select(
            F.col("o_custkey").alias("u"),
            F.to_date("o_orderdate").alias("d"),
            F.col("o_totalprice").alias("amt"),
            F.col("o_orderstatus").alias("st"),
        )
        .groupBy("u", "d")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("amt").alias("s"),
            F.count_if(F.col("st") == "F").alias("nf"),
        )
    )


def customer_activity(orders: DataFrame) -> DataFrame:
    """Per customer: first/last day, first-90-day counts and sums, lifetime counts."""
    days = order_days(orders)
    by_user = Window.partitionBy("u")
    in90 = F.col("d") <= F.date_add(F.col("i"), 89)
    return (
        days.withColumn("i", F.min("d").over(by_user))
        .groupBy("u")
        .agg(
            F.min("i").alias("i"),
            F.max("d").alias("mx"),
            F.sum("n").alias("n_all"),
            F.count(F.lit(1)).alias("nd"),
            F.sum(F.when(in90, F.col("n"))).alias("n90"),
            F.max(F.when(in90, F.col("d"))).alias("l90"),
            F.sum(F.when(in90, F.col("s"))).alias("s90"),
            F.sum(F.when(in90, F.col("nf"))).alias("w90"),
        )
    )


def players_base(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Players without the operator-derived columns (arena_id, roas_90d, aliases)."""
    act = customer_activity(orders)
    cust = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    bal = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    dsll = F.datediff(F.lit(K.SNAPSHOT_DATE).cast("date"), F.col("mx"))
    return (
        cust.join(act, cust.c_custkey == act.u, "inner")
        .select(
            k.alias("user_id"),
            F.col("i").alias("acquisition_date"),
            F.col("i").alias("install_date"),
            F.col("l90").alias("last_login_date"),
            _literal_map(K.SEGMENT_TO_CHANNEL)[F.col("c_mktsegment")].alias("acquisition_channel"),
            F.element_at(
                F.array(*[F.lit(c) for c in K.COUNTRIES]), (F.col("c_nationkey") % 7 + 1).cast("int")
            ).alias("country"),
            F.when(k % 2 == 0, F.lit("iOS")).otherwise(F.lit("Android")).alias("device_type"),
            (1 + k % 14).cast("int").alias("king_level"),
            F.floor(bal).cast("int").alias("trophies_end_week1"),
            F.least(F.col("n90") * 7 + k % 11, F.lit(60)).cast("int").alias("battles_week1"),
            (F.col("w90") / F.col("n90")).alias("win_rate_week1"),
            (k % 81).cast("int").alias("cards_upgraded_week1"),
            (k % 3 == 0).cast("int").alias("clan_member"),
            (k % 5 == 0).cast("int").alias("pass_royale_active"),
            (bal / 2000.0).alias("cost_per_install"),
            (F.datediff(F.col("l90"), F.col("i")) >= 7).cast("int").alias("retained_day7"),
            (F.col("s90") / 5000.0).alias("ltv_day90"),
            (F.col("n90") > 1).cast("int").alias("is_purchaser"),
            (F.col("n_all") * 5).cast("int").alias("matches_played"),
            F.col("nd").cast("int").alias("days_active"),
            dsll.cast("int").alias("days_since_last_login"),
            (F.col("n90") / 7.0).alias("avg_sessions_per_day"),
            (1 + (k % 8) / 8.0 * 7).alias("avg_battle_duration"),
            (F.col("s90") / 5000.0).alias("total_spend"),
            X.churn_label(dsll).alias("churned"),
        )
    )


def derive_player_columns(base: DataFrame) -> DataFrame:
    """P1 arena bucket, P2 ROAS (round 2, half-even) and the P13 alias projections."""
    return base.withColumns(
        {
            "arena_id": X.trophies_to_arena("trophies_end_week1"),
            "roas_90d": F.bround(X.roas("ltv_day90", "cost_per_install"), 2),
            "trophies": F.col("trophies_end_week1"),
            "win_rate": F.col("win_rate_week1"),
            "pass_royale": F.col("pass_royale_active"),
        }
    ).select(*PLAYER_COLUMNS)


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30-column acquisition table, one row per customer with at least one order."""
    return derive_player_columns(
        players_base(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders"))
    )


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase transactions: (user_id, transaction_date, transaction_amount, transaction_type)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").alias("transaction_amount"),
        _literal_map(K.PRIORITY_TO_TYPE)[F.col("o_orderpriority")].alias("transaction_type"),
    )


def txns_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All purchase transactions with the amount in units of 5000 (the scale of ``ltv_day90``)."""
    return txns(spark, sf_dir).withColumn("transaction_amount", F.col("transaction_amount") / 5000.0)
