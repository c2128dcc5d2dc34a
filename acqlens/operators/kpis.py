"""Channel KPIs, profiles and presentation aggregates over the players / txns tables.

All grouped aggregates here are keyed by low-cardinality columns (channel, month, label) or
are global, so Spark's partial (map-side) aggregation collapses every task to a few rows
before the exchange; a channel holding a third of all players costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.functions import expressions as X


# --- A1 / P14: overview ------------------------------------------------------------------
def overview_kpis(players: DataFrame) -> DataFrame:
    return players.agg(
        F.count(F.lit(1)).alias("players"),
        F.avg("ltv_day90").alias("avg_ltv_day90"),
        F.avg("retained_day7").alias("day7_retention"),
        F.sum("cost_per_install").alias("total_spend"),
    )


def kpi_cards(players: DataFrame) -> DataFrame:
    """The four overview cards as (position, label, value) display strings."""
    k = overview_kpis(players)
    return k.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("position"), F.lit("Players Acquired").alias("label"),
                         X.format_count_k("players").alias("value")),
                F.struct(F.lit(2).alias("position"), F.lit("Avg 90d IAP").alias("label"),
                         X.format_usd_k("avg_ltv_day90").alias("value")),
                F.struct(F.lit(3).alias("position"), F.lit("Day-7 Retention").alias("label"),
                         X.format_pct("day7_retention", 1).alias("value")),
                F.struct(F.lit(4).alias("position"), F.lit("Total UA Spend").alias("label"),
                         X.format_usd_k("total_spend").alias("value")),
            )
        )
    )


# --- A2 / A13 / T3: channel means ---------------------------------------------------------
def cpa_by_channel(players: DataFrame) -> DataFrame:
    return (
        players.filter(F.col("acquisition_channel").isNotNull())
        .groupBy("acquisition_channel")
        .agg(F.avg("cost_per_install").alias("cost_per_install"))
        .orderBy("cost_per_install")
    )


def ltv_by_channel(players: DataFrame) -> DataFrame:
    return (
        players.filter(F.col("acquisition_channel").isNotNull())
        .groupBy("acquisition_channel")
        .agg(F.avg("ltv_day90").alias("avg_ltv_day90"), F.count(F.lit(1)).alias("players"))
        .orderBy(F.desc("avg_ltv_day90"))
    )


def best_channel(players: DataFrame) -> DataFrame:
    """Highest and lowest mean-LTV channel in one pass over the (tiny) channel means."""
    means = ltv_by_channel(players)
    return means.agg(
        F.max_by("acquisition_channel", "avg_ltv_day90").alias("best_channel"),
        F.max("avg_ltv_day90").alias("best_avg_ltv"),
        F.min_by("acquisition_channel", "avg_ltv_day90").alias("worst_channel"),
        F.min("avg_ltv_day90").alias("worst_avg_ltv"),
    )


# --- A3 / P10 / P11: monthly ROAS trend ---------------------------------------------------
def roas_trend(players: DataFrame) -> DataFrame:
    """Revenue and spend by (acquisition month, channel); roas is a ratio of sums (NULL on 0 spend)."""
    return (
        players.filter(F.col("acquisition_channel").isNotNull() & F.col("acquisition_date").isNotNull())
        .groupBy(X.month_label("acquisition_date").alias("month"), "acquisition_channel")
        .agg(F.sum("ltv_day90").alias("revenue"), F.sum("cost_per_install").alias("spend"))
        .withColumn("roas", X.safe_ratio("revenue", "spend"))
    )


# --- A7: per-channel ROAS mean / sample std ----------------------------------------------
def channel_roas_stats(players: DataFrame) -> DataFrame:
    return (
        players.filter(F.col("acquisition_channel").isNotNull())
        .groupBy("acquisition_channel")
        .agg(
            F.avg("roas_90d").alias("roas_mean"),
            F.coalesce(F.stddev_samp("roas_90d"), F.lit(0.0)).alias("roas_std"),
        )
    )


# --- A10: dataset profile -------------------------------------------------------------------
PROFILE_FLAGS = ["retained_day7", "churned", "pass_royale_active", "clan_member", "is_purchaser"]


def dataset_profile(players: DataFrame) -> DataFrame:
    return players.agg(
        F.count(F.lit(1)).alias("players"),
        *[(F.avg(c) * 100.0).alias(f"{c}_pct") for c in PROFILE_FLAGS],
    )


# --- A11: transaction profile -------------------------------------------------------------
def txn_profile(txns: DataFrame) -> DataFrame:
    """n transactions, distinct buyers, repeat buyers: one keyed aggregate instead of a distinct shuffle."""
    per_user = txns.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.agg(
        F.sum("n").alias("transactions"),
        F.count(F.lit(1)).alias("purchasers"),
        F.count_if(F.col("n") > 1).alias("repeat_buyers"),
    )


# --- A12: correlations ----------------------------------------------------------------------
def correlations(players: DataFrame) -> DataFrame:
    return players.agg(
        F.corr("win_rate_week1", "retained_day7").alias("win_rate_vs_retained"),
        F.corr("trophies_end_week1", "ltv_day90").alias("trophies_vs_ltv"),
        F.corr("pass_royale_active", "ltv_day90").alias("pass_vs_ltv"),
    )


# --- A14: null profile ----------------------------------------------------------------------
def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, null_count) for every column, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_count")


# --- A15: normalised value counts -----------------------------------------------------------
def label_balance(players: DataFrame, labels: tuple[str, ...] = ("retained_day7", "churned", "is_purchaser")) -> DataFrame:
    long = players.select(*[F.col(c).cast("int").alias(c) for c in labels]).unpivot(
        [], list(labels), "label", "value"
    )
    counts = long.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the aggregated (label x value) rows only
    return counts.select(
        "label", "value", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("label"))).alias("share")
    )


# --- A21: channel mix -----------------------------------------------------------------------
def channel_mix(players: DataFrame) -> DataFrame:
    """Observed install share per channel.

    The ratio's denominator is a window over the *aggregated* table (one row per channel),
    so the un-partitioned window only ever sees the handful of channel rows.
    """
    counts = players.groupBy("acquisition_channel").agg(F.count(F.lit(1)).alias("players"))
    return counts.select(
        "acquisition_channel",
        "players",
        (F.col("players") / F.sum("players").over(Window.partitionBy())).alias("share"),
    )


# --- F1 / T2 ---------------------------------------------------------------------------------
def purchasers(players: DataFrame, require_nonempty: bool = False) -> DataFrame:
    """purchasers only; optionally fail when there are none (a ``limit(1)`` probe, which
    stops after the first matching row instead of counting the table)."""
    out = players.filter(F.col("is_purchaser") == 1)
    if require_nonempty and not out.limit(1).count():
        raise ValueError("the table has no purchasers")
    return out


def sample_players(players: DataFrame, n: int = 5) -> DataFrame:
    """head(n) in key order: a top-k (sort + limit pushes down to TakeOrderedAndProject)."""
    return players.orderBy("user_id").limit(n)


# --- J2 / J3 / P18: dimension joins and deterministic scores ---------------------------------
def channel_attributes(players: DataFrame, channel_dim: DataFrame, country_dim: DataFrame) -> DataFrame:
    """Per-player channel (6 attributes) and country engagement via broadcast joins on fixed-size dims."""
    return players.join(F.broadcast(channel_dim), "acquisition_channel", "left").join(
        F.broadcast(country_dim), "country", "left"
    )


def engagement_scores(players: DataFrame, channel_dim: DataFrame, country_dim: DataFrame,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """P18 scores per player; ``keep`` carries extra player columns through the same projection."""
    p = channel_attributes(players, channel_dim, country_dim)
    week = {"battles": "battles_week1", "win_rate": "win_rate_week1"}
    index = X.linear_score("engagement_index", **week, trophies="trophies_end_week1", arena="arena_id", clan="clan_member",
                           retention_boost="retention_boost", base_retention="base_retention", **{"pass": "pass_royale_active"})
    return p.select(
        "user_id",
        *keep,
        X.model_trophies("battles_week1", "win_rate_week1").alias("model_trophies"),
        X.linear_score("battle_mean", engagement="engagement", skill_bias="skill_bias").alias("battle_mean"),
        X.linear_score("clan_propensity", **week).alias("clan_propensity"),
        X.linear_score("pass_propensity", trophies="trophies_end_week1", win_rate="win_rate_week1", cards="cards_upgraded_week1").alias("pass_propensity"),
        index.alias("engagement_index"),
        X.retention_score(index).alias("retention_score"),
        X.trophy_wall("trophies_end_week1").alias("trophy_wall"),
        X.device_factor("device_type").alias("device_factor"),
        X.login_gap_score(
            "win_rate_week1", "battles_week1", "clan_member", "pass_royale_active", "avg_sessions_per_day"
        ).alias("login_gap_score"),
    )


def risk_bands(scores: DataFrame, prob_col: str = "churn_probability") -> DataFrame:
    return scores.withColumn("churn_risk", X.risk_band(prob_col))


# --- P12 ---------------------------------------------------------------------------------------
def rounded_metrics(players: DataFrame) -> DataFrame:
    """Half-even rounding at the reference's precisions (3 for rates, 2 for money/ratios)."""
    return players.select(
        "user_id",
        F.bround("win_rate_week1", 3).alias("win_rate_r3"),
        F.bround("cost_per_install", 2).alias("cpi_r2"),
        F.bround("ltv_day90", 2).alias("ltv_r2"),
        F.bround(X.roas("ltv_day90", "cost_per_install"), 2).alias("roas_r2"),
        F.bround("avg_sessions_per_day", 2).alias("sessions_r2"),
        F.bround("avg_battle_duration", 2).alias("battle_duration_r2"),
        F.bround(F.col("win_rate_week1") * 100.0, 1).alias("win_rate_pct_r1"),
    )


# --- P20 ---------------------------------------------------------------------------------------
def feature_projection(players: DataFrame) -> DataFrame:
    """Model inputs + targets only: Catalyst prunes every other column out of the scan."""
    cols = ["user_id"] + K.FEATURE_COLUMNS + [K.RETENTION_TARGET, K.LTV_TARGET]
    return players.select(*cols)


def churn_feature_projection(players: DataFrame) -> DataFrame:
    """The churn model's inputs and label."""
    return players.select("user_id", *K.CHURN_FEATURE_COLUMNS, K.CHURN_TARGET)


# --- F6: required-column guard -------------------------------------------------------------
def require_columns(df: DataFrame, cols: list[str], what: str = "operator") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns {missing} required by {what}.")


def small_side(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
