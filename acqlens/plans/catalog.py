"""The query catalog: one registered entry per SURVEY §2 key.

Every query reads the driver's tables (through the adapter views) so its work grows with
the data; fixed dimension/scenario tables only ever enter through keyed joins.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.functions import expressions as X
from acqlens.operators import cohorts, kpis, ranks, rfm
from acqlens.plans.oracle_sql import (
    PLAYERS_CTE,
    TXNS_CTE,
    TXNS_UNITS_CTE,
    rfm_cte,
    with_ctes,
)
from acqlens.plans.registry import REGISTRY, register
from acqlens.sources import dims, fixtures, store

P = with_ctes(PLAYERS_CTE)
PT = with_ctes(PLAYERS_CTE, TXNS_CTE)
RFM_RAW = with_ctes(TXNS_CTE, rfm_cte("txns"))
RFM_UNITS = with_ctes(TXNS_UNITS_CTE, rfm_cte("txns_units"))
P_RFM_UNITS = with_ctes(PLAYERS_CTE, TXNS_UNITS_CTE, rfm_cte("txns_units"))

PLAYER_DOUBLES = (
    "win_rate_week1", "cost_per_install", "ltv_day90", "roas_90d", "win_rate",
    "avg_sessions_per_day", "avg_battle_duration", "total_spend",
)

_CHANNEL_VALUES = ", ".join(
    "('{}', {})".format(ch, ", ".join(f"CAST({v!r} AS DOUBLE)" for v in vals))
    for ch, vals in K.CHANNEL_ATTRIBUTES.items()
)
CHANNEL_DIM_SQL = (
    f"channel_dim(acquisition_channel, {', '.join(K.CHANNEL_ATTRIBUTE_NAMES)}) AS (VALUES {_CHANNEL_VALUES})"
)
COUNTRY_DIM_SQL = "country_dim(country, engagement) AS (VALUES {})".format(
    ", ".join(f"('{c}', CAST({v!r} AS DOUBLE))" for c, v in K.COUNTRY_ENGAGEMENT.items())
)


def _src(sf, *tables_):
    return [f"{sf.rstrip('/')}/{t}.parquet" for t in tables_]


def _players(spark, sf):
    """The players table, materialised once per input version (see ``sources.store``)."""
    return store.materialized(spark, "players", _src(sf, "customer", "orders"),
                              lambda: fixtures.players(spark, sf))


# ============================== S: scans and sinks ==============================
@register("scan_players", P + "SELECT * FROM players", PLAYER_DOUBLES)
def q_scan_players(spark, sf):
    """The adapter view itself (computed from customer + orders, not the stored copy)."""
    return fixtures.players(spark, sf)


@register("scan_txns", with_ctes(TXNS_CTE) + "SELECT * FROM txns", ("transaction_amount",), bits=16)
def q_scan_txns(spark, sf):
    return fixtures.txns(spark, sf)


# ============================== P: projections ==============================
@register(
    "arena_bucket",
    P + """SELECT user_id, trophies_end_week1, arena_id,
      CAST(least(15, greatest(1, floor(greatest(trunc(trophies_end_week1 * 0.45 - 300), 0) / 300) + 1)) AS INTEGER)
        AS arena_shifted
    FROM players""",
)
def q_arena_bucket(spark, sf):
    p = _players(spark, sf)
    return p.select(
        "user_id", "trophies_end_week1",
        X.trophies_to_arena("trophies_end_week1").alias("arena_id"),
        X.trophies_to_arena(F.col("trophies_end_week1") * 0.45 - 300).alias("arena_shifted"),
    )


@register(
    "player_roas",
    P + """SELECT user_id, ltv_day90, cost_per_install,
      CASE WHEN cost_per_install > 0 THEN ltv_day90 / cost_per_install ELSE 0.0 END AS roas_raw, roas_90d
    FROM players""",
    ("ltv_day90", "cost_per_install", "roas_raw", "roas_90d"),
)
def q_player_roas(spark, sf):
    p = _players(spark, sf)
    return p.select("user_id", "ltv_day90", "cost_per_install",
                    X.roas("ltv_day90", "cost_per_install").alias("roas_raw"), "roas_90d")


@register(
    "churn_label",
    P + """SELECT user_id, days_since_last_login, CAST(days_since_last_login >= 14 AS INTEGER) AS churned,
      CAST(days_since_last_login >= 30 AS INTEGER) AS churned_30 FROM players""",
)
def q_churn_label(spark, sf):
    p = _players(spark, sf)
    return p.select("user_id", "days_since_last_login", X.churn_label("days_since_last_login").alias("churned"),
                    X.churn_label("days_since_last_login", 30).alias("churned_30"))


@register(
    "last_login_derived",
    P + f"""SELECT user_id, install_date,
      install_date + CAST(least(greatest(
        CASE WHEN churned = 1 THEN greatest(days_active - days_since_last_login, 0)
             ELSE least(days_active - 1, greatest(DATE '{K.SNAPSHOT_DATE}' - install_date, 0)) END, 0),
        greatest(DATE '{K.SNAPSHOT_DATE}' - install_date, 0)) AS INTEGER) AS last_login_derived
    FROM players""",
)
def q_last_login_derived(spark, sf):
    p = _players(spark, sf)
    return p.select("user_id", "install_date", X.last_login_from_activity(
        "install_date", "days_active", "days_since_last_login", "churned", K.SNAPSHOT_DATE
    ).alias("last_login_derived"))


_WEEK_SQL = ("strftime(CAST(date_trunc('week', install_date) AS DATE), '%Y-%m-%d') || '/' || "
             "strftime(CAST(date_trunc('week', install_date) AS DATE) + 6, '%Y-%m-%d')")
COHORT_SQL = f"""cohort AS (
  SELECT user_id, {_WEEK_SQL} AS install_week,
    CAST(greatest(last_login_date - install_date, 0) >= 1 AS INTEGER) AS retained_d1,
    CAST(greatest(last_login_date - install_date, 0) >= 7 AS INTEGER) AS retained_d7,
    CAST(greatest(last_login_date - install_date, 0) >= 30 AS INTEGER) AS retained_d30
  FROM players
)"""
MATRIX_SQL = """matrix AS (
  SELECT install_week, round_even(avg(retained_d1) * 100, 1) AS "D1", round_even(avg(retained_d7) * 100, 1) AS "D7",
         round_even(avg(retained_d30) * 100, 1) AS "D30"
  FROM cohort GROUP BY install_week
)"""
PC = with_ctes(PLAYERS_CTE, COHORT_SQL)
PCM = with_ctes(PLAYERS_CTE, COHORT_SQL, MATRIX_SQL)


@register("cohort_flags", PC + "SELECT * FROM cohort")
def q_cohort_flags(spark, sf):
    c = cohorts.cohort_frame(_players(spark, sf))
    return c.select("user_id", "install_week", "retained_d1", "retained_d7", "retained_d30")


@register("cohort_legacy_install", P + "SELECT user_id, acquisition_date AS install_date, last_login_date FROM players")
def q_cohort_legacy_install(spark, sf):
    legacy = _players(spark, sf).drop("install_date")
    return cohorts.with_activity_dates(legacy).select("user_id", "install_date", "last_login_date")


@register(
    "cohort_legacy_login",
    P + """SELECT user_id, install_date,
      install_date + CAST(greatest(days_active - days_since_last_login, 0) AS INTEGER) AS last_login_date
    FROM players""",
)
def q_cohort_legacy_login(spark, sf):
    legacy = _players(spark, sf).drop("last_login_date")
    return cohorts.with_activity_dates(legacy).select("user_id", "install_date", "last_login_date")


@register("retention_matrix", PCM + "SELECT * FROM matrix", ("D1", "D7", "D30"))
def q_retention_matrix(spark, sf):
    return cohorts.retention_matrix(cohorts.cohort_frame(_players(spark, sf)))


@register(
    "avg_retention",
    PCM + 'SELECT coalesce(avg("D1"), 0.0) AS d1, coalesce(avg("D7"), 0.0) AS d7, coalesce(avg("D30"), 0.0) AS d30 FROM matrix',
    ("d1", "d7", "d30"),
)
def q_avg_retention(spark, sf):
    return cohorts.average_retention(cohorts.retention_matrix(cohorts.cohort_frame(_players(spark, sf))))


@register(
    "retention_curve",
    PCM + """, a AS (SELECT coalesce(avg("D1"), 0.0) AS d1, coalesce(avg("D7"), 0.0) AS d7, coalesce(avg("D30"), 0.0) AS d30 FROM matrix)
    SELECT 1 AS position, 'D1' AS day_label, d1 AS retention_pct FROM a
    UNION ALL SELECT 2, 'D7', d7 FROM a UNION ALL SELECT 3, 'D30', d30 FROM a""",
    ("retention_pct",),
)
def q_retention_curve(spark, sf):
    return cohorts.retention_curve(cohorts.retention_matrix(cohorts.cohort_frame(_players(spark, sf))))


@register(
    "rounded_metrics",
    P + """SELECT user_id, round_even(win_rate_week1, 3) AS win_rate_r3, round_even(cost_per_install, 2) AS cpi_r2,
      round_even(ltv_day90, 2) AS ltv_r2,
      round_even(CASE WHEN cost_per_install > 0 THEN ltv_day90 / cost_per_install ELSE 0.0 END, 2) AS roas_r2,
      round_even(avg_sessions_per_day, 2) AS sessions_r2, round_even(avg_battle_duration, 2) AS battle_duration_r2,
      round_even(win_rate_week1 * 100.0, 1) AS win_rate_pct_r1
    FROM players""",
)
def q_rounded_metrics(spark, sf):
    return kpis.rounded_metrics(_players(spark, sf))


@register("churn_features", P + f"SELECT user_id, {', '.join(K.CHURN_FEATURE_COLUMNS)}, {K.CHURN_TARGET} FROM players",
          ("win_rate", "avg_sessions_per_day", "avg_battle_duration", "total_spend"))
def q_churn_features(spark, sf):
    """P20, the churn model's columns."""
    return kpis.churn_feature_projection(_players(spark, sf))


@register(
    "feature_projection",
    P + f"SELECT user_id, {', '.join(K.FEATURE_COLUMNS)}, retained_day7, ltv_day90 FROM players",
    ("cost_per_install", "win_rate_week1", "ltv_day90"),
)
def q_feature_projection(spark, sf):
    return kpis.feature_projection(_players(spark, sf))


# ============================== A: aggregates ==============================
@register(
    "roas_trend",
    P + """SELECT strftime(acquisition_date, '%Y-%m') AS month, acquisition_channel,
      sum(ltv_day90) AS revenue, sum(cost_per_install) AS spend,
      CASE WHEN sum(cost_per_install) = 0 THEN NULL ELSE sum(ltv_day90) / sum(cost_per_install) END AS roas
    FROM players WHERE acquisition_channel IS NOT NULL GROUP BY 1, 2""",
    ("revenue", "spend", "roas"),
)
def q_roas_trend(spark, sf):
    return kpis.roas_trend(_players(spark, sf))


@register(
    "overview_kpis",
    P + """SELECT count(*) AS players, avg(ltv_day90) AS avg_ltv_day90, avg(retained_day7) AS day7_retention,
      sum(cost_per_install) AS total_spend FROM players""",
    ("avg_ltv_day90", "day7_retention", "total_spend"),
)
def q_overview_kpis(spark, sf):
    return kpis.overview_kpis(_players(spark, sf))


@register(
    "kpi_cards",
    P + """, k AS (SELECT count(*) AS n, avg(ltv_day90) AS l, avg(retained_day7) AS r, sum(cost_per_install) AS s FROM players)
    SELECT 1 AS position, 'Players Acquired' AS label, format('{:,}', CAST(round_even(n / 1000.0, 0) * 1000 AS BIGINT)) AS value FROM k
    UNION ALL SELECT 2, 'Avg 90d IAP', CASE WHEN abs(l) < 500 THEN '$' || format('{:,.2f}', l)
        ELSE '$' || format('{:,}', CAST(round_even(l / 1000.0, 0) * 1000 AS BIGINT)) END FROM k
    UNION ALL SELECT 3, 'Day-7 Retention', format('{:.1f}', r * 100) || '%' FROM k
    UNION ALL SELECT 4, 'Total UA Spend', CASE WHEN abs(s) < 500 THEN '$' || format('{:,.2f}', s)
        ELSE '$' || format('{:,}', CAST(round_even(s / 1000.0, 0) * 1000 AS BIGINT)) END FROM k""",
)
def q_kpi_cards(spark, sf):
    return kpis.kpi_cards(_players(spark, sf))


@register(
    "cpa_by_channel",
    P + "SELECT acquisition_channel, avg(cost_per_install) AS cost_per_install FROM players "
        "WHERE acquisition_channel IS NOT NULL GROUP BY 1",
    ("cost_per_install",),
)
def q_cpa_by_channel(spark, sf):
    return kpis.cpa_by_channel(_players(spark, sf))


@register(
    "channel_roas_stats",
    P + "SELECT acquisition_channel, avg(roas_90d) AS roas_mean, coalesce(stddev_samp(roas_90d), 0.0) AS roas_std "
        "FROM players WHERE acquisition_channel IS NOT NULL GROUP BY 1",
    ("roas_mean", "roas_std"),
)
def q_channel_roas_stats(spark, sf):
    return kpis.channel_roas_stats(_players(spark, sf))


@register(
    "dataset_profile",
    P + "SELECT count(*) AS players, "
        + ", ".join(f"avg({c}) * 100.0 AS {c}_pct" for c in kpis.PROFILE_FLAGS) + " FROM players",
    tuple(f"{c}_pct" for c in kpis.PROFILE_FLAGS),
)
def q_dataset_profile(spark, sf):
    return kpis.dataset_profile(_players(spark, sf))


@register(
    "txn_profile",
    with_ctes(TXNS_CTE) + """SELECT CAST(sum(n) AS BIGINT) AS transactions, count(*) AS purchasers,
      count(*) FILTER (WHERE n > 1) AS repeat_buyers FROM (SELECT user_id, count(*) AS n FROM txns GROUP BY 1)""",
)
def q_txn_profile(spark, sf):
    return kpis.txn_profile(fixtures.txns(spark, sf))


@register(
    "correlations",
    P + """SELECT corr(win_rate_week1, retained_day7) AS win_rate_vs_retained,
      corr(trophies_end_week1, ltv_day90) AS trophies_vs_ltv, corr(pass_royale_active, ltv_day90) AS pass_vs_ltv
    FROM players""",
    ("win_rate_vs_retained", "trophies_vs_ltv", "pass_vs_ltv"),
)
def q_correlations(spark, sf):
    return kpis.correlations(_players(spark, sf))


@register(
    "ltv_by_channel",
    P + "SELECT acquisition_channel, avg(ltv_day90) AS avg_ltv_day90, count(*) AS players FROM players "
        "WHERE acquisition_channel IS NOT NULL GROUP BY 1",
    ("avg_ltv_day90",),
)
def q_ltv_by_channel(spark, sf):
    return kpis.ltv_by_channel(_players(spark, sf))


@register(
    "best_channel",
    P + """, m AS (SELECT acquisition_channel, avg(ltv_day90) AS v FROM players WHERE acquisition_channel IS NOT NULL GROUP BY 1)
    SELECT arg_max(acquisition_channel, v) AS best_channel, max(v) AS best_avg_ltv,
           arg_min(acquisition_channel, v) AS worst_channel, min(v) AS worst_avg_ltv FROM m""",
    ("best_avg_ltv", "worst_avg_ltv"),
)
def q_best_channel(spark, sf):
    return kpis.best_channel(_players(spark, sf))


@register(
    "null_profile",
    P + "SELECT column_name, null_count FROM (SELECT "
        + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in
                    __import__("acqlens.schemas", fromlist=["PLAYER_COLUMNS"]).PLAYER_COLUMNS)
        + " FROM players) UNPIVOT (null_count FOR column_name IN (COLUMNS(*)))",
)
def q_null_profile(spark, sf):
    return kpis.null_profile(_players(spark, sf))


@register(
    "label_balance",
    P + """, l AS (
      SELECT 'retained_day7' AS label, retained_day7 AS value FROM players
      UNION ALL SELECT 'churned', churned FROM players
      UNION ALL SELECT 'is_purchaser', is_purchaser FROM players)
    SELECT label, value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share
    FROM l GROUP BY label, value""",
    ("share",),
)
def q_label_balance(spark, sf):
    return kpis.label_balance(_players(spark, sf))


@register(
    "channel_mix",
    P + """SELECT acquisition_channel, count(*) AS players, count(*) / sum(count(*)) OVER () AS share
    FROM players GROUP BY 1""",
    ("share",),
)
def q_channel_mix(spark, sf):
    return kpis.channel_mix(_players(spark, sf))


@register("purchasers", P + "SELECT * FROM players WHERE is_purchaser = 1", PLAYER_DOUBLES)
def q_purchasers(spark, sf):
    return kpis.purchasers(_players(spark, sf))


@register("sample_players", P + "SELECT * FROM players ORDER BY user_id LIMIT 5", PLAYER_DOUBLES)
def q_sample_players(spark, sf):
    return kpis.sample_players(_players(spark, sf))


# ============================== J / P18 / P15: dimension joins ==============================
_ATTR_COLS = ", ".join(f"d.{n}" for n in K.CHANNEL_ATTRIBUTE_NAMES)
PD = with_ctes(PLAYERS_CTE, CHANNEL_DIM_SQL, COUNTRY_DIM_SQL)


@register(
    "channel_attributes",
    PD + f"""SELECT p.user_id, p.acquisition_channel, p.country, {_ATTR_COLS}, cd.engagement
    FROM players p LEFT JOIN channel_dim d USING (acquisition_channel) LEFT JOIN country_dim cd USING (country)""",
    tuple(K.CHANNEL_ATTRIBUTE_NAMES) + ("engagement",),
)
def q_channel_attributes(spark, sf):
    p = kpis.channel_attributes(_players(spark, sf), dims.channel_dim(spark), dims.country_dim(spark))
    return p.select("user_id", "acquisition_channel", "country", *K.CHANNEL_ATTRIBUTE_NAMES, "engagement")


ENGAGEMENT_SQL = """eng AS (
  SELECT p.*, d.retention_boost, d.base_retention, d.skill_bias, cd.engagement,
    (battles_week1 / 60.0) * 0.22 + win_rate_week1 * 0.28 + (trophies_end_week1 / 4500.0) * 0.18
      + (arena_id / 15.0) * 0.10 + clan_member * 0.12 + pass_royale_active * 0.05 + d.retention_boost
      + (d.base_retention - 0.40) * 0.30 AS engagement_index
  FROM players p LEFT JOIN channel_dim d USING (acquisition_channel) LEFT JOIN country_dim cd USING (country)
)"""
PDE = with_ctes(PLAYERS_CTE, CHANNEL_DIM_SQL, COUNTRY_DIM_SQL, ENGAGEMENT_SQL)
ENG_DOUBLES = ("battle_mean", "clan_propensity", "pass_propensity", "engagement_index", "retention_score",
               "device_factor", "login_gap_score")


@register(
    "engagement_score",
    PDE + """SELECT user_id,
      CAST(least(greatest(floor(battles_week1 * win_rate_week1) * 30
        - (battles_week1 - floor(battles_week1 * win_rate_week1)) * 27, 0), 4500) AS INTEGER) AS model_trophies,
      least(greatest(8 + engagement * 4 + (skill_bias + 0.1) * 20, 3.0), 55.0) AS battle_mean,
      least(greatest(0.12 + (battles_week1 / 60.0) * 0.45 + win_rate_week1 * 0.25, 0.05), 0.85) AS clan_propensity,
      least(greatest(0.04 + (trophies_end_week1 / 4500.0) * 0.10 + win_rate_week1 * 0.06
        + cards_upgraded_week1 / 80.0 * 0.08, 0.01), 0.35) AS pass_propensity,
      engagement_index,
      1.0 / (1.0 + exp(-10.0 * (engagement_index - 0.38))) AS retention_score,
      CAST(trophies_end_week1 BETWEEN 500 AND 1200 AS INTEGER) AS trophy_wall,
      CASE WHEN device_type = 'iOS' THEN 1.06 ELSE 1.0 END AS device_factor,
      (1 - win_rate_week1) * 5 + greatest(0, 12 - floor(battles_week1 / 5)) + (1 - clan_member) * 3
        - pass_royale_active * 4 - least(avg_sessions_per_day, 6.0) * 1.5 AS login_gap_score
    FROM eng""",
    ENG_DOUBLES,
)
def q_engagement_score(spark, sf):
    return kpis.engagement_scores(_players(spark, sf), dims.channel_dim(spark), dims.country_dim(spark))


def _churn_scores(spark, sf):
    """Players with a deterministic churn probability (1 - P18 retention score) and label."""
    s = kpis.engagement_scores(_players(spark, sf), dims.channel_dim(spark), dims.country_dim(spark),
                               keep=("retained_day7", "churned"))
    return s.withColumn("churn_probability", 1.0 - F.col("retention_score"))


@register(
    "risk_bands",
    PDE + """SELECT user_id, 1.0 - 1.0 / (1.0 + exp(-10.0 * (engagement_index - 0.38))) AS churn_probability,
      CASE WHEN 1.0 - 1.0 / (1.0 + exp(-10.0 * (engagement_index - 0.38))) < 0.30 THEN 'Low'
           WHEN 1.0 - 1.0 / (1.0 + exp(-10.0 * (engagement_index - 0.38))) < 0.60 THEN 'Medium'
           ELSE 'High' END AS churn_risk
    FROM eng""",
    ("churn_probability",),
)
def q_risk_bands(spark, sf):
    return kpis.risk_bands(_churn_scores(spark, sf)).select("user_id", "churn_probability", "churn_risk")


# ============================== RFM ==============================
RFM_DOUBLES = ("monetary_value",)


@register("rfm_summary", RFM_RAW + "SELECT * FROM rfm", RFM_DOUBLES, bits=16)
def q_rfm_summary(spark, sf):
    return rfm.rfm_summary(fixtures.txns(spark, sf), K.OBSERVATION_END)


def _rfm_units(spark, sf):
    """RFM of all orders in the window, materialised like ``players`` (shared by every CLV query)."""
    return store.materialized(spark, "rfm_units", _src(sf, "orders"),
                              lambda: rfm.rfm_summary(fixtures.txns_units(spark, sf), K.OBSERVATION_END))


@register("repeat_buyers", RFM_UNITS + "SELECT * FROM rfm WHERE frequency > 0", RFM_DOUBLES)
def q_repeat_buyers(spark, sf):
    return rfm.repeat_buyers(_rfm_units(spark, sf))


@register(
    "rfm_channel_join",
    with_ctes(PLAYERS_CTE, TXNS_CTE, rfm_cte("txns"))
    + "SELECT r.*, p.acquisition_channel FROM rfm r LEFT JOIN players p USING (user_id)",
    RFM_DOUBLES, bits=16,
)
def q_rfm_channel_join(spark, sf):
    return rfm.rfm_with_channel(rfm.rfm_summary(fixtures.txns(spark, sf), K.OBSERVATION_END), _players(spark, sf))


CHANNEL_RFM_SQL = """channel_rfm AS (
  SELECT p.acquisition_channel,
    quantile_cont(CAST(r.frequency AS DOUBLE), 0.5) AS frequency, quantile_cont(CAST(r.recency AS DOUBLE), 0.5) AS recency,
    quantile_cont(CAST(r."T" AS DOUBLE), 0.5) AS "T", quantile_cont(r.monetary_value, 0.5) AS monetary_value
  FROM rfm r JOIN players p USING (user_id)
  WHERE r.frequency > 0 AND p.acquisition_channel IS NOT NULL GROUP BY 1
)"""


@register(
    "channel_rfm",
    with_ctes(PLAYERS_CTE, TXNS_UNITS_CTE, rfm_cte("txns_units"), CHANNEL_RFM_SQL) + "SELECT * FROM channel_rfm",
    ("frequency", "recency", "T", "monetary_value"),
)
def q_channel_rfm(spark, sf):
    return rfm.channel_rfm(_rfm_units(spark, sf), _players(spark, sf))


# ============================== W: ranks, split, AUC ==============================
PCTRANK_SQL = """pr AS (
  SELECT p.*, (rank() OVER (ORDER BY ltv_day90) + (count(*) OVER (PARTITION BY ltv_day90) - 1) / 2.0)
              / count(*) OVER () AS ltv_pct_rank
  FROM players p
)"""


@register(
    "ltv_pct_rank",
    with_ctes(PLAYERS_CTE, PCTRANK_SQL) + "SELECT user_id, ltv_day90, ltv_pct_rank FROM pr",
    ("ltv_day90", "ltv_pct_rank"),
)
def q_ltv_pct_rank(spark, sf):
    p = _players(spark, sf).select("user_id", "ltv_day90")
    return ranks.pct_rank(p, "ltv_day90", "ltv_pct_rank").select("user_id", "ltv_day90", "ltv_pct_rank")


@register(
    "purchase_propensity",
    with_ctes(PLAYERS_CTE, PCTRANK_SQL) + """SELECT user_id, ltv_pct_rank,
      least(greatest(0.04 + pass_royale_active * 0.35 + ltv_pct_rank * 0.30 + retained_day7 * 0.08
        + (cards_upgraded_week1 / 80.0) * 0.10, 0.0), 0.88) AS purchase_propensity
    FROM pr""",
    ("ltv_pct_rank", "purchase_propensity"),
)
def q_purchase_propensity(spark, sf):
    p = _players(spark, sf).select("user_id", "ltv_day90", "pass_royale_active", "retained_day7", "cards_upgraded_week1")
    r = ranks.pct_rank(p, "ltv_day90", "ltv_pct_rank")
    return r.select("user_id", "ltv_pct_rank", X.linear_score(
        "purchase_propensity", ltv_pct_rank="ltv_pct_rank", retained="retained_day7", cards="cards_upgraded_week1",
        **{"pass": "pass_royale_active"}).alias("purchase_propensity"))


def _split_sql(label: str, name: str) -> str:
    return f"""{name} AS (
  SELECT p.*, row_number() OVER (PARTITION BY {label} ORDER BY ('0x' || substr(md5('{K.SEED}|' || CAST(user_id AS VARCHAR)), 1, 15))::BIGINT)
      <= ceil(count(*) OVER (PARTITION BY {label}) * {K.TEST_SIZE}) AS is_test
  FROM players p
)"""


@register(
    "holdout_split",
    with_ctes(PLAYERS_CTE, _split_sql("retained_day7", "split")) + "SELECT user_id, retained_day7, is_test FROM split",
)
def q_holdout_split(spark, sf):
    p = _players(spark, sf).select("user_id", "retained_day7")
    return ranks.holdout_split(p, "user_id", K.TEST_SIZE, K.SEED, "retained_day7").select(
        "user_id", "retained_day7", "is_test")


@register(
    "class_weight",
    with_ctes(PLAYERS_CTE, _split_sql("retained_day7", "s1"), _split_sql("churned", "s2")) + """
    SELECT 'retained_day7' AS label, count(*) FILTER (WHERE retained_day7 = 0) AS negatives,
           count(*) FILTER (WHERE retained_day7 = 1) AS positives,
           count(*) FILTER (WHERE retained_day7 = 0) / greatest(count(*) FILTER (WHERE retained_day7 = 1), 1) AS class_weight
    FROM s1 WHERE NOT is_test
    UNION ALL
    SELECT 'churned', count(*) FILTER (WHERE churned = 0), count(*) FILTER (WHERE churned = 1),
           count(*) FILTER (WHERE churned = 0) / greatest(count(*) FILTER (WHERE churned = 1), 1)
    FROM s2 WHERE NOT is_test""",
    ("class_weight",),
)
def q_class_weight(spark, sf):
    from acqlens.operators import models

    p = _players(spark, sf)
    out = None
    for label in ("retained_day7", "churned"):
        w = models.class_weight(ranks.train_counts(p, K.TEST_SIZE, label), label, "n").select(F.lit(label).alias("label"), "*")
        out = w if out is None else out.unionByName(w)
    return out


AUC_SQL = """auc_in AS (
  SELECT retained_day7 AS y, 1.0 / (1.0 + exp(-10.0 * (engagement_index - 0.38))) AS s FROM eng
), auc_r AS (
  SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM auc_in
)"""


@register(
    "roc_auc",
    with_ctes(PLAYERS_CTE, CHANNEL_DIM_SQL, COUNTRY_DIM_SQL, ENGAGEMENT_SQL, AUC_SQL) + """
    SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
           / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc
    FROM auc_r""",
    ("roc_auc",),
)
def q_roc_auc(spark, sf):
    return ranks.roc_auc(_churn_scores(spark, sf), "retained_day7", "retention_score")


# ============================== O: budget allocation ==============================
from acqlens.operators import budget  # noqa: E402

def _usd_k_sql(x: str) -> str:
    """P14 display format in DuckDB SQL (the oracle side of ``expressions.format_usd_k``)."""
    return (f"CASE WHEN abs({x}) < 500 THEN '$' || format('{{:,.2f}}', {x}) "
            f"ELSE '$' || format('{{:,}}', CAST(round_even({x} / 1000.0, 0) * 1000 AS BIGINT)) END")


_SCEN_VALUES = ", ".join(f"({i}, CAST({b!r} AS DOUBLE), CAST({s!r} AS DOUBLE))" for i, b, s in dims.SCENARIO_ROWS)
BUDGET_SQL = [
    f"scen(scenario_id, budget, share) AS (VALUES {_SCEN_VALUES})",
    "chans AS (SELECT DISTINCT acquisition_channel FROM players WHERE acquisition_channel IS NOT NULL)",
    "sat(acquisition_channel, saturation) AS (VALUES {})".format(
        ", ".join(f"('{c}', CAST({v!r} AS DOUBLE))" for c, v in K.CHANNEL_SATURATION.items())),
    "mins(acquisition_channel, min_spend) AS (VALUES {})".format(
        ", ".join(f"('{c}', CAST(1000.0 AS DOUBLE))" for c in K.CHANNELS)),
    """stats AS (
  SELECT acquisition_channel, avg(roas_90d) AS roas_mean, coalesce(stddev_samp(roas_90d), 0.0) AS roas_std
  FROM players WHERE acquisition_channel IS NOT NULL GROUP BY 1
)""",
    f"""inp AS (
  SELECT s.scenario_id, s.budget, s.share, c.acquisition_channel,
    coalesce(st.roas_mean, 0.0) AS roas, coalesce(st.roas_std, 0.0) AS roas_std,
    greatest(coalesce(st.roas_mean, 0.0), {K.ROAS_FLOOR}) AS roas_opt,
    greatest(coalesce(sa.saturation, {K.DEFAULT_SATURATION}), {K.SATURATION_FLOOR}) AS saturation,
    coalesce(m.min_spend, 0.0) AS min_spend, s.share * s.budget AS cap
  FROM scen s CROSS JOIN chans c LEFT JOIN stats st USING (acquisition_channel)
  LEFT JOIN sat sa USING (acquisition_channel) LEFT JOIN mins m USING (acquisition_channel)
)""",
    """valst AS (
  SELECT scenario_id, budget, share, n_channels, min_total, cap,
    CASE WHEN budget <= 0 THEN 'bad_budget' WHEN share <= 0 OR share > 1 THEN 'bad_share'
         WHEN min_total > budget THEN 'min_exceeds_budget'
         WHEN min_total > n_channels * cap + 1e-6 THEN 'min_exceeds_cap'
         WHEN max_min > cap THEN 'min_above_cap'
         WHEN n_channels * cap < budget * (1 - 1e-12) THEN 'cap_below_budget' ELSE 'ok' END AS status
  FROM (SELECT scenario_id, budget, share, count(*) AS n_channels, sum(min_spend) AS min_total,
               max(min_spend) AS max_min, any_value(cap) AS cap FROM inp GROUP BY 1, 2, 3)
)""",
    # Independent of the Spark algorithm (cumulative deltas over sorted breakpoints): here
    # the true clipped total is evaluated at every breakpoint, the budget is bracketed, the
    # channels are classified inside the bracket and lam is solved from that piece.
    """okin AS (
  SELECT i.* FROM inp i JOIN valst v USING (scenario_id) WHERE v.status = 'ok'
), bp AS (
  SELECT scenario_id, roas_opt / (1 + min_spend / saturation) AS lam FROM okin
  UNION
  SELECT scenario_id, roas_opt / (1 + cap / saturation) FROM okin
), bptot AS (
  SELECT b.scenario_id, b.lam, any_value(o.budget) AS budget,
         sum(least(greatest(o.saturation * (o.roas_opt / b.lam - 1), o.min_spend), o.cap)) AS total
  FROM bp b JOIN okin o USING (scenario_id) GROUP BY 1, 2
), br AS (
  SELECT *, CASE WHEN lam_lo IS NULL THEN lam_hi / 2 ELSE (lam_lo + lam_hi) / 2 END AS lm
  FROM (SELECT scenario_id, any_value(budget) AS budget,
               min(lam) FILTER (WHERE total <= budget * (1 + 1e-12)) AS lam_hi,
               max(lam) FILTER (WHERE total > budget * (1 + 1e-12)) AS lam_lo
        FROM bptot GROUP BY 1)
), cls AS (
  SELECT o.scenario_id, any_value(br.budget) AS budget, any_value(br.lam_hi) AS lam_hi,
    sum(CASE WHEN o.saturation * (o.roas_opt / br.lm - 1) <= o.min_spend THEN o.min_spend
             WHEN o.saturation * (o.roas_opt / br.lm - 1) >= o.cap THEN o.cap
             ELSE -o.saturation END) AS a,
    sum(CASE WHEN o.saturation * (o.roas_opt / br.lm - 1) > o.min_spend
              AND o.saturation * (o.roas_opt / br.lm - 1) < o.cap THEN o.saturation * o.roas_opt
             ELSE 0.0 END) AS c
  FROM okin o JOIN br USING (scenario_id) GROUP BY 1
), lam AS (
  SELECT scenario_id, CASE WHEN c > 0 THEN c / (budget - a) ELSE lam_hi END AS lam FROM cls
), alloc AS (
  SELECT i.*, v.status,
    CASE WHEN v.status = 'ok' THEN least(greatest(i.saturation * (i.roas_opt / l.lam - 1), i.min_spend), i.cap) END
      AS allocation
  FROM inp i JOIN valst v USING (scenario_id) LEFT JOIN lam l USING (scenario_id)
)""",
    """rep0 AS (
  SELECT scenario_id, budget, acquisition_channel, allocation, allocation / budget * 100.0 AS percentage,
    CASE WHEN allocation > 0 AND roas > 0 AND saturation > 0
         THEN roas * saturation * ln(1 + allocation / saturation) ELSE 0.0 END AS expected_return,
    CASE WHEN allocation <= 0 OR saturation <= 0 THEN roas ELSE roas / (1 + allocation / saturation) END
      AS marginal_roas
  FROM alloc WHERE status = 'ok'
), rep AS (
  SELECT *, round_even(percentage, 1) AS share_pct_r1, round_even(marginal_roas, 2) AS marginal_roas_r2,
    CASE WHEN abs(allocation) < 500 THEN '$' || format('{:,.2f}', allocation)
         ELSE '$' || format('{:,}', CAST(round_even(allocation / 1000.0, 0) * 1000 AS BIGINT)) END AS allocation_display,
    sum(expected_return) OVER (PARTITION BY scenario_id) AS total_expected_return
  FROM rep0
)""",
    f"""sim AS (
  SELECT a.scenario_id, a.acquisition_channel, d.draw,
    CASE WHEN a.allocation > 0 AND a.saturation > 0 THEN
      greatest(greatest(a.roas, {K.ROAS_FLOOR}) + greatest(
          CASE WHEN a.roas_std > 0 THEN a.roas_std ELSE greatest(a.roas, {K.ROAS_FLOOR}) * {K.ROAS_CV} END,
          greatest(a.roas, {K.ROAS_FLOOR}) * {K.MIN_STD_FRACTION})
        * sqrt(-2.0 * ln((('0x' || substr(md5('{K.SEED}|' || CAST(d.draw AS VARCHAR) || '|' || a.acquisition_channel), 1, 13))::BIGINT + 0.5) / 4503599627370496.0))
        * cos(2.0 * pi() * (('0x' || substr(md5('{K.SEED}|' || CAST(d.draw AS VARCHAR) || '|' || a.acquisition_channel), 14, 13))::BIGINT + 0.5) / 4503599627370496.0),
      {K.ROAS_FLOOR}) * a.saturation * ln(1 + a.allocation / a.saturation)
    ELSE 0.0 END AS ret
  FROM alloc a CROSS JOIN (SELECT range AS draw FROM range({K.MC_SIMULATIONS})) d WHERE a.status = 'ok'
), tot AS (
  SELECT scenario_id, draw, sum(ret) AS total FROM sim GROUP BY 1, 2
), bands AS (
  SELECT scenario_id, acquisition_channel, quantile_cont(ret, 0.1) AS p10, quantile_cont(ret, 0.5) AS p50,
         quantile_cont(ret, 0.9) AS p90, avg(ret) AS mean, stddev_pop(ret) AS std FROM sim GROUP BY 1, 2
  UNION ALL
  SELECT scenario_id, 'TOTAL', quantile_cont(total, 0.1), quantile_cont(total, 0.5), quantile_cont(total, 0.9),
         avg(total), stddev_pop(total) FROM tot GROUP BY 1
)""",
]
PB = with_ctes(PLAYERS_CTE, *BUDGET_SQL)


def _inputs(spark, sf):
    """Scenario x channel inputs.  Allocation, report and simulation branches all start from
    the same channel-statistics aggregate; Spark's exchange reuse runs that scan once."""
    p = _players(spark, sf)
    return budget.scenario_inputs(dims.scenarios(spark), kpis.channel_roas_stats(p),
                                  dims.saturation_dim(spark), dims.min_spend_dim(spark))


def _allocation(spark, sf):
    return budget.budget_allocation(_inputs(spark, sf))


INPUT_DOUBLES = ("budget", "share", "roas", "roas_std", "roas_opt", "saturation", "min_spend", "cap")


@register("scenario_inputs", PB + "SELECT * FROM inp", INPUT_DOUBLES)
def q_scenario_inputs(spark, sf):
    return _inputs(spark, sf)


@register("scenario_validation", PB + "SELECT * FROM valst", ("budget", "share", "min_total", "cap"))
def q_scenario_validation(spark, sf):
    return budget.scenario_validation(_inputs(spark, sf))


@register(
    "budget_allocation",
    PB + "SELECT scenario_id, acquisition_channel, status, allocation FROM alloc",
    ("allocation",), bits=20,
)
def q_budget_allocation(spark, sf):
    return _allocation(spark, sf).select("scenario_id", "acquisition_channel", "status", "allocation")


REPORT_DOUBLES = ("budget", "allocation", "percentage", "expected_return", "marginal_roas", "share_pct_r1",
                  "marginal_roas_r2", "total_expected_return")


@register("allocation_report", PB + "SELECT * FROM rep", REPORT_DOUBLES, bits=20)
def q_allocation_report(spark, sf):
    return budget.allocation_report(_allocation(spark, sf))


@register(
    "allocation_totals",
    PB + """SELECT scenario_id, budget, sum(allocation) AS total_allocation, sum(percentage) AS total_percentage,
      sum(expected_return) AS total_expected_return, sum(expected_return) / budget AS return_over_budget
    FROM rep GROUP BY 1, 2""",
    ("budget", "total_allocation", "total_percentage", "total_expected_return", "return_over_budget"), bits=20,
)
def q_allocation_totals(spark, sf):
    return budget.allocation_totals(budget.allocation_report(_allocation(spark, sf)))


@register("mc_bands", PB + "SELECT * FROM bands", ("p10", "p50", "p90", "mean", "std"), bits=16)
def q_mc_bands(spark, sf):
    return budget.mc_bands(budget.simulate_returns(_allocation(spark, sf)))


@register(
    "mc_histogram",
    PB + """, rng AS (SELECT scenario_id, min(total) AS lo, max(total) AS hi, quantile_cont(total, 0.1) AS p10,
                           quantile_cont(total, 0.5) AS p50, quantile_cont(total, 0.9) AS p90 FROM tot GROUP BY 1)
    SELECT scenario_id, bin, lo + bin * (hi - lo) / 40 AS bin_lo, lo + (bin + 1) * (hi - lo) / 40 AS bin_hi, count(*) AS n,
           any_value(p10) AS p10, any_value(p50) AS p50, any_value(p90) AS p90
    FROM (SELECT t.scenario_id, lo, hi, p10, p50, p90,
                 CAST(CASE WHEN hi > lo THEN least(floor((total - lo) / ((hi - lo) / 40)), 39)
                 ELSE 0 END AS INTEGER) AS bin FROM tot t JOIN rng USING (scenario_id))
    GROUP BY scenario_id, bin, lo, hi""",
    ("bin_lo", "bin_hi", "p10", "p50", "p90"), bits=16,
)
def q_mc_histogram(spark, sf):
    return budget.mc_histogram(budget.simulate_returns(_allocation(spark, sf)))


@register(
    "allocation_with_bands",
    PB + f"""SELECT r.*, b.p10, b.p50, b.p90, b.p90 - b.p50 AS error_plus, b.p50 - b.p10 AS error_minus,
      {_usd_k_sql("b.p50")} AS return_p50_display,
      {_usd_k_sql("b.p10")} || ' – ' || {_usd_k_sql("b.p90")} AS return_band_display
    FROM rep r LEFT JOIN bands b USING (scenario_id, acquisition_channel)""",
    REPORT_DOUBLES + ("p10", "p50", "p90", "error_plus", "error_minus"), bits=16,
)
def q_allocation_with_bands(spark, sf):
    alloc = _allocation(spark, sf)
    return budget.allocation_with_bands(budget.allocation_report(alloc), budget.mc_bands(budget.simulate_returns(alloc)))


@register(
    "response_curve",
    PB + """SELECT scenario_id, acquisition_channel, spend,
      CASE WHEN spend > 0 AND roas > 0 AND saturation > 0
           THEN roas * saturation * ln(1 + spend / saturation) ELSE 0.0 END AS channel_return,
      CASE WHEN spend <= 0 OR saturation <= 0 THEN roas ELSE roas / (1 + spend / saturation) END AS marginal_roas
    FROM (SELECT i.*, x.k * 0.1 * i.saturation AS spend
          FROM inp i CROSS JOIN (SELECT range AS k FROM range(0, 11)) x)""",
    ("spend", "channel_return", "marginal_roas"), bits=20,
)
def q_response_curve(spark, sf):
    """P16/P17 on a spend grid of 0, 10%, ..., 100% of each channel's saturation scale, at
    the channel's observed ROAS (the grid is generated per row; no join)."""
    g = _inputs(spark, sf).select("scenario_id", "acquisition_channel", "roas", "saturation",
                 F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    spend = F.col("k") * 0.1 * F.col("saturation")
    return g.select("scenario_id", "acquisition_channel", spend.alias("spend"),
                    X.channel_return(spend, "roas", "saturation").alias("channel_return"),
                    X.marginal_roas(spend, "roas", "saturation").alias("marginal_roas"))


# ============================== M11-M16: BG/NBD and Gamma-Gamma ==============================
from acqlens.operators import clv  # noqa: E402

# Fixed parameters for the likelihood / CLV oracles (FIXTURES.md §2.3).
BG_FIXED = (0.8, 300.0, 0.5, 2.5)   # r, alpha, a, b
GG_FIXED = (6.0, 4.0, 15.0)         # p, q, v

PRM_SQL = ("prm AS (SELECT CAST({} AS DOUBLE) AS r, CAST({} AS DOUBLE) AS al, CAST({} AS DOUBLE) AS a, "
           "CAST({} AS DOUBLE) AS b, CAST({} AS DOUBLE) AS p, CAST({} AS DOUBLE) AS q, CAST({} AS DOUBLE) AS v)"
           ).format(*BG_FIXED, *GG_FIXED)


def _clv_sql(src: str, key: str) -> list[str]:
    """Expected purchases at 0/30/60/90 days and CLV for every row of ``src`` (oracle side)."""
    return [
        PRM_SQL,
        f"""u AS (SELECT {key}, CAST(frequency AS DOUBLE) AS x, CAST(recency AS DOUBLE) AS tx,
                    CAST("T" AS DOUBLE) AS tt, monetary_value AS m FROM {src})""",
        """hyp AS (
  SELECT u.*, hz.t, sum(exp(lgamma(prm.r + u.x + g.k) - lgamma(prm.r + u.x) + lgamma(prm.b + u.x + g.k) - lgamma(prm.b + u.x)
       - lgamma(prm.a + prm.b + u.x - 1 + g.k) + lgamma(prm.a + prm.b + u.x - 1) - lgamma(g.k + 1.0)
       + g.k * ln(hz.t / (prm.al + u.tt + hz.t)))) AS s
  FROM u CROSS JOIN prm CROSS JOIN (VALUES (30.0), (60.0), (90.0)) hz(t) CROSS JOIN range(0, 600) g(k)
  GROUP BY ALL
)""",
        """ep AS (
  SELECT h.*, (prm.a + prm.b + h.x - 1) / (prm.a - 1)
      * (1 - pow((prm.al + h.tt) / (prm.al + h.tt + h.t), prm.r + h.x) * h.s)
      / (1 + CASE WHEN h.x > 0 THEN prm.a / (prm.b + h.x - 1) * pow((prm.al + h.tt) / (prm.al + h.tx), prm.r + h.x)
                  ELSE 0.0 END) AS e
  FROM hyp h CROSS JOIN prm
)""",
        f"""epw AS (
  SELECT {key}, any_value(x) AS x, any_value(m) AS m,
         max(e) FILTER (WHERE t = 30.0) AS e30, max(e) FILTER (WHERE t = 60.0) AS e60,
         max(e) FILTER (WHERE t = 90.0) AS e90
  FROM ep GROUP BY 1
)""",
        f"""clv AS (
  SELECT {key}, ((1 - prm.p * x / (prm.p * x + prm.q - 1)) * (prm.p * prm.v / (prm.q - 1))
                 + prm.p * x / (prm.p * x + prm.q - 1) * m)
         * (e30 / 1.01 + (e60 - e30) / pow(1.01, 2) + (e90 - e60) / pow(1.01, 3)) AS clv
  FROM epw CROSS JOIN prm
)""",
    ]


RD = [TXNS_UNITS_CTE, rfm_cte("txns_units")]


@register(
    "bgnbd_loglik",
    with_ctes(*RD, PRM_SQL) + """SELECT user_id,
      lgamma(prm.r + frequency) - lgamma(prm.r) + prm.r * ln(prm.al) + lgamma(prm.a + prm.b) + lgamma(prm.b + frequency)
      - lgamma(prm.b) - lgamma(prm.a + prm.b + frequency)
      + ln(exp(-(prm.r + frequency) * ln(prm.al + "T"))
           + CASE WHEN frequency > 0 THEN exp(ln(prm.a) - ln(prm.b + frequency - 1) - (prm.r + frequency) * ln(prm.al + recency))
                  ELSE 0.0 END) AS loglik
    FROM rfm CROSS JOIN prm""",
    ("loglik",),
)
def q_bgnbd_loglik(spark, sf):
    return _rfm_units(spark, sf).select("user_id", clv.bgnbd_loglik_expr(*BG_FIXED).alias("loglik"))


@register(
    "gamma_gamma_loglik",
    with_ctes(*RD, PRM_SQL) + """SELECT user_id,
      lgamma(prm.p * frequency + prm.q) - lgamma(prm.p * frequency) - lgamma(prm.q) + prm.q * ln(prm.v)
      + (prm.p * frequency - 1) * ln(monetary_value) + prm.p * frequency * ln(frequency)
      - (prm.p * frequency + prm.q) * ln(frequency * monetary_value + prm.v) AS loglik
    FROM rfm CROSS JOIN prm WHERE frequency > 0""",
    ("loglik",),
)
def q_gamma_gamma_loglik(spark, sf):
    r = rfm.repeat_buyers(_rfm_units(spark, sf))
    return r.select("user_id", clv.gamma_gamma_loglik_expr(*GG_FIXED).alias("loglik"))


@register(
    "expected_purchases",
    with_ctes(*RD, *_clv_sql("rfm", "user_id")) + "SELECT user_id, e30 AS expected_30, e60 AS expected_60, e90 AS expected_90 FROM epw",
    ("expected_30", "expected_60", "expected_90"),
)
def q_expected_purchases(spark, sf):
    r = _rfm_units(spark, sf)
    return clv.with_expected_purchases(r, [30, 60, 90], BG_FIXED).select("user_id", "expected_30", "expected_60", "expected_90")


@register(
    "customer_clv",
    with_ctes(*RD, *_clv_sql("rfm", "user_id"))
    + 'SELECT r.user_id, r.frequency, r.recency, r."T", r.monetary_value, c.clv FROM rfm r JOIN clv c USING (user_id) WHERE r.frequency > 0',
    ("monetary_value", "clv"),
)
def q_customer_clv(spark, sf):
    return clv.customer_clv(_rfm_units(spark, sf), BG_FIXED, GG_FIXED)


@register(
    "clv_summary",
    with_ctes(*RD, *_clv_sql("rfm", "user_id")) + """SELECT count(*) AS n, avg(c.clv) AS mean_clv, min(c.clv) AS min_clv,
      count(*) FILTER (WHERE c.clv < 0) AS negative FROM rfm r JOIN clv c USING (user_id) WHERE r.frequency > 0""",
    ("mean_clv", "min_clv"),
)
def q_clv_summary(spark, sf):
    return clv.clv_summary(clv.customer_clv(_rfm_units(spark, sf), BG_FIXED, GG_FIXED))


@register(
    "channel_clv",
    with_ctes(PLAYERS_CTE, *RD, CHANNEL_RFM_SQL, *_clv_sql("channel_rfm", "acquisition_channel"))
    + "SELECT acquisition_channel, clv AS bgnbd_ltv FROM clv",
    ("bgnbd_ltv",),
)
def q_channel_clv(spark, sf):
    """M16, with F4's lookup of each observed channel's median profile."""
    players = _players(spark, sf)
    wanted = players.select("acquisition_channel").where("acquisition_channel is not null").distinct()
    prof = rfm.channel_profile(rfm.channel_rfm(_rfm_units(spark, sf), players), wanted)
    return prof.where("frequency is not null").select("acquisition_channel", clv.clv_expr(BG_FIXED, GG_FIXED).alias("bgnbd_ltv"))


@register("bgnbd_fit")
def q_bgnbd_fit(spark, sf):
    """The fit's parameter bundle as it is stored for scoring."""
    path = scratch_path(spark, "bgnbd")
    clv.save_params(clv.fit_bgnbd(_rfm_units(spark, sf)), path)
    return clv.load_params(spark, path)


@register("gamma_gamma_fit")
def q_gamma_gamma_fit(spark, sf):
    return clv.fit_gamma_gamma(_rfm_units(spark, sf))


# ============================== Point-in-time features ==============================
from acqlens.plans.oracle_sql import SNAPSHOTS_CTE  # noqa: E402
from acqlens.sources import snapshots  # noqa: E402

SNAPSHOT_DOUBLES = ("cost_per_install", "win_rate_week1", "ltv_day90", "win_rate", "avg_sessions_per_day", "avg_battle_duration", "total_spend")


@register("player_snapshots", with_ctes(SNAPSHOTS_CTE) + "SELECT * FROM snapshots", SNAPSHOT_DOUBLES, bits=20)
def q_player_snapshots(spark, sf):
    """Inputs of M3-M5: features as known at each player's cutoff, labels from later days."""
    return snapshots.player_snapshots(spark, sf)


def _snapshots(spark, sf):
    return store.materialized(spark, "snapshots", _src(sf, "customer", "orders", "lineitem", "events"),
                              lambda: snapshots.player_snapshots(spark, sf))


# ============================== M1-M10: models ==============================
from acqlens.operators import models  # noqa: E402
from acqlens.session import ensure_checkpoint_dir, scratch_path, ship  # noqa: E402

_FITTED: dict[tuple, object] = {}


def _memo(spark, sf, key, build):
    """Train/fit once per session, source version and model; a failed build is not kept."""
    k = (spark.sparkContext.applicationId, store.signature(spark, _src(sf, "customer", "orders", "lineitem", "events")), key)
    if k not in _FITTED:
        _FITTED[k] = build()
    return _FITTED[k]


def _trained(spark, sf, spec):
    """The fitted model and held-out rows for ``spec``; only the requested model is trained."""
    ensure_checkpoint_dir(spark)
    return _memo(spark, sf, ("model", spec.name), lambda: models.train_model(_snapshots(spark, sf), spec))


def _side_by_side(spark, sf, *builds):
    """Results of functions that fit something.  Fits are long chains of small jobs, so they run
    at the same time; the snapshots that they share are stored before."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    _snapshots(spark, sf)
    with ThreadPoolExecutor(len(builds)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(b)) for b in builds]]


def _all_trained(spark, sf, *specs):
    return _side_by_side(spark, sf, *[partial(_trained, spark, sf, spec) for spec in specs])


_CATS_SQL = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS cat_{c}" for c in K.CATEGORICAL_FEATURES)
_NUMS_SQL = ", ".join(
    f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS num_{c}" for c in K.NUMERIC_FEATURES)


@register(
    "preprocessed_features",
    P + f"SELECT user_id, {_CATS_SQL}, {_NUMS_SQL} FROM players",
    tuple(f"num_{c}" for c in K.NUMERIC_FEATURES),
)
def q_preprocessed_features(spark, sf):
    return models.preprocessed_features(_players(spark, sf))


@register(
    "classification_metrics",
    with_ctes(PLAYERS_CTE, CHANNEL_DIM_SQL, COUNTRY_DIM_SQL, ENGAGEMENT_SQL, AUC_SQL) + """, cm AS (
      SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn
      FROM (SELECT y, CAST(s >= 0.5 AS INTEGER) AS yhat FROM auc_in))
    SELECT 'accuracy' AS metric, CAST((tp + tn) AS DOUBLE) / (tp + tn + fp + fn) AS value FROM cm
    UNION ALL SELECT 'precision', coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) FROM cm
    UNION ALL SELECT 'recall', coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) FROM cm
    UNION ALL SELECT 'f1', coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) FROM cm
    UNION ALL SELECT 'roc_auc', (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
           / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) FROM auc_r""",
    ("value",),
)
def q_classification_metrics(spark, sf):
    return models.classification_metrics(_churn_scores(spark, sf), "retained_day7", "retention_score")


BASELINE_SQL = """base AS (
  SELECT p.ltv_day90 AS y, m.ltv_estimate AS yhat FROM players p
  LEFT JOIN (SELECT acquisition_channel, avg(ltv_day90) AS ltv_estimate FROM players GROUP BY 1) m USING (acquisition_channel)
), reg AS (
  SELECT 1 - sum((y - yhat) * (y - yhat)) / sum((y - (SELECT avg(y) FROM base)) * (y - (SELECT avg(y) FROM base))) AS r2,
         sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
         count(*) FILTER (WHERE yhat < 0) AS negative_predictions
  FROM base
)"""


@register(
    "regression_metrics",
    with_ctes(PLAYERS_CTE, BASELINE_SQL) + "SELECT * FROM reg",
    ("r2", "rmse", "mae"),
)
def q_regression_metrics(spark, sf):
    return models.regression_metrics(models.channel_baseline(_players(spark, sf)), "ltv_day90", "ltv_estimate")


@register(
    "quality_gates",
    with_ctes(PLAYERS_CTE, CHANNEL_DIM_SQL, COUNTRY_DIM_SQL, ENGAGEMENT_SQL, AUC_SQL, BASELINE_SQL) + f""", auc AS (
      SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
           / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc FROM auc_r)
    SELECT 'roc_auc' AS gate, roc_auc AS value, {K.AUC_GATE} AS threshold, roc_auc >= {K.AUC_GATE} AS passed FROM auc
    UNION ALL SELECT 'r2', r2, {K.R2_GATE}, r2 >= {K.R2_GATE} FROM reg
    UNION ALL SELECT 'negative_predictions', CAST(negative_predictions AS DOUBLE), 0.0, negative_predictions = 0 FROM reg""",
    ("value", "threshold"),
)
def q_quality_gates(spark, sf):
    auc = ranks.roc_auc(_churn_scores(spark, sf), "retained_day7", "retention_score")
    reg = models.regression_metrics(models.channel_baseline(_players(spark, sf)), "ltv_day90", "ltv_estimate")
    return models.quality_gates(auc, reg)


@register("model_gates")
def q_model_gates(spark, sf):
    """M8 on the fitted models: held-out ROC-AUC of retention, R^2 and negatives of LTV."""
    (ret, ret_test), (ltv, ltv_test) = _all_trained(spark, sf, models.RETENTION, models.LTV)
    auc = ranks.roc_auc(models.positive_probability(ret.transform(ret_test)), models.RETENTION.label, "p")
    return models.quality_gates(auc, models.regression_metrics(ltv.transform(ltv_test), models.LTV.label, "prediction"))


@register("retention_model")
def q_retention_model(spark, sf):
    model, test = _trained(spark, sf, models.RETENTION)
    return models.evaluate_classifier(model, test, models.RETENTION)


@register("ltv_model")
def q_ltv_model(spark, sf):
    model, test = _trained(spark, sf, models.LTV)
    return models.evaluate_regressor(model, test, models.LTV)


@register("churn_model")
def q_churn_model(spark, sf):
    model, test = _trained(spark, sf, models.CHURN)
    ev = models.evaluate_classifier(model, test, models.CHURN)
    imp = models.feature_importances(model, spark).select(
        F.lit("churn").alias("model"), F.concat(F.lit("importance:"), F.col("feature")).alias("metric"),
        F.col("importance").alias("value"))
    return ev.unionByName(imp)


def _scored(spark, sf):
    fitted = _all_trained(spark, sf, models.RETENTION, models.LTV, models.CHURN)
    return models.score_players(_snapshots(spark, sf), *[model for model, _ in fitted])


@register("score_players")
def q_score_players(spark, sf):
    return _scored(spark, sf)


@register("prediction_sanity")
def q_prediction_sanity(spark, sf):
    return models.prediction_sanity(_scored(spark, sf), "ltv_estimate")


@register("ltv_compare")
def q_ltv_compare(spark, sf):
    """Model LTV next to the BG/NBD CLV of the player's channel median profile."""
    rd = _rfm_units(spark, sf)
    bg = _memo(spark, sf, ("fit", "bgnbd"), lambda: clv.params_of(clv.fit_bgnbd(rd), ("r", "alpha", "a", "b")))
    gg = _memo(spark, sf, ("fit", "gg"), lambda: clv.params_of(clv.fit_gamma_gamma(rd), ("p", "q", "v")))
    prof = rfm.channel_rfm(rd, _players(spark, sf)).select(
        "acquisition_channel", clv.clv_expr(bg, gg).alias("bgnbd_ltv"))
    scored = _scored(spark, sf)
    return scored.join(kpis.small_side(prof), "acquisition_channel", "left").select(
        "user_id", "acquisition_channel", "ltv_estimate", "bgnbd_ltv",
        (F.col("ltv_estimate") - F.col("bgnbd_ltv")).alias("ltv_delta"))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Save the fitted retention pipeline, load it back, score the test rows with both."""
    model, test = _trained(spark, sf, models.RETENTION)
    path = scratch_path(spark, "retention-model")
    models.save_model(model, path)
    loaded = models.load_model(spark, path)
    a = models.positive_probability(model.transform(test), "p_saved").select("user_id", "p_saved")
    b = models.positive_probability(loaded.transform(test), "p_loaded").select("user_id", "p_loaded")
    return a.join(b, "user_id").withColumn("identical", F.col("p_saved") == F.col("p_loaded"))


# ============================== S3 / ST1: sinks and streaming ==============================
from acqlens.schemas import PLAYERS_SCHEMA, TXNS_SCHEMA  # noqa: E402
from acqlens.sources import tables  # noqa: E402
from acqlens.streaming import orders_stream, roas_stream  # noqa: E402


@register("csv_roundtrip", P + "SELECT * FROM players", PLAYER_DOUBLES)
def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "players-csv")
    tables.write_dataset(_players(spark, sf), path, fmt="csv")
    return tables.read_players_csv(spark, path)


ROAS_TREND_SQL = P + """SELECT strftime(acquisition_date, '%Y-%m') AS month, acquisition_channel,
      sum(ltv_day90) AS revenue, sum(cost_per_install) AS spend,
      CASE WHEN sum(cost_per_install) = 0 THEN NULL ELSE sum(ltv_day90) / sum(cost_per_install) END AS roas
    FROM players WHERE acquisition_channel IS NOT NULL GROUP BY 1, 2"""


@register(
    "scan_txns_csv",
    with_ctes(TXNS_CTE) + """SELECT CASE o_orderkey % 50 WHEN 0 THEN 'transaction_date' WHEN 1 THEN 'fields' ELSE 'accepted' END AS outcome,
      count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 50 > 1 THEN round(o_totalprice * 100) ELSE 0 END) AS BIGINT) AS cents
    FROM orders GROUP BY 1""",
)
def q_scan_txns_csv(spark, sf):
    """S2 from CSV with its rejects: a part of the lines is written with a broken date or without
    the last field; they land in the quarantine, the others in the table."""
    o = tables.read_table(spark, sf, "orders")
    key = F.col("o_orderkey") % 50
    date = F.when(key == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    fields = [F.col("o_custkey").cast("string"), date, F.col("o_totalprice").cast("decimal(18,2)").cast("string")]
    line = F.concat_ws(",", *fields, F.when(key != 1, "gem_pack"))
    path = scratch_path(spark, "txns-csv")
    # lines as they are: one column whose name is the header and whose text isn't quoted
    o.select(line.alias(",".join(TXNS_SCHEMA.names))).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    rows, rejects = tables.read_csv_checked(spark, path, TXNS_SCHEMA)
    accepted = rows.select(F.lit("accepted").alias("outcome"), F.round(F.col("transaction_amount") * 100).cast("long").alias("c"))
    both = accepted.unionByName(rejects.select(F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("c")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@register("partitioned_rewrite", P + "SELECT user_id, acquisition_date, ltv_day90 * 2 AS ltv_day90, acquisition_channel FROM players WHERE acquisition_channel = 'Google'",
          ("ltv_day90",))
def q_partitioned_rewrite(spark, sf):
    """S3: a dataset by channel, one channel rewritten, that channel read back by its partition."""
    p = _players(spark, sf).select("user_id", "acquisition_date", "ltv_day90", "acquisition_channel")
    path = scratch_path(spark, "players-by-channel")
    tables.write_dataset(p, path, partition_by=["acquisition_channel"])
    google = p.where("acquisition_channel = 'Google'").withColumn("ltv_day90", F.col("ltv_day90") * 2)
    tables.write_dataset(google, path, partition_by=["acquisition_channel"])
    return spark.read.schema(p.schema).parquet(path).where("acquisition_channel = 'Google'")


@register(
    "metrics_history",
    with_ctes(PLAYERS_CTE, BASELINE_SQL) + """SELECT model, metric, value, CAST(runs AS BIGINT) AS runs FROM (
      SELECT 'baseline' AS model, unnest(['r2', 'rmse', 'mae']) AS metric, unnest([r2, rmse, mae]) AS value, 2 AS runs FROM reg)""",
    ("value",),
)
def q_metrics_history(spark, sf):
    """The metrics of two runs of the channel-mean model appended to a history and read back."""
    m = models.regression_metrics(models.channel_baseline(_players(spark, sf)), "ltv_day90", "ltv_estimate")
    long = m.select(F.lit("baseline").alias("model"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("r2", "rmse", "mae")])))
    path = scratch_path(spark, "metrics-history")
    for _ in range(2):
        tables.save_metrics(long, path)
    return tables.load_metrics(spark, path).groupBy("model", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("runs"))


@register("roas_trend_stream", ROAS_TREND_SQL, ("revenue", "spend", "roas"))
def q_roas_trend_stream(spark, sf):
    """ST1: the file-source stream reads the materialised players table's folder directly,
    whatever has arrived there in one trigger -- no copy of the data."""
    _players(spark, sf)
    src = store.location(spark, "players", _src(sf, "customer", "orders"))
    return roas_stream.run_roas_refresh(
        spark, src, scratch_path(spark, "roas-stream-out"), scratch_path(spark, "roas-stream-ckpt"))


@register("roas_trend_orders", ROAS_TREND_SQL, ("revenue", "spend", "roas"))
def q_roas_trend_orders(spark, sf):
    """ST1 from the orders: state per customer, orders in any order (the whole history may be late)."""
    return orders_stream.refresh(spark, _src(sf, "orders")[0], tables.read_table(spark, sf, "customer"),
                                 scratch_path(spark, "orders-stream-out"), scratch_path(spark, "orders-stream-ckpt"), lateness="3650 days")


# ============================== Shares per source file ==============================
from acqlens.operators import sketches  # noqa: E402
from acqlens.sources import shares  # noqa: E402


def _player_shares(spark, sf, name, share):
    """Shares of the files of the stored players table."""
    _players(spark, sf)
    folder = store.location(spark, "players", _src(sf, "customer", "orders"))
    return shares.maintained(spark, name, folder, PLAYERS_SCHEMA, share)[0]


@register("roas_trend_maintained", ROAS_TREND_SQL, ("revenue", "spend", "roas"))
def q_roas_trend_maintained(spark, sf):
    """A3 merged from sums per file, month and channel."""
    def share(rows, version):
        known = rows.where("acquisition_channel is not null and acquisition_date is not null")
        return known.groupBy(*version, X.month_label("acquisition_date").alias("month"), "acquisition_channel").agg(
            F.sum("ltv_day90").alias("revenue"), F.sum("cost_per_install").alias("spend"))

    merged = _player_shares(spark, sf, "roas-trend", share).groupBy("month", "acquisition_channel").agg(
        F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))
    return merged.withColumn("roas", X.safe_ratio("revenue", "spend"))


@register("retention_matrix_maintained", REGISTRY["retention_matrix"].sql, REGISTRY["retention_matrix"].doubles, REGISTRY["retention_matrix"].bits)
def q_retention_matrix_maintained(spark, sf):
    """A4 merged from counts per file and install week."""
    days = [(label, f"retained_d{d}") for label, d in cohorts.RETENTION_DAYS]

    def share(rows, version):
        frame = cohorts.cohort_frame(rows).where("install_week is not null")
        return frame.groupBy(*version, "install_week").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for _, c in days])

    merged = _player_shares(spark, sf, "retention", share).groupBy("install_week").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for _, c in days])
    return merged.select("install_week", *[F.bround(F.col(c) / F.col("n") * 100.0, 1).alias(label) for label, c in days])


@register("channel_sketch_medians")
def q_channel_sketch_medians(spark, sf):
    """A9 beyond exact sorts: medians per channel merged from sketches per install day."""
    values = ["ltv_day90", "cost_per_install", "days_active"]
    p = _players(spark, sf).where("acquisition_channel is not null")
    daily = sketches.sketch(p, ["acquisition_channel", "install_date"], values)
    return sketches.quantiles(daily, ["acquisition_channel"], values)
