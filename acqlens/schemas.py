"""Explicit StructTypes for every table the library reads or writes (no schema inference)."""

from __future__ import annotations

from pyspark.sql import types as T

_I = T.IntegerType()
_D = T.DoubleType()
_S = T.StringType()
_DT = T.DateType()
_L = T.LongType()

PLAYERS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", _L),
        T.StructField("acquisition_date", _DT),
        T.StructField("install_date", _DT),
        T.StructField("last_login_date", _DT),
        T.StructField("acquisition_channel", _S),
        T.StructField("country", _S),
        T.StructField("device_type", _S),
        T.StructField("king_level", _I),
        T.StructField("trophies_end_week1", _I),
        T.StructField("arena_id", _I),
        T.StructField("battles_week1", _I),
        T.StructField("win_rate_week1", _D),
        T.StructField("cards_upgraded_week1", _I),
        T.StructField("clan_member", _I),
        T.StructField("pass_royale_active", _I),
        T.StructField("cost_per_install", _D),
        T.StructField("retained_day7", _I),
        T.StructField("ltv_day90", _D),
        T.StructField("is_purchaser", _I),
        T.StructField("roas_90d", _D),
        T.StructField("trophies", _I),
        T.StructField("win_rate", _D),
        T.StructField("matches_played", _I),
        T.StructField("pass_royale", _I),
        T.StructField("days_active", _I),
        T.StructField("days_since_last_login", _I),
        T.StructField("avg_sessions_per_day", _D),
        T.StructField("avg_battle_duration", _D),
        T.StructField("total_spend", _D),
        T.StructField("churned", _I),
    ]
)
PLAYER_COLUMNS: list[str] = [f.name for f in PLAYERS_SCHEMA.fields]

TXNS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", _L),
        T.StructField("transaction_date", _DT),
        T.StructField("transaction_amount", _D),
        T.StructField("transaction_type", _S),
    ]
)

RFM_SCHEMA = T.StructType(
    [
        T.StructField("user_id", _L),
        T.StructField("frequency", _L),
        T.StructField("recency", _L),
        T.StructField("T", _L),
        T.StructField("monetary_value", _D),
    ]
)

SCENARIO_SCHEMA = T.StructType(
    [
        T.StructField("scenario_id", _I),
        T.StructField("budget", _D),
        T.StructField("share", _D),
    ]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("model", _S),
        T.StructField("metric", _S),
        T.StructField("value", _D),
    ]
)
