"""Fixed values that must equal the reference's for identical results."""

from __future__ import annotations

CHANNELS: list[str] = ["TikTok", "YouTube", "Instagram", "Facebook", "Google"]
COUNTRIES: list[str] = ["US", "UK", "DE", "JP", "BR", "FR", "KR"]
DEVICE_TYPES: list[str] = ["iOS", "Android"]
TRANSACTION_TYPES: list[str] = ["gem_pack", "pass_royale", "chest_offer", "evo_shards", "gold_offer"]

ARENA_TROPHY_GATES: list[int] = [
    0, 300, 600, 900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600, 3900, 4200,
]

# channel -> (channel_prob, cpi_base, base_retention, retention_boost, avg_ltv_multiplier, skill_bias)
CHANNEL_ATTRIBUTES: dict[str, tuple[float, float, float, float, float, float]] = {
    "TikTok": (0.25, 1.80, 0.33, -0.05, 1.0, -0.08),
    "Facebook": (0.20, 3.20, 0.40, 0.05, 1.5, 0.02),
    "Google": (0.30, 3.80, 0.42, 0.10, 2.0, 0.05),
    "Instagram": (0.15, 2.90, 0.37, 0.02, 1.2, 0.0),
    "YouTube": (0.10, 4.50, 0.48, 0.15, 2.5, 0.10),
}
CHANNEL_ATTRIBUTE_NAMES: list[str] = [
    "channel_prob", "cpi_base", "base_retention", "retention_boost", "avg_ltv_multiplier", "skill_bias",
]

COUNTRY_ENGAGEMENT: dict[str, float] = {
    "US": 1.10, "UK": 1.05, "DE": 1.00, "JP": 1.15, "BR": 0.90, "FR": 0.95, "KR": 1.20,
}

# Fixed values of the linear player scores: constant, {input: (unit, weight)}, bounds.
# A score is constant + sum of weight * input / unit, kept within its bounds.
LINEAR_SCORES: dict[str, tuple[float, dict[str, tuple[float, float]], tuple[float, float] | None]] = {
    "battle_mean": (10.0, {"engagement": (1, 4.0), "skill_bias": (1, 20.0)}, (3.0, 55.0)),
    "clan_propensity": (0.12, {"battles": (60, 0.45), "win_rate": (1, 0.25)}, (0.05, 0.85)),
    "pass_propensity": (0.04, {"trophies": (4500, 0.10), "win_rate": (1, 0.06), "cards": (80, 0.08)}, (0.01, 0.35)),
    "engagement_index": (-0.12, {
        "battles": (60, 0.22), "win_rate": (1, 0.28), "trophies": (4500, 0.18), "arena": (15, 0.10), "clan": (1, 0.12), "pass": (1, 0.05),
        "retention_boost": (1, 1.0), "base_retention": (1, 0.30)}, None),
    "purchase_propensity": (0.04, {"pass": (1, 0.35), "ltv_pct_rank": (1, 0.30), "retained": (1, 0.08), "cards": (80, 0.10)}, (0.0, 0.88)),
}
RETENTION_SLOPE, RETENTION_MIDDLE = 10.0, 0.38  # logistic curve over the engagement index
TROPHY_WALL = (500, 1200)
IOS_FACTOR = 1.06

TROPHIES_PER_WIN = 30
TROPHIES_PER_LOSS = 27

CHANNEL_SATURATION: dict[str, float] = {
    "TikTok": 12000.0, "YouTube": 28000.0, "Instagram": 22000.0, "Facebook": 25000.0, "Google": 30000.0,
}
DEFAULT_SATURATION = 25000.0
SATURATION_FLOOR = 1000.0
ROAS_FLOOR = 0.01
DEFAULT_MAX_CHANNEL_SHARE = 0.40
MC_SIMULATIONS = 2000
ROAS_CV = 0.15
MIN_STD_FRACTION = 0.05
SEED = 42

CHURN_IDLE_DAYS = 14
RISK_LOW = 0.30
RISK_HIGH = 0.60
AUC_GATE = 0.75
R2_GATE = 0.70

CATEGORICAL_FEATURES: list[str] = [
    "acquisition_channel", "country", "device_type", "clan_member", "pass_royale_active",
]
NUMERIC_FEATURES: list[str] = [
    "cost_per_install", "king_level", "trophies_end_week1", "arena_id",
    "battles_week1", "win_rate_week1", "cards_upgraded_week1",
]
FEATURE_COLUMNS: list[str] = CATEGORICAL_FEATURES + NUMERIC_FEATURES
RETENTION_TARGET = "retained_day7"
LTV_TARGET = "ltv_day90"
CHURN_TARGET = "churned"
CHURN_FEATURE_COLUMNS: list[str] = [
    "king_level", "trophies", "win_rate", "matches_played", "days_active",
    "pass_royale", "avg_sessions_per_day", "avg_battle_duration", "total_spend",
]

TEST_SIZE = 0.2
RETENTION_GBT = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}
LTV_GBT = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}
CHURN_GBT = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05}

CLV_PERIODS = 3
CLV_PERIOD_DAYS = 30
CLV_DISCOUNT = 0.01
PENALIZER = 0.01

# Adapter constants (the driver's TPC-H style tables re-shaped to the player model).
OBSERVATION_END = "2000-12-31"
SNAPSHOT_DATE = "2001-08-01"
SEGMENT_TO_CHANNEL: dict[str, str] = {
    "AUTOMOBILE": "TikTok", "BUILDING": "YouTube", "FURNITURE": "Instagram",
    "HOUSEHOLD": "Facebook", "MACHINERY": "Google",
}
PRIORITY_TO_TYPE: dict[str, str] = {
    "1-URGENT": "pass_royale", "2-HIGH": "gem_pack", "3-MEDIUM": "chest_offer",
    "4-NOT SPECIFIED": "evo_shards", "5-LOW": "gold_offer",
}
