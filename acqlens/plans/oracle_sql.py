"""DuckDB SQL building blocks for the oracle check (FIXTURES.md §2 written in SQL).

These are independent re-statements of the adapter views, so the oracle does not reuse the
Spark code path: a wrong Spark plan and a right SQL definition disagree.
"""

from __future__ import annotations

from acqlens import constants as K

_CHANNEL_CASE = "CASE c.c_mktsegment " + " ".join(
    f"WHEN '{seg}' THEN '{ch}'" for seg, ch in K.SEGMENT_TO_CHANNEL.items()
) + " END"
_TYPE_CASE = "CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN '{t}'" for p, t in K.PRIORITY_TO_TYPE.items()
) + " END"
_COUNTRIES = "[" + ", ".join(f"'{c}'" for c in K.COUNTRIES) + "]"

PLAYERS_CTE = f"""
o_ AS (
  SELECT o_custkey AS u, CAST(o_orderdate AS DATE) AS d, o_totalprice AS amt, o_orderstatus AS st FROM orders
), f_ AS (
  SELECT u, min(d) AS i, max(d) AS mx, count(*) AS n_all, count(DISTINCT d) AS nd FROM o_ GROUP BY u
), w_ AS (
  SELECT o_.u, count(*) AS n90, max(o_.d) AS l90, sum(o_.amt) AS s90,
         count(*) FILTER (WHERE o_.st = 'F') AS w90
  FROM o_ JOIN f_ ON o_.u = f_.u WHERE o_.d <= f_.i + 89 GROUP BY o_.u
), players_base AS (
  SELECT c.c_custkey AS user_id,
    f_.i AS acquisition_date, f_.i AS install_date, w_.l90 AS last_login_date,
    {_CHANNEL_CASE} AS acquisition_channel,
    ({_COUNTRIES})[c.c_nationkey % 7 + 1] AS country,
    CASE WHEN c.c_custkey % 2 = 0 THEN 'iOS' ELSE 'Android' END AS device_type,
    CAST(1 + c.c_custkey % 14 AS INTEGER) AS king_level,
    CAST(floor(greatest(c.c_acctbal, 0)) AS INTEGER) AS trophies_end_week1,
    CAST(least(w_.n90 * 7 + c.c_custkey % 11, 60) AS INTEGER) AS battles_week1,
    CAST(w_.w90 AS DOUBLE) / w_.n90 AS win_rate_week1,
    CAST(c.c_custkey % 81 AS INTEGER) AS cards_upgraded_week1,
    CAST(c.c_custkey % 3 = 0 AS INTEGER) AS clan_member,
    CAST(c.c_custkey % 5 = 0 AS INTEGER) AS pass_royale_active,
    greatest(c.c_acctbal, 0) / 2000.0 AS cost_per_install,
    CAST(w_.l90 - f_.i >= 7 AS INTEGER) AS retained_day7,
    w_.s90 / 5000.0 AS ltv_day90,
    CAST(w_.n90 > 1 AS INTEGER) AS is_purchaser,
    CAST(f_.n_all * 5 AS INTEGER) AS matches_played,
    CAST(f_.nd AS INTEGER) AS days_active,
    CAST(DATE '{K.SNAPSHOT_DATE}' - f_.mx AS INTEGER) AS days_since_last_login,
    CAST(w_.n90 AS DOUBLE) / 7.0 AS avg_sessions_per_day,
    1 + CAST(c.c_custkey % 8 AS DOUBLE) / 8.0 * 7 AS avg_battle_duration,
    w_.s90 / 5000.0 AS total_spend,
    CAST(DATE '{K.SNAPSHOT_DATE}' - f_.mx >= {K.CHURN_IDLE_DAYS} AS INTEGER) AS churned
  FROM customer c JOIN f_ ON c.c_custkey = f_.u JOIN w_ ON c.c_custkey = w_.u
), players AS (
  SELECT user_id, acquisition_date, install_date, last_login_date, acquisition_channel, country, device_type,
    king_level, trophies_end_week1,
    CAST(least(15, floor(trophies_end_week1 / 300) + 1) AS INTEGER) AS arena_id,
    battles_week1, win_rate_week1, cards_upgraded_week1, clan_member, pass_royale_active, cost_per_install,
    retained_day7, ltv_day90, is_purchaser,
    round_even(CASE WHEN cost_per_install > 0 THEN ltv_day90 / cost_per_install ELSE 0.0 END, 2) AS roas_90d,
    trophies_end_week1 AS trophies, win_rate_week1 AS win_rate, matches_played, pass_royale_active AS pass_royale,
    days_active, days_since_last_login, avg_sessions_per_day, avg_battle_duration, total_spend, churned
  FROM players_base
)"""

TXNS_CTE = f"""
txns AS (
  SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS transaction_date,
         o_totalprice AS transaction_amount, {_TYPE_CASE} AS transaction_type
  FROM orders
)"""

TXNS_UNITS_CTE = f"""
txns_units AS (
  SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS transaction_date,
         o_totalprice / 5000.0 AS transaction_amount, {_TYPE_CASE} AS transaction_type
  FROM orders
)"""


def rfm_cte(src: str, name: str = "rfm", end: str = K.OBSERVATION_END) -> str:
    """RFM by its definition: day sums, first day excluded from the monetary mean."""
    return f"""
{name}_d AS (
  SELECT user_id, transaction_date AS d, sum(transaction_amount) AS s
  FROM {src} WHERE transaction_date <= DATE '{end}' GROUP BY 1, 2
), {name}_f AS (
  SELECT user_id, min(d) AS first_day FROM {name}_d GROUP BY 1
), {name} AS (
  SELECT a.user_id, CAST(count(*) - 1 AS BIGINT) AS frequency,
         CAST(max(a.d) - min(a.d) AS BIGINT) AS recency,
         CAST(DATE '{end}' - min(a.d) AS BIGINT) AS "T",
         coalesce(avg(a.s) FILTER (WHERE a.d > b.first_day), 0.0) AS monetary_value
  FROM {name}_d a JOIN {name}_f b USING (user_id) GROUP BY a.user_id
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

_DAYS = f"""
po AS (SELECT o_orderkey AS k, o_custkey AS u, CAST(o_orderdate AS DATE) AS d, o_totalprice AS amt, o_orderpriority AS pr, o_orderstatus AS st FROM orders),
pf AS (SELECT u, min(d) AS i, arg_min(st, (d, st)) AS opening FROM po GROUP BY u),
pl AS (SELECT u, greatest(CAST(l_shipdate AS DATE), po.d) AS d, l_quantity AS q, CAST(l_returnflag <> 'R' AS INTEGER) AS kept, CAST(l_shipdate AS DATE) - po.d AS lag
       FROM lineitem JOIN po ON l_orderkey = k),
pe AS (SELECT pf.u, pf.i + CAST(CAST(ts AS DATE) - (SELECT min(CAST(x.ts AS DATE)) FROM events x WHERE x.user_id = e.user_id) AS INTEGER) AS d, event_type, value
       FROM events e JOIN pf ON pf.u = e.user_id)"""


def _known(name: str, cutoff: str) -> str:
    """Totals of each player's facts up to and including the day ``cutoff`` (an expression of pf)."""
    return f"""{name} AS (
  SELECT pf.u, (SELECT count(*) FROM po WHERE po.u = pf.u AND po.d <= {cutoff}) AS n_orders,
    (SELECT count(DISTINCT d) FROM po WHERE po.u = pf.u AND po.d <= {cutoff}) AS order_days,
    (SELECT coalesce(sum(amt), 0) FROM po WHERE po.u = pf.u AND po.d <= {cutoff}) AS spend,
    (SELECT count(*) FROM po WHERE po.u = pf.u AND po.d <= {cutoff} AND pr = '1-URGENT') AS urgent,
    (SELECT count(*) FROM pl WHERE pl.u = pf.u AND pl.d <= {cutoff}) AS n_items,
    (SELECT coalesce(sum(q), 0) FROM pl WHERE pl.u = pf.u AND pl.d <= {cutoff}) AS quantity,
    (SELECT coalesce(sum(kept), 0) FROM pl WHERE pl.u = pf.u AND pl.d <= {cutoff}) AS kept,
    (SELECT coalesce(sum(lag), 0) FROM pl WHERE pl.u = pf.u AND pl.d <= {cutoff}) AS ship_days,
    (SELECT count(*) FROM pe WHERE pe.u = pf.u AND pe.d <= {cutoff}) AS n_events,
    (SELECT count(*) FROM pe WHERE pe.u = pf.u AND pe.d <= {cutoff} AND event_type = 'click') AS clicks,
    (SELECT coalesce(sum(value), 0) FROM pe WHERE pe.u = pf.u AND pe.d <= {cutoff}) AS event_value
  FROM pf)"""


SNAPSHOTS_CTE = f"""{_DAYS.strip()},
{_known("kw", "pf.i + 6")}, {_known("kv", "pf.i + 89")}, {_known("kc", f"DATE '{K.OBSERVATION_END}'")}, {_known("kl", f"DATE '{K.OBSERVATION_END}' + 90")},
snapshots AS (
  SELECT c.c_custkey AS user_id, pf.i AS install_date, {_CHANNEL_CASE} AS acquisition_channel,
    ({_COUNTRIES})[c.c_nationkey % 7 + 1] AS country,
    CASE WHEN pf.opening = 'F' THEN 'iOS' ELSE 'Android' END AS device_type,
    CAST(kw.n_events > 0 AS INTEGER) AS clan_member, CAST(kw.urgent > 0 AS INTEGER) AS pass_royale_active,
    greatest(c.c_acctbal, 0) / 2000.0 AS cost_per_install,
    CAST(1 + least(kw.n_orders + kw.n_items, 13) AS INTEGER) AS king_level,
    CAST(floor(round(kw.quantity * 30 + kw.event_value, 6)) AS INTEGER) AS trophies_end_week1,
    CAST(least(kw.n_events + kw.n_items, 60) AS INTEGER) AS battles_week1,
    CAST(kw.kept + kw.clicks AS DOUBLE) / nullif(kw.n_items + kw.n_events, 0) AS win_rate_week1,
    CAST(floor(kw.quantity) AS INTEGER) AS cards_upgraded_week1,
    CASE WHEN pf.i + 89 <= DATE '{K.SNAPSHOT_DATE}' THEN CAST(kv.n_orders > kw.n_orders OR kv.n_events > kw.n_events AS INTEGER) END AS retained_day7,
    CASE WHEN pf.i + 89 <= DATE '{K.SNAPSHOT_DATE}' THEN (kv.spend - kw.spend) / 5000.0 END AS ltv_day90,
    CAST(floor(round(kc.quantity * 30 + kc.event_value, 6)) AS INTEGER) AS trophies,
    CAST(kc.kept + kc.clicks AS DOUBLE) / nullif(kc.n_items + kc.n_events, 0) AS win_rate,
    CAST(kc.n_items + kc.n_events AS INTEGER) AS matches_played, CAST(kc.order_days AS INTEGER) AS days_active,
    CAST(kc.urgent > 0 AS INTEGER) AS pass_royale,
    CASE WHEN pf.i <= DATE '{K.OBSERVATION_END}' THEN 30.0 * kc.n_orders / (DATE '{K.OBSERVATION_END}' - pf.i + 1) END AS avg_sessions_per_day,
    CAST(kc.ship_days AS DOUBLE) / nullif(kc.n_items, 0) AS avg_battle_duration,
    kc.spend / 5000.0 AS total_spend,
    CASE WHEN pf.i <= DATE '{K.OBSERVATION_END}' THEN CAST(kl.n_orders = kc.n_orders AS INTEGER) END AS churned,
    CAST(least(15, floor(floor(round(kw.quantity * 30 + kw.event_value, 6)) / 300) + 1) AS INTEGER) AS arena_id
  FROM customer c JOIN pf ON c.c_custkey = pf.u JOIN kw ON kw.u = pf.u JOIN kv ON kv.u = pf.u JOIN kc ON kc.u = pf.u JOIN kl ON kl.u = pf.u
)"""
