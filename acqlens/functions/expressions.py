"""Pure Column expressions: the reference's scalar helpers as native Spark SQL.

Nothing here touches a DataFrame; every function maps Columns to a Column, so Catalyst
keeps the whole computation inside whole-stage codegen (no Python UDFs anywhere).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acqlens import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float | Column, hi: float | Column) -> Column:
    """numpy.clip for columns."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(_c(x), lo_c), hi_c)


# --- sorted-cut counting -----------------------------------------------------------------
def count_cuts(v: Column, cuts: list[float], inclusive: bool = False) -> Column:
    """Number of ascending ``cuts`` below ``v`` (``<= v`` when ``inclusive``).

    Built as a balanced tree of CASE WHEN over the literal cut points: log2(len) comparisons
    per row, fully inside whole-stage codegen (a higher-order ``filter`` over an array would
    fall back to interpreted evaluation and scan every cut).
    """
    def below(c):
        return (F.lit(c) <= v) if inclusive else (F.lit(c) < v)

    def build(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(0)
        mid = (lo + hi) // 2
        return F.when(below(cuts[mid]), F.lit(mid - lo + 1) + build(mid + 1, hi)).otherwise(build(lo, mid))

    return build(0, len(cuts))


# --- P1: trophy count -> arena id -------------------------------------------------------
def trophies_to_arena(trophies: Column | str, gates: list[int] | None = None) -> Column:
    """Arena 1..len(gates): truncate, floor at 0, last gate <= value wins, clamp.

    Works for any ascending gate list (irregular gates need no UDF): the number of gates
    not above the value, counted with :func:`count_cuts`.
    """
    gates = sorted(gates or K.ARENA_TROPHY_GATES)
    t = F.greatest(_c(trophies).cast("long"), F.lit(0))
    passed = count_cuts(t, gates, inclusive=True)
    return F.least(F.greatest(passed, F.lit(1)), F.lit(len(gates))).cast("int")


# --- P2 / P11: guarded ratios ----------------------------------------------------------
def roas(ltv: Column | str, cpi: Column | str) -> Column:
    """Per-player ROAS: ltv / cpi when cpi > 0, else 0 (division never evaluated on 0)."""
    return F.when(_c(cpi) > 0, _c(ltv) / _c(cpi)).otherwise(F.lit(0.0))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when den is 0 (ANSI-safe)."""
    return F.try_divide(_c(num), _c(den))


# --- P3 / P4: churn label and derived last activity ------------------------------------
def churn_label(days_idle: Column | str, threshold: int = K.CHURN_IDLE_DAYS) -> Column:
    return (_c(days_idle) >= threshold).cast("int")


def last_login_from_activity(
    install: Column | str,
    days_active: Column | str,
    days_idle: Column | str,
    churned: Column | str,
    observation_end: str,
) -> Column:
    """Last-activity date: churned -> active minus idle days, else active - 1, clipped to window."""
    inst = _c(install)
    max_off = F.greatest(F.datediff(F.lit(observation_end).cast("date"), inst), F.lit(0))
    raw = F.when(
        _c(churned) == 1, F.greatest(_c(days_active) - _c(days_idle), F.lit(0))
    ).otherwise(F.least(_c(days_active) - 1, max_off))
    return F.date_add(inst, clip(raw, F.lit(0), max_off).cast("int"))


# --- P7-P10: cohort calendar helpers ---------------------------------------------------
def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, floored at 0."""
    return F.greatest(F.datediff(_c(end), _c(start)), F.lit(0))


def week_label(d: Column | str) -> Column:
    """Monday-to-Sunday period label 'YYYY-MM-DD/YYYY-MM-DD' (pandas weekly period string)."""
    monday = F.to_date(F.date_trunc("week", _c(d)))
    return F.concat(
        F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")
    )


def month_label(d: Column | str) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


# --- P12: half-even rounding (numpy/pandas semantics) ----------------------------------
def round_half_even(x: Column | str, scale: int) -> Column:
    return F.bround(_c(x), scale)


# --- P14: display formatting -----------------------------------------------------------
def format_usd_k(x: Column | str) -> Column:
    """'$1,234.56' below 500 in magnitude, else nearest thousand '$21,000' (half-even)."""
    v = _c(x).cast("double")
    small = F.concat(F.lit("$"), F.format_number(v, 2))
    big = F.concat(F.lit("$"), F.format_number((F.bround(v / 1000.0, 0) * 1000).cast("long"), 0))
    return F.when(F.abs(v) < 500, small).otherwise(big)


def format_count_k(x: Column | str) -> Column:
    v = _c(x).cast("double")
    return F.format_number((F.bround(v / 1000.0, 0) * 1000).cast("long"), 0)


def format_pct(x: Column | str, decimals: int = 1) -> Column:
    return F.concat(F.format_number(_c(x).cast("double") * 100.0, decimals), F.lit("%"))


# --- P15: churn risk band --------------------------------------------------------------
def risk_band(p: Column | str, low: float = K.RISK_LOW, high: float = K.RISK_HIGH) -> Column:
    return F.when(_c(p) < low, "Low").when(_c(p) < high, "Medium").otherwise("High")


# --- P16 / P17: saturating response curve ----------------------------------------------
def channel_return(spend: Column | str, roas_: Column | str, sat: Column | str) -> Column:
    """roas * sat * log1p(spend / sat); 0 when any input is not positive."""
    s, r, k = _c(spend), _c(roas_), _c(sat)
    return F.when((s > 0) & (r > 0) & (k > 0), r * k * F.log1p(s / k)).otherwise(F.lit(0.0))


def marginal_roas(spend: Column | str, roas_: Column | str, sat: Column | str) -> Column:
    """Derivative of channel_return: roas / (1 + spend / sat); roas itself at spend<=0 or sat<=0."""
    s, r, k = _c(spend), _c(roas_), _c(sat)
    return F.when((s <= 0) | (k <= 0), r).otherwise(r / (1.0 + s / k))


# --- P18 / P19: player scores ------------------------------------------------------------
def linear_score(name: str, **inputs: Column | str) -> Column:
    """A score of ``constants.LINEAR_SCORES`` from its inputs, each a column."""
    constant, terms, bounds = K.LINEAR_SCORES[name]
    if set(inputs) != set(terms):
        raise ValueError(f"{name} takes {sorted(terms)}")
    total = F.lit(constant)
    for term, (unit, weight) in terms.items():
        total = total + _c(inputs[term]) * (weight / unit)
    return clip(total, *bounds) if bounds else total


def model_trophies(battles: Column | str, win_rate: Column | str) -> Column:
    won = F.floor(_c(battles) * _c(win_rate))
    return clip(won * (K.TROPHIES_PER_WIN + K.TROPHIES_PER_LOSS) - _c(battles) * K.TROPHIES_PER_LOSS, 0, 4500).cast("int")


def retention_score(index: Column | str) -> Column:
    return 1 / (1 + F.exp((K.RETENTION_MIDDLE - _c(index)) * K.RETENTION_SLOPE))


def trophy_wall(trophies: Column | str) -> Column:
    return _c(trophies).between(*K.TROPHY_WALL).cast("int")


def device_factor(device: Column | str) -> Column:
    return F.when(_c(device) == "iOS", K.IOS_FACTOR).otherwise(1.0)


def login_gap_score(win_rate, battles, clan, pass_, sessions) -> Column:
    """Deterministic part of the idle-days model (random terms dropped)."""
    return (
        (1 - _c(win_rate)) * 5
        + F.greatest(F.lit(0), 12 - F.floor(_c(battles) / 5))
        + (1 - _c(clan)) * 3
        - _c(pass_) * 4
        - F.least(_c(sessions), F.lit(6.0)) * 1.5
    )
