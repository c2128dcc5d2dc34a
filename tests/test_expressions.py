import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from acqlens.functions import expressions as X
from acqlens.functions.special import hyp2f1, hyp2f1_by_depth, lgamma


def _one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_arena_edges(spark):
    vals = [-5.0, 0.0, 299.9, 300.0, 4199.9, 4200.0, 4500.0, 9999.0]
    got = _one(spark, X.trophies_to_arena("t"), "t double", [(v,) for v in vals])
    assert got == [1, 1, 1, 2, 14, 15, 15, 15]


def test_arena_irregular_gates(spark):
    got = _one(spark, X.trophies_to_arena("t", [0, 10, 100]), "t double", [(5.0,), (10.0,), (99.0,), (1e6,)])
    assert got == [1, 2, 2, 3]


def test_roas_guard_and_rounding(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (0.125, 1.0)], "l double, c double")
    got = [r[0] for r in df.select(F.bround(X.roas("l", "c"), 2)).collect()]
    assert got == [0.0, 2.5, 0.12]  # half-even: 0.125 -> 0.12


def test_half_even(spark):
    got = _one(spark, X.round_half_even("x", 1), "x double", [(0.25,), (0.35,), (2.5,)])
    assert got[0] == 0.2 and got[2] == 2.5


def test_risk_bands(spark):
    got = _one(spark, X.risk_band("p"), "p double", [(0.29,), (0.3,), (0.59,), (0.6,), (1.0,)])
    assert got == ["Low", "Medium", "Medium", "High", "High"]


def test_formatting(spark):
    rows = [(20525.99,), (499.5,), (12.0,), (-600.0,), (100000.0,)]
    got = _one(spark, X.format_usd_k("x"), "x double", rows)
    assert got == ["$21,000", "$499.50", "$12.00", "$-1,000", "$100,000"]
    assert _one(spark, X.format_count_k("x"), "x double", [(100000.0,), (1499.0,)]) == ["100,000", "1,000"]
    assert _one(spark, X.format_pct("x"), "x double", [(0.4567,)]) == ["45.7%"]


def test_response_curve(spark):
    df = spark.createDataFrame([(1000.0, 2.0, 25000.0), (0.0, 2.0, 25000.0), (10.0, -1.0, 5.0), (10.0, 2.0, 0.0)],
                               "s double, r double, k double")
    got = df.select(X.channel_return("s", "r", "k"), X.marginal_roas("s", "r", "k")).collect()
    assert got[0][0] == pytest.approx(2.0 * 25000 * math.log1p(1000 / 25000))
    assert got[0][1] == pytest.approx(2.0 / (1 + 1000 / 25000))
    assert got[1][0] == 0.0 and got[1][1] == 2.0
    assert got[2][0] == 0.0
    assert got[3][0] == 0.0 and got[3][1] == 2.0


def test_week_and_month_labels(spark):
    rows = [(dt.date(2024, 12, 30),), (dt.date(2025, 1, 5),), (dt.date(2025, 1, 6),)]
    got = _one(spark, X.week_label("d"), "d date", rows)
    assert got == ["2024-12-30/2025-01-05", "2024-12-30/2025-01-05", "2025-01-06/2025-01-12"]
    assert _one(spark, X.month_label("d"), "d date", rows[:1]) == ["2024-12"]


def test_last_login_from_activity(spark):
    rows = [(dt.date(2001, 7, 30), 10, 3, 0), (dt.date(2001, 1, 1), 10, 3, 1), (dt.date(2001, 1, 1), 2, 9, 1)]
    got = _one(spark, X.last_login_from_activity("i", "a", "g", "c", "2001-08-01"),
               "i date, a int, g int, c int", rows)
    # not churned: min(active-1, window) -> clipped to 2 days; churned: active - idle, floored at 0
    assert got == [dt.date(2001, 8, 1), dt.date(2001, 1, 8), dt.date(2001, 1, 1)]


@pytest.mark.parametrize("z", [1e-3, 0.5, 1.0, 2.5, 7.3, 31.0, 1234.5])
def test_lgamma_matches_math(spark, z):
    got = _one(spark, lgamma(F.col("z")), "z double", [(z,)])[0]
    assert got == pytest.approx(math.lgamma(z), rel=1e-13, abs=1e-13)


def _hyp_ref(a, b, c, z, n=5000):
    t, s = 1.0, 1.0
    for k in range(n):
        t *= (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        s += t
    return s


@pytest.mark.parametrize("a,b,c,z", [(1.8, 3.5, 3.0, 0.2), (20.8, 22.5, 22.0, 0.9), (0.8, 2.5, 2.0, 0.0),
                                     (5.0, 1.0, 3.0, 0.99)])
def test_hyp2f1_series(spark, a, b, c, z):
    got = _one(spark, hyp2f1(a, b, c, F.col("z")), "z double", [(z,)])[0]
    assert got == pytest.approx(_hyp_ref(a, b, c, z), rel=1e-11)


@pytest.mark.parametrize("a, b, c", [(1.2, -0.5, 2.0), (4.8, 6.5, 6.0), (5000.2, 2.0, 5002.0), (-3.1, -0.99, 0.4)])
def test_hyp2f1_by_depth_matches_the_series(spark, a, b, c):
    """Nested products for small z, the summed series for the rest, both for several c."""
    rows = [(z, c + k) for z in (0.0, 1e-6, 0.05, 0.1, 0.11, 0.5, 0.9) for k in (0.0, 1.0, 30.0)]
    df = spark.createDataFrame(rows, "z double, c double")
    got = {(r.z, r.c): r.f for r in df.select("z", "c", hyp2f1_by_depth(a, b, F.col("c"), F.col("z"), c).alias("f")).collect()}
    for (z, k), v in got.items():
        assert v == pytest.approx(_hyp_ref(a, b, k, z), rel=1e-11)


def test_linear_scores(spark):
    df = spark.createDataFrame([(60.0, 1.0), (0.0, 0.0)], "b double, w double")
    got = [r[0] for r in df.select(X.linear_score("clan_propensity", battles="b", win_rate="w")).collect()]
    assert got == pytest.approx([0.82, 0.12])
    with pytest.raises(ValueError, match="takes"):
        X.linear_score("clan_propensity", battles="b")
