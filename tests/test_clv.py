import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acqlens.functions import special
from acqlens.operators import clv

BG = (0.8, 300.0, 0.5, 2.5)
GG = (6.0, 4.0, 15.0)
ROWS = [(1, 0, 0, 30), (2, 3, 100, 400), (3, 12, 700, 720), (4, 1, 5, 2000), (5, 40, 1500, 1600)]


def _ll_ref(x, tx, T, r, al, a, b):
    a1 = math.lgamma(r + x) - math.lgamma(r) + r * math.log(al)
    a2 = math.lgamma(a + b) + math.lgamma(b + x) - math.lgamma(b) - math.lgamma(a + b + x)
    a3 = -(r + x) * math.log(al + T)
    s = math.exp(a3)
    if x > 0:
        s += math.exp(math.log(a) - math.log(b + x - 1) - (r + x) * math.log(al + tx))
    return a1 + a2 + math.log(s)


def _hyp(a, b, c, z):
    t, s, k = 1.0, 1.0, 0
    while k < 20000:
        t *= (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        s += t
        k += 1
        if abs(t) < 1e-18 * abs(s) and k > 50:
            break
    return s


def _ep_ref(t, x, tx, T, r, al, a, b):
    z = t / (al + T + t)
    first = (a + b + x - 1) / (a - 1)
    second = 1 - ((al + T) / (al + T + t)) ** (r + x) * _hyp(r + x, b + x, a + b + x - 1, z)
    den = 1 + (a / (b + x - 1) * ((al + T) / (al + tx)) ** (r + x) if x > 0 else 0.0)
    return first * second / den


def _ep_exact(t, x, tx, T, r, al, a, b):
    """The same with exact fractions, where the plain series cancels or converges slowly."""
    from decimal import Decimal as D
    from decimal import getcontext

    getcontext().prec = 60
    r, al, a, b, t, x, tx, T = (D(repr(float(v))) for v in (r, al, a, b, t, x, tx, T))
    z = t / (al + T + t)
    p, q, c = r + x, b + x, a + b + x - 1
    term, s, k = D(1), D(1), 0
    while k < 60000:
        term *= (p + k) * (q + k) / ((c + k) * (k + 1)) * z
        s += term
        k += 1
        if k > 50 and abs(term) < D("1e-40") * abs(s):
            break
    second = 1 - ((al + T) / (al + T + t)) ** p * s
    den = 1 + (a / (b + x - 1) * ((al + T) / (al + tx)) ** p if x > 0 else 0)
    return float(c / (a - 1) * second / den)


@pytest.fixture(scope="module")
def rfm(spark):
    return spark.createDataFrame([(u, x, tx, T, 20.0 + u) for u, x, tx, T in ROWS],
                                 "user_id long, frequency long, recency long, T long, monetary_value double")


def test_bgnbd_loglik(rfm):
    got = {r.user_id: r.ll for r in rfm.select("user_id", clv.bgnbd_loglik_expr(*BG).alias("ll")).collect()}
    for u, x, tx, T in ROWS:
        assert got[u] == pytest.approx(_ll_ref(x, tx, T, *BG), rel=1e-12)


def test_expected_purchases_and_clv(rfm):
    cols = [clv.expected_purchases_expr(float(t), *BG).alias(f"e{t}") for t in (30, 60, 90)]
    got = {r.user_id: r for r in rfm.select("user_id", *cols, clv.clv_expr(BG, GG).alias("clv")).collect()}
    p, q, v = GG
    for u, x, tx, T in ROWS:
        e = [0.0] + [_ep_ref(t, x, tx, T, *BG) for t in (30, 60, 90)]
        assert got[u]["e90"] == pytest.approx(e[3], rel=1e-10)
        if x > 0:
            m = 20.0 + u
            w = p * x / (p * x + q - 1)
            spend = (1 - w) * p * v / (q - 1) + w * m
            ref = sum(spend * (e[k] - e[k - 1]) / 1.01**k for k in (1, 2, 3))
            assert got[u]["clv"] == pytest.approx(ref, rel=1e-10)


def test_gamma_gamma_loglik(rfm):
    r = rfm.filter("frequency > 0").select("frequency", "monetary_value", clv.gamma_gamma_loglik_expr(*GG).alias("ll"))
    p, q, v = GG
    for row in r.collect():
        x, m = row.frequency, row.monetary_value
        ref = (math.lgamma(p * x + q) - math.lgamma(p * x) - math.lgamma(q) + q * math.log(v)
               + (p * x - 1) * math.log(m) + p * x * math.log(x) - (p * x + q) * math.log(x * m + v))
        assert row.ll == pytest.approx(ref, rel=1e-12)


def test_newton_on_a_quadratic_and_a_saddle():
    target, scale = np.array([0.3, -1.2, 2.0]), np.array([1.0, 5.0, 0.3])
    x, fx, it, ok = clv.minimize_newton(lambda p: (float(((p - target) ** 2) @ scale), 2 * scale * (p - target), np.diag(2 * scale)), [0.0, 0.0, 0.0])
    assert ok and np.allclose(x, target) and fx < 1e-12 and it <= 3
    # starts where the Hessian is negative
    x, fx, it, ok = clv.minimize_newton(lambda p: (float(-np.cos(p[0])), np.sin(p), np.diag(np.cos(p))), [2.5])
    assert ok and abs(x[0]) < 1e-7


def test_gamma_derivatives():
    for z in (1e-4, 0.3, 1.0, 2.5, 17.0, 4000.0):
        h = 1e-5 * max(z, 1e-3)
        assert special.digamma(z) == pytest.approx((math.lgamma(z + h) - math.lgamma(z - h)) / (2 * h), rel=1e-5, abs=1e-6)
        assert special.trigamma(z) == pytest.approx((special.digamma(z + h) - special.digamma(z - h)) / (2 * h), rel=1e-5)
    assert special.digamma(1.0) == pytest.approx(-0.57721566490153286, rel=1e-14)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-14)
    assert special.digamma(0.5) == pytest.approx(-0.57721566490153286 - 2 * math.log(2), rel=1e-14)


@pytest.mark.parametrize("theta", [(1.0, 1.0, 1.0, 1.0), (0.4, 2.0, 0.02, 3.0), (3.0, 0.05, 2.0, 0.1)])
def test_derivatives_of_the_likelihoods(rfm, theta):
    """Gradient and Hessian from the aggregates against differences of the value."""
    data = rfm.select("frequency", (F.col("recency") / 200).alias("recency"), (F.col("T") / 200).alias("T"), "monetary_value", F.lit(2).alias("w")).cache()
    for evaluate, size in ((clv._bgnbd_evaluation(data, clv._frequency_counts(data), 0.01), 4),
                           (clv._gamma_gamma_evaluation(data.where("frequency > 0"), clv._frequency_counts(data.where("frequency > 0")), 0.01), 3)):
        at = np.log(np.array(theta[:size]))
        f, g, h = evaluate(at)
        for i in range(size):
            e = np.zeros(size)
            e[i] = 1e-4
            up, down = evaluate(at + e), evaluate(at - e)
            assert g[i] == pytest.approx((up[0] - down[0]) / 2e-4, rel=1e-5, abs=1e-7)
            assert np.allclose(h[i], (up[1] - down[1]) / 2e-4, rtol=1e-4, atol=1e-6)
    value = data.agg(F.avg(clv.bgnbd_loglik_expr(*theta))).first()[0]
    assert clv._bgnbd_evaluation(data, clv._frequency_counts(data), 0.0)(np.log(np.array(theta)))[0] == pytest.approx(-value, rel=1e-12)


@pytest.mark.parametrize("bg", [(0.8, 300.0, 0.5, 2.5), (0.2, 1.0, 0.05, 0.3), (4.0, 2000.0, 3.0, 5000.0), (0.8, 5.0, 1e-6, 0.9)])
def test_expected_purchases_over_parameters(rfm, bg):
    for t in (1, 90, 3000):
        got = {r.user_id: r.e for r in rfm.select("user_id", clv.expected_purchases_expr(float(t), *bg).alias("e")).collect()}
        for u, x, tx, T in ROWS:
            if math.log10(max(1.0, bg[1] + T + t)) and (bg[1] + T) / t > 0.01:  # the plain series of the reference needs z < 1
                assert got[u] == pytest.approx(_ep_exact(t, x, tx, T, *bg), rel=1e-7)


def test_optimum_is_a_minimum(spark):
    """At the fitted parameters the plain objective can't be lowered by small steps."""
    rd = _window_rfm(spark)
    rows = [(r.frequency, r.recency, r.T, r.monetary_value) for r in rd.collect()]
    fit = clv.fit_bgnbd(rd).first()
    scale = 10.0 / max(r[2] for r in rows)

    def objective(theta):
        r, al, a, b = theta
        mean = sum(_ll_ref(x, tx * scale, T * scale, r, al * scale, a, b) for x, tx, T, _ in rows) / len(rows)
        return -mean + 0.01 * (r * r + (al * scale) ** 2 + a * a + b * b)

    best = (fit.r, fit.alpha, fit.a, fit.b)
    assert objective(best) == pytest.approx(fit.objective, abs=1e-9)
    for i in range(4):
        for step in (0.999, 1.001):
            moved = list(best)
            moved[i] *= step
            assert objective(moved) > objective(best) - 1e-10


def _window_rfm(spark):
    from acqlens import constants as K
    from acqlens.operators import rfm as R
    from acqlens.sources import fixtures

    return R.rfm_summary(fixtures.txns_units(spark, "/root/testdata/sf0.001"), K.OBSERVATION_END)


def test_rfm_counts_every_order_in_the_window(spark):
    from acqlens import constants as K

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(F.col("o_orderdate") < F.date_add(F.lit(K.OBSERVATION_END).cast("date"), 1))
    days = orders.select("o_custkey", F.to_date("o_orderdate")).distinct().count()
    assert _window_rfm(spark).agg(F.sum(F.col("frequency") + 1)).first()[0] == days


def test_fits_beat_a_parameter_grid(spark):
    rd = _window_rfm(spark).cache()
    fit = clv.fit_bgnbd(rd).first()
    assert fit.converged and min(fit.r, fit.alpha, fit.a, fit.b) > 0
    assert fit.at_boundary == (min(fit.r, fit.a, fit.b) < clv.BOUNDARY)
    scale = 10.0 / rd.agg(F.max("T")).first()[0]
    grid = [(r, al, a, b) for r in (0.3, 1.0, 3.0) for al in (60.0, 300.0, 1500.0) for a in (0.01, 0.5) for b in (0.5, 2.5)]
    means = rd.agg(*[F.avg(clv.bgnbd_loglik_expr(*g)).alias(f"g{i}") for i, g in enumerate(grid + [(fit.r, fit.alpha, fit.a, fit.b)])]).first()
    # the fit works in scaled days, which shifts every mean log-likelihood alike
    objective = [-m + clv.K.PENALIZER * (g[0] ** 2 + (g[1] * scale) ** 2 + g[2] ** 2 + g[3] ** 2)
                 for m, g in zip(means, grid + [(fit.r, fit.alpha, fit.a, fit.b)])]
    assert objective[-1] <= min(objective[:-1]) + 1e-9
    gg = clv.fit_gamma_gamma(rd).first()
    assert gg.converged and min(gg.p, gg.q, gg.v) > 0
    repeat = rd.where("frequency > 0")
    grid = [(p, q, v) for p in (1.0, 4.0, 10.0) for q in (1.5, 4.0, 12.0) for v in (2.0, 15.0, 60.0)] + [(gg.p, gg.q, gg.v)]
    means = repeat.agg(*[F.avg(clv.gamma_gamma_loglik_expr(*g)).alias(f"g{i}") for i, g in enumerate(grid)]).first()
    objective = [-m + clv.K.PENALIZER * sum(t * t for t in g) for m, g in zip(means, grid)]
    assert objective[-1] <= min(objective[:-1]) + 1e-9


def test_parameter_bundle_round_trip(spark):
    from acqlens.session import scratch_path

    path = scratch_path(spark, "bundle")
    assert clv.load_params(spark, path) is None
    fit = spark.createDataFrame([(0.5, 2.0, True)], "r double, alpha double, converged boolean")
    clv.save_params(fit, path)
    assert clv.params_of(clv.load_params(spark, path), ("r", "alpha")) == (0.5, 2.0)
    with pytest.raises(ValueError, match="converge"):
        clv.params_of(fit.withColumn("converged", F.lit(False)), ("r",))


def test_gamma_gamma_needs_repeat_buyers(spark):
    empty = spark.createDataFrame([(1, 0, 0, 10, 0.0)],
                                  "user_id long, frequency long, recency long, T long, monetary_value double")
    with pytest.raises(ValueError):
        clv.fit_gamma_gamma(empty)
