"""BG/NBD and Gamma-Gamma: likelihoods, fits, expected purchases and CLV.

Formulas: Fader, Hardie & Lee (2005) for BG/NBD; Fader & Hardie (2013) for Gamma-Gamma.
Times are in days, money in the transaction currency.

Fitting is Newton's method with analytic derivatives: the log-likelihood, its gradient and its
Hessian are sums over customers, and a step takes them all from one aggregate over the RFM table,
checkpointed to the shared folder.  The gamma functions depend on a customer's frequency alone, a
number of days, so they are summed on the driver over the counts per frequency, a table no longer
than the observation window.  Rows add logarithms and fractions only.

Expected purchases need 2F1(r + x, b + x; a + b + x - 1; z).  By Euler's transformation it is
(1 - z)^(a - 1 - r - x) 2F1(a + b - 1 - r, a - 1; a + b + x - 1; z), whose power cancels in the
formula and whose series needs a dozen terms: a projection, with no join or table of values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.functions.special import digamma, hyp2f1_by_depth, lgamma, log_add_exp, trigamma
from acqlens.session import reliable_checkpoint


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


# --- M12: BG/NBD log-likelihood ------------------------------------------------------------
def bgnbd_loglik_expr(r, alpha, a, b, x="frequency", tx="recency", T="T") -> Column:
    """Per-customer log-likelihood; parameters may be floats or Columns (batched fitting)."""
    r, alpha, a, b = (_lit(v) for v in (r, alpha, a, b))
    x, tx, T = F.col(x).cast("double"), F.col(tx).cast("double"), F.col(T).cast("double")
    a1 = lgamma(r + x) - lgamma(r) + r * F.log(alpha)
    a2 = lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    a3 = -(r + x) * F.log(alpha + T)
    a4 = F.when(x > 0, F.log(a) - F.log(b + x - 1) - (r + x) * F.log(alpha + tx))
    return a1 + a2 + log_add_exp(a3, a4)


# --- M13: Gamma-Gamma log-likelihood --------------------------------------------------------
def gamma_gamma_loglik_expr(p, q, v, x="frequency", m="monetary_value") -> Column:
    p, q, v = (_lit(t) for t in (p, q, v))
    x, m = F.col(x).cast("double"), F.col(m).cast("double")
    px = p * x
    return (
        lgamma(px + q) - lgamma(px) - lgamma(q) + q * F.log(v)
        + (px - 1) * F.log(m) + px * F.log(x) - (px + q) * F.log(x * m + v)
    )


# --- M14: expected purchases in (T, T + t] -------------------------------------------------
def expected_purchases_multi(ts: Sequence[float], r, alpha, a, b, x="frequency", tx="recency", T="T") -> list[Column]:
    """E[purchases in (T, T + t]] for several horizons t, each a plain expression of a row."""
    if a == 1:
        raise ValueError("expected purchases need a != 1")
    x, tx, T = F.col(x).cast("double"), F.col(tx).cast("double"), F.col(T).cast("double")
    c = x + (a + b - 1)
    alive = 1 + F.when(x > 0, a / (b + x - 1) * F.pow((alpha + T) / (alpha + tx), r + x)).otherwise(F.lit(0.0))

    def one(t: float) -> Column:
        z = t / (T + (alpha + t))
        return c / (a - 1) * (1 - F.pow(1 - z, a - 1) * hyp2f1_by_depth(a + b - 1 - r, a - 1, c, z, a + b - 1)) / alive

    return [one(float(t)) if t > 0 else F.lit(0.0) for t in ts]


def expected_purchases_expr(t: float, r, alpha, a, b, x="frequency", tx="recency", T="T") -> Column:
    return expected_purchases_multi([t], r, alpha, a, b, x, tx, T)[0]


# --- M15: conditional spend and CLV ---------------------------------------------------------
def expected_spend_expr(p, q, v, x="frequency", m="monetary_value") -> Column:
    x, m = F.col(x).cast("double"), F.col(m).cast("double")
    w = p * x / (p * x + q - 1)
    return (1 - w) * (p * v / (q - 1)) + w * m


def clv_expr(bg: Sequence[float], gg: Sequence[float], periods: int = K.CLV_PERIODS,
             period_days: int = K.CLV_PERIOD_DAYS, discount: float = K.CLV_DISCOUNT,
             x="frequency", tx="recency", T="T", m="monetary_value") -> Column:
    """sum_k spend * (E[k*30] - E[(k-1)*30]) / (1 + d)^k, k = 1..periods."""
    r, alpha, a, b = bg
    spend = expected_spend_expr(*gg, x=x, m=m)
    e = expected_purchases_multi([k * period_days for k in range(periods + 1)], r, alpha, a, b, x, tx, T)
    total = F.lit(0.0)
    for k in range(1, periods + 1):
        total = total + spend * (e[k] - e[k - 1]) / (1 + discount) ** k
    return total


_TRIPLE = ["frequency", "recency", "T"]


def with_expected_purchases(rfm: DataFrame, ts: Sequence[float], bg: Sequence[float]) -> DataFrame:
    """``rfm`` with ``expected_<t>`` per horizon."""
    return rfm.withColumns({f"expected_{t}": e for t, e in zip(ts, expected_purchases_multi(ts, *bg))})


def customer_clv(rfm: DataFrame, bg, gg, periods: int = K.CLV_PERIODS, period_days: int = K.CLV_PERIOD_DAYS,
                 discount: float = K.CLV_DISCOUNT) -> DataFrame:
    ts = [k * period_days for k in range(1, periods + 1)]
    e = with_expected_purchases(rfm.filter(F.col("frequency") > 0), ts, bg)
    spend, before, total = expected_spend_expr(*gg), F.lit(0.0), F.lit(0.0)
    for k, t in enumerate(ts, 1):
        total = total + spend * (F.col(f"expected_{t}") - before) / (1 + discount) ** k
        before = F.col(f"expected_{t}")
    return e.select("user_id", *_TRIPLE, "monetary_value", total.alias("clv"))


def clv_summary(clv: DataFrame) -> DataFrame:
    return clv.agg(F.count(F.lit(1)).alias("n"), F.avg("clv").alias("mean_clv"), F.min("clv").alias("min_clv"),
                   F.count_if(F.col("clv") < 0).alias("negative"))


# --- Newton's method on sums over rows ---------------------------------------------------------
Evaluation = tuple[float, np.ndarray, np.ndarray]


FLOOR = 1e-12  # a parameter that runs towards 0 ends here


def minimize_newton(evaluate: Callable[[np.ndarray], Evaluation], x0: Sequence[float], max_iter: int = 100,
                    gtol: float = 1e-8) -> tuple[np.ndarray, float, int, bool]:
    """(minimum, value, steps, converged) by logarithms of positive parameters, of a function that
    returns value, gradient and Hessian.

    Every call of ``evaluate`` is one data pass.  A Hessian that isn't positive definite is shifted
    until it is; steps longer than 2 per coordinate are shortened, and halved until the value falls.
    A parameter that is small and still falling is put to FLOOR at once, if that lowers the value
    (by logarithms the way to 0 would take a step per factor e), and stays there.
    """
    x, floor = np.asarray(x0, dtype=float), math.log(FLOOR)
    f, g, h = evaluate(x)
    free = x > floor
    for it in range(1, max_iter + 1):
        g = np.where(free, g, 0.0)
        if np.linalg.norm(g, np.inf) < gtol:
            return x, f, it, True
        hf, shift = h[np.ix_(free, free)], 0.0
        while True:
            try:
                np.linalg.cholesky(hf + shift * np.eye(len(hf)))
                break
            except np.linalg.LinAlgError:
                shift = max(1e-6, shift * 10 if shift else abs(np.diag(hf)).max() * 1e-3)
        d = np.zeros(len(x))
        d[free] = -np.linalg.solve(hf + shift * np.eye(len(hf)), g[free])
        d *= min(1.0, 2.0 / max(np.linalg.norm(d, np.inf), 1e-300))
        falling = free & (x < math.log(1e-2)) & (g > 0) & (d < -0.5)
        if falling.any():
            jump = np.where(falling, floor, x + d)
            fx, gx, hx = evaluate(jump)
            if math.isfinite(fx) and fx <= f:
                x, f, g, h, free = jump, fx, gx, hx, free & ~falling
                continue
        t = 1.0
        while True:
            fx, gx, hx = evaluate(x + t * d)
            if math.isfinite(fx) and fx <= f + 1e-4 * t * float(g @ d):
                break
            t /= 2
            if t < 1e-6:  # no descent left in the sums' last bits
                return x, f, it, bool(np.linalg.norm(g, np.inf) < 1e-5)
        x, f, g, h = x + t * d, fx, gx, hx
    return x, f, max_iter, False


def _penalised(theta: np.ndarray, value: float, grad: np.ndarray, hess: np.ndarray, n: float, penalizer: float) -> Evaluation:
    """Mean negative log-likelihood plus penalizer * |theta|^2, with derivatives by log(theta)."""
    g = -grad / n + 2 * penalizer * theta
    h = -hess / n + 2 * penalizer * np.eye(len(theta))
    return -value / n + penalizer * float(theta @ theta), theta * g, np.outer(theta, theta) * h + np.diag(theta * g)


def _symmetric(size: int, upper: dict[tuple[int, int], float]) -> np.ndarray:
    h = np.zeros((size, size))
    for (i, j), v in upper.items():
        h[i, j] = h[j, i] = v
    return h


def _sums(data: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    """Weighted sums of the columns: one aggregate over the rows."""
    row = data.agg(*[F.sum(F.col("w") * c).alias(n) for n, c in columns.items()]).first()
    return {n: float(row[n]) for n in columns}


def _with(data: DataFrame, **numbers: float) -> DataFrame:
    """``data`` with constant columns.  They come from a one-row array rather than from literals,
    so the compiled code is the same in every step and is compiled once."""
    return data.select("*", F.inline(F.array(F.struct(*[F.lit(float(v)).alias(n) for n, v in numbers.items()]))))


def _frequency_counts(data: DataFrame) -> list[tuple[float, float]]:
    """(frequency, customers): frequencies are days with a purchase, so at most the window's length."""
    return [(float(r["frequency"]), float(r["n"])) for r in data.groupBy("frequency").agg(F.sum("w").alias("n")).collect()]


def _bgnbd_evaluation(data: DataFrame, counts: list[tuple[float, float]], penalizer: float) -> Callable[[np.ndarray], Evaluation]:
    n = sum(c for _, c in counts)
    x, tx, T = F.col("frequency").cast("double"), F.col("recency"), F.col("T")

    def evaluate(log_theta: np.ndarray) -> Evaluation:
        r, al, a, b = theta = np.exp(log_theta)
        # the mixture of customers still alive (first) and gone after the last purchase (second)
        mixed = _with(data, r_=r, al_=al, a_=a, b_=b).select(
            "w", "a_", (x + F.col("r_")).alias("rx"), F.log(T + F.col("al_")).alias("ln_end"), F.log(tx + F.col("al_")).alias("ln_last"),
            (1 / (T + F.col("al_"))).alias("i_end"), (1 / (tx + F.col("al_"))).alias("i_last"),
            F.when(x > 0, 1 / (x + F.col("b_") - 1)).otherwise(F.lit(0.0)).alias("i_b"))
        mixed = mixed.withColumn("odds", F.when(F.col("i_b") > 0, F.col("i_b") * F.col("a_") * F.exp(F.col("rx") * (F.col("ln_end") - F.col("ln_last")))).otherwise(F.lit(0.0)))
        mixed = mixed.withColumn("q", F.when(F.col("odds") > 1e300, F.lit(1.0)).otherwise(F.col("odds") / (1 + F.col("odds"))))
        rx, ln_end, ln_last, i_end, i_last, i_b, q = (F.col(c) for c in ("rx", "ln_end", "ln_last", "i_end", "i_last", "i_b", "q"))
        p, both = 1 - q, q * (1 - q)
        # log(1 + odds) without overflow: rows beyond the double range have their logarithm alone
        log1 = F.when(F.col("odds") > 1e300, F.log(F.greatest(i_b * F.col("a_"), F.lit(1e-300))) + rx * (ln_end - ln_last)).otherwise(F.log1p("odds"))
        apart = [ln_last - ln_end, rx * (i_last - i_end), -1 / F.col("a_"), i_b]
        s = _sums(mixed, {
            "f": log1 - rx * ln_end, "g0": -(p * ln_end + q * ln_last), "g1": -rx * (p * i_end + q * i_last), "g2": q / F.col("a_"), "g3": -q * i_b,
            **{f"h{i}{j}": both * apart[i] * apart[j] for i in range(4) for j in range(i, 4)},
            "k01": -(p * i_end + q * i_last), "k11": rx * (p * i_end * i_end + q * i_last * i_last), "k22": -q / (F.col("a_") * F.col("a_")), "k33": q * i_b * i_b})
        lg = [math.lgamma(v) for v in (r, a + b, b)]
        di = [digamma(v) for v in (r, a + b, b)]
        tri = [trigamma(v) for v in (r, a + b, b)]
        f = s["f"] + n * r * math.log(al)
        g = np.array([s[f"g{i}"] for i in range(4)]) + np.array([n * math.log(al), n * r / al, 0.0, 0.0])
        h = {(i, j): s[f"h{i}{j}"] + s.get(f"k{i}{j}", 0.0) for i in range(4) for j in range(i, 4)}
        h[0, 1] += n / al
        h[1, 1] -= n * r / al**2
        for k, c in counts:
            f += c * (math.lgamma(r + k) - lg[0] + lg[1] + math.lgamma(b + k) - lg[2] - math.lgamma(a + b + k))
            ab, ab2 = di[1] - digamma(a + b + k), tri[1] - trigamma(a + b + k)
            g += c * np.array([digamma(r + k) - di[0], 0.0, ab, ab + digamma(b + k) - di[2]])
            h[0, 0] += c * (trigamma(r + k) - tri[0])
            h[2, 2] += c * ab2
            h[2, 3] += c * ab2
            h[3, 3] += c * (ab2 + trigamma(b + k) - tri[2])
        return _penalised(theta, f, g, _symmetric(4, h), n, penalizer)

    return evaluate


def _gamma_gamma_evaluation(data: DataFrame, counts: list[tuple[float, float]], penalizer: float) -> Callable[[np.ndarray], Evaluation]:
    n = sum(c for _, c in counts)
    x, m = F.col("frequency").cast("double"), F.col("monetary_value").cast("double")
    fixed = _sums(data, {"ln_m": F.log(m), "x_ln_m": x * F.log(m), "x_ln_x": x * F.log(x)})

    def evaluate(log_theta: np.ndarray) -> Evaluation:
        p, q, v = theta = np.exp(log_theta)
        all_spent = x * m + F.col("v_")
        spent = _with(data, v_=v).select("w", x.alias("x"), F.log(all_spent).alias("l"), (1 / all_spent).alias("i"))
        x_, l, i = F.col("x"), F.col("l"), F.col("i")
        s = _sums(spent, {"l": l, "xl": x_ * l, "i": i, "xi": x_ * i, "ii": i * i, "xii": x_ * i * i})
        f = n * (q * math.log(v) - math.lgamma(q)) + p * fixed["x_ln_m"] - fixed["ln_m"] + p * fixed["x_ln_x"] - p * s["xl"] - q * s["l"]
        g = np.array([fixed["x_ln_m"] + fixed["x_ln_x"] - s["xl"], n * (math.log(v) - digamma(q)) - s["l"], n * q / v - p * s["xi"] - q * s["i"]])
        h = {(0, 0): 0.0, (0, 1): 0.0, (0, 2): -s["xi"], (1, 1): -n * trigamma(q), (1, 2): n / v - s["i"], (2, 2): -n * q / v**2 + p * s["xii"] + q * s["ii"]}
        for k, c in counts:
            f += c * (math.lgamma(p * k + q) - math.lgamma(p * k))
            up, down, up2, down2 = digamma(p * k + q), digamma(p * k), trigamma(p * k + q), trigamma(p * k)
            g += c * np.array([k * (up - down), up, 0.0])
            h[0, 0] += c * k * k * (up2 - down2)
            h[0, 1] += c * k * up2
            h[1, 1] += c * up2
        return _penalised(theta, f, g, _symmetric(3, h), n, penalizer)

    return evaluate


# --- M11: BG/NBD fit -------------------------------------------------------------------------
BOUNDARY = 1e-3  # a shape parameter below this has run to the edge of its range


def fit_bgnbd(rfm: DataFrame, penalizer: float = K.PENALIZER, x0: Sequence[float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """Penalised maximum likelihood on all buyers; time scaled to T / max(T) * 10 while fitting.

    Returns one row ``(r, alpha, a, b, objective, customers, iterations, converged, at_boundary)``
    with alpha in days.  ``at_boundary`` tells of a shape parameter near 0 (with ``a`` near 0:
    customers hardly ever drop out), where the data don't determine it.
    """
    compact = reliable_checkpoint(rfm.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("w")))
    stats = compact.agg(F.max("T").alias("tmax"), F.sum("w").alias("n")).first()
    scale = 10.0 / float(stats["tmax"])
    scaled = compact.select("frequency", (F.col("recency") * scale).alias("recency"), (F.col("T") * scale).alias("T"), "w")
    x, fx, it, ok = minimize_newton(_bgnbd_evaluation(scaled, _frequency_counts(scaled), penalizer), np.log(np.asarray(x0)))
    r, alpha, a, b = (float(v) for v in np.exp(x))
    spark = rfm.sparkSession
    return spark.createDataFrame(
        [(r, alpha / scale, a, b, float(fx), int(stats["n"]), it, ok, min(r, a, b) < BOUNDARY)],
        "r double, alpha double, a double, b double, objective double, customers long, iterations int, converged boolean, "
        "at_boundary boolean",
    )


# --- M13: Gamma-Gamma fit --------------------------------------------------------------------
def fit_gamma_gamma(rfm: DataFrame, penalizer: float = K.PENALIZER, x0: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    repeat = rfm.filter(F.col("frequency") > 0)
    data = reliable_checkpoint(repeat.select("frequency", "monetary_value", F.lit(1).alias("w")))
    counts = _frequency_counts(data)
    if not counts:
        raise ValueError("the Gamma-Gamma fit needs customers with frequency > 0")
    n = sum(c for _, c in counts)
    x, fx, it, ok = minimize_newton(_gamma_gamma_evaluation(data, counts, penalizer), np.log(np.asarray(x0)))
    p, q, v = (float(t) for t in np.exp(x))
    return rfm.sparkSession.createDataFrame(
        [(p, q, v, float(fx), int(n), it, ok)],
        "p double, q double, v double, objective double, customers long, iterations int, converged boolean",
    )


def params_of(fit: DataFrame, names: Sequence[str]) -> tuple[float, ...]:
    """The fitted parameter vector (a one-row result) as Python floats for expression building."""
    row = fit.first()
    if not row["converged"]:
        raise ValueError(f"the fit did not converge: {row.asDict()}")
    return tuple(float(row[n]) for n in names)


# --- S5: parameter bundle ----------------------------------------------------------------------
def save_params(fit: DataFrame, path: str) -> None:
    fit.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark, path: str) -> DataFrame | None:
    """The stored bundle; ``None`` when nothing is stored at ``path`` (other errors are raised)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)
