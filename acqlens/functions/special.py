"""Special functions as native Column expressions (Spark SQL has no lgamma / 2F1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LN_2PI = 0.5 * math.log(2.0 * math.pi)
_SHIFT = 10


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _stirling(w: Column) -> Column:
    inv = 1.0 / w
    inv2 = inv * inv
    series = inv * (1.0 / 12 + inv2 * (-1.0 / 360 + inv2 * (1.0 / 1260 + inv2 * (-1.0 / 1680 + inv2 * (1.0 / 1188)))))
    return (w - 0.5) * F.log(w) - w + _HALF_LN_2PI + series


def lgamma(z: Column | float, guard: bool = True) -> Column:
    """ln Gamma(z) for z > 0.

    Shift by 10 with the recurrence and apply Stirling's series through 1/w^9 (for w >= 10 the
    truncation error is below 2e-14).  The shift is one log of the 10-term product; above
    1e15, where that product could overflow, Stirling is applied to z directly (exact there).
    ``guard=False`` drops that branch (halving the generated code) where the caller knows
    z < 1e30; an overflow there yields -inf, never a wrong finite value.
    """
    z = _lit(z)
    prod = z
    for k in range(1, _SHIFT):
        prod = prod * (z + k)
    shifted = _stirling(z + _SHIFT) - F.log(prod)
    if not guard:
        return shifted
    return F.when(z >= 1e15, _stirling(z)).otherwise(shifted)


def digamma(z: float) -> float:
    """d/dz ln Gamma(z) for z > 0, by the same shift and series as :func:`lgamma`."""
    w = z + _SHIFT
    inv2 = 1.0 / (w * w)
    series = inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240 - inv2 / 132))))
    return math.log(w) - 0.5 / w - series - math.fsum(1.0 / (z + k) for k in range(_SHIFT))


def trigamma(z: float) -> float:
    """Second derivative of ln Gamma(z) for z > 0."""
    w = z + _SHIFT
    inv = 1.0 / w
    inv2 = inv * inv
    series = inv * inv2 * (1.0 / 6 - inv2 * (1.0 / 30 - inv2 * (1.0 / 42 - inv2 * (1.0 / 30 - inv2 * 5.0 / 66))))
    return inv + 0.5 * inv2 + series + math.fsum(1.0 / (z + k) ** 2 for k in range(_SHIFT))


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow; b may be NULL meaning e^b = 0."""
    m = F.greatest(a, F.coalesce(b, a))
    return m + F.log(F.exp(a - m) + F.coalesce(F.exp(b - m), F.lit(0.0)))


def hyp2f1(a: Column | float, b: Column | float, c: Column | float, z: Column | float, tol_digits: int = 17) -> Column:
    """Gauss hypergeometric 2F1(a, b; c; z) for 0 <= z < 1 by its power series.

    The term ratio tends to z * (1 + (a + b - c - 1) / k); the series is summed well past the
    largest term (``k > m z / (1 - z)``) and then until z^k drops below 10^-tol_digits, with
    the count chosen per row from that row's own arguments (no global cap).
    """
    a, b, c, z = _lit(a), _lit(b), _lit(c), _lit(z)
    m = F.greatest(a + b - c - 1, F.lit(0.0))
    zz = F.greatest(z, F.lit(1e-300))
    tail = F.ceil(F.lit(tol_digits * math.log(10.0)) / (-F.log(zz)))
    n_terms = (F.ceil(2 * m * zz / (1 - zz)) + tail + 10).cast("long")
    init = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc, k):
        kd = k.cast("double")
        t = acc["t"] * (a + kd) * (b + kd) / ((c + kd) * (kd + 1)) * z
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.when(z == 0, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(F.lit(0).cast("long"), n_terms - 1), init, step, lambda acc: acc["s"])
    )


def hyp2f1_by_depth(a: float, b: float, c: Column, z: Column, least_c: float, near: float = 0.1, most: int = 40) -> Column:
    """2F1(a, b; c; z) for numbers a, b and columns c >= ``least_c`` and 0 <= z < 1.

    Where z <= ``near`` the series is a nested product of as many terms as leave a remainder
    below 1e-17 for any such c and z: plain arithmetic that Spark compiles.  Other rows, and
    parameters that would need more than ``most`` terms, go through :func:`hyp2f1`.
    """
    depth, term = 0, 1.0
    while depth <= most and (term > 1e-17 or depth < 4):
        low = min(abs(least_c + depth), abs(math.ceil(least_c) + depth)) if least_c < 0 else least_c + depth
        term *= abs((a + depth) * (b + depth)) / (max(low, 1e-9) * (depth + 1)) * near
        depth += 1
    if depth > most:
        return hyp2f1(a, b, c, z)
    nested = F.lit(1.0)
    for k in reversed(range(depth)):
        nested = 1.0 + nested * (z * ((a + k) * (b + k) / (k + 1))) / (c + float(k))
    return F.when(z <= near, nested).otherwise(hyp2f1(a, b, c, z))
