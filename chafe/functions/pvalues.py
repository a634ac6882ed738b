"""Tail probabilities for the test statistics, without scipy.

Pure functions (math module only) plus Arrow-batched pandas UDFs.  They are
applied to aggregated test tables (one row per test), never to fact rows.
Regularized incomplete gamma (series and Legendre's continued fraction, with a
prefactor that stays exact for large arguments), regularized incomplete beta
(continued fraction), normal tail by erfc.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Degrees of freedom beyond which Student's t is taken through its normal
# transform (relative error of order 1 / dof^2 there).
LARGE_DOF = 100_000


def _stirling_rest(a: float) -> float:
    """ln Gamma(a + 1) minus Stirling's ln(sqrt(2 pi a) (a / e)^a)."""
    if a < 16.0:
        return math.lgamma(a + 1.0) - (0.5 * math.log(2.0 * math.pi * a) + a * math.log(a) - a)
    u = 1.0 / (a * a)
    return (1.0 / 12.0 - u * (1.0 / 360.0 - u * (1.0 / 1260.0 - u / 1680.0))) / a


def _log_excess(a: float, x: float) -> float:
    """x - a - a ln(x / a), without cancellation where x is close to a."""
    d = (x - a) / a
    if abs(d) > 0.1:
        return x - a - a * math.log(x / a)
    # a (d - ln(1 + d)) = a (d^2/2 - d^3/3 + d^4/4 - ...)
    return a * sum((-d) ** n / n for n in range(18, 1, -1))


def _poisson_like(a: float, x: float) -> float:
    """x^a e^-x / Gamma(a + 1), stable for any size of a."""
    return math.exp(-_log_excess(a, x) - _stirling_rest(a)) / math.sqrt(2.0 * math.pi * a)


def _fraction(terms, least_terms: int = 2) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + ...)) from pairs (a, b), the first one
    (_, b0), by the ratios of successive numerators and denominators."""
    it = iter(terms)
    value = next(it)[1] or 1e-300
    up, down = value, 0.0
    for n, (a, b) in enumerate(it):
        down = b + a * down
        down = 1.0 / (down if down else 1e-300)
        up = (b + a / up) or 1e-300
        step = up * down
        value *= step
        if n >= least_terms and abs(step - 1.0) < 4e-16:
            return value
    return value


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x).

    Below the mode 1 - P from the series sum x^n / ((a + 1) ... (a + n)); above it
    Legendre's continued fraction.  Both run until they have converged, which
    takes of the order of sqrt(a) steps."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = _poisson_like(a, x)
    if front == 0.0:
        return 1.0 if x < a else 0.0
    if x < a + 1.0:
        total = term = 1.0
        n = a
        while term > total * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)

    def legendre():
        yield 0.0, x + 1.0 - a
        n = 1
        while True:
            yield -n * (n - a), x + 2.0 * n + 1.0 - a
            n += 1
    return min(1.0, front * a / _fraction(legendre()))


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return float("nan")
    return gamma_q(dof / 2.0, x / 2.0)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b) by its continued fraction, on the
    side of the mean where that converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def terms():
        yield 0.0, 1.0
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
    return math.exp(log_front) / (a * _fraction(terms(), 4))


def t_sf_two_sided(t: float, dof: float) -> float:
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if dof > LARGE_DOF:
        # Wallace's transform of t to a normal deviate
        z = (8.0 * dof + 1.0) / (8.0 * dof + 3.0) * math.sqrt(dof * math.log1p(t * t / dof))
        return 2.0 * norm_sf(z)
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def corr_p(r: float, n: float) -> float:
    """Two-sided p of a correlation coefficient via t with n - 2 dof."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    dof = n - 2.0
    t = r * math.sqrt(dof / ((1.0 + r) * (1.0 - r)))
    return t_sf_two_sided(abs(t), dof)


def _vec(fn, *series):
    out = [fn(*[None if pd.isna(v) else float(v) for v in vals]) for vals in zip(*series)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(lambda a, b: float("nan") if a is None or b is None else chi2_sf(a, b), x, dof)


@F.pandas_udf(T.DoubleType())
def corr_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return _vec(lambda a, b: float("nan") if a is None or b is None else corr_p(a, b), r, n)


@F.pandas_udf(T.DoubleType())
def norm_two_sided_udf(z: pd.Series) -> pd.Series:
    return _vec(lambda a: float("nan") if a is None else min(1.0, 2.0 * norm_sf(a)), z)
