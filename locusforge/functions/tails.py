"""Tail probabilities, quantiles and a bounded minimiser, as Columns, as SQL text and for numpy arrays.

``erfc`` follows the rational Chebyshev fit of Press et al., *Numerical Recipes*, section 6.2 (relative error below
1.2e-7); the incomplete beta function its continued fraction after Lentz; the minimiser is Brent's (1973).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fit, highest power first.
ERFC_FIT = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
#: Median of the chi-square distribution with one degree of freedom.
CHI2_MEDIAN = 0.454936423119572


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def erfc_column(x: Column) -> Column:
    """erfc of a Column that is not negative."""

    def fit(v: Column, t: Column) -> Column:
        poly = F.lit(ERFC_FIT[0])
        for c in ERFC_FIT[1:]:
            poly = F.lit(c) + t * poly
        return t * F.exp(poly - v * v)

    return let(x, lambda v: let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * v), lambda t: fit(v, t)))


def erfc_sql(x: str) -> str:
    t = f"(1.0/(1.0+0.5*({x})))"
    poly = f"({ERFC_FIT[0]})"
    for c in ERFC_FIT[1:]:
        poly = f"(({c})+{t}*{poly})"
    return f"({t}*exp({poly}-({x})*({x})))"


def normal_p(t: Column) -> Column:
    """Two-sided normal tail of a statistic."""
    return F.least(F.lit(1.0), erfc_column(F.abs(t) / F.lit(math.sqrt(2.0))))


_erfc = np.vectorize(math.erfc, otypes=[float])


def erfc(x) -> np.ndarray:
    return _erfc(np.asarray(x, float))


def normal_tail(t) -> np.ndarray:
    """Two-sided normal tail; NaN gives NaN."""
    return np.clip(erfc(np.abs(t) / math.sqrt(2.0)), 0, 1)


def chi2_tail(x) -> np.ndarray:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return erfc(np.sqrt(np.maximum(x, 0) / 2.0))


def normal_critical(p: float) -> float:
    """|z| whose two-sided tail is ``p``."""
    if not 0 < p:
        return math.inf
    return 0.0 if p >= 1 else -NormalDist().inv_cdf(p / 2)


def chi2_of_p(p) -> np.ndarray:
    return np.array([normal_critical(float(v)) ** 2 for v in np.atleast_1d(p)])


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for even in (True, False):
            f = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 + f * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + f / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def beta_inc(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.exp(front + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        out = np.where(low, scale * _beta_fraction(a, b, np.where(low, x, 0.0)) / a, 1.0 - scale * _beta_fraction(b, a, np.where(low, 0.0, 1.0 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def student_tail(t, df: float) -> np.ndarray:
    """Two-sided tail of Student's t; NaN gives NaN."""
    t = np.asarray(t, float)
    with np.errstate(invalid="ignore", over="ignore"):
        x = df / (df + t * t)
    out = beta_inc(df / 2.0, 0.5, np.where(np.isnan(x), 0.5, x))
    return np.where(np.isnan(t), np.nan, np.clip(out, 0.0, 1.0))


#: Residual degrees of freedom from which the linear model uses the normal tail.
NORMAL_FROM_DF = 50


def linear_tail(t, df: float) -> np.ndarray:
    return normal_tail(t) if df >= NORMAL_FROM_DF else student_tail(t, df)


def minimize_bounded(f: Callable[[float], float], low: float, high: float, tolerance: float, steps: int = 500) -> tuple[float, float]:
    """Place and value of a minimum of ``f`` between two bounds: golden sections and parabolas."""
    golden = 0.5 * (3.0 - math.sqrt(5.0))
    a, b = low, high
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    step = before = 0.0
    for _ in range(steps):
        middle = 0.5 * (a + b)
        near = 1.4901161193847656e-08 * abs(x) + tolerance / 3.0
        if abs(x - middle) <= 2.0 * near - 0.5 * (b - a):
            break
        parabola = False
        if abs(before) > near:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2.0 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            last, before = before, step
            if abs(p) < abs(0.5 * q * last) and q * (a - x) < p < q * (b - x):
                step = p / q
                if min(x + step - a, b - x - step) < 2.0 * near:
                    step = math.copysign(near, middle - x)
                parabola = True
        if not parabola:
            before = (a if x >= middle else b) - x
            step = golden * before
        u = x + (step if abs(step) >= near else math.copysign(near, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx
