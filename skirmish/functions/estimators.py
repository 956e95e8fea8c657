"""Statistical estimators as column expressions: w wins, g games, b a baseline rate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Normal quantiles for two-sided 95 % and one-sided 90 %, and the tier bounds.
Z95, Z90 = 1.96, 1.2815515655446004
TIERS = (("OP", 0.55), ("T1", 0.52), ("T2", 0.50), ("T3", 0.48), ("T4", 0.46))


def number(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(number(x), F.lit(float(low))), F.lit(float(high)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-number(x)))


def logit(p, eps: float = 1e-4) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def raw_rate(w, g) -> Column:
    """w / g; null where there are no games."""
    return F.when(number(g) > 0, number(w) / number(g))


def bayes_rate(w, g, prior=0.5, k=200.0) -> Column:
    """Rate shrunk towards prior as by k games."""
    return (number(w) + number(prior) * number(k)) / (number(g) + number(k))


def laplace_rate(w, g) -> Column:
    return (number(w) + 1) / (number(g) + 2)


def wilson_interval(w, g, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of Wilson's interval; a half both where there are no games."""
    n, p = number(g), number(w) / number(g)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = n <= 0
    return F.when(none, 0.5).otherwise(middle - half), F.when(none, 0.5).otherwise(middle + half)


def wilson_lower(w, g, z: float = Z95) -> Column:
    return F.when(number(g) <= 0, 0.0).otherwise(wilson_interval(w, g, z)[0])


def binomial_variance(w, g) -> Column:
    p = number(w) / number(g)
    return p * (1 - p) / number(g)


def assign_tier(rate) -> Column:
    """Name of the first tier whose bound the rate reaches, else T5."""
    out = F
    for name, low in TIERS:
        out = out.when(number(rate) >= low, name)
    return out.otherwise("T5")


def beta_mean(a, b) -> Column:
    return number(a) / (number(a) + number(b))


def beta_quantile_normal(a, b, z: float = -Z90) -> Column:
    """Normal form of a beta quantile: mean + z sd, within 0 and 1."""
    a, b = number(a), number(b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return clip(a / (a + b) + z * sd, 0, 1)


def log_gamma(x) -> Column:
    """ln of the gamma function for x > 0: Stirling's series eight places up, stepped back down."""
    x = number(x)
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5))
    for i in range(8):
        series = series - F.log(x + i)
    return series


def log_beta(a, b) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(number(a) + number(b))


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method; a value is done when it stops changing, and only the others go on."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    result, left = np.empty_like(x), np.arange(len(x))
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + top * d), safe(1 + top / c)
            out = out * d * c
        done = np.abs(d * c - 1) < 1e-15
        if done.any():
            result[left[done]] = out[done]
            left, x, a, b, c, d, out = (v[~done] for v in (left, x, a, b, c, d, out))
            if not len(left):
                return result
    result[left] = out
    return result


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of arrays, a and b above zero, x strictly between 0 and 1."""
    log_beta = np.array([math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q) for p, q in zip(a, b, strict=True)])
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta)
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    part = front * _fraction(y, p, q) / p
    return np.where(turned, 1 - part, part)


def beta_quantiles(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with beta_cdf(x) = q: bisection, by secants where these stay inside the bracket."""
    low, high = np.zeros_like(a), np.ones_like(a)
    f_low, f_high = -q, 1 - q
    for i in range(200):
        secant = low - f_low * (high - low) / (f_high - f_low)
        inside = (secant > low) & (secant < high) & (i % 3 != 2)
        x = np.where(inside, secant, (low + high) / 2)
        f = beta_cdf(np.clip(x, 1e-300, 1 - 1e-16), a, b) - q
        low, f_low = np.where(f < 0, x, low), np.where(f < 0, f, f_low)
        high, f_high = np.where(f < 0, high, x), np.where(f < 0, f_high, f)
        if np.all((high - low < 1e-13) | (f == 0)):
            break
    return x


def beta_quantile(q: float, a, b) -> Column:
    """Exact quantile of a beta distribution, in Arrow batches; meant for aggregates. Null in, null out; a or b of zero or less gives null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        whole = (a > 0) & (b > 0)
        out = pd.Series(np.nan, index=a.index)
        if whole.any():
            p, r = a[whole].to_numpy(float), b[whole].to_numpy(float)
            out[whole] = beta_quantiles(np.full(len(p), float(q)), p, r)
        return out.where(whole, None)

    return F.nanvl(F.pandas_udf(run, DoubleType())(number(a), number(b)), F.lit(None).cast("double"))
