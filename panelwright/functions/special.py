"""Tails that Spark SQL lacks, from the standard library alone, and their pandas UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction (Lentz) above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi_square_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + n * d), 1 + n / c
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def student_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    tail = (1 - confidence) / 2
    return (0.0 if k == 0 else beta_quantile(tail, k, n - k + 1), 1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k))


def binomial_pmf(k: int, n: int, p: float) -> float:
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X > k)."""
    return beta_cdf(k + 1, n - k, p) if 0 <= k < n else float(k < 0)


def binomial_doubled(k: int, n: int, p: float) -> float:
    """Twice the smaller tail, at most 1."""
    return min(1.0, 2 * min(1 - binomial_sf(k, n, p), binomial_sf(k - 1, n, p)))


def binomial_minimum_likelihood(k: int, n: int, p: float) -> float:
    """Sum of the probabilities of all outcomes that are at most as likely as k."""
    own = binomial_pmf(k, n, p) * (1 + 1e-7)
    mode = math.floor((n + 1) * p)
    if k == round(n * p) == n * p:
        return 1.0
    if k < mode:  # the first outcome above the mode that is as rare
        low, high = mode, n + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if binomial_pmf(mid, n, p) <= own else (mid + 1, high)
        return min(1.0, 1 - binomial_sf(k, n, p) + binomial_sf(low - 1, n, p))
    low, high = -1, mode
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if binomial_pmf(mid, n, p) <= own else (low, mid - 1)
    return min(1.0, binomial_sf(k - 1, n, p) + (1 - binomial_sf(low, n, p) if low >= 0 else 0.0))


def _each(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in r) else float(f(*r)) for r in zip(*cols, strict=True)], dtype="float64")


def udf(f):
    """A pandas UDF of one to three numeric columns; a null or NaN argument gives null."""

    def one(a: pd.Series) -> pd.Series:
        return _each(f, a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(f, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _each(f, a, b, c)

    return F.pandas_udf((one, two, three)[f.__code__.co_argcount - 1], T.DoubleType())
