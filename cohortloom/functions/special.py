"""Tail probabilities in plain Python, for the few rows of a result table (Spark SQL has no error function)."""

from __future__ import annotations

import math


def norm_sf2(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(2000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def f_sf(f: float, d1: float, d2: float) -> float:
    return _beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    return _beta_i(df / 2, 0.5, df / (df + t * t))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Sample odds ratio and two-sided p of [[a, b], [c, d]]: the sum over tables at most as likely."""
    r1, r2, c1 = a + b, c + d, a + c
    if not (r1 and r2 and c1 and b + d):
        return float("nan"), 1.0
    lf = math.lgamma
    logp = lambda x: lf(r1 + 1) - lf(x + 1) - lf(r1 - x + 1) + lf(r2 + 1) - lf(c1 - x + 1) - lf(r2 - c1 + x + 1) - lf(r1 + r2 + 1) + lf(c1 + 1) + lf(r1 + r2 - c1 + 1)
    at = logp(a)
    p = sum(math.exp(q) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (q := logp(x)) <= at + 1e-7)
    return (a * d / (b * c) if b * c else float("inf")), min(1.0, p)
