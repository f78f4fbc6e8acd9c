"""Tail probabilities on the driver, from the standard library only."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, Lentz's continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_tail(x: float, dof: float) -> float:
    return gamma_tail(dof / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_tail(d: float, n: float) -> float:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance at effective sample size ``n`` (Stephens' correction)."""
    if d <= 0:
        return 1.0
    r = math.sqrt(n)
    x = (r + 0.12 + 0.11 / r) * d
    total = sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def skew_z(g1: float, n: int) -> float:
    """D'Agostino's transform of population skewness to a normal score."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    alpha = math.sqrt(2 / (w2 - 1))
    return math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))


def kurtosis_z(g2: float, n: int) -> float:
    """Anscombe and Glynn's transform of population excess kurtosis to a normal score."""
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    t = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    root = math.copysign(abs(t) ** (1 / 3), t)
    return (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))


def k2_test(g1: float, g2: float, n: int) -> tuple[float, float]:
    """D'Agostino-Pearson omnibus statistic and p-value from population moments."""
    k2 = skew_z(g1, n) ** 2 + kurtosis_z(g2, n) ** 2
    return k2, math.exp(-k2 / 2)


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """Shapiro-Wilk W and p-value by Royston's approximation (1995), for 3 to 5000 values."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = [NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        # Royston's polynomial coefficients.
        last = m[-1] / math.sqrt(mm) + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - 2.706056 * u))))
        if n > 5:
            second = m[-2] / math.sqrt(mm) + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u))))
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *[v / math.sqrt(phi) for v in m[2:-2]], second, last]
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *[v / math.sqrt(phi) for v in m[1:-1]], last]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y = -math.log(g - y)
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, 1 - NORMAL.cdf((y - mu) / sigma)
