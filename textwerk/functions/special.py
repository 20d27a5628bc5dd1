"""Tail probabilities and small exact solvers, in NumPy; used within tasks on small tables."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    # continued fraction for the upper part, by the modified Lentz method
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return max(0.0, 1.0 - scale * h)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, accurate in its tail."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1.0 - gamma_p(a, x)
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution; 1 for no degrees of freedom."""
    return gamma_q(df / 2, x / 2) if df > 0 else 1.0


def ncx2_cdf(x: float, df: float, nc: float) -> float:
    """Distribution function of the non-central chi-square distribution: central ones under Poisson weights around their mode."""
    if x <= 0:
        return 0.0
    if nc <= 0:
        return gamma_p(df / 2, x / 2)
    lam, half = nc / 2, x / 2
    width = int(12 * math.sqrt(lam) + 40)
    low, high = max(0, int(lam) - width), int(lam) + width
    j = np.arange(low, high + 1, dtype=float)
    log_fact = np.array([math.lgamma(v + 1) for v in j])
    weight = np.exp(-lam + j * math.log(lam) - log_fact)
    # P(a) = P(a + 1) + x^a e^-x / gamma(a + 1), added from the largest a down
    a = df / 2 + j
    step = np.exp(a[:-1] * math.log(half) - half - np.array([math.lgamma(v + 1) for v in a[:-1]]))
    p = gamma_p(a[-1], half) + np.r_[np.cumsum(step[::-1])[::-1], 0.0]
    return float(min(1.0, (weight * np.minimum(p, 1.0)).sum()))


def ncx2_interval(chi2: float, df: float, alpha: float = 0.05) -> tuple[float, float]:
    """Non-centralities at which ``chi2`` is the 1 - alpha/2 and the alpha/2 quantile; 0 where none is."""

    def solve(target: float) -> float:
        if ncx2_cdf(chi2, df, 0.0) < target:
            return 0.0
        low, high = 0.0, max(1.0, chi2)
        while ncx2_cdf(chi2, df, high) > target and high < 1e10:
            low, high = high, high * 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if ncx2_cdf(chi2, df, middle) > target else (low, middle)
        return (low + high) / 2

    return solve(1 - alpha / 2), solve(alpha / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs, by t with n - 2 degrees of freedom."""
    if n < 3:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return beta_inc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def signed_rank_p(differences: list[float]) -> float:
    """Exact two-sided p of the signed-rank test; zeros are dropped, ties get mean ranks; nan if nothing is left."""
    d = np.array([x for x in differences if x], float)
    if not len(d):
        return math.nan
    size = np.abs(d)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    w = rank[d > 0].sum()
    sums = np.array([0.0])
    for r in rank:  # all signs
        sums = np.concatenate([sums, sums + r])
    return float(min(1.0, 2 * min((sums <= w + 1e-9).mean(), (sums >= w - 1e-9).mean())))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a square cost matrix with the smallest sum, by shortest augmenting paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            gain = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = gain < low[free]
            low[free[better]], way[free[better]] = gain[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, n + 1))
