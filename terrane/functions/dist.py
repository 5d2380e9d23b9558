"""Tail probabilities, quantiles and small assignment problems, on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def _root(f: Callable[[float], float], low: float, high: float) -> float:
    """Zero of an increasing function by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_ppf(p: float) -> float:
    return _root(lambda x: normal_cdf(x) - p, -40.0, 40.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1 - h * scale


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h / a


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def f_ppf(p: float, d1: float, d2: float) -> float:
    high = 1.0
    while f_sf(high, d1, d2) > 1 - p:
        high *= 2
    return _root(lambda x: (1 - p) - f_sf(x, d1, d2), 0.0, high)


def t_sf(t: float, df: float) -> float:
    """One-sided upper tail."""
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


# The published polynomial coefficients of Royston's approximation (algorithm AS R94), constant term first.
_SHAPIRO = {
    "last": (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056),
    "second": (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633),
    "small mean": (0.544, -0.39978, 0.025054, -6.714e-4),
    "small deviation": (1.3822, -0.77857, 0.062767, -0.0020322),
    "mean": (-1.5861, -0.31082, -0.083751, 0.0038915),
    "deviation": (-0.4803, -0.082676, 0.0030302),
    "gamma": (-2.273, 0.459),
}


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test of normality; (1, 1) for equal values, NaN for fewer than three."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    if x[0] == x[-1]:
        return 1.0, 1.0
    poly = lambda name, at: float(np.polynomial.polynomial.polyval(at, _SHAPIRO[name]))
    score = np.array([normal_ppf((k - 0.375) / (n + 0.25)) for k in range(1, n + 1)])
    norm = float(score @ score)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        ends = [score[-1] / math.sqrt(norm) + poly("last", n**-0.5)]
        if n > 5:
            ends.append(score[-2] / math.sqrt(norm) + poly("second", n**-0.5))
        m = len(ends)
        outer = score[::-1][:m]
        a = score / math.sqrt((norm - 2 * float(outer @ outer)) / (1 - 2 * sum(e * e for e in ends)))
        a[n - m :], a[:m] = ends[::-1], [-e for e in ends]
    d = x - x.mean()
    w = min(1.0, float(a @ d) ** 2 / float(d @ d))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    y = math.log1p(-w)
    if n > 11:
        return w, normal_sf((y - poly("mean", math.log(n))) / math.exp(poly("deviation", math.log(n))))
    gamma = poly("gamma", n)
    return w, 0.0 if y >= gamma else normal_sf((-math.log(gamma - y) - poly("small mean", n)) / math.exp(poly("small deviation", n)))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost one-to-one assignment of a small matrix (shortest augmenting paths)."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        return sorted((a, b) for b, a in assign(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        best, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[col]:
            used[col] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[col] - 1, free - 1] - u[match[col]] - v[free]
            better = reduced < best[free]
            best[free[better]], way[free[better]] = reduced[better], col
            nxt = free[np.argmin(best[free])]
            step = best[nxt]
            u[match[used]] += step
            v[used] -= step
            best[~used] -= step
            col = nxt
        while col:
            match[col] = match[way[col]]
            col = way[col]
    return sorted((match[c] - 1, c - 1) for c in range(1, m + 1) if match[c])


def knee(scores: list[float]) -> int:
    """Index of the knee of a convex decreasing curve: the largest gap between the normalised curve and the diagonal.

    End points never win; a flat curve gives the midpoint; fewer than three points
    the smallest score.
    """
    y = np.asarray(scores, float)
    if len(y) < 3:
        return int(np.argmin(y))
    if y.max() == y.min():
        return len(y) // 2
    gap = (1 - (y - y.min()) / (y.max() - y.min())) - np.linspace(0, 1, len(y))
    return int(np.clip(np.argmax(gap), 1, len(y) - 2))


def vote(scores: dict[str, list[float]], direction: dict[str, str]) -> int:
    """Index with most criteria behind it (``max``, ``min`` or ``knee`` by name); ties go to the smallest."""
    choose = {"max": lambda s: int(np.argmax(s)), "min": lambda s: int(np.argmin(s)), "knee": knee}
    votes = [choose[direction[name]](s) for name, s in scores.items()]
    return min(set(votes), key=lambda k: (-votes.count(k), k))
