"""Numeric routines for a handful of aggregates on the driver."""

from __future__ import annotations

import math


def chi2_sf(x: float, df: float) -> float:
    """1 - CDF of the chi-squared distribution: the regularised upper incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    # Lentz's continued fraction
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def is_graphic(degrees: list[int], self_loops: bool = False, multi_edges: bool = False) -> bool:
    """Whether a degree sequence can be that of an undirected graph with or without self-loops and multi-edges."""
    if sum(degrees) % 2 or any(d < 0 for d in degrees):
        return False
    if multi_edges:
        return self_loops or not degrees or 2 * max(degrees) <= sum(degrees)
    d = sorted(degrees, reverse=True)
    extra = 1 if self_loops else 0
    for r in range(1, len(d) + 1):
        most = r * (r - 1 + 2 * extra) if self_loops else r * (r - 1)
        if sum(d[:r]) > most + sum(min(r, x) for x in d[r:]):
            return False
    return True
