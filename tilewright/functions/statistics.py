"""Tail probabilities of the screening's tests, for one test at a time."""

from __future__ import annotations

import math
from functools import lru_cache

#: Products of two group sizes up to which the distribution of U is counted out.
EXACT = 10_000


@lru_cache(maxsize=256)
def u_counts(m: int, n: int) -> tuple[int, ...]:
    """In how many of the orders of m and n different values U is 0, 1, ... m * n.

    The generating function is the product of (1 - x^(n+i)) / (1 - x^i) for i from
    1 to m; each factor is multiplied and divided in whole numbers.
    """
    m, n = min(m, n), max(m, n)
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            counts[u] -= counts[u - n - i]
        for u in range(i, m * n + 1):
            counts[u] += counts[u - i]
    return tuple(counts)


def mann_whitney_p(u: float, n0: int, n1: int, ties: int) -> float | None:
    """Two-sided p of U: counted out for small groups without ties, else by the normal curve with corrections for ties and continuity.

    ``ties`` is the sum of t^3 - t over the groups of t equal values. None where a group is empty; 1 where all values are equal.
    """
    if not n0 or not n1:
        return None
    top, pairs, n = max(u, n0 * n1 - u), n0 * n1, n0 + n1
    if not ties and pairs <= EXACT:
        counts = u_counts(n0, n1)
        return min(1.0, 2 * sum(counts[int(top) :]) / math.comb(n, n0))
    spread = pairs / 12 * (n + 1 - ties / (n * (n - 1)))
    if spread <= 0:
        return 1.0
    return min(1.0, math.erfc((top - pairs / 2 - 0.5) / math.sqrt(spread) / math.sqrt(2)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _inverse(a, b, x)


def _inverse(a: float, b: float, x: float) -> float:
    """1 over the continued fraction 1 + d1 / (1 + d2 / ...), from its far end."""
    terms, value = 400 + int(4 * math.sqrt(max(a, b))), 1.0
    for k in range(terms, 0, -1):
        j = k // 2
        step = j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j)) if k % 2 == 0 else -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1))
        value = 1 + step / value
    return 1 / value


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom; None for fewer than three pairs."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, (1 - rho) * (1 + rho)))
