"""Tail probabilities for the tests, from published formulas; plain Python, for use in Pandas functions."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np


def chi2_1_sf(x: float) -> float:
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def binomial_cdf_half(k: int, n: int) -> float:
    return sum(math.comb(n, i) for i in range(k + 1)) / 2**n


def mcnemar(b: int, c: int) -> tuple[float, float, bool]:
    """(statistic, p, exact): exact below 25 discordant pairs, else chi square with continuity correction."""
    n = b + c
    if n < 25:
        return float(min(b, c)), min(1.0, 2 * binomial_cdf_half(min(b, c), n)), True
    s = (abs(b - c) - 1) ** 2 / n
    return s, chi2_1_sf(s), False


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(120)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's T.

    With t = sqrt(df) tan(a) the density is a power of a cosine, and the tail is its integral from a to a right angle, by
    Gauss and Legendre's rule as far as the integrand matters; so small tails keep their digits.
    """
    power, a = df - 1, math.atan(abs(t) / math.sqrt(df))
    reach = min([math.pi / 2 - a] + ([40 / (power * math.tan(a))] if power and a else []) + ([math.sqrt(80 / power)] if power else []))
    x = a + reach * (_NODES + 1) / 2
    inside = float((_WEIGHTS * np.exp(power * (np.log(np.maximum(np.cos(x), 1e-300)) - math.log(math.cos(a))))).sum()) * reach / 2
    whole = 0.5 * math.log(math.pi) + math.lgamma(df / 2) - math.lgamma((df + 1) / 2)
    return min(1.0, 2 * inside * math.exp(power * math.log(math.cos(a)) - whole))


@functools.lru_cache(maxsize=4096)
def t_quantile(df: float, outside: float = 0.05) -> float:
    """The t beyond which, on both sides together, lies the share outside; by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > outside:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > outside else (low, mid)
    return (low + high) / 2


def spearman_p(rho: float, n: int) -> float:
    """Two-sided, by Student's approximation with n - 2 degrees of freedom; nan below three pairs."""
    if n < 3:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def midranks(values: Sequence[float]) -> list[float]:
    """Ranks from 1; equal values share the mean of theirs, which follows from how many are below and how many are equal."""
    _, of, count = np.unique(np.asarray(values, float), return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[of].tolist()


def wilcoxon(diffs: Sequence[float]) -> tuple[float, float]:
    """(statistic, two-sided p) of the signed-rank test: zeros dropped, midranks; exact up to 50 differences, then normal with tie correction.

    All differences zero: p is 1.
    """
    d = [x for x in diffs if x != 0 and not math.isnan(x)]
    if not d:
        return 0.0, 1.0
    ranks = midranks([abs(x) for x in d])
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    total = sum(ranks)
    w = min(plus, total - plus)
    if len(d) <= 50:  # the distribution of twice the rank sum, over all signs
        ways = {0: 1}
        for r in ranks:
            step = round(2 * r)
            new = dict(ways)
            for s, n in ways.items():
                new[s + step] = new.get(s + step, 0) + n
            ways = new
        low = sum(n for s, n in ways.items() if s <= round(2 * w))
        return w, min(1.0, 2 * low / 2 ** len(d))
    n = len(d)
    ties = {}
    for r in ranks:
        ties[r] = ties.get(r, 0) + 1
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties.values()) / 48)
    return w, min(1.0, math.erfc(abs(w - total / 2) / sd / math.sqrt(2)))
