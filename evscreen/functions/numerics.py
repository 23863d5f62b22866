"""Exact tails and quantiles for the few numbers that are computed on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

from evscreen.errors import RecallError


#: Samples up to which a tail within 1e-9 of its limit is computed from whole numbers; beyond, such a tie falls as rounding has it.
EXACT_SAMPLE = 10_000


def two_sided_z(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise RecallError("confidence must lie strictly between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)


def _tail(lo: int, hi: int, k: int, n: int, population: int) -> float:
    """The probability that a sample of n holds lo to hi of k marked among population, from whole numbers."""
    ways = sum(math.comb(k, i) * math.comb(population - k, n - i) for i in range(max(lo, n - population + k, 0), min(hi, k, n) + 1))
    return ways / math.comb(population, n)


def _quick_tail(lo: int, hi: int, k: int, n: int, population: int) -> float:
    """_tail but for about 1e-12 of it: terms relative to the largest one, as far as they count."""
    least, most = max(n - population + k, 0), min(k, n)
    mode = min(most, max(least, (n + 1) * (k + 1) // (population + 2)))
    reach = int(40 * math.sqrt(n * (k / population) * (1 - k / population) + 1)) + 40
    i = np.arange(mode, min(most, mode + reach), dtype=float)
    up = np.cumprod((k - i) * (n - i) / ((i + 1) * (population - k - n + i + 1)))
    i = np.arange(mode, max(least, mode - reach), -1, dtype=float)
    down = np.cumprod(i * (population - k - n + i) / ((k - i + 1) * (n - i + 1)))
    terms, first = np.concatenate([down[::-1], [1.0], up]), mode - len(down)
    return terms[max(lo - first, 0) : max(hi - first + 1, 0)].sum() / terms.sum()


def _reaches(lo: int, hi: int, k: int, n: int, population: int, least: float) -> bool:
    """Whether _tail is least or more: by whole numbers where rounding could tell otherwise and samples aren't large."""
    quick = _quick_tail(lo, hi, k, n, population)
    return _tail(lo, hi, k, n, population) >= least if abs(quick - least) <= 1e-9 and n <= EXACT_SAMPLE else quick >= least


def _checked(m: int, n: int, population: int, confidence: float) -> None:
    if not 0 < confidence < 1:
        raise RecallError("confidence must lie strictly between 0 and 1")
    if not (0 < n <= population and 0 <= m <= n):
        raise RecallError(f"need 0 <= m <= n <= population and n > 0, not {(m, n, population)}")


def _edge(lo: int, hi: int, holds: Callable[[int], bool], last: bool) -> int:
    """The last k from lo on, or the first, for which a monotone condition holds."""
    while lo < hi:
        mid = (lo + hi + last) // 2
        if holds(mid):
            lo, hi = (mid, hi) if last else (lo, mid)
        else:
            lo, hi = (lo, mid - 1) if last else (mid + 1, hi)
    return lo


def hypergeometric_upper(m: int, n: int, population: int, confidence: float = 0.95) -> int:
    """The most marked items that leave a chance of at least 1 - confidence to draw m or fewer."""
    _checked(m, n, population, confidence)
    if n == population:
        return m
    return _edge(m, population, lambda k: _reaches(0, m, k, n, population, 1 - confidence), last=True)


def hypergeometric_lower(k: int, n: int, population: int, confidence: float = 0.95) -> int:
    """The fewest marked items that leave a chance of at least 1 - confidence to draw k or more."""
    _checked(k, n, population, confidence)
    if k == 0 or n == population:
        return k
    return _edge(k, population, lambda x: _reaches(k, n, x, n, population, 1 - confidence), last=False)
