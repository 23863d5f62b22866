"""Closed forms of the statistics, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evscreen.functions.numerics import two_sided_z


def dispersion(x: Column, total: Column, squares: Column) -> Column:
    """The sample standard deviation from whole-number sums; 0 for one value or none."""
    x, total, squares = (c.cast("long") for c in (x, total, squares))
    return F.when(x <= 1, F.lit(0.0)).otherwise(F.sqrt(F.try_divide((x * squares - total * total).cast("double"), (x * (x - 1)).cast("double"))))


def phi(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """The correlation of two binary variables from their joint counts; null without variance."""
    a, b, c, d = (x.cast("double") for x in (both, only_a, only_b, neither))
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(spread > 0, F.try_divide(a * d - b * c, F.sqrt(spread)))


def ordinal_alpha(o_nz: Column, o_zp: Column, o_np: Column, m_n: Column, m_z: Column, m_p: Column) -> Column:
    """Krippendorff's ordinal alpha from coincidences of differing values and marginals of (-1, 0, 1); null if undefined."""
    total = m_n + m_z + m_p
    d_nz, d_zp, d_np = (F.pow((m_n + m_z) / 2, F.lit(2)), F.pow((m_z + m_p) / 2, F.lit(2)), F.pow(m_n / 2 + m_z + m_p / 2, F.lit(2)))
    seen = o_nz * d_nz + o_zp * d_zp + o_np * d_np
    chance = m_n * m_z * d_nz + m_z * m_p * d_zp + m_n * m_p * d_np
    return F.when(chance > 0, 1 - (total - 1) * F.try_divide(seen, chance))


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """The two-sided Wilson interval, clipped to [0, 1]."""
    z = two_sided_z(confidence)
    p, n = F.try_divide(successes.cast("double"), n.cast("double")), n.cast("double")
    scale = 1 + F.try_divide(F.lit(z * z), n)
    mid = F.try_divide(p + F.try_divide(F.lit(z * z), 2 * n), scale)
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)), scale)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def finite_correction(n: Column, population: Column) -> Column:
    """The finite population correction; 0 for a census."""
    n, population = n.cast("double"), population.cast("double")
    return F.when((population <= 1) | (n >= population), F.lit(0.0)).otherwise(F.sqrt(F.try_divide(population - n, population - 1)))


def error_rate_floor(m: Column, n: Column, population: Column, confidence: float = 0.95) -> Column:
    """A conservative rate: three over n if nothing was found, else the Wilson end, drawn in by the correction."""
    rate = F.try_divide(m.cast("double"), n.cast("double"))
    upper = F.when(m == 0, F.try_divide(F.lit(3.0), n.cast("double"))).otherwise(wilson(m, n, confidence)[1])
    return F.least(F.lit(1.0), rate + (upper - rate) * finite_correction(n, population))


def recall(found: Column, missed: Column) -> Column:
    """found / (found + missed); 0 if both are 0."""
    total = found.cast("double") + missed.cast("double")
    return F.when(total > 0, F.try_divide(found.cast("double"), total)).otherwise(F.lit(0.0))
