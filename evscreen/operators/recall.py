"""Recall of a screening from audit strata: point, floors, interval, and exact bounds.

strata are rows (role, stratum, n, m, population); there are few, and exact
bounds are computed from whole numbers in pandas batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evscreen.errors import RecallError
from evscreen.functions import stats
from evscreen.functions.numerics import hypergeometric_lower, hypergeometric_upper


def check_strata(strata: DataFrame, role: str) -> None:
    bad = strata.agg(F.count("*").alias("rows"), F.count_if(F.col("role") != role).alias("role"), F.count_if((F.col("n") <= 0) | (F.col("m") < 0) | (F.col("m") > F.col("n")) | (F.col("n") > F.col("population"))).alias("sizes")).first()
    if not bad["rows"]:
        raise RecallError("at least one stratum is needed")
    if bad["role"]:
        raise RecallError(f"a stratum isn't of the role {role}")
    if bad["sizes"]:
        raise RecallError("strata need 0 <= m <= n <= population and n > 0")


def exact_bounds(strata: DataFrame, confidence: float | None = None, joint: int | None = None) -> DataFrame:
    """strata with exact_upper and exact_lower on the relevant of each, each at confidence, or shared among joint strata."""
    level = confidence if joint is None else 1 - (1 - confidence) / joint

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = list(zip(f["m"], f["n"], f["population"]))
            f["exact_upper"] = [hypergeometric_upper(int(m), int(n), int(p), level) for m, n, p in rows]
            f["exact_lower"] = [hypergeometric_lower(int(m), int(n), int(p), level) for m, n, p in rows]
            yield f

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strata.schema.fields)
    return strata.mapInPandas(run, f"{fields}, exact_upper long, exact_lower long")


def stratum_rates(strata: DataFrame, confidence: float = 0.95) -> DataFrame:
    """strata with rate, its Wilson interval and its floor, and the counts that they give."""
    m, n, p = F.col("m"), F.col("n"), F.col("population")
    low, high = stats.wilson(m, n, confidence)
    floor = stats.error_rate_floor(m, n, p, confidence)
    rate = F.try_divide(m.cast("double"), n.cast("double"))
    return strata.withColumns({"rate": rate, "low": low, "high": high, "rate_floor": floor, "estimated": rate * p, "estimated_floor": floor * p})


def stratified(strata: DataFrame, true_positives: float, confidence: float = 0.95) -> DataFrame:
    """One row: point, floor, exact_floor, ci_low, ci_high and the counts of misses behind them.

    The interval adds up half the Wilson widths in quadrature around the
    point's misses. Exact bounds hold together: each has its part of the error.
    """
    if true_positives < 0:
        raise RecallError("true positives must not be negative")
    check_strata(strata, "exclusion")
    joint = strata.count()
    half = F.pow((F.col("high") - F.col("low")) * F.col("population") / 2, F.lit(2))
    sums = exact_bounds(stratum_rates(strata, confidence), confidence, joint).agg(F.sum("estimated").alias("fn"), F.sum("estimated_floor").alias("fn_floor"), F.sqrt(F.sum(half)).alias("half"), F.sum("exact_upper").cast("double").alias("fn_exact"))
    tp = F.lit(float(true_positives))
    return sums.select(stats.recall(tp, F.col("fn")).alias("point"), stats.recall(tp, F.col("fn_floor")).alias("floor"), stats.recall(tp, F.col("fn_exact")).alias("exact_floor"), stats.recall(tp, F.col("fn") + F.col("half")).alias("ci_low"), stats.recall(tp, F.greatest(F.lit(0.0), F.col("fn") - F.col("half"))).alias("ci_high"), tp.alias("true_positives"), F.col("fn").alias("estimated_fn"), F.col("fn_floor").alias("estimated_fn_floor"), F.col("fn_exact").alias("estimated_fn_exact_floor"))


def with_audited_positives(exclusion: DataFrame, true_positives: float, inclusion: DataFrame | None, confidence: float = 0.95) -> DataFrame:
    """stratified with true positives from an audit: the exact floor bounds both sides at once; floor and interval are null."""
    base = stratified(exclusion, true_positives, confidence)
    if inclusion is None or inclusion.isEmpty():
        return base
    check_strata(inclusion, "inclusion")
    joint = exclusion.count() + inclusion.count()
    missed = exact_bounds(exclusion, confidence, joint).agg(F.sum("exact_upper").cast("double").alias("missed"))
    found = exact_bounds(inclusion, confidence, joint).agg(F.sum("exact_lower").cast("double").alias("found"))
    none = F.lit(None).cast("double")
    return base.crossJoin(missed).crossJoin(found).withColumns({"floor": none, "ci_low": none, "ci_high": none, "exact_floor": stats.recall(F.col("found"), F.col("missed")), "estimated_fn_exact_floor": F.col("missed")}).drop("missed", "found")


def estimated_positives(inclusion: DataFrame) -> float:
    check_strata(inclusion, "inclusion")
    return inclusion.agg(F.sum(F.col("m").cast("double") / F.col("n") * F.col("population"))).first()[0]
