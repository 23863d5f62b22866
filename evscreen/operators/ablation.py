"""Ensemble ablation: every metric of every subset of raters, and what each rater adds.

Votes are first collapsed to a histogram of vote patterns (a rating or nothing
for each rater, with the truth); all subsets run on that table, whose size
depends on the ensemble and not on the records.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evscreen.errors import AblationError
from evscreen.operators import agreement, decide

SUBSETS_PER_SIZE = 50


def choose_subsets(vendors: Sequence[str], size: int, most: int = SUBSETS_PER_SIZE, seed: int | None = None) -> list[tuple[str, ...]]:
    """All subsets of a size; beyond most, that many drawn so that raters appear about equally often."""
    pool = sorted(set(vendors))
    if math.comb(len(pool), size) <= most:
        return list(itertools.combinations(pool, size))
    rng, seen, chosen = random.Random(seed), dict.fromkeys(pool, 0), set()
    for _ in range(50 * most):
        if len(chosen) == most:
            break
        left, own = list(pool), []
        while len(own) < size:
            own.append(rng.choices(left, [1 / (seen[v] + 1) for v in left])[0])
            left.remove(own[-1])
        subset = tuple(sorted(own))
        if subset not in chosen:
            chosen.add(subset)
            for v in subset:
                seen[v] += 1
    return sorted(chosen)


def patterns(votes: DataFrame, truths: DataFrame) -> DataFrame:
    """(votes map<vendor, rating>, truth, weight): distinct vote patterns and how many records have them."""
    own = votes.join(truths.select("record_id", "truth"), "record_id").groupBy("record_id", "truth").agg(F.array_sort(F.collect_list(F.struct("vendor", "rating"))).alias("pattern"))
    return own.groupBy("pattern", "truth").agg(F.count("*").alias("weight"))


def subset_metrics(histogram: DataFrame, subsets: Sequence[Sequence[str]], tau: float, zero_policy: str = "escalate") -> DataFrame:
    """(subset, x, alpha, raw_agreement, recall, precision, escalation_rate, n_records) for each subset with votes.

    Escalated records count as adjudicated to their gold label.
    """
    spark = histogram.sparkSession
    named = spark.createDataFrame([("+".join(s), list(s)) for s in subsets], "subset string, vendors array<string>")
    own = histogram.crossJoin(F.broadcast(named)).withColumn("kept", F.filter("pattern", lambda v: F.array_contains("vendors", v["vendor"]))).where(F.size("kept") > 0)
    count = lambda r: F.size(F.filter("kept", lambda v: v["rating"] == r)).cast("long")
    counted = own.withColumns({"n_neg": count(-1), "n_zero": count(0), "n_pos": count(1)}).groupBy("subset", "vendors", "n_neg", "n_zero", "n_pos", "truth").agg(F.sum("weight").alias("weight"))
    decided = decide.with_decision(counted, tau, zero_policy)
    said = F.when(F.col("escalate"), F.col("truth")).otherwise(F.col("auto_label")) == 1
    true, w = F.col("truth") == 1, F.col("weight")
    terms = agreement._unit_terms(decided)
    add = lambda c: F.coalesce(F.sum(c * w), F.lit(0.0))
    over = lambda cond: F.sum(F.when(cond, w).otherwise(F.lit(0)))
    sums = terms.groupBy("subset", F.size("vendors").alias("x")).agg(*(add(F.col(c)).alias(c) for c in ("o_nz", "o_zp", "o_np", "m_n", "m_z", "m_p", "agreeing", "pairs")), over(said & true).alias("tp"), over(said & ~true).alias("fp"), over(~said & true).alias("fn"), over(F.col("escalate")).alias("escalated"), F.sum(w).alias("n_records"))
    alpha = agreement.stats.ordinal_alpha(*(F.col(c) for c in ("o_nz", "o_zp", "o_np", "m_n", "m_z", "m_p")))
    rate = agreement.share
    return sums.select("subset", "x", alpha.alias("alpha"), F.try_divide("agreeing", "pairs").alias("raw_agreement"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("escalated"), F.col("n_records")).alias("escalation_rate"), "n_records")


METRICS = ("alpha", "raw_agreement", "recall", "precision", "escalation_rate")


def sweep(votes: DataFrame, truths: DataFrame, tau: float, vendors: Sequence[str] | None = None, zero_policy: str = "escalate", most: int = SUBSETS_PER_SIZE, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics of subsets of two and more raters, and leave-one-out differences (subset, removed, delta_...)."""
    pool = sorted(set(vendors)) if vendors is not None else [r[0] for r in votes.select("vendor").distinct().orderBy("vendor").collect()]
    if len(pool) < 2:
        raise AblationError("an ablation needs two raters")
    if not votes.join(truths, "record_id", "left_anti").isEmpty():
        raise AblationError("a record with votes has no gold label")
    main = [s for x in range(2, len(pool) + 1) for s in choose_subsets(pool, x, most, seed)]
    reduced = {tuple(v for v in s if v != r) for s in main for r in s}
    everything = subset_metrics(patterns(votes, truths), sorted({*main, *reduced}), tau, zero_policy)
    pairs = votes.sparkSession.createDataFrame([("+".join(s), r, "+".join(v for v in s if v != r)) for s in main for r in s], "subset string, removed string, reduced string")
    own = everything.where("x >= 2").join(F.broadcast(pairs.select("subset").distinct()), "subset", "left_semi")
    less = everything.select(F.col("subset").alias("reduced"), *(F.col(m).alias(f"reduced_{m}") for m in METRICS))
    deltas = own.join(pairs, "subset").join(less, "reduced").select("subset", "removed", *((F.col(m) - F.col(f"reduced_{m}")).alias(f"delta_{m}") for m in METRICS))
    return own, deltas
