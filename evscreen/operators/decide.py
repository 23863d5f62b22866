"""Decisions from votes, and the calculus of the dispersion threshold."""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evscreen.errors import VoteError
from evscreen.functions import stats

RULE = "boundary_dispersion"
DOMAIN = (-1, 0, 1)
MULTISET_LIMIT = 2_000_000


def vote_violations(votes: DataFrame) -> DataFrame:
    """Votes outside the domain, and repeated votes of a rater on a record."""
    outside = votes.where(F.col("rating").isNull() | ~F.col("rating").isin(*DOMAIN)).select("record_id", "vendor", F.lit("rating is outside -1, 0 and 1").alias("rule"))
    repeated = votes.groupBy("record_id", "vendor").count().where("count > 1").select("record_id", "vendor", F.lit("vote is repeated"))
    return outside.union(repeated)


def vote_vectors(votes: DataFrame) -> DataFrame:
    """(record_id, ratings) in casting order."""
    return votes.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vendor", "rating"))), lambda v: F.struct(v["vendor"].alias("vendor"), v["rating"].alias("rating"))).alias("votes"))


def vote_counts(votes: DataFrame, *by: str) -> DataFrame:
    """(record_id, n_neg, n_zero, n_pos): all that a decision depends on, from one shuffle with partial sums."""
    r = F.col("rating")
    return votes.groupBy("record_id", *by).agg(F.count_if(r == -1).alias("n_neg"), F.count_if(r == 0).alias("n_zero"), F.count_if(r == 1).alias("n_pos"))


def with_decision(counts: DataFrame, tau: float, zero_policy: str = "escalate", aggregation: str = RULE) -> DataFrame:
    """Adds x, dispersion, boundary, escalate and auto_label to vote counts.

    Escalated: both ends voted for, or dispersion strictly above tau, or a
    balance of 0 under the policy escalate. The label is the balance's sign; 1
    for a balance of 0 under the policy include.
    """
    if aggregation in ("majority", "unanimity"):
        raise NotImplementedError(f"the rule {aggregation} has a name but no definition")
    if aggregation != RULE:
        raise VoteError(f"unknown aggregation {aggregation!r}")
    if zero_policy not in ("escalate", "include"):
        raise VoteError(f"unknown zero_policy {zero_policy!r}")
    neg, zero, pos = (F.col(c).cast("long") for c in ("n_neg", "n_zero", "n_pos"))
    x, balance = neg + zero + pos, pos - neg
    spread = stats.dispersion(x, balance, neg + pos)
    boundary = (neg > 0) & (pos > 0)
    escalate = boundary | (spread > tau) | ((balance == 0) & F.lit(zero_policy == "escalate"))
    label = F.when(balance < 0, -1).otherwise(1)
    return counts.withColumns({"x": x, "dispersion": spread, "boundary": boundary, "escalate": escalate, "auto_label": F.when(~escalate, label)})


def decide(votes: DataFrame, tau: float, zero_policy: str = "escalate", aggregation: str = RULE) -> DataFrame:
    return with_decision(vote_counts(votes), tau, zero_policy, aggregation)


def decision_table(spark: SparkSession, x: int, tau: float, zero_policy: str = "escalate") -> DataFrame:
    """The decision for every count vector of x votes."""
    side = spark.range(x + 1)
    grid = side.select(F.col("id").alias("n_neg")).crossJoin(side.select(F.col("id").alias("n_zero"))).where(f"n_neg + n_zero <= {x}")
    return with_decision(grid.withColumn("n_pos", F.lit(x) - F.col("n_neg") - F.col("n_zero")), tau, zero_policy)


def escalation_rate(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.avg(F.col("escalate").cast("double")).alias("escalation_rate"))


def reachable_frame(sizes: DataFrame) -> DataFrame:
    """(x, dispersion) of all vectors without both ends, in closed form, for each row x of sizes."""
    each = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("x") / 2).cast("int"))))
    value = F.when((F.col("x") <= 1) | (F.col("k") == 0), F.lit(0.0)).otherwise(F.sqrt((F.col("k") * (F.col("x") - F.col("k"))).cast("double") / (F.col("x") * (F.col("x") - 1)).cast("double")))
    return each.select("x", value.alias("dispersion")).distinct()


def reachable(x: int, domain: Sequence[int] = DOMAIN, with_boundary: bool = False) -> tuple[float, ...]:
    """The dispersions that x votes can have, ascending; without vectors that hold both ends of the domain unless asked."""
    values = sorted(set(domain))
    if x < 1 or not values:
        raise VoteError("x must be positive and the domain not empty")
    if x == 1:
        return (0.0,)
    if math.comb(len(values) + x - 1, x) > MULTISET_LIMIT:
        raise VoteError("too many vote vectors to enumerate")
    found = set()
    for combo in itertools.combinations_with_replacement(values, x):
        if with_boundary or len(values) < 2 or not (combo[0] == values[0] and combo[-1] == values[-1]):
            found.add(x * sum(v * v for v in combo) - sum(combo) ** 2)
    return tuple(math.sqrt(n / (x * (x - 1))) for n in sorted(found))


@dataclass(frozen=True)
class TauReport:
    """What a threshold does at one ensemble size."""

    tau: float
    x: int
    reachable: tuple[float, ...]
    effective_breakpoint: float | None
    canonical_interval: tuple[float, float]
    dispersion_inert: bool
    on_reachable_value: bool
    justification: str
    warnings: tuple[str, ...]

    def to_dict(self) -> dict:
        """With null for infinite ends."""
        own = dict(self.__dict__, reachable=list(self.reachable), warnings=list(self.warnings))
        own["canonical_interval"] = [v if math.isfinite(v) else None for v in self.canonical_interval]
        return own


def describe_tau(tau: float, x: int, domain: Sequence[int] = DOMAIN) -> TauReport:
    values = reachable(x, domain)
    low, high = max((v for v in values if v <= tau), default=-math.inf), min((v for v in values if v > tau), default=math.inf)
    on = any(math.isclose(tau, v, rel_tol=1e-9, abs_tol=1e-12) for v in values)
    inert = tau >= values[-1]
    notes = []
    if on:
        notes.append(f"tau {tau} is a reachable dispersion at x={x}; votes with just that dispersion are not escalated")
    if inert:
        notes.append(f"tau {tau} is at or above the largest reachable dispersion at x={x}; only votes for both ends, and balances of 0, escalate")
    if math.isfinite(high) and not math.isclose(tau, (low + high) / 2, rel_tol=1e-9, abs_tol=1e-12):
        notes.append(f"tau {tau} decides like {(low + high) / 2}, the middle of its interval")
    proof = "\n".join([f"{x} votes without both ends reach {len(values)} dispersions:", *(f"{v}: {'escalates' if v > tau else 'is decided'}" for v in values), f"Every tau strictly between {low} and {high} decides alike."])
    return TauReport(tau, x, values, max((v for v in values if v < tau), default=None), (low, high), inert, on, proof, tuple(notes))


def validate_tau(tau: float, x: int, domain: Sequence[int] = DOMAIN) -> TauReport:
    if not math.isfinite(tau) or (x > 1 and tau <= 0):
        raise VoteError(f"tau must be finite, and positive for several votes, not {tau}")
    return describe_tau(tau, x, domain)


def resolve_tau(policy: float | str, x: int, domain: Sequence[int] = DOMAIN) -> float:
    """A threshold between reachable dispersions: by a share of the largest, or by whether an even tie of low and middle votes escalates."""
    values = reachable(x, domain)
    if isinstance(policy, str):
        own = sorted(set(domain))
        if policy not in ("tie_escalate", "tie_tolerate"):
            raise VoteError(f"unknown policy {policy!r}")
        if x % 2 or len(own) < 3:
            raise VoteError("tie policies need an even ensemble and a domain of three values")
        half, step = x // 2, own[1] - own[0]
        tie = math.sqrt(half * half * step * step / (x * (x - 1)))
        if policy == "tie_escalate":
            return (max((v for v in values if v < tie), default=0.0) + tie) / 2
        above = [v for v in values if v > tie]
        return (tie + above[0]) / 2 if above else tie + 1.0
    if not 0 <= policy <= 1:
        raise VoteError("a share must lie in [0, 1]")
    at = bisect_right(values, policy * values[-1])
    if at < len(values):
        return ((values[at - 1] if at else 0.0) + values[at]) / 2
    return values[-1] + 1.0 if values[-1] > 0 else 1.0


def tau_columns(tau: float, frame: DataFrame) -> DataFrame:
    """Per x of a frame (x, dispersion): breakpoint, interval, and whether tau is inert."""
    d = F.col("dispersion")
    return frame.groupBy("x").agg(F.max(F.when(d < tau, d)).alias("effective_breakpoint"), F.max(F.when(d <= tau, d)).alias("interval_low"), F.min(F.when(d > tau, d)).alias("interval_high"), (F.max(d) <= tau).alias("dispersion_inert"), F.count("*").alias("reachable"))


