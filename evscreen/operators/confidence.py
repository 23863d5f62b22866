"""Confidence of votes and records from token log probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evscreen.errors import ConfidenceError
from evscreen.functions.text import strip

OPENAI_LIKE = ("openai", "mistral", "fireworks", "together")
MIN_SUPPORTING = 3
_GOOGLE = "array<struct<token:string,logProbability:string,log_probability:string>>"
#: What counts of a reply of either kind, read in one pass.
_REPLY = f"struct<logprobs:struct<content:array<struct<token:string,logprob:string>>,chosenCandidates:{_GOOGLE},chosen_candidates:{_GOOGLE}>>"


def _geometric_mean(entries: Column) -> Column:
    """exp of the mean log probability of entries (token, p) that aren't white space; null if any entry is malformed or none is left."""
    bad = F.exists(entries, lambda e: e.isNull() | e["token"].isNull() | e["p"].isNull() | F.isnan(e["p"]) | (F.abs(e["p"]) == float("inf")))
    own = F.filter(entries, lambda e: strip(e["token"]) != "")
    total = F.aggregate(own, F.lit(0.0), lambda a, e: a + e["p"])
    return F.when(~bad & (F.size(own) > 0), F.exp(total / F.size(own)))


def vote_confidence(vendor: Column, raw: Column) -> Column:
    """The probability of a vote's tokens, 1 at most; null for raters without log probabilities and for unusable replies."""
    own = F.from_json(raw, _REPLY)["logprobs"]
    content = own["content"]
    plain = _geometric_mean(F.transform(content, lambda e: F.struct(e["token"].alias("token"), e["logprob"].try_cast("double").alias("p"))))
    google = _geometric_mean(F.transform(F.coalesce(own["chosenCandidates"], own["chosen_candidates"]), lambda e: F.struct(e["token"].alias("token"), F.coalesce(e["logProbability"].try_cast("double"), e["log_probability"].try_cast("double")).alias("p"))))
    found = F.when(vendor.isin(*OPENAI_LIKE), plain).when(vendor == "google", google)
    return F.when(found.isNotNull(), F.least(F.lit(1.0), found))  # least() alone passes over nulls


def record_confidence(votes: DataFrame, probability: str = "probability") -> DataFrame:
    """(record_id, median_probability, n_supporting, n_total, scored); the median is 0 unless three votes support it."""
    p = F.col(probability)
    return votes.groupBy("record_id").agg(F.median(p).alias("m"), F.count(p).alias("n_supporting"), F.count("*").alias("n_total")).select("record_id", F.when(F.col("n_supporting") >= MIN_SUPPORTING, F.col("m")).otherwise(F.lit(0.0)).alias("median_probability"), "n_supporting", "n_total", (F.col("n_supporting") >= MIN_SUPPORTING).alias("scored"))


def tier(scored: Column, median: Column, low_threshold: float = 0.5) -> Column:
    """unscored, low (up to the threshold) or high."""
    if not 0 <= low_threshold <= 1:
        raise ConfidenceError("the threshold must lie in [0, 1]")
    return F.when(~scored, "unscored").when(median <= low_threshold, "low").otherwise("high")
