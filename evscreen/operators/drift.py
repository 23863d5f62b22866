"""Rater drift on a frozen reference set."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evscreen.errors import DriftError
from evscreen.operators import agreement
from evscreen.operators.provenance import DRIFT, ConfigChange, Epoch, canonical_hash, open_epoch

HARD_CROSSINGS, ADVISORY_ALPHA = 2, 0.80


def set_id(records: Iterable[Mapping[str, Any]]) -> str:
    """A hash of the set's records (id, title, abstract, track), whatever their order."""
    rows = sorted(({k: r[k] for k in ("id", "title", "abstract", "track")} for r in records), key=lambda r: r["id"])
    if not rows:
        raise DriftError("a reference set needs a record")
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def evaluate(baseline: DataFrame, current: DataFrame, hard_crossings: int = HARD_CROSSINGS, advisory_alpha: float = ADVISORY_ALPHA) -> DataFrame:
    """Per rater in both (vendor, record_id, rating): n_records, raw_agreement, alpha, crossings and their records, and triggers.

    A crossing goes from 0 or 1 to -1.
    """
    both = baseline.select("vendor", "record_id", F.col("rating").alias("was")).join(current.select("vendor", "record_id", F.col("rating").alias("is")), ["vendor", "record_id"])
    r = lambda v: ((F.col("was") == v).cast("long") + (F.col("is") == v).cast("long"))
    counts = both.withColumns({"n_neg": r(-1), "n_zero": r(0), "n_pos": r(1)})
    agreed = agreement.from_counts(counts, "vendor")
    crossed = F.col("was").isin(0, 1) & (F.col("is") == -1)
    moved = both.groupBy("vendor").agg(F.count_if(crossed).alias("polarity_crossings"), F.array_sort(F.collect_list(F.when(crossed, F.col("record_id")))).alias("crossed_record_ids"))
    out = agreed.join(moved, "vendor").withColumnRenamed("n_units", "n_records")
    return out.select("vendor", "n_records", "raw_agreement", "alpha", "polarity_crossings", "crossed_record_ids", (F.col("polarity_crossings") >= hard_crossings).alias("hard_trigger"), F.coalesce(F.col("alpha") < advisory_alpha, F.lit(False)).alias("advisory_flag"))


def checked(evaluation: DataFrame) -> DataFrame:
    if evaluation.isEmpty():
        raise DriftError("no rater has ratings on shared records in both")
    return evaluation


def summary(evaluation: DataFrame) -> DataFrame:
    """One row: the raters that trigger, those flagged, and whether any triggers."""
    names = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("vendor"))))
    return evaluation.agg(names("hard_trigger").alias("hard_trigger_vendors"), names("advisory_flag").alias("advisory_vendors"), F.coalesce(F.bool_or("hard_trigger"), F.lit(False)).alias("triggered"))


def staleness(evaluations: DataFrame, as_of: str, max_days: float) -> DataFrame:
    """One row (last_evaluated_at, staleness_days, stale): stale if never evaluated, or more than max_days ago."""
    last = evaluations.agg(F.max("evaluated_at").alias("last_evaluated_at"))
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_evaluated_at").cast("timestamp"))) / F.lit(86400e6)
    return last.select("last_evaluated_at", days.alias("staleness_days"), F.coalesce(days > max_days, F.lit(True)).alias("stale"))


def epoch_for_trigger(config_payload: dict, evaluation: DataFrame) -> tuple[Epoch, ConfigChange]:
    """A new epoch of the same configuration, and the change to log; refused without a trigger."""
    row = summary(evaluation).first()
    if not row["triggered"]:
        raise DriftError("no rater triggered")
    own = canonical_hash(config_payload)
    epoch = open_epoch(own)
    return epoch, ConfigChange(epoch.opened_at, own, own, "drift of " + ", ".join(row["hard_trigger_vendors"]), DRIFT)


def simulate(spark: SparkSession, flips: float, trials: int, composition: tuple[int, int, int] = (90, 3, 7), seed: int = 1) -> DataFrame:
    """How often rules fire without drift: each trial flips each of the set's ratings with probability flips to another at random.

    (rule, rate) for the rules any_change, alpha, crossing_1 and crossing_2; uniform numbers are hashes, so that runs repeat.
    """
    neg, zero, pos = composition
    rows = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(0), F.lit(neg + zero + pos - 1))).alias("i"))
    was = F.when(F.col("i") < neg, -1).when(F.col("i") < neg + zero, 0).otherwise(1)
    u = lambda salt: F.pmod(F.xxhash64("trial", "i", F.lit(f"{seed}:{salt}")), F.lit(1 << 32)) / float(1 << 32)
    moved = rows.withColumn("was", was).withColumn("is", F.when(u("flip") < flips, F.pmod(F.col("was") + 1 + F.when(u("to") < 0.5, 1).otherwise(2), F.lit(3)) - 1).otherwise(F.col("was")))
    r = lambda v: ((F.col("was") == v).cast("long") + (F.col("is") == v).cast("long"))
    counts = moved.withColumns({"n_neg": r(-1), "n_zero": r(0), "n_pos": r(1)})
    by = agreement.from_counts(counts, "trial").join(moved.groupBy("trial").agg(F.count_if(F.col("was") != F.col("is")).alias("changed"), F.count_if((F.col("was") >= 0) & (F.col("is") == -1)).alias("crossed")), "trial")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    one = by.agg(share(F.col("changed") > 0).alias("any_change"), share(F.col("alpha") < 0.95).alias("alpha"), share(F.col("crossed") >= 1).alias("crossing_1"), share(F.col("crossed") >= 2).alias("crossing_2"))
    return one.unpivot([], ["any_change", "alpha", "crossing_1", "crossing_2"], "rule", "rate")
