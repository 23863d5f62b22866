"""Adjudication of escalated records, and selections for active learning. Neither enters audit strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evscreen.errors import AdjudicationError, ReviewError

ADJUDICATION, ACTIVE_LEARNING = "adjudication", "active_learning"


def escalation_reason(boundary: Column, dispersion: Column) -> Column:
    return F.when(boundary, "boundary").when(dispersion > 0, "dispersion").otherwise("tie")


def queue(decisions: DataFrame) -> DataFrame:
    """(record_id, dispersion, boundary, selection_reason, plane) of escalated records; order by record_id to read it."""
    return decisions.where("escalate").select("record_id", "dispersion", "boundary", escalation_reason(F.col("boundary"), F.col("dispersion")).alias("selection_reason"), F.lit(ADJUDICATION).alias("plane"))


def resolve(items: DataFrame, labels: DataFrame, reviewer: str, protocol_id: str | None = None) -> DataFrame:
    """Queue items with human_label, reviewer, resolved_at and protocol_id; labels of records that aren't queued are refused."""
    stray = labels.join(items, "record_id", "left_anti").limit(5).collect()
    if stray:
        raise AdjudicationError("not escalated: " + ", ".join(r["record_id"] for r in stray))
    return items.join(labels.select("record_id", "human_label"), "record_id", "left").withColumns({"reviewer": F.when(F.col("human_label").isNotNull(), F.lit(reviewer)), "resolved_at": F.when(F.col("human_label").isNotNull(), F.current_timestamp()), "protocol_id": F.lit(protocol_id)})


def pending(items: DataFrame) -> DataFrame:
    return items.where("human_label is null").orderBy("record_id")


def overlay(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Decisions after adjudication: a labelled record is no longer escalated and has its human label, 0 included."""
    out = decisions.join(labels.select("record_id", "human_label"), "record_id", "left")
    done = F.col("escalate") & F.col("human_label").isNotNull()
    return out.withColumns({"auto_label": F.when(done, F.col("human_label")).otherwise(F.col("auto_label")), "escalate": F.col("escalate") & ~done}).drop("human_label")


def final_labels(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_id, label, problem): human labels for escalated records, automatic ones for the rest.

    problem: 'unresolved' where an escalated record has no human label,
    'forbidden' where a decided one has.
    """
    out = decisions.join(labels.select("record_id", "human_label"), "record_id", "left")
    human = F.col("human_label").isNotNull()
    problem = F.when(F.col("escalate") & ~human, "unresolved").when(~F.col("escalate") & human, "forbidden")
    return out.select("record_id", F.when(problem.isNull(), F.coalesce(F.when(F.col("escalate"), F.col("human_label")), F.col("auto_label"))).alias("label"), problem.alias("problem"))


def unresolved(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    return decisions.where("escalate").select("record_id").join(labels.where("human_label is not null"), "record_id", "left_anti")


def usable_labels(decisions: DataFrame, stored: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(record_id, human_label) for records still escalated; given labels go before stored ones."""
    open_ = decisions.where("escalate").select("record_id")
    old = stored.select("record_id", F.col("human_label").alias("old")).join(open_, "record_id", "left_semi")
    if given is None:
        return old.select("record_id", F.col("old").alias("human_label"))
    new = given.select("record_id", F.col("human_label").alias("new")).join(open_, "record_id", "left_semi")
    return old.join(new, "record_id", "full").select("record_id", F.coalesce("new", "old").alias("human_label"))


def select_for_review(decisions: DataFrame, confidence: DataFrame, dispersion_threshold: float = 0.0, include_boundary: bool = True, confidence_threshold: float = 0.5, limit: int | None = None) -> DataFrame:
    """Uncertain records, the most dispersed first, then the least confident, then by id; reasons in a fixed order.

    With a limit this is a top-k by partition and a merge, not a sort.
    """
    if limit is not None and limit < 0:
        raise ReviewError("the limit must not be negative")
    if not 0 <= confidence_threshold <= 1:
        raise ReviewError("the confidence threshold must lie in [0, 1]")
    out = decisions.join(confidence, "record_id", "left")
    scored = F.coalesce("scored", F.lit(False))
    low = scored & (F.col("median_probability") <= confidence_threshold)
    reasons = F.filter(F.array(F.when(F.lit(include_boundary) & F.col("boundary"), F.lit("boundary")), F.when(F.col("dispersion") > dispersion_threshold, F.lit("dispersion")), F.when(low, F.lit("low_confidence"))), lambda x: x.isNotNull())
    doubt = F.when(scored, 1 - F.col("median_probability")).otherwise(F.lit(0.0))
    ranked = out.withColumns({"selection_reason": reasons, "doubt": doubt}).where(F.size("selection_reason") > 0).orderBy(F.desc("dispersion"), F.desc("doubt"), "record_id")
    ranked = ranked if limit is None else ranked.limit(limit)
    return ranked.select("record_id", "dispersion", "boundary", "median_probability", "scored", "selection_reason", F.lit(ACTIVE_LEARNING).alias("plane"))


def review(selections: DataFrame, reviewer: str, protocol_id: str | None = None, notes: str | None = None) -> DataFrame:
    return selections.select("record_id", "selection_reason", "plane", F.lit(reviewer).alias("reviewer"), F.current_timestamp().alias("reviewed_at"), F.lit(protocol_id).alias("protocol_id"), F.lit(notes).alias("notes"))
