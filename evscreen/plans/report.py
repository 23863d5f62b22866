"""The validation record: one row of nested statistics over everything that a run has stored."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evscreen.errors import StoreError
from evscreen.operators import agreement, audit, recall, review
from evscreen.operators import provenance as pv
from evscreen.sources.store import RunStore

SCHEMA_VERSION = "1.6"


def assemble(store: RunStore, flow: dict[str, int], truths: DataFrame, sizes: DataFrame, human_labels: DataFrame | None = None, confidence: float = 0.95, allow_unresolved: bool = False, inclusion_sizes: DataFrame | None = None) -> dict[str, Any]:
    """The record as a dictionary. Escalations without a human label are refused unless allowed, and are counted then.

    flow has the counts of prefilter.flow_counts, truths is (record_id,
    truth), sizes are population_sizes. True positives come from the inclusion
    audit if it has labels and inclusion_sizes are given.
    """
    config, epoch = store.read_config(), store.read_epoch()
    own_id = pv.config_id(config)
    if epoch.ensemble_config_id != own_id:
        raise StoreError("the epoch was opened for another configuration")
    votes, decisions = store.require("votes"), store.require("decisions")
    spark = store.spark
    labels = human_labels if human_labels is not None else spark.createDataFrame([], "record_id string, human_label int")

    final = review.final_labels(decisions, labels)
    counts = final.agg(F.count_if(F.col("problem").isNotNull()).alias("open"), F.count_if(F.col("label") == 1).alias("included"), F.count_if(F.col("label") != 1).alias("excluded")).first()
    if counts["open"] and not allow_unresolved:
        shown = ", ".join(r[0] for r in final.where("problem is not null").select("record_id").orderBy("record_id").limit(10).collect())
        raise StoreError(f"{counts['open']} escalated records have no human label: {shown}")
    overall = agreement.strict_agreement(votes).first()
    pairs = {f"{r['vendor_a']}|{r['vendor_b']}": r["alpha"] for r in agreement.pairwise_alpha(votes).orderBy("vendor_a", "vendor_b").collect()}
    errors = {f"{r['vendor_a']}|{r['vendor_b']}": {c: r[c] for c in ("correlation", "n", "both", "only_a", "only_b", "neither")} for r in agreement.fn_correlation(votes, truths).orderBy("vendor_a", "vendor_b").collect()}
    matrix = agreement.confusion(final.where("label is not null"), truths).first().asDict()
    rate = decisions.agg(F.avg(F.col("escalate").cast("double"))).first()[0]

    rows = store.read("audit")
    rows = rows.where("human_label is not null") if rows is not None and "human_label" in rows.columns else None
    estimate: dict[str, Any] = {"point": None, "floor": None, "exact_floor": None, "ci": None, "audit_n": 0, "audit_budget_note": "", "tp_estimation_method": "full_review", "estimated_true_positives": None}
    if rows is not None and not rows.isEmpty():
        strata = audit.strata(rows, sizes, audit.EXCLUSION)
        inside = store.read("inclusion_audit")
        inside = inside.where("human_label is not null") if inside is not None and "human_label" in inside.columns else None
        if inside is not None and inclusion_sizes is not None and not inside.isEmpty():
            included = audit.strata(inside, inclusion_sizes, audit.INCLUSION)
            tp, method = recall.estimated_positives(included), "inclusion_audit"
            out = recall.with_audited_positives(strata, tp, included, confidence).first()
        else:
            tp, method = None, "full_review"
            out = recall.stratified(strata, matrix["tp"], confidence).first()
        n, population = strata.agg(F.sum("n"), F.sum("population")).first()
        estimate = {"point": out["point"], "floor": out["floor"], "exact_floor": out["exact_floor"], "ci": None if out["ci_low"] is None else [out["ci_low"], out["ci_high"]], "audit_n": n, "audit_budget_note": f"{n} of {population} excluded records were audited", "tp_estimation_method": method, "estimated_true_positives": tp}
    body = {"vendors": list(config.vendors), "models": {k: v.model for k, v in config.vendors.items()}, "prompts": {k: v.prompt_version for k, v in config.vendors.items()}, "aggregation": config.aggregation, "tau": config.tau, "batch_size": config.batch_size, "x": config.x, "zero_policy": config.zero_policy}
    return {"schema_version": SCHEMA_VERSION, "ensemble_config_id": own_id, "epoch": epoch.id, "config": body, "agreement": {"krippendorff_alpha": overall["alpha"], "pairwise": pairs}, "error_correlation": {"pairwise_fn_on_relevant": errors}, "escalation_rate": rate, "unresolved_escalations": counts["open"], "recall": estimate, "confusion": matrix, "prisma": flow | {"screen_excluded": counts["excluded"], "included": counts["included"]}}


def to_json(record: dict[str, Any]) -> str:
    return json.dumps(record, indent=2)
