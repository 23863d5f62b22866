"""The workflow as commands over a run's folder: python -m evscreen.cli COMMAND.

Every command prints JSON. Votes come from seeded offline raters
(--deterministic-seed) or from factories that a program passes to main().
"""

from __future__ import annotations

import argparse
import json
import sys
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evscreen.errors import BatchJobError, CommandError, ScreeningError
from evscreen.operators import ablation, audit, confidence, decide, drift, ensemble, prefilter, review
from evscreen.operators import provenance as pv
from evscreen.plans import report
from evscreen.sources import ingest
from evscreen.sources.files import read_bytes, write_text
from evscreen.sources.store import RunStore

VOTES, RAW = ("record_id", "pos", "vendor", "rating"), ("record_id", "vendor", "raw")
Services = Mapping[str, ensemble.Factory]
BatchServices = Mapping[str, ensemble.BatchFactory]


class Context:
    """What a command works with."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, factories: Services | None, batch_factories: BatchServices | None = None):
        self.spark, self.args, self.factories, self.batch_factories = spark, args, factories, batch_factories
        self.store = RunStore(spark, args.run_dir)

    def records(self, path: str) -> DataFrame:
        return ingest.load(self.spark, path).withColumnRenamed("id", "record_id")

    def outcomes(self) -> DataFrame:
        return prefilter.prefilter(self.records(self.args.input), prefilter.external_key(F.col("ids"), F.col("record_id")), prefilter.default_rules())

    def truths(self) -> DataFrame:
        return ingest.gold(self.records(self.args.input)).select("record_id", F.col("gold_label").alias("truth"))

    def raters(self, config: ingest.EnsembleConfig, logprobs: bool = False) -> list[ensemble.Rater]:
        seed = self.args.deterministic_seed
        if seed is not None:
            return [ensemble.SeededRater(k, seed, v.model, logprobs) for k, v in config.vendors.items()]
        if self.factories is None:
            raise CommandError("no services are connected: give --deterministic-seed, or call main() with factories")
        return ensemble.build_raters(config, self.factories)

    def batch_services(self, config: ingest.EnsembleConfig) -> list[ensemble.BatchService]:
        if self.args.deterministic_seed is not None:
            return [ensemble.SeededBatchService(self.spark, f"{self.store.root}/jobs", r) for r in self.raters(config, self.args.request_logprobs)]
        if self.batch_factories is None:
            raise CommandError("no batch services are connected: give --deterministic-seed, or call main() with batch_factories")
        return ensemble.build_batch_raters(config, self.batch_factories)


def shown(payload: Any, out: str | None = None, spark: SparkSession | None = None) -> None:
    text = json.dumps(payload, indent=2, sort_keys=True, default=str)
    if out is None:
        print(text)
    else:
        write_text(spark, out, text + "\n")


def rows_of(df: DataFrame) -> list[dict[str, Any]]:
    """Rows that a person reads."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _finish(c: Context, config: ingest.EnsembleConfig, epoch: pv.Epoch, cast: DataFrame, flow: dict[str, int]) -> dict[str, Any]:
    own = pv.config_id(config)
    c.store.write("raw_responses", cast.select(*RAW), own)
    c.store.write("votes", cast.select(*VOTES), own)
    decisions = decide.decide(c.store.require("votes"), config.tau, config.zero_policy, config.aggregation)
    c.store.write("decisions", decisions, own)
    escalated = c.store.require("decisions").where("escalate").count()
    run = pv.start_run("screening", epoch.id, c.args.track).finish(counts={"identified": flow["identified"], "screened": flow["screened"], "escalated": escalated})
    c.store.write_run(run)
    return {"ensemble_config_id": own, "epoch": epoch.id, "prisma": flow, "escalated": escalated}


def screen(c: Context) -> int:
    args, config = c.args, ingest.load_config(c.spark, c.args.config)
    tau = decide.validate_tau(config.tau, config.x)  # before anything is written
    if args.approver is not None and args.previous_run_dir is None:
        raise CommandError("--approver goes with --previous-run-dir")
    if args.previous_run_dir is not None and not args.change_reason:
        raise CommandError("--previous-run-dir needs --change-reason")
    outcomes = c.outcomes()
    flow = prefilter.flow_counts(outcomes).first().asDict()
    before = RunStore(c.spark, args.previous_run_dir).read_config() if args.previous_run_dir else None
    own = c.store.write_config(config)
    known = c.store.read_json("epoch")
    epoch = pv.maybe_open_epoch(pv.Epoch(**known) if known else None, own)
    c.store.write_epoch(epoch)
    if known is None and before is None:
        c.store.append_change(pv.ConfigChange(epoch.opened_at, None, own, args.change_reason or "first configuration of this run", pv.INITIAL))
    elif known is None:
        fields = tuple(pv.changed_fields(pv.config_payload(before), pv.config_payload(config)))
        c.store.append_change(pv.ConfigChange(epoch.opened_at, pv.config_id(before), own, args.change_reason, pv.EXPLICIT, fields, args.approver))
    for message in tau.warnings:
        warnings.warn(message, stacklevel=2)
    c.store.write_json("tau_report", tau.to_dict())
    passed = outcomes.where("outcome = 'passed'")
    if args.mode == "batch":
        services = c.batch_services(config)
        jobs = ensemble.submit_jobs(passed, services, config, own, {k: ensemble.Job(**v) for k, v in c.store.read_jobs().items()})
        for vendor, job in jobs.items():
            c.store.write_job(vendor, json.loads(job.to_json()))
        if not args.wait:
            shown({"ensemble_config_id": own, "epoch": epoch.id, "prisma": flow, "mode": "batch", "submitted": True, "waited": False})
            return 0
        cast = ensemble.fetch_jobs(services, jobs)
    else:
        cast = ensemble.run_ensemble(passed, c.raters(config, args.request_logprobs), config)
    shown(_finish(c, config, epoch, cast, flow))
    return 0


def batch_fetch(c: Context) -> int:
    config, epoch = c.store.read_config(), c.store.read_epoch()
    jobs = {k: ensemble.Job(**v) for k, v in c.store.read_jobs().items()}
    cast = ensemble.fetch_jobs(c.batch_services(config), jobs, c.args.poll_interval, longest=c.args.max_poll_interval)
    shown(_finish(c, config, epoch, cast, prefilter.flow_counts(c.outcomes()).first().asDict()))
    return 0


def adjudicate(c: Context) -> int:
    own, decisions = pv.config_id(c.store.read_config()), c.store.require("decisions")
    if c.args.record_id is None:
        shown({"pending": [r[0] for r in decisions.where("escalate").select("record_id").orderBy("record_id").collect()]})
        return 0
    if c.args.label is None:
        raise CommandError("--record-id needs --label")
    one = decisions.where(F.col("record_id") == c.args.record_id)
    row = one.first()
    if row is None:
        raise CommandError(f"{c.args.record_id} has no decision")
    if not row["escalate"]:
        raise CommandError(f"{c.args.record_id} is not escalated")
    label = c.spark.createDataFrame([(c.args.record_id, c.args.label)], "record_id string, human_label int")
    resolved = review.resolve(review.queue(one), label, c.args.reviewer or "", c.args.protocol_id)
    c.store.write("adjudication_records", resolved, own)
    c.store.write("decisions", review.overlay(one, label), own)
    shown({"record_id": c.args.record_id, "final_label": c.args.label})
    return 0


def _tiers(c: Context, population: DataFrame, threshold: float) -> DataFrame:
    scored = _confidences(c)
    return population.join(scored.select("record_id", confidence.tier(F.col("scored"), F.col("median_probability"), threshold).alias("confidence")), "record_id")


def _confidences(c: Context) -> DataFrame:
    cast = c.store.require("votes").join(c.store.require("raw_responses"), ["record_id", "vendor"], "left")
    return confidence.record_confidence(cast.withColumn("probability", confidence.vote_confidence(F.col("vendor"), F.col("raw"))))


def _draw(c: Context, population: DataFrame, by: str | None, plane: str, rows: str, drawn: str) -> int:
    own, size = pv.config_id(c.store.read_config()), population.count()
    if not size:
        raise CommandError("nothing is there to audit")
    seed = c.args.seed if c.args.seed is not None else int(datetime.now(UTC).timestamp() * 1e6)
    found = audit.draw(population, c.args.size if c.args.size is not None else size, seed, by, plane)
    frame = audit.frame_hash(population).first()["frame_hash"]
    empty = {"human_label": F.lit(None).cast("int"), "reviewer": F.lit(None).cast("string"), "blinded": F.lit(None).cast("boolean")}
    c.store.write(rows, found.withColumns(empty), own)
    c.store.write_draw(drawn, found, own, frame)
    shown({"drawn": rows_of(found.select("record_id", "stratum").orderBy("record_id")), "sampling_frame_hash": frame})
    return 0


def audit_draw(c: Context) -> int:
    if c.args.stratify_by_track and c.args.stratify_by_confidence:
        raise CommandError("strata are by track or by confidence")
    population = audit.excluded_population(c.store.require("decisions"), c.records(c.args.input))
    if c.args.stratify_by_confidence:
        threshold = c.store.read_config().confidence_threshold
        population = _tiers(c, population, threshold)
        c.store.write_json("confidence_policy", {"low_threshold": threshold, "min_supporting_votes": confidence.MIN_SUPPORTING})
    by = "track" if c.args.stratify_by_track else "confidence" if c.args.stratify_by_confidence else None
    return _draw(c, population, by, audit.EXCLUSION, "audit", "audit_draw")


def inclusion_audit_draw(c: Context) -> int:
    if c.args.stratify_by_track and c.args.stratify_by_status:
        raise CommandError("strata are by track or by status")
    population = audit.included_population(c.store.require("decisions"), c.records(c.args.input))
    by = "track" if c.args.stratify_by_track else "status" if c.args.stratify_by_status else None
    return _draw(c, population, by, audit.INCLUSION, "inclusion_audit", "inclusion_audit_draw")


def _apply(c: Context, name: str) -> DataFrame:
    own, labels = pv.config_id(c.store.read_config()), ingest.labels_from_json(c.spark, c.args.labels)
    rows = c.store.read(name)
    open_ = rows.where("human_label is null").drop("human_label", "reviewer", "blinded") if rows is not None else None
    if open_ is None or open_.isEmpty():
        raise CommandError("no audit row waits for a label")
    done = audit.apply_labels(open_, labels, c.args.reviewer, c.args.blinded)
    ids = done.select("record_id", "human_label").orderBy("record_id").collect()
    c.store.write(name, done, own)
    if name == "audit":
        c.store.write("audit_labels", c.spark.createDataFrame(ids, "record_id string, human_label int"), own)
    shown({"labeled": [r[0] for r in ids]})
    return done


def audit_apply(c: Context) -> int:
    _apply(c, "audit")
    return 0


def inclusion_audit_apply(c: Context) -> int:
    _apply(c, "inclusion_audit")
    return 0


def validate(c: Context) -> int:
    args, decisions, records = c.args, c.store.require("decisions"), c.records(c.args.input)
    excluded = audit.excluded_population(decisions, records)
    policy = c.store.read_json("confidence_policy")
    kinds = ["track"]
    if policy is not None:
        excluded, kinds = _tiers(c, excluded, policy["low_threshold"]), ["track", "confidence"]
    sizes = audit.population_sizes(excluded, *kinds)
    inside = audit.population_sizes(audit.included_population(decisions, records), "track", "status")
    stored = c.store.read("adjudication_records")
    stored = stored.select("record_id", "human_label") if stored is not None else c.spark.createDataFrame([], "record_id string, human_label int")
    given = ingest.labels_from_json(c.spark, args.human_labels) if args.human_labels else None
    labels = review.usable_labels(decisions, stored.where("human_label is not null"), given)
    flow = prefilter.flow_counts(c.outcomes()).first().asDict()
    record = report.assemble(c.store, flow, c.truths(), sizes, labels, args.confidence, args.allow_unresolved_escalations, inside)
    record |= {k: v for k, v in (("tau_report", c.store.read_json("tau_report")), ("confidence_policy", policy)) if v is not None}
    if args.max_staleness_days is not None:
        log = c.store.read("drift_evaluations")
        log = log.select(F.col("evaluated_at").cast("timestamp").alias("evaluated_at")) if log is not None else c.spark.createDataFrame([], "evaluated_at timestamp")
        row = drift.staleness(log, datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f+00:00"), args.max_staleness_days).first()
        record["sentinel_staleness"] = {"last_checked_at": row["last_evaluated_at"] and str(row["last_evaluated_at"]), "staleness_days": row["staleness_days"], "max_staleness_days": args.max_staleness_days, "stale": row["stale"]}
        if row["stale"]:
            message = f"drift was not checked within {args.max_staleness_days} days"
            if args.fail_on_stale_sentinel:
                raise CommandError(message)
            print(f"warning: {message}", file=sys.stderr)
    c.store.write_json("validation_record", record)
    shown(record, args.out, c.spark)
    return 0


def ablate(c: Context) -> int:
    args, truths = c.args, c.truths()
    cast = c.store.require("votes").join(truths, "record_id", "left_semi")
    if cast.isEmpty():
        raise CommandError("no vote has a gold label")
    if args.aggregation != decide.RULE:
        raise CommandError(f"an ablation knows the rule {decide.RULE} only")
    vendors = sorted(r[0] for r in cast.select("vendor").distinct().collect())
    main, deltas = ablation.sweep(cast, truths, args.tau, vendors, args.zero_policy, args.max_subsets_per_x, args.seed)
    out: dict[str, list] = {}
    for r in rows_of(deltas.orderBy("subset", "removed")):
        out.setdefault(r.pop("subset"), []).append(r)
    results = [r | {"vendors": r["subset"].split("+"), "leave_one_out": {d["removed"]: {k: v for k, v in d.items() if k != "removed"} for d in out[r["subset"]]}, "tau_report": decide.describe_tau(args.tau, r["x"]).to_dict()} for r in rows_of(main.orderBy("x", "subset"))]
    shown({"candidate_vendors": vendors, "results": [{k: v for k, v in r.items() if k != "subset"} for r in results]}, args.out, c.spark)
    return 0


def protocol(c: Context) -> int:
    a = c.args
    own = pv.Protocol(
        pv.AuditDesign(a.stratify_by, a.audit_size_policy, a.confidence_level),
        pv.AdjudicationRules(a.adjudication_protocol_version, a.adjudication_description),
        pv.DriftPolicy(a.hard_trigger_crossings, a.advisory_alpha_threshold, a.sentinel_cadence_note),
        pv.Reporting(report.SCHEMA_VERSION, a.reporting_notes),
    )
    shown({"protocol_id": c.store.write_protocol(own)} | own.to_dict())
    return 0


def _seeds(values: Sequence[str]) -> dict[str, int]:
    out = {}
    for value in values:
        name, mark, number = value.partition("=")
        if not mark or not number.lstrip("-").isdigit():
            raise CommandError(f"--seed takes NAME=NUMBER, not {value!r}")
        out[name] = int(number)
    return out


def manifest(c: Context) -> int:
    plan = c.store.read_json("protocol")
    hashed = pv.hashlib.sha256(read_bytes(c.spark, c.args.input)).hexdigest() if c.args.input else None
    shown(c.store.write_manifest(protocol=plan and plan["protocol_id"], input_hash=hashed, input_source=c.args.input, seeds=_seeds(c.args.seed or ())))
    return 0


def verify(c: Context) -> int:
    problems = rows_of(c.store.verify().orderBy("artifact"))
    shown({"ok": not problems, "problems": problems})
    return 1 if problems else 0


def _reference_votes(c: Context, config: ingest.EnsembleConfig) -> tuple[str, DataFrame]:
    records = c.records(c.args.sentinel_input)
    set_id = drift.set_id({"id": r["record_id"], "title": r["title"], "abstract": r["abstract"], "track": r["track"]} for r in records.collect())
    plain = ingest.EnsembleConfig(config.vendors, config.aggregation, config.tau)  # reference sets are rated without prompts
    return set_id, ensemble.run_ensemble(records, c.raters(config), plain).select("vendor", "record_id", "rating")


def sentinel_init(c: Context) -> int:
    config, epoch = c.store.read_config(), c.store.read_epoch()
    set_id, cast = _reference_votes(c, config)
    old = c.store.read_json("sentinel_baseline")
    if old is not None and old["sentinel_set_id"] != set_id:
        raise CommandError(f"the baseline belongs to the set {old['sentinel_set_id']}")
    votes: dict[str, dict[str, int]] = {v: {} for v in config.vendors}
    for r in cast.collect():  # a reference set is small
        votes[r["vendor"]][r["record_id"]] = r["rating"]
    c.store.write_json("sentinel_baseline", {"sentinel_set_id": set_id, "ensemble_config_id": pv.config_id(config), "epoch": epoch.id, "captured_at": pv.now(), "votes": votes})
    shown({"sentinel_set_id": set_id, "vendors": sorted(votes), "epoch": epoch.id})
    return 0


def sentinel_check(c: Context) -> int:
    config, base = c.store.read_config(), c.store.require_json("sentinel_baseline")
    set_id, current = _reference_votes(c, config)
    if set_id != base["sentinel_set_id"]:
        raise CommandError(f"the input is the set {set_id}, the baseline's is {base['sentinel_set_id']}")
    was = c.spark.createDataFrame([(v, r, x) for v, own in base["votes"].items() for r, x in own.items()], "vendor string, record_id string, rating int")
    plan = c.store.read_protocol()
    policy = plan.sentinel_policy if plan is not None else pv.DriftPolicy()
    hard = c.args.hard_trigger_crossings if c.args.hard_trigger_crossings is not None else policy.hard_trigger_crossings
    soft = c.args.advisory_alpha_threshold if c.args.advisory_alpha_threshold is not None else policy.advisory_alpha_threshold
    own = pv.config_id(config)
    evaluated = drift.checked(drift.evaluate(was, current, hard, soft)).withColumns({"sentinel_set_id": F.lit(set_id), "evaluated_at": F.lit(pv.now())})
    c.store.write("drift_evaluations", evaluated, own)
    every = rows_of(evaluated.orderBy("vendor"))
    result: dict[str, Any] = {"sentinel_set_id": set_id, "vendors": every, "triggered": any(r["hard_trigger"] for r in every)}
    if result["triggered"]:
        epoch, event = drift.epoch_for_trigger(pv.config_payload(config), evaluated)
        c.store.append_change(event)
        result["new_epoch"] = asdict(epoch)
        result["action_required"] = "go on with this configuration in a new run folder, under the new epoch"
    shown(result)
    return 0


def active_learning_select(c: Context) -> int:
    config = c.store.read_config()
    threshold = c.args.confidence_threshold if c.args.confidence_threshold is not None else config.confidence_threshold
    decisions = decide.decide(c.store.require("votes"), config.tau, config.zero_policy, config.aggregation)
    found = review.select_for_review(decisions, _confidences(c), c.args.dispersion_threshold, not c.args.no_boundary, threshold, c.args.limit)
    c.store.write("active_learning_selections", found, pv.config_id(config))
    shown({"selected": rows_of(found.select("record_id", "dispersion", "boundary", "selection_reason"))})
    return 0


def active_learning_review(c: Context) -> int:
    chosen = c.store.read("active_learning_selections")
    one = chosen.where(F.col("record_id") == c.args.record_id) if chosen is not None else None
    if one is None or one.isEmpty():
        raise CommandError(f"{c.args.record_id} was not selected")
    c.store.write("active_learning_reviews", review.review(one, c.args.reviewer, c.args.protocol_id, c.args.notes), pv.config_id(c.store.read_config()))
    shown({"record_id": c.args.record_id, "reviewer": c.args.reviewer})
    return 0


class _Option:
    """One option, for several commands."""

    def __init__(self, name: str, **how: Any):
        self.name, self.how = name, how


_INPUT, _FLAG = _Option("--input", required=True), {"action": "store_true"}
_RATING = [_Option("--deterministic-seed", type=int), _Option("--request-logprobs", **_FLAG), _Option("--track", default="default")]
_LABELS = [_Option("--labels", required=True), _Option("--reviewer"), _Option("--blinded", action=argparse.BooleanOptionalAction)]
_DRAW = [_INPUT, _Option("--size", type=int), _Option("--seed", type=int), _Option("--stratify-by-track", **_FLAG)]
_SET = [_Option("--sentinel-input", required=True), _Option("--deterministic-seed", type=int)]

COMMANDS: dict[str, tuple[Callable[[Context], int], list[_Option]]] = {
    "screen": (screen, [_INPUT, _Option("--config", required=True), *_RATING, _Option("--mode", choices=("sync", "batch"), default="sync"), _Option("--wait", **_FLAG), _Option("--previous-run-dir"), _Option("--change-reason"), _Option("--approver")]),
    "batch-fetch": (batch_fetch, [_INPUT, *_RATING, _Option("--poll-interval", type=float, default=1.0), _Option("--max-poll-interval", type=float, default=30.0)]),
    "adjudicate": (adjudicate, [_Option("--record-id"), _Option("--label", type=int, choices=(-1, 0, 1)), _Option("--reviewer"), _Option("--protocol-id")]),
    "audit-draw": (audit_draw, [*_DRAW, _Option("--stratify-by-confidence", **_FLAG)]),
    "audit-apply": (audit_apply, _LABELS),
    "inclusion-audit-draw": (inclusion_audit_draw, [*_DRAW, _Option("--stratify-by-status", **_FLAG)]),
    "inclusion-audit-apply": (inclusion_audit_apply, _LABELS),
    "validate": (validate, [_INPUT, _Option("--confidence", type=float, default=0.95), _Option("--human-labels"), _Option("--allow-unresolved-escalations", **_FLAG), _Option("--max-staleness-days", type=float), _Option("--fail-on-stale-sentinel", **_FLAG), _Option("--out")]),
    "ablate": (ablate, [_INPUT, _Option("--aggregation", default=decide.RULE), _Option("--tau", type=float, default=0.0), _Option("--zero-policy", choices=("escalate", "include"), default="escalate"), _Option("--max-subsets-per-x", type=int, default=ablation.SUBSETS_PER_SIZE), _Option("--seed", type=int), _Option("--out")]),
    "protocol": (protocol, [_Option("--stratify-by", choices=pv.AUDIT_KINDS, default="none"), _Option("--audit-size-policy", default=""), _Option("--confidence-level", type=float, default=0.95), _Option("--adjudication-protocol-version", default="1"), _Option("--adjudication-description", default=""), _Option("--hard-trigger-crossings", type=int, default=drift.HARD_CROSSINGS), _Option("--advisory-alpha-threshold", type=float, default=drift.ADVISORY_ALPHA), _Option("--sentinel-cadence-note", default=""), _Option("--reporting-notes", default="")]),
    "manifest": (manifest, [_Option("--input"), _Option("--seed", action="append")]),
    "verify": (verify, []),
    "sentinel-init": (sentinel_init, _SET),
    "sentinel-check": (sentinel_check, [*_SET, _Option("--hard-trigger-crossings", type=int), _Option("--advisory-alpha-threshold", type=float)]),
    "active-learning-select": (active_learning_select, [_Option("--dispersion-threshold", type=float, default=0.0), _Option("--no-boundary", **_FLAG), _Option("--confidence-threshold", type=float), _Option("--limit", type=int)]),
    "active-learning-review": (active_learning_review, [_Option("--record-id", required=True), _Option("--reviewer", required=True), _Option("--protocol-id"), _Option("--notes")]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="evscreen", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        own = commands.add_parser(name)
        own.add_argument("--run-dir", required=True)
        for o in options:
            own.add_argument(o.name, **o.how)
    return out


def main(argv: Sequence[str] | None = None, factories: Services | None = None, spark: SparkSession | None = None, batch_factories: BatchServices | None = None) -> int:
    """The exit code: 0, 1 for problems that verify finds, 2 for refusals."""
    args = parser().parse_args(argv)
    try:
        return COMMANDS[args.command][0](Context(spark or SparkSession.builder.getOrCreate(), args, factories, batch_factories))
    except (ScreeningError, BatchJobError, CommandError, NotImplementedError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
