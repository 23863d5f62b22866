"""Content-hashed configurations and protocols, epochs, change logs, run records and manifests."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evscreen import __version__
from evscreen.errors import ProvenanceError
from evscreen.operators.ensemble import CONTRACT_VERSION, PACKED_CONTRACT_VERSION
from evscreen.sources.ingest import EnsembleConfig

INITIAL, EXPLICIT, DRIFT = CHANGE_TYPES = ("initial_config", "explicit_config_change", "sentinel_drift")
AUDIT_KINDS = ("none", "track", "confidence")


def canonical_json(payload: Any) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def canonical_hash(payload: Any) -> str:
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()


def config_payload(config: EnsembleConfig) -> dict[str, Any]:
    """What identifies a configuration. The confidence threshold doesn't; fields at their defaults don't either."""
    out = {"vendors": {k: asdict(v) for k, v in config.vendors.items()}, "aggregation": config.aggregation, "tau": config.tau, "batch_size": config.batch_size, "x": config.x, "output_contract_version": CONTRACT_VERSION}
    optional = {"default_prompt": (config.default_prompt, config.default_prompt is not None), "track_prompts": (dict(config.track_prompts), bool(config.track_prompts)), "batch_output_contract_version": (PACKED_CONTRACT_VERSION, config.batch_size > 1), "zero_policy": (config.zero_policy, config.zero_policy != "escalate")}
    return out | {k: v for k, (v, given) in optional.items() if given}


def config_id(config: EnsembleConfig) -> str:
    return canonical_hash(config_payload(config))


def now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass(frozen=True)
class Epoch:
    id: str
    ensemble_config_id: str
    opened_at: str


def open_epoch(ensemble_config_id: str, opened_at: str | None = None) -> Epoch:
    return Epoch(str(uuid.uuid4()), ensemble_config_id, opened_at or now())


def maybe_open_epoch(current: Epoch | None, ensemble_config_id: str, opened_at: str | None = None) -> Epoch:
    """The current epoch while the configuration stays; else a new one."""
    return current if current is not None and current.ensemble_config_id == ensemble_config_id else open_epoch(ensemble_config_id, opened_at)


@dataclass(frozen=True)
class ConfigChange:
    timestamp: str
    before: str | None
    after: str
    reason: str
    change_type: str
    changed_fields: tuple[str, ...] = ()
    approver: str | None = None

    def __post_init__(self) -> None:
        if not self.reason.strip():
            raise ProvenanceError("a change needs a reason")
        if self.change_type not in CHANGE_TYPES:
            raise ProvenanceError(f"unknown change type {self.change_type!r}")
        if self.before == self.after and self.change_type != DRIFT:
            raise ProvenanceError("nothing changed")


@dataclass
class ChangeLog:
    """Changes in order; only ever extended."""

    events: list[ConfigChange] = field(default_factory=list)

    def record(self, event: ConfigChange) -> None:
        if self.events and datetime.fromisoformat(event.timestamp) < datetime.fromisoformat(self.events[-1].timestamp):
            raise ProvenanceError("changes must be logged in order")
        self.events.append(event)

    def previous(self, config: str) -> str | None:
        return next((e.before for e in reversed(self.events) if e.after == config and e.before != config), None)

    def history(self, config: str) -> list[ConfigChange]:
        """The changes that led to a configuration, the oldest first."""
        out: list[ConfigChange] = []
        for e in reversed(self.events):
            if e.after == config:
                out.append(e)
                config = e.before
                if config is None:
                    break
        return out[::-1]

    def extends(self, older: ChangeLog) -> bool:
        return self.events[: len(older.events)] == older.events


def flatten(payload: dict[str, Any], prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in payload.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": canonical_json(v)}
    return out


def changed_fields(before: dict[str, Any], after: dict[str, Any]) -> list[str]:
    a, b = flatten(before), flatten(after)
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def field_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(field, before, after) where flattened (field, value) tables differ."""
    x, y = before.select("field", F.col("value").alias("before")), after.select("field", F.col("value").alias("after"))
    return x.join(y, "field", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def lineage(events: DataFrame, config: str, order: str = "seq") -> DataFrame:
    """(depth, before, after) from a configuration back to the first, over a table of changes of any length.

    Each step takes the latest change before the last one that led to the
    configuration in question, so a change counts once at most and reverts
    don't go round. A log has one order, which makes the walk one pass over it,
    the latest change first: rows stream through a task that holds none.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, depth = config, 0
        for batch in batches:
            out = []
            for before, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if want is not None and after == want:
                    out.append((depth, before, after))
                    want, depth = before, depth + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))], ["depth", "before", "after"])

    back = events.select(F.col("before").cast("string"), F.col("after").cast("string"), F.col(order).alias("seq")).repartition(1).sortWithinPartitions(F.desc("seq"))
    return back.select("before", "after").mapInArrow(walk, "depth int, before string, after string")


@dataclass(frozen=True)
class AuditDesign:
    stratify_by: str = "none"
    audit_size_policy: str = ""
    confidence_level: float = 0.95

    def __post_init__(self) -> None:
        if self.stratify_by not in AUDIT_KINDS or not 0 < self.confidence_level < 1:
            raise ProvenanceError("an audit needs a known stratification and a confidence within (0, 1)")


@dataclass(frozen=True)
class AdjudicationRules:
    protocol_version: str = "1"
    description: str = ""


@dataclass(frozen=True)
class DriftPolicy:
    hard_trigger_crossings: int = 2
    advisory_alpha_threshold: float = 0.80
    cadence_note: str = ""

    def __post_init__(self) -> None:
        if self.hard_trigger_crossings < 1 or not 0 <= self.advisory_alpha_threshold <= 1:
            raise ProvenanceError("drift thresholds are out of range")


@dataclass(frozen=True)
class Reporting:
    validation_record_schema_version: str = ""
    notes: str = ""


@dataclass(frozen=True)
class Protocol:
    """The plan of an analysis; it identifies itself and never enters a configuration's id."""

    audit_design: AuditDesign = AuditDesign()
    adjudication_protocol: AdjudicationRules = AdjudicationRules()
    sentinel_policy: DriftPolicy = DriftPolicy()
    reporting_spec: Reporting = Reporting()

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, payload: dict[str, Any]) -> Protocol:
        """Parts and fields that are missing have their defaults; others are ignored."""
        parts = {f.name: type(f.default) for f in fields(cls)}
        own = {k: {n.name: payload[k][n.name] for n in fields(kind) if n.name in payload[k]} for k, kind in parts.items() if k in payload}
        return cls(**{k: parts[k](**v) for k, v in own.items()})


def protocol_id(protocol: Protocol) -> str:
    return canonical_hash(protocol.to_dict())


@dataclass(frozen=True)
class RunRecord:
    id: str
    type: str
    track: str | None
    epoch_id: str
    started_at: str
    ended_at: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    status: str = "running"

    def finish(self, status: str = "completed", counts: dict[str, int] | None = None) -> RunRecord:
        return RunRecord(self.id, self.type, self.track, self.epoch_id, self.started_at, now(), counts or self.counts, status)


def start_run(kind: str, epoch_id: str, track: str | None = None) -> RunRecord:
    return RunRecord(str(uuid.uuid4()), kind, track, epoch_id, now())


def software_version() -> str:
    commit = os.environ.get("EVSCREEN_COMMIT")
    return f"{__version__}+{commit}" if commit else __version__


def library_versions(names: tuple[str, ...] = ("pyspark", "pyarrow", "pandas")) -> dict[str, str]:
    out = {}
    for name in names:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            continue
    return out


def build_manifest(hashes: DataFrame, ensemble_config_id: str, protocol: str | None = None, input_hash: str | None = None, input_source: str | None = None, seeds: dict[str, int] | None = None, created_at: str | None = None) -> dict[str, Any]:
    """A manifest over (artifact, sha256), identified by the hash of all it says. Artifacts of a run are a few dozen."""
    own = {"created_at": created_at or now(), "software_version": software_version(), "ensemble_config_id": ensemble_config_id, "protocol_id": protocol, "input_hash": input_hash, "input_source": input_source, "seeds": dict(seeds or {}), "artifact_hashes": {r[0]: r[1] for r in hashes.collect()}, "sdk_versions": library_versions()}
    return {"id": canonical_hash(own)} | own


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(artifact, problem): artifacts that are missing or hash differently."""
    have = actual.select("artifact", F.col("sha256").alias("found"))
    out = expected.join(have, "artifact", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "hash_mismatch")
    return out.select("artifact", problem.alias("problem")).where("problem is not null")


def manifest_frame(spark: SparkSession, manifest: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(list(manifest["artifact_hashes"].items()), "artifact string, sha256 string")
