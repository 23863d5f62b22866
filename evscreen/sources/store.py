"""A run's artifacts: Parquet tables that are stamped with their configuration, and small JSON files.

Tables are upserted: the last write of a key counts. Every write makes a new
version of a table beside the old one and then names it in a small pointer
file, so readers never meet half a table and a lost executor costs nothing but
its tasks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evscreen.errors import StoreError
from evscreen.operators import provenance as pv
from evscreen.sources import files
from evscreen.sources.ingest import EnsembleConfig

#: Keys of the tables that are upserted; the stamped ones refuse rows of another configuration.
TABLES: dict[str, tuple[str, ...]] = {
    "votes": ("record_id", "vendor"),
    "raw_responses": ("record_id", "vendor"),
    "decisions": ("record_id",),
    "audit": ("record_id",),
    "inclusion_audit": ("record_id",),
    "audit_draw": ("record_id",),
    "inclusion_audit_draw": ("record_id",),
    "audit_labels": ("record_id",),
    "adjudication_records": ("record_id",),
    "active_learning_selections": ("record_id",),
}
#: Tables that only grow.
LOGS = ("active_learning_reviews", "drift_evaluations")


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key by order."""
    own = rows.withColumn("latest_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    return own.where("latest_rank = 1").drop("latest_rank")


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # JSON artifacts

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}.json"

    def write_json(self, name: str, payload: Any) -> None:
        files.write_text(self.spark, self._at(name), json.dumps(payload, indent=2, sort_keys=True))

    def read_json(self, name: str, default: Any = None) -> Any:
        return json.loads(files.read_text(self.spark, self._at(name))) if files.exists(self.spark, self._at(name)) else default

    def require_json(self, name: str) -> Any:
        found = self.read_json(name)
        if found is None:
            raise StoreError(f"the run has no {name}")
        return found

    def lock(self, name: str, payload: Any, key: str) -> None:
        """Write once; the same key may be written again, another is refused."""
        old = self.read_json(name)
        if old is not None and old[key] != payload[key]:
            raise StoreError(f"{name} is locked to {old[key]}")
        self.write_json(name, payload)

    def write_config(self, config: EnsembleConfig) -> str:
        own = pv.config_id(config)
        body = {"vendors": {k: asdict(v) for k, v in config.vendors.items()}, "vendor_order": list(config.vendors), "aggregation": config.aggregation, "tau": config.tau, "batch_size": config.batch_size, "default_prompt": config.default_prompt, "track_prompts": config.track_prompts, "zero_policy": config.zero_policy, "confidence_threshold": config.confidence_threshold}
        self.lock("config", body | {"ensemble_config_id": own}, "ensemble_config_id")
        return own

    def read_config(self) -> EnsembleConfig:
        body = self.require_json("config")
        return EnsembleConfig.from_dict(body | {"vendors": {k: body["vendors"][k] for k in body["vendor_order"]}})

    def write_epoch(self, epoch: pv.Epoch) -> None:
        self.lock("epoch", asdict(epoch), "id")

    def read_epoch(self) -> pv.Epoch:
        return pv.Epoch(**self.require_json("epoch"))

    def write_changelog(self, log: pv.ChangeLog) -> None:
        if not log.extends(self.read_changelog()):
            raise StoreError("the change log may only be extended")
        self.write_json("changelog", [asdict(e) for e in log.events])

    def read_changelog(self) -> pv.ChangeLog:
        return pv.ChangeLog([pv.ConfigChange(**(e | {"changed_fields": tuple(e["changed_fields"])})) for e in self.read_json("changelog", [])])

    def append_change(self, event: pv.ConfigChange) -> None:
        log = self.read_changelog()
        log.record(event)
        self.write_changelog(log)

    def write_run(self, run: pv.RunRecord) -> None:
        rows = {r["id"]: r for r in self.read_json("runs", [])} | {run.id: asdict(run)}
        self.write_json("runs", [rows[k] for k in sorted(rows)])

    def read_runs(self) -> list[pv.RunRecord]:
        return [pv.RunRecord(**r) for r in self.read_json("runs", [])]

    def write_job(self, vendor: str, payload: dict) -> None:
        self.write_json("batch_handles", self.read_json("batch_handles", {}) | {vendor: payload})

    def read_jobs(self) -> dict[str, dict]:
        return self.read_json("batch_handles", {})

    def write_protocol(self, protocol: pv.Protocol) -> str:
        own = pv.protocol_id(protocol)
        self.write_json("protocol", protocol.to_dict() | {"protocol_id": own})
        return own

    def read_protocol(self) -> pv.Protocol | None:
        found = self.read_json("protocol")
        return pv.Protocol.from_dict(found) if found else None

    # tables

    def _pointer(self, name: str) -> dict | None:
        return self.read_json(f"{name}.table")

    def read(self, name: str) -> DataFrame | None:
        at = self._pointer(name)
        return self.spark.read.parquet(f"{self.root}/{at['version']}") if at else None

    def require(self, name: str) -> DataFrame:
        found = self.read(name)
        if found is None:
            raise StoreError(f"the run has no {name}")
        return found

    def write(self, name: str, rows: DataFrame, ensemble_config_id: str) -> None:
        """Upsert rows under the run's configuration; those of another are refused. Labels that audit rows have are kept."""
        at = self._pointer(name)
        if at and at["ensemble_config_id"] != ensemble_config_id:
            raise StoreError(f"{name} belongs to configuration {at['ensemble_config_id']}")
        if name in ("audit", "inclusion_audit") and at:
            labelled = self.read(name).where("human_label is not null")
            fresh = rows.where("human_label is null") if "human_label" in rows.columns else rows
            if not labelled.join(fresh, "record_id", "left_semi").isEmpty():
                raise StoreError("a labelled audit row can't be drawn again")
        own = rows.withColumn("write_no", F.lit((at or {"writes": 0})["writes"]))
        old = self.read(name)
        every = own if old is None else old.unionByName(own, allowMissingColumns=True)
        version = f"{name}-{uuid.uuid4().hex}"
        (latest(every, TABLES[name], "write_no") if name in TABLES else every).write.parquet(f"{self.root}/{version}")
        self.write_json(f"{name}.table", {"version": version, "ensemble_config_id": ensemble_config_id, "writes": (at or {"writes": 0})["writes"] + 1})

    def write_draw(self, name: str, rows: DataFrame, ensemble_config_id: str, frame_hash: str) -> None:
        """A snapshot of a draw before labels; within an epoch its frame can't change."""
        frame = self.read_json(f"{name}.frame")
        if frame and frame["frame_hash"] != frame_hash:
            raise StoreError("the population changed since the first draw of this epoch")
        self.write(name, rows, ensemble_config_id)
        self.write_json(f"{name}.frame", {"frame_hash": frame_hash})

    def hashes(self) -> DataFrame:
        """(artifact, sha256) of the run's JSON files and, as name.parquet, of the tables that its pointers name."""
        out = files.file_hashes(self.spark, self.root).where("artifact like '%.json' and artifact <> 'manifest.json'")
        for name in (*TABLES, *LOGS):
            at = self._pointer(name)
            if at and files.exists(self.spark, f"{self.root}/{at['version']}"):
                out = out.union(files.tree_hash(self.spark, f"{self.root}/{at['version']}").select(F.lit(f"{name}.parquet").alias("artifact"), "sha256"))
        return out

    def write_manifest(self, **options: Any) -> dict[str, Any]:
        manifest = pv.build_manifest(self.hashes(), self.require_json("config")["ensemble_config_id"], **options)
        self.write_json("manifest", manifest)
        return manifest

    def verify(self) -> DataFrame:
        return pv.verify(pv.manifest_frame(self.spark, self.require_json("manifest")), self.hashes())
