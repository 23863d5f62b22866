"""Input documents, labels and configurations; their contract; and the synthetic tables as records."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evscreen.errors import InputError
from evscreen.functions.text import strip

RAW = "schema_version string, project string, records array<struct<id:string,title:string,abstract:string,track:string,ids:array<struct<kind:string,value:string>>,gold_label:int>>"
RATING_DOMAIN = (-1, 0, 1)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An input document as rows (seq, id, title, abstract, track, ids, gold_label), in order, not yet normalised."""
    whole = spark.read.schema(RAW).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = whole.select("schema_version", F.col("records").isNull().alias("none")).first()
    if head is None or head["none"]:
        raise InputError("the document needs a list of records")
    if (head["schema_version"] or "").split(".")[0] != "1":
        raise InputError(f"schema version {head['schema_version']!r} is not supported")
    return whole.select(F.posexplode("records").alias("seq", "r")).select("seq", "r.*")


def normalise(records: DataFrame) -> DataFrame:
    """Ids stripped; external ids stripped and in lower case; missing ones an empty list; the track a string."""
    known = F.coalesce(F.col("ids"), F.array().cast("array<struct<kind:string,value:string>>"))
    clean = F.transform(known, lambda x: F.struct(F.lower(strip(x["kind"])).alias("kind"), F.lower(strip(x["value"])).alias("value")))
    return records.withColumns({"id": strip(F.col("id")), "track": F.col("track").cast("string"), "ids": clean})


def violations(records: DataFrame) -> DataFrame:
    """(seq, id, rule): every broken rule of normalised records."""
    rules: list[tuple[str, Column]] = [
        ("id is empty", F.coalesce(F.col("id"), F.lit("")) == ""),
        ("title is missing", F.col("title").isNull()),
        ("abstract is missing", F.col("abstract").isNull()),
        ("track is empty", strip(F.coalesce(F.col("track"), F.lit(""))) == ""),
        ("gold label is outside -1, 0 and 1", F.col("gold_label").isNotNull() & ~F.col("gold_label").isin(*RATING_DOMAIN)),
        ("external id is incomplete", F.exists("ids", lambda x: x["kind"].isNull() | x["value"].isNull())),
    ]
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    single = records.select("seq", "id", F.explode(broken).alias("rule"))
    repeated = records.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n > 1")
    return single.union(repeated.select("seq", "id", F.lit("id is repeated")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Valid normalised records of an input document; InputError with the first broken rules else."""
    records = normalise(read_json(spark, path))
    broken = violations(records).limit(5).collect()
    if broken:
        raise InputError("; ".join(f"record {r['seq']} ({r['id']}): {r['rule']}" for r in broken))
    return records


def gold(records: DataFrame) -> DataFrame:
    return records.where("gold_label is not null")


def labels_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, human_label) from a JSON object of ids and labels."""
    from evscreen.sources.files import read_text

    payload = json.loads(read_text(spark, path))
    if not isinstance(payload, dict) or any(isinstance(v, bool) or v not in RATING_DOMAIN for v in payload.values()):
        raise InputError("labels must be an object of ids and ratings -1, 0 or 1")
    return spark.createDataFrame([(k, int(v)) for k, v in payload.items()], "record_id string, human_label int")


@dataclass(frozen=True)
class RaterSpec:
    model: str
    model_version: str
    prompt_version: str
    temperature: float


@dataclass(frozen=True)
class EnsembleConfig:
    """Raters in order, the decision rule and the prompts."""

    vendors: dict[str, RaterSpec]
    aggregation: str
    tau: float
    batch_size: int = 1
    default_prompt: str | None = None
    track_prompts: dict[str, str] = field(default_factory=dict)
    zero_policy: str = "escalate"
    confidence_threshold: float = 0.5

    def __post_init__(self) -> None:
        if not self.vendors:
            raise InputError("at least one rater is needed")
        if self.batch_size < 1:
            raise InputError("batch_size must be at least 1")
        if self.zero_policy not in ("escalate", "include"):
            raise InputError(f"unknown zero_policy {self.zero_policy!r}")
        if not 0 <= self.confidence_threshold <= 1:
            raise InputError("confidence_threshold must lie in [0, 1]")
        if not math.isfinite(self.tau):
            raise InputError("tau must be finite")

    @property
    def x(self) -> int:
        return len(self.vendors)

    @classmethod
    def from_dict(cls, payload: dict[str, Any]) -> EnsembleConfig:
        try:
            vendors = {k: RaterSpec(v["model"], v["model_version"], v["prompt_version"], float(v["temperature"])) for k, v in payload["vendors"].items()}
            return cls(vendors, payload["aggregation"], float(payload["tau"]), int(payload.get("batch_size", 1)), payload.get("default_prompt"), dict(payload.get("track_prompts") or {}), payload.get("zero_policy", "escalate"), float(payload.get("confidence_threshold", 0.5)))
        except (KeyError, TypeError, AttributeError) as error:
            raise InputError(f"incomplete configuration: {error!r}") from error


def load_config(spark: SparkSession, path: str) -> EnsembleConfig:
    from evscreen.sources.files import read_text

    return EnsembleConfig.from_dict(json.loads(read_text(spark, path)))


def prompt_for(track: Column, config: EnsembleConfig) -> Column:
    """The prompt of a track, else the default, else null."""
    out = F.lit(config.default_prompt).cast("string")
    for name, text in config.track_prompts.items():
        out = F.when(track == name, F.lit(text)).otherwise(out)
    return out


def documents_as_records(documents: DataFrame) -> DataFrame:
    """The documents table as records; the track is the language."""
    return documents.select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("track"))


def labels_as_gold(labels: DataFrame) -> DataFrame:
    """The labels table as gold labels: low quality excludes, toxic is uncertain, the rest includes."""
    label = F.when(F.col("quality") == 0, -1).when(F.col("toxic") == 1, 0).otherwise(1)
    return labels.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"), label.alias("truth"))
