"""Raters and ensembles: records crossed with raters, packed requests and batch jobs.

Live services aren't called here: a rater is anything that turns requests into
replies. SeededRater is the offline one; it is a Column expression. Services
are plugged in as functions on batches of pandas rows (ServiceRater).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evscreen.errors import BatchJobError, InputError, ModelDriftError
from evscreen.functions.text import parse_batch_replies, parse_batch_reply, parse_reply
from evscreen.operators import codecs
from evscreen.sources.ingest import EnsembleConfig, RaterSpec, prompt_for

TASK = "You screen scientific records for a review. Judge the record by its title and abstract."
CONTRACT = "Reply with a single letter and nothing else: E to exclude, U if uncertain, I to include."
PACKED_CONTRACT = "Reply with one JSON object that maps each record's id to E (exclude), U (uncertain) or I (include)."
CONTRACT_VERSION = PACKED_CONTRACT_VERSION = "1"


def system_prompt(criteria: Column, packed: bool = False) -> Column:
    """Criteria, or the general task, with the output contract."""
    return F.concat(F.coalesce(criteria, F.lit(TASK)), F.lit("\n\n" + (PACKED_CONTRACT if packed else CONTRACT)))


def user_message(record_id: Column, title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Record "), record_id, F.lit(":\nTitle: "), title, F.lit("\nAbstract: "), abstract)


def numbered(records: DataFrame, group: str, order: str, tie: str) -> DataFrame:
    """records with place: their place from 0 in their group by (order, tie).

    order is a number. It is cut at quantiles into ranges; places within a
    range of a group are counted in parallel, and the ranges' sizes, a row for
    each range and group, are added up.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = records.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    cuts = F.array(*map(F.lit, sorted(set(cuts or [0]))))
    own = records.withColumn("place_range", F.size(F.filter(cuts, lambda c: c < F.col(order))))
    sizes = own.groupBy(group, "place_range").agg(F.count("*").alias("place_size"))
    before = Window.partitionBy(group).orderBy("place_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "place_range", F.coalesce(F.sum("place_size").over(before), F.lit(0)).alias("place_start"))
    within = F.row_number().over(Window.partitionBy(group, "place_range").orderBy(order, tie)) - 1
    return own.withColumn("place", within).join(starts, [group, "place_range"]).withColumn("place", F.col("place") + F.col("place_start")).drop("place_range", "place_start")


def pack(records: DataFrame, size: int, group: Column | None = None, order: str = "seq") -> DataFrame:
    """records with chunk, position and peers: runs of up to size records of one group (prompt), by order.

    peers are the sorted ids of the chunk's other records.
    """
    if size < 1:
        raise InputError("chunks need at least one record")
    keyed = records.withColumn("chunk_group", F.coalesce((group if group is not None else F.lit("")).cast("string"), F.lit("")))
    placed = numbered(keyed, "chunk_group", order, "record_id")
    out = placed.withColumn("position", (F.col("place") % size).cast("int")).withColumn("chunk", F.floor(F.col("place") / size).cast("long")).drop("place")
    own = Window.partitionBy("chunk_group", "chunk")
    return out.withColumn("peers", F.array_sort(F.array_remove(F.collect_list("record_id").over(own), F.col("record_id"))))


def digest(seed: Column | int, vendor: Column, model: Column, record_id: Column, prompt: Column | None = None, peers: Column | None = None) -> Column:
    """The hash that a seeded rater draws from; prompt and peers count only where they are given and not empty."""
    base = F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), vendor, model, record_id)
    if prompt is not None:
        base = F.when(prompt.isNull(), base).otherwise(F.concat_ws(":", base, system_prompt(prompt)))
    if peers is not None:
        base = F.when(F.size(peers) == 0, base).otherwise(F.concat_ws(":", base, F.array_join(peers, ",")))
    return F.sha2(base, 256)


def digest_byte(value: Column, i: int) -> Column:
    return F.conv(F.substring(value, 2 * i + 1, 2), 16, 10).cast("int")


def seeded_rating(value: Column) -> Column:
    return (digest_byte(value, 0) % 3 - 1).cast("int")


def seeded_logprob(value: Column) -> Column:
    return -(digest_byte(value, 1) / F.lit(255.0)) * 3.0


def seeded_reply(vendor: Column, value: Column, logprobs: bool = True) -> Column:
    """A raw reply as JSON, with the log probability of its only token."""
    letter = F.element_at(F.array(F.lit("E"), F.lit("U"), F.lit("I")), seeded_rating(value) + 2)
    content = F.array(F.struct(letter.alias("token"), seeded_logprob(value).alias("logprob")))
    return F.to_json(F.struct(vendor.alias("vendor"), value.alias("digest"), letter.alias("text"), *([F.struct(content.alias("content")).alias("logprobs")] if logprobs else [])))


def raters_frame(spark: SparkSession, config: EnsembleConfig) -> DataFrame:
    """(pos, vendor, model, model_version, prompt_version, temperature): one row per rater of a configuration."""
    rows = [(i, k, v.model, v.model_version, v.prompt_version, v.temperature) for i, (k, v) in enumerate(config.vendors.items())]
    return spark.createDataFrame(rows, "pos int, vendor string, model string, model_version string, prompt_version string, temperature double")


def seeded_votes(records: DataFrame, raters: DataFrame, seed: int, config: EnsembleConfig | None = None, miss: int = 0) -> DataFrame:
    """Votes of seeded raters on all records: (record_id, track, pos, vendor, digest, rating, logprob).

    raters is a row per rater of a configuration and is broadcast. With a
    configuration, prompts and chunk peers enter the digest. miss leaves out
    the votes whose third byte is below it.
    """
    if config is not None and config.batch_size > 1:
        records = pack(records, config.batch_size, prompt_for(F.col("track"), config))
    each = records.crossJoin(F.broadcast(raters))
    prompt = prompt_for(F.col("track"), config) if config is not None and (config.default_prompt is not None or config.track_prompts) else None
    peers = F.col("peers") if config is not None and config.batch_size > 1 else None
    out = each.withColumn("digest", digest(seed, F.col("vendor"), F.col("model"), F.col("record_id"), prompt, peers))
    if miss:
        out = out.where(digest_byte(F.col("digest"), 2) >= miss)
    return out.select("record_id", "track", "pos", "vendor", "digest", seeded_rating(F.col("digest")).alias("rating"), seeded_logprob(F.col("digest")).alias("logprob"))


class Rater(Protocol):
    """Turns requests (record_id, track, title, abstract, prompt, peers) into (record_id, rating, raw)."""

    vendor: str

    def rate(self, requests: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class SeededRater:
    vendor: str
    seed: int
    model: str = "deterministic-v1"
    logprobs: bool = False

    def rate(self, requests: DataFrame) -> DataFrame:
        value = digest(self.seed, F.lit(self.vendor), F.lit(self.model), F.col("record_id"), F.col("prompt"), F.col("peers"))
        return requests.withColumn("digest", value).select("record_id", seeded_rating(F.col("digest")).alias("rating"), seeded_reply(F.lit(self.vendor), F.col("digest"), self.logprobs).alias("raw"))


def chunk_requests(requests: DataFrame) -> DataFrame:
    """(custom_id, system, user, size, members): one row for each chunk of packed requests, and for each record of others.

    A chunk of one record is asked for as a single one. Chunks hold a bounded
    number of records.
    """
    message = user_message(F.col("record_id"), F.col("title"), F.col("abstract"))
    if "chunk" not in requests.columns:
        return requests.select(F.col("record_id").alias("custom_id"), system_prompt(F.col("prompt")).alias("system"), message.alias("user"), F.lit(1).alias("size"), F.array("record_id").alias("members"))
    own = requests.select(custom_id().alias("custom_id"), "prompt", F.struct("position", "record_id", message.alias("message")).alias("m"))
    chunks = own.groupBy("custom_id").agg(F.first("prompt").alias("prompt"), F.array_sort(F.collect_list("m")).alias("m"))
    size = F.size("m")
    system = F.when(size > 1, system_prompt(F.col("prompt"), packed=True)).otherwise(system_prompt(F.col("prompt")))
    return chunks.select("custom_id", system.alias("system"), F.array_join(F.transform("m", lambda x: x["message"]), "\n\n").alias("user"), size.alias("size"), F.transform("m", lambda x: x["record_id"]).alias("members"))


def custom_id() -> Column:
    """Names the chunk of a packed request: its prompt, hashed, and its number."""
    return F.concat(F.lit("item-"), F.substring(F.sha2("chunk_group", 256), 1, 16), F.lit("-"), F.col("chunk").cast("string"))


@dataclass(frozen=True)
class ServiceRater:
    """A rater behind a service. ask gets pandas rows (record_id, system, user) and returns their replies as
    (text, raw JSON, reported model version); it runs on executors, a batch of rows at a time. A packed chunk is one
    row, with its custom id as record_id, and its reply must rate each of its records."""

    vendor: str
    model_version: str
    ask: Callable[[pd.DataFrame], list[tuple[str, str, str | None]]]
    checks_version: bool = True

    def rate(self, requests: DataFrame) -> DataFrame:
        chunks = chunk_requests(requests)
        prepared = chunks.select(F.col("custom_id").alias("record_id"), "system", "user", F.to_json("members").alias("members"))
        ask, vendor, wanted = self.ask, self.vendor, self.model_version if self.checks_version else None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                replies = ask(frame.drop(columns="members"))
                for _, _, reported in replies:
                    check_version(vendor, wanted, reported)
                yield pd.DataFrame({"members": frame["members"], "text": [r[0] for r in replies], "raw": [r[1] for r in replies]})

        replies = prepared.mapInPandas(run, "members string, text string, raw string").withColumn("members", F.from_json("members", "array<string>"))
        each = replies.select(F.explode("members").alias("record_id"), (F.size("members") > 1).alias("packed"), "text", "raw")
        parsed = F.when(F.col("packed"), parse_batch_reply(F.col("text"), F.col("record_id"))).otherwise(parse_reply(F.col("text"))["rating"])
        rating = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"{vendor}: no single rating in the reply for "), F.col("record_id")))).otherwise(parsed)
        return each.select("record_id", rating.cast("int").alias("rating"), "raw")


def check_version(vendor: str, expected: str | None, reported: str | None) -> None:
    """Refuse a model of another version; services that report none can't be checked."""
    if expected is not None and reported is not None and expected != reported:
        raise ModelDriftError(f"{vendor} reports model version {reported}, not {expected}")


#: Services by name: whether log probabilities come with single and with batch replies, whether the model version is
#: checked, the batch states that end a job well and badly.
SERVICES: dict[str, dict[str, Any]] = {
    "anthropic": {"logprobs": (False, False), "versioned": True, "done": {"ended"}, "failed": set()},
    "openai": {"logprobs": (True, True), "versioned": True, "done": {"completed"}, "failed": {"failed", "expired", "cancelled"}},
    "google": {"logprobs": (True, True), "versioned": False, "done": {"JOB_STATE_SUCCEEDED", "BATCH_STATE_SUCCEEDED"}, "failed": {f"{kind}_STATE_{end}" for kind in ("JOB", "BATCH") for end in ("FAILED", "CANCELLED", "EXPIRED")}},
    "mistral": {"logprobs": (True, True), "versioned": True, "done": {"SUCCESS"}, "failed": {"FAILED", "TIMEOUT_EXCEEDED", "CANCELLED"}},
    "fireworks": {"logprobs": (True, False), "versioned": True, "done": {"JOB_STATE_COMPLETED"}, "failed": {"JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED"}},
    "together": {"logprobs": (True, True), "versioned": True, "done": {"COMPLETED"}, "failed": {"FAILED", "EXPIRED", "CANCELLED"}},
    "openmodel": {"logprobs": (False, None), "versioned": True, "done": None, "failed": None},
}


def job_state(vendor: str, reported: str) -> str:
    """pending, completed or failed."""
    service = SERVICES.get(vendor)
    if service is None or service["done"] is None:
        raise InputError(f"{vendor} has no batch service")
    return "completed" if reported in service["done"] else "failed" if reported in service["failed"] else "pending"


Factory = Callable[[str, RaterSpec], Rater]


def build_raters(config: EnsembleConfig, factories: Mapping[str, Factory]) -> list[Rater]:
    """A rater for each name of the configuration; names without a factory are refused."""
    missing = [n for n in config.vendors if n not in factories]
    if missing:
        raise InputError(f"no rater is known for {', '.join(missing)}")
    return [factories[name](name, spec) for name, spec in config.vendors.items()]


def run_ensemble(records: DataFrame, raters: list[Rater], config: EnsembleConfig) -> DataFrame:
    """(record_id, pos, vendor, rating, raw) of every record and rater."""
    requests = records.withColumn("prompt", prompt_for(F.col("track"), config))
    requests = pack(requests, config.batch_size, F.col("prompt")) if config.batch_size > 1 else requests.withColumn("peers", F.array().cast("array<string>"))
    parts = [r.rate(requests).select("record_id", F.lit(i).alias("pos"), F.lit(r.vendor).alias("vendor"), "rating", "raw") for i, r in enumerate(raters)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@dataclass
class Job:
    """A batch job. ids is a table (custom_id, record_id, prompt, peers) of what went out under which custom id."""

    vendor: str
    model: str
    config_id: str
    submitted_at: float
    provider_id: str
    ids: str

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Job:
        return cls(**json.loads(text))


class BatchService(Protocol):
    """A batch service of a vendor."""

    vendor: str
    model: str

    def submit(self, requests: DataFrame, config_id: str) -> Job: ...

    def poll(self, job: Job) -> str: ...

    def fetch(self, job: Job) -> DataFrame: ...


@dataclass
class SeededBatchService:
    """The offline batch twin of SeededRater: equal ratings; fails leaves records out. place: a folder for its jobs."""

    spark: SparkSession
    place: str
    rater: SeededRater
    fails: tuple[str, ...] = ()
    pending_polls: int = 0

    @property
    def vendor(self) -> str:
        return self.rater.vendor

    @property
    def model(self) -> str:
        return self.rater.model

    def submit(self, requests: DataFrame, config_id: str) -> Job:
        return Job(self.vendor, self.model, config_id, time.time(), uuid.uuid4().hex, _write_ids(requests, self.place))

    def poll(self, job: Job) -> str:
        self.pending_polls -= 1
        return "pending" if self.pending_polls >= 0 else "completed"

    def fetch(self, job: Job) -> DataFrame:
        return self.rater.rate(self.spark.read.parquet(job.ids)).where(~F.col("record_id").isin(*self.fails) if self.fails else F.lit(True))


def _write_ids(requests: DataFrame, place: str) -> str:
    path = f"{place}/ids-{uuid.uuid4().hex}"
    requests.select(custom_id().alias("custom_id"), "record_id", "prompt", "peers").write.parquet(path)
    return path


class Transport(Protocol):
    """Carries a batch job's file to a service and back. Rows are (place, line); place numbers them from 0."""

    def submit(self, lines: DataFrame) -> str: ...

    def state(self, provider_id: str) -> str: ...

    def results(self, provider_id: str) -> DataFrame: ...


@dataclass
class ServiceBatch:
    """The batch service of a vendor, over a transport: requests and answers in the vendor's own form."""

    spark: SparkSession
    place: str
    vendor: str
    options: codecs.Options
    model_version: str
    transport: Transport

    @property
    def model(self) -> str:
        return self.options.model

    def lines(self, requests: DataFrame) -> DataFrame:
        """(place, custom_id, line), in a fixed order."""
        chunks = chunk_requests(requests).withColumns({"all": F.lit(""), "spread": F.xxhash64("custom_id")})
        placed = numbered(chunks, "all", "spread", "custom_id")
        return placed.select("place", "custom_id", codecs.line(self.vendor, self.options, F.col("custom_id"), F.col("system"), F.col("user"), F.col("size")).alias("line"))

    def submit(self, requests: DataFrame, config_id: str) -> Job:
        job_state(self.vendor, "")  # refuses vendors without such a service
        ids = _write_ids(requests, self.place)
        self.lines(requests).write.parquet(f"{ids}-lines")
        lines = self.spark.read.parquet(f"{ids}-lines")
        return Job(self.vendor, self.model, config_id, time.time(), self.transport.submit(lines.select("place", "line")), ids)

    def poll(self, job: Job) -> str:
        return job_state(self.vendor, self.transport.state(job.provider_id))

    def fetch(self, job: Job) -> DataFrame:
        own = self.transport.results(job.provider_id).select(codecs.returned(self.vendor, F.col("line"), F.col("place")).alias("r")).select("r.*")
        if self.vendor == "fireworks":
            names = self.spark.read.parquet(f"{job.ids}-lines").select(F.col("place").cast("string").alias("custom_id"), F.col("custom_id").alias("name"))
            own = own.join(names, "custom_id").drop("custom_id").withColumnRenamed("name", "custom_id")
        own = own.where("text is not null")
        raw = F.to_json(F.struct("custom_id", "text", "model", F.from_json("logprobs", "variant").alias("logprobs")))
        other = F.lit(SERVICES[self.vendor]["versioned"]) & (F.col("model") != F.lit(self.model_version))
        text = F.when(other, F.raise_error(F.concat(F.lit(f"{self.vendor} reports model version "), F.col("model"), F.lit(f", not {self.model_version}")))).otherwise(F.col("text"))
        ids = self.spark.read.parquet(job.ids).select("custom_id", "record_id")
        return reassemble(own.select("custom_id", text.alias("reply"), raw.alias("raw")), ids)


BatchFactory = Callable[[str, RaterSpec], BatchService]


def build_batch_raters(config: EnsembleConfig, factories: Mapping[str, BatchFactory]) -> list[BatchService]:
    """A batch service for each name of the configuration; names without a factory, and services without batch jobs, are refused."""
    for name in config.vendors:
        if name in SERVICES and SERVICES[name]["done"] is None:
            raise InputError(f"{name} has no batch service")
    missing = [n for n in config.vendors if n not in factories]
    if missing:
        raise InputError(f"no batch service is known for {', '.join(missing)}")
    return [factories[name](name, spec) for name, spec in config.vendors.items()]


def submit_jobs(records: DataFrame, services: list[BatchService], config: EnsembleConfig, config_id: str, known: dict[str, Job]) -> dict[str, Job]:
    """Jobs by vendor: those known, and new ones for the rest; a job of another configuration is refused."""
    requests = pack(records.withColumn("prompt", prompt_for(F.col("track"), config)), config.batch_size, F.col("prompt"))
    jobs = dict(known)
    for service in services:
        old = jobs.get(service.vendor)
        if old is not None and old.config_id != config_id:
            raise BatchJobError(f"{service.vendor} has a job of another configuration")
        if old is None:
            jobs[service.vendor] = service.submit(requests, config_id)
    return jobs


def fetch_jobs(services: list[BatchService], jobs: dict[str, Job], wait: float = 1.0, factor: float = 2.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Votes (record_id, pos, vendor, rating, raw) once all jobs are done; records that a job failed have no vote of it."""
    open_ = {s.vendor for s in services}
    if open_ - set(jobs):
        raise BatchJobError(f"no job is known for {', '.join(sorted(open_ - set(jobs)))}")
    while True:
        for service in services:
            if service.vendor in open_:
                state = service.poll(jobs[service.vendor])
                if state == "failed":
                    raise BatchJobError(f"the job of {service.vendor} failed")
                if state == "completed":
                    open_.discard(service.vendor)
        if not open_:
            break
        sleep(wait)
        wait = min(wait * factor, longest)
    parts = [s.fetch(jobs[s.vendor]).select("record_id", F.lit(i).alias("pos"), F.lit(s.vendor).alias("vendor"), "rating", "raw") for i, s in enumerate(services)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def reassemble(results: DataFrame, ids: DataFrame, of: Sequence[str] = ()) -> DataFrame:
    """(record_id, rating), and raw if results have it, from job results (custom_id, reply) and the map (custom_id, record_id).

    of: columns of results that tell several jobs over the same ids apart; they
    stay. A packed reply gives each of its records a rating or counts for none
    of them: it is one answer, and what is wrong with it can't be laid to a
    single record. Requests hold a bounded number of records, so their windows
    do too. Replies are short but dear to read, so they are spread by number,
    not by size.
    """
    more = [*of, *(c for c in ("raw",) if c in results.columns)]
    members = ids.groupBy("custom_id").agg(F.collect_list(F.struct("record_id")).alias("members"))
    spread = results.repartition(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), "custom_id")
    each = F.transform("members", lambda x: x["record_id"])
    single = F.transform(each, lambda x: F.struct(x.alias("record_id"), parse_reply(F.col("reply"))["rating"].alias("rating")))
    rated = spread.join(members, "custom_id").select("custom_id", *more, F.when(F.size("members") > 1, parse_batch_replies(F.col("reply"), each)).otherwise(single).alias("rated"))
    rated = rated.withColumn("whole", F.min(F.forall("rated", lambda x: x["rating"].isNotNull())).over(Window.partitionBy("custom_id", *of)))
    return rated.where("whole").select(F.explode("rated").alias("rated"), *more).select("rated.record_id", "rated.rating", *more)
