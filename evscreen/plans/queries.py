"""The operators as queries over the whole synthetic tables. Derived doubles are rounded to 9 digits for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evscreen.functions import stats
from evscreen.functions.text import bound, parse_batch_reply, parse_reply
from evscreen.operators import ablation, agreement, audit, codecs, confidence, decide, drift, ensemble, prefilter, provenance, recall, review
from evscreen.sources import ingest, store

SEED, OTHER_SEED, MODEL, MISS, TAU = 42, 43, "deterministic-v1", 13, 0.5
VENDORS = ("anthropic", "google", "mistral", "openai", "together")
CONFIG = ingest.EnsembleConfig({v: ingest.RaterSpec(MODEL, "1", "v1", 0.0) for v in VENDORS}, decide.RULE, TAU)
PROMPTED = ingest.EnsembleConfig(CONFIG.vendors, decide.RULE, TAU, default_prompt="Include trials.", track_prompts={"en": "Include English trials.", "de": "Include German trials."})
PACKED = ingest.EnsembleConfig(CONFIG.vendors, decide.RULE, TAU, batch_size=5)
AUDIT_SHARE = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def records(spark: SparkSession, d: str) -> DataFrame:
    return ingest.documents_as_records(table(spark, d, "documents"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    return ingest.labels_as_gold(table(spark, d, "labels"))


def votes(spark: SparkSession, d: str, seed: int = SEED) -> DataFrame:
    return ensemble.seeded_votes(records(spark, d).select("record_id", "track"), ensemble.raters_frame(spark, CONFIG), seed, miss=MISS)


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return decide.decide(votes(spark, d), TAU)


def human(spark: SparkSession, d: str) -> DataFrame:
    """A human label for every record: gold where there is one, else a hash of the id."""
    drawn = ensemble.seeded_rating(F.sha2(F.concat(F.lit("human:"), F.col("record_id")), 256))
    own = records(spark, d).select("record_id").join(gold(spark, d), "record_id", "left")
    return own.select("record_id", F.coalesce("truth", drawn).alias("human_label"))


# input and prefilter


@query
def normalize_records(spark, d):
    raw = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit(" doc-"), F.col("doc_id"), F.lit("\t")).alias("id"), F.col("lang").alias("track"), F.array(F.struct(F.lit(" DOI ").alias("kind"), F.concat(F.lit("10.1/"), F.upper("source"), F.lit(" ")).alias("value"))).alias("ids"))
    out = ingest.normalise(raw)
    return out.select("seq", "id", "track", F.col("ids")[0]["kind"].alias("kind"), F.col("ids")[0]["value"].alias("value"))


@query
def contract_violations(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    raw = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("id"), F.when(F.col("n_chars") >= 50, F.substring("text", 1, 80)).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("track"), F.array().cast("array<struct<kind:string,value:string>>").alias("ids"), (F.col("quality") + F.col("toxic")).alias("gold_label"))
    return ingest.violations(ingest.normalise(raw))


def _prefiltered(spark, d):
    rules = [*prefilter.default_rules(), ("short", F.length("abstract") < 40, "abstract is short")]
    return prefilter.prefilter(records(spark, d), prefilter.text_key(F.col("abstract")), rules)


@query
def prefilter_dedup(spark, d):
    return prefilter.dedup(records(spark, d), prefilter.text_key(F.col("abstract"))).select("record_id", "kept_id", "duplicate")


@query
def prefilter_exclusions(spark, d):
    return _prefiltered(spark, d).where("outcome = 'excluded'").select("record_id", "code", "reason")


@query
def prisma_counts(spark, d):
    return prefilter.flow_counts(_prefiltered(spark, d))


# votes


@query
def seeded_votes(spark, d):
    return rounded(votes(spark, d).select("record_id", "vendor", "rating", "logprob"))


@query
def votes_missing(spark, d):
    every = records(spark, d).select("record_id").crossJoin(F.broadcast(ensemble.raters_frame(spark, CONFIG).select("vendor")))
    return every.join(votes(spark, d).select("record_id", "vendor"), ["record_id", "vendor"], "left_anti").groupBy("vendor").agg(F.count("*").alias("missing"))


@query
def chunked_votes(spark, d):
    return ensemble.seeded_votes(records(spark, d).select("seq", "record_id", "track"), ensemble.raters_frame(spark, PACKED), SEED, PACKED).select("record_id", "vendor", "rating")


@query
def prompt_resolution(spark, d):
    return records(spark, d).groupBy("track", ingest.prompt_for(F.col("track"), PROMPTED).alias("prompt")).agg(F.count("*").alias("n"))


@query
def prompted_votes(spark, d):
    out = ensemble.seeded_votes(records(spark, d).select("record_id", "track"), ensemble.raters_frame(spark, PROMPTED), SEED, PROMPTED)
    return out.groupBy("track", "vendor", "rating").agg(F.count("*").alias("n"))


_REPLIES = ("I", " e. ", "Decision: U", "E or I", "", "no idea", "(i)", "Thinking.\n\nU;")


def _reply(value):
    return F.element_at(F.array(*map(F.lit, _REPLIES)), ensemble.digest_byte(value, 0) % len(_REPLIES) + 1)


@query
def parse_replies(spark, d):
    turns = table(spark, d, "conversations")
    made = records(spark, d).select(_reply(F.sha2("record_id", 256)).alias("reply"))
    out = turns.select(F.col("text").alias("reply")).union(made).withColumn("p", parse_reply(F.col("reply")))
    return out.groupBy("p.rating", "p.problem").agg(F.count("*").alias("n"))


@query
def parse_batch_replies(spark, d):
    own = records(spark, d).withColumn("reply", F.to_json(F.create_map("record_id", _reply(F.sha2("record_id", 256)))))
    return own.select("record_id", parse_batch_reply(F.col("reply"), F.col("record_id")).alias("rating"))


@query
def batch_reassemble(spark, d):
    ids = records(spark, d).select(F.concat(F.lit("job-"), F.col("track"), F.lit("-"), F.length("abstract").cast("string")).alias("custom_id"), "record_id", _reply(F.sha2("record_id", 256)).alias("r"))
    packed = ids.groupBy("custom_id").agg(F.when(F.count("*") > 1, F.to_json(F.map_from_entries(F.collect_list(F.struct("record_id", "r"))))).otherwise(F.first("r")).alias("reply"))
    return ensemble.reassemble(packed, ids.select("custom_id", "record_id"))


@query
def batch_services(spark, d):
    """Records packed by track, as JSONL for each service, answered in its form and read back: what becomes of them."""
    own = records(spark, d).withColumn("prompt", F.col("track"))
    packed = ensemble.pack(own, 3, F.col("track")).select("record_id", "title", "abstract", "prompt", "chunk_group", "chunk", "position")
    ids = packed.select(ensemble.custom_id().alias("custom_id"), "record_id", _reply(F.sha2("record_id", 256)).alias("r"))
    texts = ids.groupBy("custom_id").agg(F.when(F.count("*") > 1, F.to_json(F.map_from_entries(F.collect_list(F.struct("record_id", "r"))))).otherwise(F.first("r")).alias("text"))
    chunks = ensemble.chunk_requests(packed).join(texts, "custom_id")

    def back(vendor):  # lines are long: each is made, and read, once
        line = codecs.line(vendor, codecs.Options("m"), F.col("custom_id"), F.col("system"), F.col("user"), F.col("size"))
        key = F.get_json_object(line, "$.key" if vendor == "google" else "$.custom_id")
        return bound(codecs.answer(vendor, key, F.col("text"), "m"), lambda answer: F.struct(F.lit(vendor).alias("vendor"), codecs.returned(vendor, answer).alias("r")))

    answered = chunks.select(F.explode(F.array(*map(back, ("anthropic", "google", "mistral", "openai", "together")))).alias("b")).select("b.vendor", "b.r.custom_id", F.col("b.r.text").alias("reply"))
    out = ensemble.reassemble(answered, ids.select("custom_id", "record_id"), of=["vendor"])
    return out.groupBy("vendor", "rating").agg(F.count("*").alias("n")).select("rating", "n", "vendor")


# decisions


@query
def decide_escalate(spark, d):
    return rounded(decisions(spark, d).select("record_id", "x", "dispersion", "boundary", "escalate", "auto_label"))


@query
def decide_include(spark, d):
    return rounded(decide.decide(votes(spark, d), 0.6, "include").select("record_id", "x", "dispersion", "boundary", "escalate", "auto_label"))


@query
def vote_vectors(spark, d):
    return decide.vote_vectors(votes(spark, d)).select("record_id", F.array_join(F.transform("votes", lambda v: F.concat_ws("=", v["vendor"], v["rating"].cast("string"))), ",").alias("vector"))


@query
def decision_table(spark, d):
    return rounded(decide.decision_table(spark, len(VENDORS), TAU).select("n_neg", "n_zero", "n_pos", "dispersion", "boundary", "escalate", "auto_label"))


@query
def escalation_rate(spark, d):
    return rounded(decide.escalation_rate(decisions(spark, d)))


@query
def escalation_by_track(spark, d):
    own = decisions(spark, d).join(records(spark, d).select("record_id", "track"), "record_id")
    return own.groupBy("track").agg(F.count("*").alias("n"), F.count_if("escalate").alias("escalated"), F.count_if(F.col("auto_label") == 1).alias("included"))


def _sizes(spark, d):
    return decide.vote_counts(votes(spark, d)).select((F.col("n_neg") + F.col("n_zero") + F.col("n_pos")).alias("x")).distinct()


@query
def tau_reachable(spark, d):
    return rounded(decide.reachable_frame(_sizes(spark, d)))


@query
def tau_report(spark, d):
    return rounded(decide.tau_columns(TAU, decide.reachable_frame(_sizes(spark, d))))


# confidence


def _probabilities(spark, d):
    raw = ensemble.seeded_reply(F.col("vendor"), F.col("digest"))
    return votes(spark, d).withColumn("probability", confidence.vote_confidence(F.col("vendor"), raw))


def _record_confidence(spark, d):
    return confidence.record_confidence(_probabilities(spark, d))


@query
def vote_confidence(spark, d):
    return rounded(_probabilities(spark, d).select("record_id", "vendor", "probability"))


@query
def record_confidence(spark, d):
    return rounded(_record_confidence(spark, d))


@query
def confidence_tiers(spark, d):
    return _record_confidence(spark, d).groupBy(confidence.tier(F.col("scored"), F.col("median_probability")).alias("tier")).agg(F.count("*").alias("n"))


# agreement and errors


@query
def agreement_overall(spark, d):
    return rounded(agreement.agreement(votes(spark, d)))


@query
def agreement_by_track(spark, d):
    return rounded(agreement.agreement(votes(spark, d), "track"))


@query
def alpha_pairwise(spark, d):
    return rounded(agreement.pairwise_alpha(votes(spark, d)))


@query
def agreement_order_lines(spark, d):
    """Lines of an order as raters of it: how far return flags agree within orders, by order status."""
    rating = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    lines = table(spark, d, "lineitem").select("l_orderkey", rating.alias("rating"))
    counts = lines.withColumnRenamed("l_orderkey", "record_id").groupBy("record_id").agg(*(F.count_if(F.col("rating") == v).alias(n) for n, v in (("n_neg", -1), ("n_zero", 0), ("n_pos", 1))))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderstatus")
    return rounded(agreement.from_counts(counts.join(orders, "record_id"), "o_orderstatus"))


@query
def reliability_matrix(spark, d):
    return agreement.reliability_matrix(votes(spark, d), list(VENDORS))


@query
def error_indicators(spark, d):
    return agreement.error_indicators(votes(spark, d), gold(spark, d))


@query
def full_coverage(spark, d):
    return agreement.fully_covered(votes(spark, d), gold(spark, d)).groupBy("truth").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("votes"))


@query
def fn_correlation(spark, d):
    return rounded(agreement.fn_correlation(votes(spark, d), gold(spark, d)))


def _final(spark, d):
    own = decisions(spark, d)
    return review.final_labels(own, human(spark, d).join(own.where("escalate"), "record_id", "left_semi"))


@query
def confusion(spark, d):
    return agreement.confusion(_final(spark, d), gold(spark, d))


@query
def confusion_by_track(spark, d):
    own = _final(spark, d).join(records(spark, d).select("record_id", "track"), "record_id")
    return agreement.confusion(own, gold(spark, d), "track")


# audits and recall


def _excluded(spark, d):
    return audit.excluded_population(decisions(spark, d), records(spark, d))


def _excluded_tiers(spark, d):
    tiers = _record_confidence(spark, d).select("record_id", confidence.tier(F.col("scored"), F.col("median_probability")).alias("tier"))
    return _excluded(spark, d).join(tiers, "record_id")


def _included(spark, d):
    return audit.included_population(decisions(spark, d), records(spark, d))


@query
def excluded_population(spark, d):
    return _excluded(spark, d)


@query
def included_population(spark, d):
    return _included(spark, d)


@query
def population_sizes(spark, d):
    return audit.population_sizes(_excluded_tiers(spark, d), "track", "tier")


@query
def inclusion_population_sizes(spark, d):
    return audit.population_sizes(_included(spark, d), "track", "status")


@query
def frame_hash(spark, d):
    return audit.frame_hash(_excluded(spark, d))


@query
def apportion(spark, d):
    """A review budget of a tenth of the customers, shared out to nations by their customers."""
    own = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("stratum")).agg(F.count("*").alias("size"), F.min("c_custkey").alias("first_seen"))
    return audit.apportion(own, own.agg(F.sum("size")).first()[0] // AUDIT_SHARE)


def _tenth(population):
    return max(1, population.count() // AUDIT_SHARE)


def _exclusion_draw(spark, d, by=None):
    own = _excluded(spark, d)
    return audit.draw(own, _tenth(own), SEED, by)


def _inclusion_draw(spark, d):
    own = _included(spark, d)
    return audit.draw(own, _tenth(own), SEED, "status", audit.INCLUSION)


@query
def audit_draw(spark, d):
    return _exclusion_draw(spark, d)


@query
def audit_draw_by_track(spark, d):
    return _exclusion_draw(spark, d, "track")


@query
def audit_draw_by_tier(spark, d):
    own = _excluded_tiers(spark, d)
    return audit.draw(own, _tenth(own), SEED, "tier")


@query
def inclusion_draw_by_status(spark, d):
    return _inclusion_draw(spark, d)


def _exclusion_strata(spark, d):
    rows = audit.apply_labels(_exclusion_draw(spark, d, "track"), human(spark, d))
    return audit.strata(rows, audit.population_sizes(_excluded(spark, d), "track"), audit.EXCLUSION)


def _inclusion_strata(spark, d):
    rows = audit.apply_labels(_inclusion_draw(spark, d), human(spark, d))
    return audit.strata(rows, audit.population_sizes(_included(spark, d), "status"), audit.INCLUSION)


@query
def exclusion_strata(spark, d):
    return _exclusion_strata(spark, d)


@query
def inclusion_strata(spark, d):
    return _inclusion_strata(spark, d)


@query
def stratum_rates(spark, d):
    return rounded(recall.stratum_rates(_exclusion_strata(spark, d)).select("stratum", "rate", "low", "high", "rate_floor", "estimated", "estimated_floor"))


@query
def wilson_by_part_size(spark, d):
    """Wilson intervals of how often a line of a part is returned, by part size."""
    own = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag").join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    counts = own.groupBy("p_size").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("m"))
    low, high = stats.wilson(F.col("m"), F.col("n"))
    return rounded(counts.select("p_size", "n", "m", low.alias("low"), high.alias("high")))


@query
def hypergeometric_bounds(spark, d):
    return recall.exact_bounds(_exclusion_strata(spark, d).select("stratum", "n", "m", "population"), 0.95)


@query
def recall_stratified(spark, d):
    tp = agreement.confusion(_final(spark, d), gold(spark, d)).first()["tp"]
    return rounded(recall.stratified(_exclusion_strata(spark, d), tp))


@query
def recall_audited(spark, d):
    inside = _inclusion_strata(spark, d)
    return rounded(recall.with_audited_positives(_exclusion_strata(spark, d), recall.estimated_positives(inside), inside))


# review


@query
def adjudication_queue(spark, d):
    return rounded(review.queue(decisions(spark, d)))


@query
def final_labels(spark, d):
    return _final(spark, d)


@query
def adjudicated_decisions(spark, d):
    return review.overlay(decisions(spark, d), human(spark, d)).select("record_id", "escalate", "auto_label")


@query
def unresolved_escalations(spark, d):
    return review.unresolved(decisions(spark, d), gold(spark, d).withColumnRenamed("truth", "human_label"))


@query
def usable_labels(spark, d):
    given = gold(spark, d).withColumnRenamed("truth", "human_label")
    return review.usable_labels(decisions(spark, d), human(spark, d), given)


@query
def active_learning_select(spark, d):
    out = review.select_for_review(decisions(spark, d), _record_confidence(spark, d))
    return rounded(out.withColumn("selection_reason", F.array_join("selection_reason", ",")))


@query
def active_learning_top_100(spark, d):
    out = review.select_for_review(decisions(spark, d), _record_confidence(spark, d), limit=100)
    return rounded(out.withColumn("selection_reason", F.array_join("selection_reason", ",")))


# ablation, drift, provenance


def _gold_votes(spark, d):
    return votes(spark, d).join(gold(spark, d), "record_id", "left_semi")


@query
def ablation_sweep(spark, d):
    return rounded(ablation.sweep(_gold_votes(spark, d), gold(spark, d), TAU, VENDORS)[0])


@query
def ablation_leave_one_out(spark, d):
    return rounded(ablation.sweep(_gold_votes(spark, d), gold(spark, d), TAU, VENDORS)[1])


@query
def drift_evaluation(spark, d):
    out = drift.evaluate(votes(spark, d), votes(spark, d, OTHER_SEED))
    return rounded(out.select("vendor", "n_records", "raw_agreement", "alpha", "polarity_crossings", F.sha2(F.array_join("crossed_record_ids", ","), 256).alias("crossed"), "hard_trigger", "advisory_flag"))


@query
def drift_summary(spark, d):
    out = drift.summary(drift.evaluate(votes(spark, d), votes(spark, d, OTHER_SEED)))
    return out.select(F.array_join("hard_trigger_vendors", ",").alias("hard"), F.array_join("advisory_vendors", ",").alias("advisory"), "triggered")


@query
def drift_staleness(spark, d):
    own = table(spark, d, "events").select(F.col("ts").alias("evaluated_at"))
    return rounded(drift.staleness(own, "2030-01-01 00:00:00", 30.0))


@query
def config_diff(spark, d):
    """Fields that differ between customers' and suppliers' records of a nation."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    as_fields = lambda x: x.select(F.concat(F.lit("nation."), F.col("k")).alias("field"), F.col("n").cast("string").alias("value"))
    return provenance.field_diff(as_fields(c), as_fields(s))


@query
def changelog_lineage(spark, d):
    """The walk back over the customers in the order of their keys, as changes between configurations (segments of
    nations) that come back again and again; each customer changes what one of the three before it set."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("after"))
    back = c.select((F.col("seq") + 1 + F.col("seq") % 3).alias("reached"), F.col("after").alias("before"))
    events = c.join(back.groupBy("reached").agg(F.max("before").alias("before")), F.col("seq") == F.col("reached"), "left")
    last = c.agg(F.max_by("after", "seq")).first()[0]
    return provenance.lineage(events, last)


@query
def manifest_verify(spark, d):
    """Customers' rows as artifacts, against those of the nation's suppliers that claim the same key."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("artifact"), F.sha2(F.col("c_nationkey").cast("string"), 256).alias("sha256"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("artifact"), F.sha2(F.col("s_nationkey").cast("string"), 256).alias("sha256"))
    return provenance.verify(c, s)


@query
def upsert_latest(spark, d):
    own = table(spark, d, "events").withColumn("order_key", F.struct("ts", "event_id"))
    return rounded(store.latest(own, ("user_id", "event_type"), "order_key").select("user_id", "event_type", "event_id", "value"))


@query
def screening_flow(spark, d):
    """The flagship: documents through the prefilter, five raters and decisions, to counts by track."""
    passed = _prefiltered(spark, d).where("outcome = 'passed'").select("record_id", "track")
    cast = ensemble.seeded_votes(passed, ensemble.raters_frame(spark, CONFIG), SEED, miss=MISS)
    own = decide.with_decision(decide.vote_counts(cast, "track"), TAU)
    return own.groupBy("track").agg(F.count("*").alias("screened"), F.count_if("escalate").alias("escalated"), F.count_if(F.col("auto_label") == 1).alias("included"), F.count_if(F.col("auto_label") == -1).alias("excluded"))


@query
def sampling_noise(spark, d):
    """How often drift rules fire without drift, at a flip rate of one percent; simulated, so without SQL."""
    return drift.simulate(spark, 0.01, 2000)
