"""Audit populations, draws, labels and strata of the two audit planes, kept apart from each other and from other planes."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evscreen.errors import AuditError

EXCLUSION, INCLUSION = "recall_audit", "inclusion_audit"
ALL = "all"
STRATA_LIMIT = 10_000


def excluded_population(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, track): decided and not included, an adjudicated 0 among them; the track of an unknown record is 'unknown'."""
    own = decisions.where(~F.col("escalate") & (F.col("auto_label") != 1)).select("record_id")
    return own.join(records.select("record_id", "track"), "record_id", "left").withColumn("track", F.coalesce("track", F.lit("unknown")))


def included_population(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, track, status): included or escalated records."""
    own = decisions.where(F.col("escalate") | (F.col("auto_label") == 1)).select("record_id", F.when(F.col("escalate"), "escalated").otherwise("included").alias("status"))
    return own.join(records.select("record_id", "track"), "record_id", "left").select("record_id", F.coalesce("track", F.lit("unknown")).alias("track"), "status")


def population_sizes(population: DataFrame, *kinds: str) -> DataFrame:
    """(kind, stratum, population): the whole, and the sizes by each column of kinds, in one pass of grouping sets."""
    cells = F.explode(F.array(F.struct(F.lit(ALL).alias("kind"), F.lit(ALL).alias("stratum")), *(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("stratum")) for k in kinds)))
    if not kinds:
        return population.agg(F.count("*").alias("population")).select(F.lit(ALL).alias("kind"), F.lit(ALL).alias("stratum"), "population")
    return population.select(cells.alias("cell")).groupBy("cell.kind", "cell.stratum").agg(F.count("*").alias("population"))


def frame_hash(population: DataFrame) -> DataFrame:
    """One row (n, frame_hash): a hash of the sorted distinct ids, each ended by a line feed but the last.

    The ids of a frame that is drawn for human labels are gathered in one row;
    for frames beyond that use frame_fingerprint.
    """
    ids = F.array_sort(F.collect_set("record_id"))
    return population.agg(F.countDistinct("record_id").alias("n"), F.sha2(F.array_join(ids, "\n"), 256).alias("frame_hash"))


def frame_fingerprint(population: DataFrame) -> DataFrame:
    """One row (n, fingerprint): a sum of the distinct ids' hashes, for frames of any size; partial sums, no gathering."""
    own = population.select("record_id").distinct()
    return own.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2("record_id", 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def apportion(sizes: DataFrame, n: int, order: str = "first_seen") -> DataFrame:
    """(stratum, size, allocated): n shared out in proportion by largest remainders; ties go to the stratum seen first.

    sizes has a row per stratum (stratum, size, first_seen).
    """
    total = sizes.agg(F.sum("size").alias("total"))
    raw = (F.lit(n).cast("long") * F.col("size")).cast("double") / F.col("total").cast("double")
    own = sizes.crossJoin(F.broadcast(total)).withColumn("raw", raw).withColumn("base", F.floor("raw"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("raw") - F.col("base")), order))
    return own.withColumns({"left": left, "rank": rank}).select("stratum", "size", (F.col("base") + (F.col("rank") <= F.col("left")).cast("int")).cast("long").alias("allocated"))


def _check_size(n: int, size: int) -> None:
    if not 0 < n <= size:
        raise AuditError(f"can't draw {n} of {size} records")


def gathered(strata: DataFrame) -> DataFrame:
    """A table of strata, read once: strata are what people review apart from each other, STRATA_LIMIT at most."""
    rows = strata.limit(STRATA_LIMIT + 1).collect()
    if len(rows) > STRATA_LIMIT:
        raise AuditError(f"more than {STRATA_LIMIT} strata")
    return strata.sparkSession.createDataFrame(rows, strata.schema)


#: Hexadecimal digits of the hash by which draws are counted.
_BIN_DIGITS = 4


def _draw_key(seed: int, record_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), record_id), 256)


def draw(population: DataFrame, n: int, seed: int, by: str | None = None, plane: str = EXCLUSION) -> DataFrame:
    """(record_id, stratum_kind, stratum, plane): n records without replacement, at once or apportioned to strata.

    Records are ordered by a keyed hash, so that a draw doesn't depend on
    partitions. How many records have each leading part of it tells where a
    stratum's share ends: what lies before is drawn as it is, and only the
    records of the last part are ranked.
    """
    own = population.withColumn("stratum", F.col(by).cast("string") if by is not None else F.lit(ALL))
    sizes = gathered(own.groupBy("stratum").agg(F.count("*").alias("size"), F.min("record_id").alias("first_seen")))
    if not sizes.where("stratum is null").isEmpty():
        raise AuditError(f"a record has no {by}")
    _check_size(n, sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    shares = apportion(sizes, n).select("stratum", "allocated")
    keyed = own.select("record_id", "stratum", _draw_key(seed, F.col("record_id")).alias("k")).withColumn("bin", F.conv(F.substring("k", 1, _BIN_DIGITS), 16, 10).cast("int"))
    so_far = Window.partitionBy("stratum").orderBy("bin")
    counts = keyed.groupBy("stratum", "bin").count().withColumn("reached", F.sum("count").over(so_far)).join(F.broadcast(shares), "stratum")
    cuts = counts.where("reached >= allocated and reached - count < allocated").select("stratum", F.col("bin").alias("cut"), (F.col("allocated") - F.col("reached") + F.col("count")).alias("left"))
    near = keyed.join(F.broadcast(cuts), "stratum").where("bin <= cut")  # a row for each stratum
    last = near.where("bin = cut").withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy("k", "record_id"))).where("rank <= left")
    drawn = near.where("bin < cut").select("record_id", "stratum").union(last.select("record_id", "stratum"))
    return drawn.select("record_id", F.lit(by if by is not None else ALL).alias("stratum_kind"), "stratum", F.lit(plane).alias("plane"))


def draw_like_random(ids_by_stratum: dict[str, list[str]], n: int, seed: int) -> list[tuple[str, str]]:
    """(id, stratum) as Python's seeded random.sample draws them, on the driver, to repeat published walkthroughs."""
    rng, sizes = random.Random(seed), {k: len(v) for k, v in ids_by_stratum.items()}
    total = sum(sizes.values())
    raw = {k: n * v / total for k, v in sizes.items()}
    given = {k: int(v) for k, v in raw.items()}
    for k in sorted(raw, key=lambda k: given[k] - raw[k])[: n - sum(given.values())]:
        given[k] += 1
    return [(r, k) for k, v in ids_by_stratum.items() for r in rng.sample(v, given[k])]


def apply_labels(rows: DataFrame, labels: DataFrame, reviewer: str | None = None, blinded: bool | None = None) -> DataFrame:
    """Audit rows with human_label, reviewer and blinded; refused if a row has no label or one outside the domain."""
    out = rows.join(labels.select("record_id", "human_label"), "record_id", "left")
    bad = out.select("record_id", "human_label").where(F.col("human_label").isNull() | ~F.col("human_label").isin(-1, 0, 1)).limit(5).collect()
    if bad:
        raise AuditError("no usable label for " + ", ".join(r["record_id"] for r in bad))
    return out.withColumns({"reviewer": F.lit(reviewer), "blinded": F.lit(blinded)})


def strata(rows: DataFrame, sizes: DataFrame, plane: str, relevant: tuple[int, ...] = (1,)) -> DataFrame:
    """(role, stratum_kind, stratum, n, m, population) of labelled audit rows; m counts the relevant.

    Refused: rows of another plane, rows without a label, strata without a
    population or larger than it, and draws of several designs at once.
    """
    own = rows.groupBy("stratum_kind", "stratum").agg(F.count("*").alias("n"), F.count_if(F.col("human_label").isin(*relevant)).alias("m"), F.count_if(F.col("plane") != plane).alias("foreign"), F.count_if(F.col("human_label").isNull()).alias("open"))
    found = gathered(own.join(sizes.withColumnRenamed("kind", "stratum_kind"), ["stratum_kind", "stratum"], "left"))
    every = found.collect()
    if any(r["foreign"] for r in every):
        raise AuditError(f"only rows of {plane} may enter its strata")
    if any(r["open"] for r in every):
        raise AuditError("every audit row needs a label")
    if len({r["stratum_kind"] for r in every}) > 1:
        raise AuditError("rows of several draw designs overlap and can't be added up")
    if any(r["population"] is None or r["n"] > r["population"] for r in every):
        raise AuditError("a stratum has no population, or fewer than were drawn")
    return found.select(F.lit("exclusion" if plane == EXCLUSION else "inclusion").alias("role"), "stratum_kind", "stratum", "n", "m", "population")
