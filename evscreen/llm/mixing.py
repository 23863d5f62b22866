"""Mixing sources to target weights.

One pass counts the tokens of each source; rates follow from target weights,
so that the expected tokens of a source are its weight's share of the budget.
Each document is then emitted floor(rate) times, plus once more if a uniform
number hashed from (seed, id) is below the fraction. The rates, a row per
source, are written, counted, and broadcast up to BROADCAST_SOURCES of them, so
that documents of a hot source stay where they are; beyond, they are joined.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, settle

SEED = "mix-1"
#: Target weights in parts; a source that isn't listed has DEFAULT_WEIGHT parts.
WEIGHTS: Mapping[str, int] = {"src0": 4, "src1": 2, "src2": 1}
DEFAULT_WEIGHT = 1
#: Sources whose rates are broadcast, at most.
BROADCAST_SOURCES = 100_000
#: Copies that one array lists; of more there are several arrays.
COPIES_AT_ONCE = 1 << 12
#: Rates must stay below it.
MAX_RATE = (1 << 31) - 2
_SPACES = "[^ \\t\\n\\r\\f]+"


def tokens(text: Column) -> Column:
    """Runs of characters between blanks, tabs, feeds and returns; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_SPACES)), F.lit(0)).cast("long")


def uniform(seed: str, id_: Column) -> Column:
    """In [0, 1), from the first 32 bits of an MD5; a null id hashes as an empty string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def rates(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default: int = DEFAULT_WEIGHT, budget: int | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, tokens, rate) for each source; budget: tokens of the result, those of docs if None.

    A null source is a source of its own with the default weight. A source
    without tokens has rate 1 and no share of the weights.
    """
    if default < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    own = docs.select(F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    listed = F.lit(default)
    for name, w in weights.items():
        listed = F.when(F.col("source") == name, F.lit(w)).otherwise(listed)
    own = own.withColumn("weight", F.when(F.col("tokens") > 0, listed).otherwise(F.lit(0)).cast("long"))
    sums = own.agg(F.sum("weight").alias("weights"), F.sum("tokens").alias("all_tokens"))
    rate = F.when(F.col("tokens") == 0, F.lit(1.0)).when(F.col("weights") == 0, F.lit(0.0))
    rate = rate.otherwise(F.col("weight").cast("double") * (F.lit(budget).cast("double") if budget is not None else F.col("all_tokens").cast("double")) / (F.col("weights").cast("double") * F.col("tokens").cast("double")))
    return own.crossJoin(sums).select("source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default: int = DEFAULT_WEIGHT, budget: int | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy_no") -> DataFrame:
    """docs with each row repeated by its source's rate; copy_col numbers a row's copies from 1.

    Repeated rows have equal ids and so equal draws; each is repeated by
    itself. Empty and null texts have no tokens but follow their source's
    rate; very long ones are one row like any other. A rate of MAX_RATE or
    more, as a tiny source with a large share of the budget has, raises
    ValueError before anything is repeated. An empty table gives an empty
    result. If docs already has a column named copy_col, an underscore is added
    to the new one's name.
    """
    rated = settle(rates(docs, weights, default, budget, source_col, text_col))
    sources, most, largest = rated.agg(F.count("*"), F.max("rate"), F.max_by("source", "rate")).first()
    if (most or 0) >= MAX_RATE:
        raise ValueError(f"source {largest!r} would be repeated {most:.3g} times; lower the budget or its weight")
    rated = F.broadcast(rated) if sources <= BROADCAST_SOURCES else rated
    copy, name, count, rate = fresh(docs, copy_col, "rate_source", "rate_tokens", "rate")
    rated = rated.toDF(name, count, rate)
    out = docs.join(rated, F.col(f"`{source_col}`").eqNullSafe(F.col(name)), "inner")
    many = F.floor(rate).cast("int") + (uniform(seed, F.col(f"`{id_col}`")) < F.col(rate) - F.floor(rate)).cast("int")
    first = F.lit(1)
    if (most or 0) >= COPIES_AT_ONCE:
        part, total = fresh(out, "copies_from", "copies")
        out = out.withColumn(total, many).where(F.col(total) > 0)
        out = out.withColumn(part, F.explode(F.sequence(F.lit(0), F.expr(f"(`{total}` - 1) div {COPIES_AT_ONCE}").cast("int")))).withColumn(part, F.col(part) * COPIES_AT_ONCE)
        first, many = F.col(part) + 1, F.least(F.col(total).cast("long"), F.col(part).cast("long") + COPIES_AT_ONCE).cast("int")
    out = out.withColumn(copy, F.explode(F.when(many >= first, F.sequence(first, many)).otherwise(F.array().cast("array<int>"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], copy)
