"""Exact-key deduplication, rule chains and flow counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evscreen.functions.text import strip

#: A rule: its code, the condition that excludes a record, and the reason given.
Rule = tuple[str, Column, str]
KEY_KINDS = ("doi", "pmid", "arxiv")


def external_key(ids: Column, record_id: Column) -> Column:
    """The first of doi, pmid and arxiv as kind:value, the last id of a kind counting; else id: and the id in lower case."""

    def last(kind: str) -> Column:  # a default argument would take the element's place in the array
        return F.try_element_at(F.filter(ids, lambda x: (x["kind"] == kind) & (x["value"] != "")), F.lit(-1))["value"]

    keys = [F.concat(F.lit(f"{kind}:"), last(kind)) for kind in KEY_KINDS]
    return F.coalesce(*keys, F.concat(F.lit("id:"), F.lower(strip(record_id))))


def text_key(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.coalesce(text, F.lit("")))), 256)


def require_nonempty(field: str) -> Rule:
    return f"empty_{field}", strip(F.coalesce(F.col(field), F.lit(""))) == "", f"{field} is empty"


def dedup(records: DataFrame, key: Column, id_col: str = "record_id", order: str = "seq") -> DataFrame:
    """records with dedup_key, kept_id and duplicate: the first of a key by (order, id) stays; a null comes first.

    The first of each key is a partial minimum, which is joined back: texts
    aren't sorted, and a key of millions of records, like that of empty texts,
    isn't one task. Records are told apart by (order, id); of equal ones, the
    whole pair is the first.
    """
    own = records.withColumn("dedup_key", key)
    first = own.groupBy("dedup_key").agg(F.min(F.struct(F.col(order).alias("o"), F.col(id_col).alias("i"))).alias("dedup_first"))
    joined = own.alias("l").join(first.withColumnRenamed("dedup_key", "dedup_first_key"), F.col("dedup_key").eqNullSafe(F.col("dedup_first_key")))
    later = ~F.struct(F.col(order).alias("o"), F.col(id_col).alias("i")).eqNullSafe(F.col("dedup_first"))
    return joined.withColumns({"kept_id": F.col("dedup_first.i"), "duplicate": later}).drop("dedup_first", "dedup_first_key")


def apply_rules(records: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """records with code and reason of the first rule that excludes them, else null."""
    hits = [F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))) for code, cond, reason in rules]
    first = F.coalesce(*hits) if hits else F.lit(None).cast("struct<code:string,reason:string>")
    return records.withColumn("hit", first).withColumns({"code": F.col("hit.code"), "reason": F.col("hit.reason")}).drop("hit")


def prefilter(records: DataFrame, key: Column, rules: Sequence[Rule], id_col: str = "record_id", order: str = "seq") -> DataFrame:
    """dedup, then rules on what stays; adds outcome: duplicate, excluded or passed."""
    ruled = apply_rules(dedup(records, key, id_col, order), rules)
    outcome = F.when(F.col("duplicate"), "duplicate").when(F.col("code").isNotNull(), "excluded").otherwise("passed")
    return ruled.withColumn("outcome", outcome).withColumns({c: F.when(F.col("outcome") == "excluded", F.col(c)) for c in ("code", "reason")})


def flow_counts(outcomes: DataFrame) -> DataFrame:
    """identified, duplicates_removed, after_dedup, prefilter_excluded and screened, in one pass."""
    n = lambda c: F.count_if(c)
    kind = F.col("outcome")
    return outcomes.agg(F.count("*").alias("identified"), n(kind == "duplicate").alias("duplicates_removed"), n(kind != "duplicate").alias("after_dedup"), n(kind == "excluded").alias("prefilter_excluded"), n(kind == "passed").alias("screened"))


def default_rules() -> list[Rule]:
    return [require_nonempty("abstract")]


KeyBuilder = Callable[[DataFrame], Column]
