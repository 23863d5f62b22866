"""Agreement of raters: raw, Krippendorff's alpha, and by pairs; and the correlation of their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evscreen.errors import AgreementError
from evscreen.functions import stats


def _unit_terms(counts: DataFrame) -> DataFrame:
    """Coincidences and marginals of each unit with several ratings, from its counts."""
    neg, zero, pos = (F.col(c).cast("double") for c in ("n_neg", "n_zero", "n_pos"))
    m = neg + zero + pos
    share = F.try_divide(F.lit(1.0), m - 1)
    pairs = (neg * (neg - 1) + zero * (zero - 1) + pos * (pos - 1)) / 2
    usable = m >= 2
    return counts.withColumns({
        "o_nz": F.when(usable, neg * zero * share), "o_zp": F.when(usable, zero * pos * share), "o_np": F.when(usable, neg * pos * share),
        "m_n": F.when(usable, neg), "m_z": F.when(usable, zero), "m_p": F.when(usable, pos), "agreeing": F.when(usable, pairs), "pairs": F.when(usable, m * (m - 1) / 2),
    })


def from_counts(counts: DataFrame, *by: str) -> DataFrame:
    """alpha, raw_agreement and n_units per group of counts (n_neg, n_zero, n_pos); alpha is null if undefined."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    sums = _unit_terms(counts).groupBy(*by).agg(*(total(c) for c in ("o_nz", "o_zp", "o_np", "m_n", "m_z", "m_p", "agreeing", "pairs")), F.count("*").alias("n_units"))
    alpha = stats.ordinal_alpha(*(F.col(c) for c in ("o_nz", "o_zp", "o_np", "m_n", "m_z", "m_p")))
    return sums.select(*by, alpha.alias("alpha"), F.try_divide("agreeing", "pairs").alias("raw_agreement"), "n_units")


def agreement(votes: DataFrame, *by: str) -> DataFrame:
    """alpha, raw_agreement, n_units and n_raters over votes, per group if asked. One shuffle by record, one of partial sums."""
    from evscreen.operators.decide import vote_counts

    out = from_counts(vote_counts(votes, *by), *by)
    raters = votes.groupBy(*by).agg(F.countDistinct("vendor").alias("n_raters"))
    return out.join(raters, list(by)) if by else out.crossJoin(raters)


def strict_agreement(votes: DataFrame) -> DataFrame:
    """agreement, refused where no unit has two ratings."""
    out = agreement(votes)
    if out.where("raw_agreement is not null").isEmpty():
        raise AgreementError("no record has two ratings")
    return out


def pair_table(votes: DataFrame, *extra: str) -> DataFrame:
    """(vendor_a, vendor_b, rating_a, rating_b, extra..., n): joint votes of each pair of raters on shared records.

    The records' votes are gathered once and paired in place, so that no join
    is needed. An ensemble has few raters, so a record's pairs are few.
    """
    own = votes.groupBy("record_id", *extra).agg(F.array_sort(F.collect_list(F.struct("vendor", "rating"))).alias("v"))
    left = own.select(*extra, "v", F.explode("v").alias("a"))
    both = left.select(*extra, "a", F.explode("v").alias("b")).where("a.vendor < b.vendor")
    return both.groupBy(F.col("a.vendor").alias("vendor_a"), F.col("b.vendor").alias("vendor_b"), F.col("a.rating").alias("rating_a"), F.col("b.rating").alias("rating_b"), *extra).agg(F.count("*").alias("n"))


def pairwise_alpha(votes: DataFrame) -> DataFrame:
    """(vendor_a, vendor_b, alpha): pairs without a defined alpha are left out."""
    t = pair_table(votes)
    a, b, n = F.col("rating_a"), F.col("rating_b"), F.col("n").cast("double")
    cross = lambda x, y: F.sum(F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), n).otherwise(0.0))
    margin = lambda x: F.sum(n * ((a == x).cast("int") + (b == x).cast("int")))
    sums = t.groupBy("vendor_a", "vendor_b").agg(cross(-1, 0).alias("o_nz"), cross(0, 1).alias("o_zp"), cross(-1, 1).alias("o_np"), margin(-1).alias("m_n"), margin(0).alias("m_z"), margin(1).alias("m_p"))
    return sums.select("vendor_a", "vendor_b", stats.ordinal_alpha(*(F.col(c) for c in ("o_nz", "o_zp", "o_np", "m_n", "m_z", "m_p"))).alias("alpha")).where("alpha is not null")


def reliability_matrix(votes: DataFrame, vendors: list[str]) -> DataFrame:
    """A row per record, a column per rater; null where a rating is missing."""
    return votes.groupBy("record_id").pivot("vendor", sorted(vendors)).agg(F.first("rating"))


def fully_covered(votes: DataFrame, truths: DataFrame) -> DataFrame:
    """Votes, with truth, of the gold records that every rater in votes has rated."""
    raters = votes.agg(F.countDistinct("vendor").alias("raters"))
    own = votes.join(truths.select("record_id", "truth"), "record_id")
    return own.withColumn("cast", F.count("*").over(Window.partitionBy("record_id"))).crossJoin(raters).where("cast = raters").drop("cast", "raters")


def error_indicators(votes: DataFrame, truths: DataFrame) -> DataFrame:
    """(record_id, vendor, error): whether a vote differs from the truth; a 0 on a relevant record is an error."""
    return votes.join(truths, "record_id").select("record_id", "vendor", (F.col("rating") != F.col("truth")).alias("error"))


def fn_correlation(votes: DataFrame, truths: DataFrame) -> DataFrame:
    """(vendor_a, vendor_b, correlation, n, both, only_a, only_b, neither) of errors on relevant, fully covered records.

    Every pair of raters has a row; the correlation is null below two records or without variance.
    """
    covered = fully_covered(votes, truths).where("truth = 1")
    t = pair_table(covered, "truth")
    a, b, n = F.col("rating_a") != F.col("truth"), F.col("rating_b") != F.col("truth"), F.col("n")
    count = lambda cond: F.sum(F.when(cond, n).otherwise(F.lit(0)))
    sums = t.groupBy("vendor_a", "vendor_b").agg(F.sum("n").alias("n"), count(a & b).alias("both"), count(a & ~b).alias("only_a"), count(~a & b).alias("only_b"), count(~a & ~b).alias("neither"))
    names = votes.select("vendor").distinct()
    pairs = names.select(F.col("vendor").alias("vendor_a")).crossJoin(names.select(F.col("vendor").alias("vendor_b"))).where("vendor_a < vendor_b")
    counts = ["n", "both", "only_a", "only_b", "neither"]
    out = pairs.join(sums, ["vendor_a", "vendor_b"], "left").fillna(0, counts)
    value = F.when(F.col("n") >= 2, stats.phi(F.col("both"), F.col("only_a"), F.col("only_b"), F.col("neither")))
    return out.select("vendor_a", "vendor_b", value.alias("correlation"), *counts)


def confusion(labels: DataFrame, truths: DataFrame, *by: str, label: str = "label", relevant: int = 1) -> DataFrame:
    """tp, fp, fn and tn over records with both; every label but relevant counts as not relevant."""
    own = labels.join(truths, "record_id")
    said, true = F.col(label) == relevant, F.col("truth") == relevant
    return own.groupBy(*by).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, F.try_divide(part.cast("double"), whole.cast("double"))).otherwise(F.lit(0.0))
