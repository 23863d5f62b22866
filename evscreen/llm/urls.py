"""URL filtering by association rules.

Spark's FP-growth mines combinations of URL tokens that go with a bad label.
Tokens that the very same rows have (the parts of a site's path, say) are one
item while rules are mined, so that n of them don't give 2**n combinations;
each rule then stands for one token of each of its items. Rules below the least
support or confidence go, and so do rules that a rule
with fewer tokens, or none, and no less confidence implies. An inverted index from
tokens to rules matches the rest against every URL: a rule matches if all its
tokens are met.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 5, 0.4
_BAD = -1


def tokens(url: Column) -> Column:
    """The distinct runs of letters and digits of the lower-cased URL, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url.cast("string"), F.lit(""))), "[^0-9a-z\\x{80}-\\x{10FFFF}]+"), lambda x: x != "")))


def _items(own: DataFrame, least: float) -> DataFrame:
    """(token, item): the tokens of least bad rows at least, those of the same rows under one item; own has (row, bad, token)."""
    rows = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))  # noqa: E731  an order-free sum tells sets of rows apart
    seen = own.groupBy("token").agg(F.count(F.when(F.col("bad"), 1)).alias("bad"), F.count("*").alias("n"), rows(1).alias("one"), rows(2).alias("two"))
    return seen.where(F.col("bad") >= least - 1e-9).select("token", F.xxhash64("n", "one", "two").alias("item"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule, tokens, confidence, support) from rows (tokens, bad), where tokens are distinct and bad is a boolean.

    Support is the share of rows with all tokens of the rule and a bad label;
    it must reach min_support and be min_count rows at least. Rules that are
    no surer than the share of bad rows, the rule without tokens, go.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule long, tokens array<string>, confidence double, support double")
    rows = settle(labelled.where((F.size("tokens") > 0) | F.col("bad")).withColumn("row", F.monotonically_increasing_id()))
    n, many = rows.agg(F.count("*"), F.count(F.when(F.col("bad"), 1))).first()
    least = max(min_support * n, min_count)
    if many < least:
        return empty
    own = rows.select("row", "bad", F.explode("tokens").alias("token"))
    items = settle(_items(own, least))
    met = own.join(items, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    met = rows.select("row", "bad").join(met, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<long>")), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<long>"))).alias("items"))
    kept = settle(met.where(F.size("items") > 0))
    sets = settle(FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 1e-9) / kept.count())).fit(kept).freqItemsets.select(F.sort_array("items").alias("items"), "freq"))
    bad = sets.where(F.array_contains("items", F.lit(_BAD))).select(F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("hits"))
    rules = settle(bad.join(sets, "items").select(F.xxhash64("items").alias("rule"), "items", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / n).alias("support")))
    rules = _unimplied(rules).where((F.col("confidence") >= min_confidence) & (F.col("confidence") > many / n + 1e-9))
    return settle(_named(rules, items))


def _unimplied(rules: DataFrame) -> DataFrame:
    """The rules (rule, items, confidence, support) of which no smaller one is as sure.

    Goes by size: the surest rule within another is one that lacks a single
    item, or lies within such a one. (All combinations within a frequent one
    are there.) So a rule of k items makes k probes.
    """
    most = rules.agg(F.max(F.size("items"))).first()[0] or 0
    last, out = None, []
    for size in range(1, most + 1):
        now = rules.where(F.size("items") == size)
        if last is None:
            now = now.withColumn("surest", F.lit(0.0))
        else:
            within = now.select("rule", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.xxhash64(F.filter("items", lambda _, j: j != i)))).alias("less"))
            surest = within.join(last.select(F.col("rule").alias("less"), F.greatest("confidence", "surest").alias("top")), "less").groupBy("rule").agg(F.max("top").alias("surest"))
            now = now.join(surest, "rule")
        last = settle(now)
        out.append(last.where("confidence > surest").drop("surest"))
    found = out[0] if out else rules
    for more in out[1:]:
        found = found.union(more)
    return found


def _named(rules: DataFrame, items: DataFrame) -> DataFrame:
    """(rule, tokens, confidence, support): a rule for each choice of one token from every item."""
    options = rules.select("rule", F.posexplode("items").alias("at", "item")).join(items, "item").groupBy("rule", "at").agg(F.collect_list("token").alias("tokens"))
    options = options.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("options"))
    choices = F.aggregate("options", F.array(F.array().cast("array<string>")), lambda all_, o: F.flatten(F.transform(all_, lambda x: F.transform(o["tokens"], lambda t: F.array_append(x, t)))))
    return rules.join(options, "rule").select("confidence", "support", F.explode(choices).alias("tokens")).select(F.xxhash64(F.array_sort("tokens")).alias("rule"), F.array_sort("tokens").alias("tokens"), "confidence", "support")


def match(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, rules, confidence, blocked): each distinct page, how many rules match it and the best one's confidence.

    blocked: whether a rule matches. A null or empty URL has no tokens and is
    never blocked; its confidence is null. URLs of any length are read whole.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).distinct()
    index = rules.select("rule", F.explode("tokens").alias("token"), F.size("tokens").alias("size"), F.col("confidence").alias("strength"))
    met = rows.select("id", "url", F.explode(tokens(F.col("url"))).alias("token")).join(index, "token")
    full = met.groupBy("id", "url", "rule").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("strength").alias("strength")).where("n = size")
    best = full.groupBy("id", "url").agg(F.count("*").alias("rules"), F.max("strength").alias("confidence")).toDF("m_id", "m_url", "rules", "confidence")
    out = rows.join(best, rows["id"].eqNullSafe(best["m_id"]) & rows["url"].eqNullSafe(best["m_url"]), "left")
    return out.select("id", "url", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"), "confidence", F.col("rules").isNotNull().alias("blocked"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """match() with rules mined from the labelled pages; a page is bad if its quality is 0 or it is toxic.

    Labels whose id or values are null are left out, repeated labels of a page
    count once (bad if any is), and pages with the same id and URL are one.
    Without labels, or without bad ones, nothing is blocked. An empty table of
    pages gives an empty result; other columns are ignored, whatever their names.
    """
    own = labels.select(F.col(label_id_col).alias("label_id"), ((F.col(quality_col) == 0) | (F.col(toxic_col) == 1)).alias("bad")).where("label_id is not null and bad is not null").groupBy("label_id").agg(F.max("bad").alias("bad"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).distinct()
    labelled = rows.join(own, rows["id"] == own["label_id"]).select(tokens(F.col("url")).alias("tokens"), "bad")
    return match(pages, mine(labelled, min_support, min_count, min_confidence), id_col, url_col)
