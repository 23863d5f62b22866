"""Text normalisation and the parsing of rater replies, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RATINGS = {"E": -1, "U": 0, "I": 1}
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is worked out once, however often f has it: Spark repeats what stands in branches."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def rating_of(token: Column) -> Column:
    """The rating that a token spells, less punctuation around it; else null."""
    bare = F.upper(F.regexp_replace(token, "^[.,:;()]+|[.,:;()]+$", ""))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in RATINGS.items() for x in pair)), bare)


def parse_reply(reply: Column) -> Column:
    """struct(rating, problem) of a free-text reply.

    The whole reply counts first, then its last line with text, then its words
    if they spell exactly one rating. problem is null, 'ambiguous' or 'none'.
    """

    def parsed(own: Column) -> Column:
        lines = F.filter(F.transform(F.split(own, LINE_ENDS), strip), lambda x: x != "")
        spelled = F.array_distinct(F.filter(F.transform(F.split(own, "(?U)\\s+"), rating_of), lambda x: x.isNotNull()))
        first = F.coalesce(rating_of(own), rating_of(F.try_element_at(lines, F.lit(-1))))
        none = F.lit(None).cast("string").alias("problem")
        by_words = lambda own: F.struct(F.when(F.size(own) == 1, F.get(own, F.lit(0))).alias("rating"), F.when(F.size(own) > 1, F.lit("ambiguous")).when(F.size(own) == 0, F.lit("none")).alias("problem"))
        return bound(first, lambda x: F.when(x.isNotNull(), F.struct(x.alias("rating"), none)).otherwise(bound(spelled, by_words)))

    return bound(strip(F.coalesce(reply, F.lit(""))), parsed)


def _decision(value: Column) -> Column:
    """The rating that a variant holds."""

    def held(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        number = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        return F.when(number.isin(-1, 0, 1), number.cast("int")).when(kind == "STRING", parse_reply(text)["rating"])

    return bound(value, held)


def parse_batch_reply(reply: Column, record_id: Column) -> Column:
    """The rating that a JSON object of ids and decisions gives a record; null if it gives none.

    Decisions are strings, read as replies by parse_reply, or the whole numbers
    -1, 0 and 1; other values, a number in quotes too, give none.
    """
    return _decision(F.try_element_at(F.from_json(reply, "map<string,variant>"), record_id))


def parse_batch_replies(reply: Column, record_ids: Column) -> Column:
    """An array of struct(record_id, rating): parse_batch_reply() for each id of an array, the reply being read once."""
    each = lambda own: F.transform(record_ids, lambda x: F.struct(x.alias("record_id"), _decision(F.try_element_at(own, x)).alias("rating")))
    return bound(F.from_json(reply, "map<string,variant>"), each)
