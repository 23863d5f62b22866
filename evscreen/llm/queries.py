"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, lines, mixing, pii, repeats, simhash, topk, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")).withColumnRenamed("id", "page_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_matches(_read(spark, sf_dir, "documents"), length_col="n_chars")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("source_id").alias("source_doc_id"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "end_word")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("key")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("kept_id").alias("kept_doc_id"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mix": op2_source_mix,
    "op3_top_k": op3_top_k,
    "op4_line_dedup": op4_line_dedup,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_decontaminate": op6_decontaminate,
    "op7_licenses": op7_licenses,
    "op8_language_id": op8_language_id,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_pseudonyms": op10_pseudonyms,
}

_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mixing.WEIGHTS.items()) + f" ELSE {mixing.DEFAULT_WEIGHT} END"

ORACLES: dict[str, str] = {
    "op2_source_mix": f"""
WITH sized AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')))::BIGINT AS tokens FROM documents GROUP BY source
), weighed AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN {_WEIGHT} ELSE 0 END AS weight FROM sized
), rated AS (
  SELECT source, CASE WHEN tokens = 0 THEN 1.0::DOUBLE WHEN sum(weight) OVER () = 0 THEN 0.0::DOUBLE
    ELSE weight::DOUBLE * (sum(tokens) OVER ())::DOUBLE / ((sum(weight) OVER ())::DOUBLE * tokens::DOUBLE) END AS rate FROM weighed
), drawn AS (
  SELECT d.*, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS many
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, many + 1))::INTEGER AS copy_no FROM drawn""",
    "op3_top_k": f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
), scored AS (
  SELECT a.vec_id, b.vec_id AS neighbor, round(list_dot_product(a.e, b.e) / (a.size * b.size), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {topk.EVERY} = 0
)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor)::INTEGER AS rank, neighbor, score FROM scored QUALIFY rank <= 10""",
    "op4_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), w AS (
  SELECT doc_id, n, line, list_sort(list_distinct(regexp_extract_all(lower(line), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'))) AS ws FROM l
), s AS (
  SELECT row_number() OVER () AS s, ws, len(ws) AS size, first FROM (SELECT ws, min({{'d': doc_id, 'n': n}}) AS first FROM w WHERE len(ws) > 0 GROUP BY ws)
), u AS (SELECT s, size, first, unnest(ws) AS word FROM s
), c AS (SELECT word, count(*) AS c FROM u GROUP BY word
), p AS (
  SELECT s, size, first, word FROM u JOIN c USING (word) QUALIFY row_number() OVER (PARTITION BY s ORDER BY c, word) <= size - ceil({lines.THRESHOLD} * size - 1e-9) + 1
), pairs AS (
  SELECT DISTINCT x.s AS late, y.s AS early FROM p x JOIN p y ON x.word = y.word AND y.first < x.first AND least(x.size, y.size) >= {lines.THRESHOLD} * greatest(x.size, y.size) - 1e-9
), matched AS (
  SELECT late AS s, min(y.first) AS other FROM pairs JOIN s x ON x.s = late JOIN s y ON y.s = early
  WHERE len(list_intersect(x.ws, y.ws)) >= {lines.THRESHOLD} * (x.size + y.size - len(list_intersect(x.ws, y.ws))) - 1e-9 GROUP BY late
), kept AS (
  SELECT doc_id, n, line, coalesce(coalesce(least(other, first), first) < {{'d': doc_id, 'n': n}}, false) AS gone FROM w LEFT JOIN s USING (ws) LEFT JOIN matched USING (s)
), made AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS new FROM kept GROUP BY doc_id HAVING bool_or(gone)
)
SELECT doc_id, coalesce(new, text) AS text, lang, source, CASE WHEN new IS NULL THEN n_chars ELSE length(new) END AS n_chars FROM documents LEFT JOIN made USING (doc_id)
WHERE new IS NULL OR regexp_matches(lower(new), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]')""",
    "op5_repeated_passages": f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents
), r AS (
  SELECT doc_id, unnest(range(0, len(words) - {repeats.LENGTH} + 1)) AS start, words FROM w WHERE len(words) >= {repeats.LENGTH}
), h AS (
  SELECT doc_id, start, md5(array_to_string(words[start + 1 : start + {repeats.LENGTH}], ' ')) AS run FROM r
), s AS (
  SELECT doc_id, start, min(doc_id) OVER (PARTITION BY run) AS source FROM h
), l AS (
  SELECT doc_id, start, source, CASE WHEN start > lag(start) OVER (PARTITION BY doc_id ORDER BY start) + {repeats.LENGTH} THEN 1 ELSE 0 END AS opens FROM s WHERE source <> doc_id
), i AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM l
)
SELECT doc_id, min(start)::BIGINT AS start_word, (max(start) + {repeats.LENGTH})::BIGINT AS end_word, min(source) AS source_doc_id FROM i GROUP BY doc_id, span""",
}
