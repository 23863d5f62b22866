"""The corpus pipeline: documents in, a deduplicated, decontaminated, reweighted training mix out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
documents. Each begins by letting the executors give back what the garbage of
its predecessor holds. run() applies them to the documents of sf_dir, writing
each stage's result to the shared folder and reading it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evscreen.llm import decontaminate, langid, lines, mixing, simhash
from evscreen.llm.shared import relieve, settle

#: Language ID and SimHash can't be expressed in SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with at least langid.MIN_CONFIDENCE; those without letters go."""
    relieve(spark)
    out = langid.identify(docs, keep=docs.columns)
    return out.where(out[out.columns[-1]]).select(*[out[f"`{c}`"] for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that match an earlier one, and without documents of which no word is left; n_chars follows."""
    relieve(spark)
    return lines.drop_matches(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    relieve(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that copy an item of the benchmark."""
    relieve(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their target weights; adds copy_no."""
    relieve(spark)
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
