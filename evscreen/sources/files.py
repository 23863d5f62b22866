"""Small files anywhere that Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _path(spark, path)
    return fs.exists(place)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    place, fs = _path(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, fs = _path(spark, path)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def tree_hash(spark: SparkSession, folder: str) -> DataFrame:
    """One row (sha256) for a table: the hash of the names and hashes of its files, in order of their names."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.concat_ws("=", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).alias("part"))
    return parts.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("part"))), 256).alias("sha256"))


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(artifact, sha256) of the files directly in root."""
    return spark.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("artifact"), F.sha2("content", 256).alias("sha256"))
