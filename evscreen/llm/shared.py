"""Shared storage, row identity and small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where unset, as in tests on one machine, a new local one. A cluster without it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="evscreen-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/evscreen-{uuid.uuid4().hex}"


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system when a task ends: Python workers live on between tasks, and executors pay for what they keep."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
                if trim:
                    trim(0)

    return held


def settle(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles and broadcasts that nothing refers to any more: executors keep their files until the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let executors collect garbage, with a task for each of their cores: their heaps shrink to what is in use, and else only ever grow over a session."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).where("java_method('java.lang.System', 'gc') is not null").count()


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing needs any more, and release what made them."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for df in tables[:1]:
        release(df.sparkSession)


def bucketed(df: DataFrame, column: str) -> str:
    """The name of a table of df in the shared folder, bucketed and sorted by column: joins on it don't move it."""
    spark = df.sparkSession
    name, buckets = f"evscreen_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", shared_dir(spark)).saveAsTable(name)
    return name


def drop_tables(spark: SparkSession, *names: str) -> None:
    """Drop bucketed tables with their files."""
    for name in names:
        place = spark.sql(f"describe formatted {name}").where("col_name = 'Location'").first()[1]
        spark.sql(f"drop table {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """With the id, identifies a row; repeated rows share it and count as one document."""
    return F.xxhash64(text, F.lit(7))


def valid(text: Column) -> Column:
    """As a string; bytes that aren't UTF-8 become U+FFFD."""
    return F.make_valid_utf8(text.cast("string"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, near the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _packed_bits(batches):
    """Rows (part, slot) ordered by part: the bits of each part's slots below 2**20."""
    now, bits = None, None
    for batch in batches:
        for part in np.unique(batch.column(0).to_numpy()):
            if part != now and bits is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])
                bits = None
            now, bits = int(part), np.zeros(1 << 20, bool) if bits is None else bits
            bits[batch.column(1).to_numpy()[batch.column(0).to_numpy() == part]] = True
    if bits is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])


def bitmap(codes: DataFrame, bits: int) -> Broadcast:
    """A broadcast bitmap of 2**bits bits, those of the leading bits of the only column's 64-bit codes.

    Its size is fixed; more codes only make it pass more. What it passes is
    therefore joined exactly afterwards.
    """
    if bits < 20:
        raise ValueError("at least 20 bits")
    slots = codes.toDF("code").select(F.shiftrightunsigned("code", 64 - bits).alias("slot")).distinct()
    parts = slots.select(F.shiftright("slot", 20).alias("part"), F.col("slot").bitwiseAND((1 << 20) - 1).alias("slot"))
    table = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_packed_bits, "part long, bits binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, raw in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
        out[part << 17 : (part + 1) << 17] = np.frombuffer(raw, np.uint8)
    return codes.sparkSession.sparkContext.broadcast(out.tobytes())


def in_bitmap(raw: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """Which codes the bitmap, as bytes, may hold."""
    slot = codes >> np.uint64(64 - bits)
    return (raw[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 > 0


def matched(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str) -> DataFrame:
    """Join on pairs of columns, with null equal to null; right's other names must be new to left."""
    on = [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[right[b] for b in pairs.values()])
