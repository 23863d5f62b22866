"""Exact top-k search by distributed histogram selection.

Scores are cosine similarities, rounded to SCALE parts. Queries are the rows
whose id is divisible by EVERY, or all rows. Vectors are packed into blocks;
every query block is scored against every corpus block. A pass
counts each query's scores in BINS bins of its open range (BINS**4 values at first); the summed counts
locate the bin of its kth best score, which becomes the open range of the next
pass. The last pass keeps the scores from the located value on and breaks ties
by id. Each pass scores everything again; scores are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle

SCALE = 10**9
BINS = 256
BLOCK_ROWS = 2048
#: Rows with ids divisible by it are queries.
EVERY = 50
#: A query is located once at most this many times k scores lie at or above its value.
SLACK = 4
_STATE = "block long, low binary, width long, need binary, open boolean"


def scores(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    return np.rint(queries @ corpus.T * SCALE).astype(np.int64)


def _pack(dimension: int):
    def run(batches: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("n", "ascending"), ("h", "ascending")])
        block = table.column("block")[0].as_py()
        x = table.column("v").combine_chunks().values.to_numpy().reshape(-1, dimension)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([table.column("n").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])

    return run


def _matrix(raw: bytes, dimension: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dimension)


def _tiles(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[dict, np.ndarray]]:
    """A row and its scores, -2 SCALE where query and row are one vector."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        s = scores(_matrix(row["x"], dimension), _matrix(row["cx"], dimension))
        s[np.frombuffer(row["ids"], np.int64)[:, None] == np.frombuffer(row["cids"], np.int64)[None, :]] = -2 * SCALE
        yield row, s


def histogram(s: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Counts by query in BINS bins of width from low on; scores on either side of them don't count."""
    at = (s - low[:, None]) // width
    row, col = np.nonzero((at >= 0) & (at < BINS))
    return np.bincount(row * BINS + at[row, col], minlength=len(s) * BINS).astype(np.int32).reshape(len(s), BINS)


def _count(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, s in _tiles(batch, dimension):
                counts = histogram(s, np.frombuffer(row["low"], np.int64), row["width"])
                held[row["block"]] = held[row["block"]] + counts if row["block"] in held else counts
                if len(held) > 8:
                    yield from _sent(held)
                    held = {}
        yield from _sent(held)

    return run


def _sent(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for block, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pa.compress(counts.astype(np.int64).tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, group in _by_block(batches):
        total = None
        for raw, size in group:
            own = np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), np.int64)
            total = own.copy() if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """Rows of (block, counts, rows) ordered by block, as they come."""
    now, held = None, []
    for batch in batches:
        for block, raw, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if block != now and held:
                yield now, held
                held = []
            now = block
            held.append((raw, rows * BINS * 8))
            if len(held) > 64:  # sums so far stand in for their parts
                total = sum(np.frombuffer(pa.decompress(r, n, "zstd", asbytes=True), np.int64) for r, n in held)
                held = [(pa.compress(total.tobytes(), "zstd", asbytes=True), rows * BINS * 8)]
    if held:
        yield now, held


def refine(counts: np.ndarray, low: np.ndarray, width: int, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The next low of each query, how many scores its next range must give, and whether any range is open.

    need: how many of the k best lie below the end of the query's range. The
    next range is the bin of the kth best.
    """
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in this bin and beyond
    enough = above >= need[:, None]
    at = np.where(enough.any(1), BINS - 1 - enough[:, ::-1].argmax(1), 0)
    rows = np.arange(len(low))
    beyond = np.where(at + 1 < BINS, above[rows, np.minimum(at + 1, BINS - 1)], 0)
    open_ = (above[rows, at] - need > (SLACK - 1) * k) & (width > 1)
    return low + at * width, need - beyond, bool(open_.any())


def _refine(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                low, need = np.frombuffer(row["low"], np.int64), np.frombuffer(row["need"], np.int64)
                counts = np.frombuffer(row["counts"], np.int64).reshape(len(low), BINS)
                low, need, open_ = refine(counts, low, row["width"], need, k)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([low.tobytes()], pa.binary()), pa.array([max(1, row["width"] // BINS)]), pa.array([need.tobytes()], pa.binary()), pa.array([open_])], ["block", "low", "width", "need", "open"])

    return run


def _start(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(ids) // 8
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.full(n, -SCALE - 1, np.int64).tobytes()], pa.binary()), pa.array([BINS**3]), pa.array([np.full(n, k, np.int64).tobytes()], pa.binary()), pa.array([True])], ["block", "low", "width", "need", "open"])

    return run


def _keep(dimension: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, s in _tiles(batch, dimension):
                q, c = np.nonzero(s >= np.maximum(np.frombuffer(row["low"], np.int64), -SCALE - 1)[:, None])
                ids, cids, value = np.frombuffer(row["ids"], np.int64)[q], np.frombuffer(row["cids"], np.int64)[c], s[q, c]
                order = np.lexsort((cids, -value, q))
                q, ids, cids, value = q[order], ids[order], cids[order], value[order]
                opens = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
                place = np.arange(len(q)) - np.repeat(opens, np.diff(np.r_[opens, len(q)]))
                best = place < k  # of a tile no more can be among the k best
                yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(cids[best]), pa.array(value[best])], ["q", "c", "s"])

    return run


def _blocks(rows: DataFrame, dimension: int) -> DataFrame:
    """(block, ids, x): rows (n, h, v) in written blocks of about BLOCK_ROWS."""
    number = -(-rows.count() // BLOCK_ROWS)
    if not number:
        return rows.sparkSession.createDataFrame([], "block long, ids binary, x binary")
    return settle(rows.withColumn("block", F.pmod(F.xxhash64("n", "h"), F.lit(number))).groupBy("block").applyInArrow(_packed(dimension), "block long, ids binary, x binary"))


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY) -> DataFrame:
    """(id, rank, neighbor, score): the k most similar other vectors of each query, by descending score, then id.

    Queries are the rows whose id is divisible by every (all rows with 1);
    each is held against all rows. Ids must be of an integer type, others
    raise TypeError. Vectors that are null, empty, all zero, hold a null
    or NaN or infinity, or differ in length from the most frequent length (the
    shortest of those that tie) are left out, and so are null ids. Of rows
    with the same id the vector of least hash counts. With fewer than k others, there are fewer ranks.
    An empty table gives an empty result; other columns are ignored.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be positive")
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise TypeError("ids must be integers")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("n"), F.col(vector_col).cast("array<double>").alias("v")).where("n is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("v"))
    rows = rows.groupBy("n").agg(F.min(F.struct("h", "v")).alias("least")).select("n", "least.h", "least.v")
    modal = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "id long, rank int, neighbor long, score double")
    if modal is None:
        return empty
    d = modal["d"]
    rows = settle(rows.where(F.size("v") == d))
    corpus = _blocks(rows, d)
    blocks = corpus if every == 1 else _blocks(rows.where(F.pmod("n", F.lit(every)) == 0), d)
    state = settle(blocks.select("block", "ids").mapInArrow(_start(k), _STATE))
    lanes = max(1, min(corpus.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    corpus = corpus.select(F.col("ids").alias("cids"), F.col("x").alias("cx")).repartition(lanes)
    while not state.where("open").isEmpty():
        tiles = blocks.join(state.where("open"), "block").crossJoin(corpus)
        counted = tiles.select("block", "ids", "x", "low", "width", "cids", "cx").mapInArrow(_count(d), "block long, counts binary")
        sized = counted.join(blocks.select("block", (F.length("ids") / 8).cast("long").alias("rows")), "block")
        summed = sized.select("block", "counts", "rows").repartition("block").sortWithinPartitions("block").mapInArrow(_sum, "block long, counts binary")
        opened = state.where("open").drop("open").join(summed, "block").mapInArrow(_refine(k), _STATE)
        state = settle(opened.union(state.where("not open")))
    tiles = blocks.join(state, "block").crossJoin(corpus)
    kept = tiles.select("block", "ids", "x", "low", "cids", "cx").mapInArrow(_keep(d, k), "q long, c long, s long")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c")))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias("id"), "rank", F.col("c").alias("neighbor"), (F.col("s").cast("double") / float(SCALE)).alias("score"))


def _packed(dimension: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_pack(dimension)(table.to_batches())))

    return run
