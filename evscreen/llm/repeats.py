"""Passages that repeat across documents, by a logarithmic family of sparse suffix arrays.

Suffixes start at anchors: in every run of LENGTH words the least of its
ANCHOR-word codes. Equal runs have equal anchors, so each repeated run holds
an anchor of all its occurrences. A suffix is compared by the codes of its
first HEAD words and of the words up to ANCHOR, packed in one number, which
orders suffixes block by block.

Batches of documents arrive one after another. A batch gets a suffix array,
sorted and bucketed by suffix; a merge-scan with each existing level finds the
suffixes they share for at least ANCHOR words; two levels of the same size
class merge into one of the next. So n batches leave about log2(n) levels, and
a suffix is rewritten as often. What the scans found is then verified on the
words: every run of LENGTH words around a shared anchor is compared by its
code, and the runs that an earlier document has are joined to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import bucketed, discard, drop_tables, release, settle, text_key, valid

LENGTH, ANCHOR, HEAD = 50, 20, 8
BATCHES = 4
#: Passes over the runs, each over those of its share of codes, so that only as large a share is shuffled at once.
PASSES = 4
_BLOCK = 1 << 20  # words handled at once


def anchors(code: np.ndarray, row: np.ndarray, length: int = LENGTH, gram: int = ANCHOR) -> np.ndarray:
    """Positions of the anchors of all runs of length words that lie in one row."""
    out = []
    reach = length - gram + 1
    for lo in range(0, max(len(code) - length + 1, 0), _BLOCK - length + 1):
        own = code[lo : lo + _BLOCK]
        value = (tx.rolling(own, gram) & ~np.uint64(_BLOCK - 1)) | np.arange(len(own) - gram + 1, dtype=np.uint64)
        least, span = value, 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        at = lo + np.arange(len(least))
        good = row[at] == row[at + length - 1]
        out.append(lo + np.unique((least[good] & np.uint64(_BLOCK - 1)).astype(np.int64)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def suffix_codes(code: np.ndarray, at: np.ndarray, gram: int = ANCHOR, head: int = HEAD) -> np.ndarray:
    """Codes of the suffixes at the positions at: the code of the first words, then that of the words up to gram."""
    first, rest = tx.rolling(code, head), tx.rolling(code, gram - head)
    return ((first[at] & ~np.uint64(0xFFFFFFFF)) | (rest[at + head] >> np.uint64(32))).view(np.int64)


def _suffixes(length: int, gram: int, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, suffixes, places = [], [], []
            for w in tx.words(batch.column(2)):
                row = tx.row_of(w.first)
                at = anchors(w.code, row, length, gram)
                if len(at):
                    rows.append(row[at] + w.lo)
                    suffixes.append(suffix_codes(w.code, at, gram, head))
                    places.append(at - w.first[row[at]])
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(suffixes) if rows else np.zeros(0, np.int64)), batch.column(1).take(take), pa.array(np.concatenate(places) if rows else np.zeros(0, np.int64))], ["batch", "suffix", "key", "place"])

    return run


class SuffixFamily:
    """Levels of suffix arrays in the shared folder. A level is a table (suffix, key, place), bucketed and sorted by suffix."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.hits = spark, [], []

    def add(self, batch: DataFrame) -> None:
        """Index a batch (suffix, key, place), and keep the suffixes that it shares with other documents."""
        name = bucketed(batch, "suffix")
        new = self.spark.table(name)
        inside = new.groupBy("suffix").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        found = inside.where("low <> high").select("suffix")
        for _, old in self.levels:
            theirs = self.spark.table(old).groupBy("suffix").agg(F.min("key").alias("old_low"), F.max("key").alias("old_high"))
            found = found.union(inside.join(theirs, "suffix").where("low <> old_low or high <> old_high").select("suffix"))
        self.hits.append(settle(found.distinct()))
        self.levels.append((0, name))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (_, a), (rank, b) = self.levels.pop(), self.levels.pop()
            merged = bucketed(self.spark.table(a).union(self.spark.table(b)), "suffix")
            drop_tables(self.spark, a, b)
            self.levels.append((rank + 1, merged))
        release(self.spark)

    def shared(self) -> DataFrame:
        """(key, place): the anchors whose suffix another document has; written, so that the levels can be dropped."""
        hits = self.hits[0]
        for more in self.hits[1:]:
            hits = hits.union(more)
        hits = hits.distinct()
        parts = [self.spark.table(name).join(hits, "suffix", "left_semi").select("key", "place") for _, name in self.levels]
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
        out = settle(out.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places")))
        drop_tables(self.spark, *(name for _, name in self.levels))
        discard(*self.hits)
        self.levels, self.hits = [], []
        return out


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(3)
            for w in tx.words(batch.column(2)):
                code = tx.rolling(w.code, length)
                rows, starts = [], []
                for i in range(w.hi - w.lo):
                    a, last = w.first[i], w.first[i + 1] - length
                    if last < a:
                        continue
                    at = places[w.lo + i].values.to_numpy()
                    flags = np.zeros(last - a + 2, np.int64)
                    lo = np.minimum(np.maximum(at - (length - gram), 0), last - a + 1)
                    np.add.at(flags, lo, 1)
                    np.add.at(flags, np.minimum(at, last - a) + 1, -1)
                    near = np.flatnonzero(np.cumsum(flags)[:-1] > 0)
                    rows.append(np.full(len(near), w.lo + i))
                    starts.append(near)
                if rows:
                    row, start = np.concatenate(rows), np.concatenate(starts)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(code[w.first[row - w.lo] + start].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(start)], ["run", "id", "key", "start"])

    return run


def _later(runs: DataFrame) -> DataFrame:
    """(id, key, start, source): the runs that an earlier document has, with the least that has them; read from written tables."""
    document = F.struct("id", "key")
    out = None
    for i in range(PASSES):
        share = runs.where(F.pmod("run", F.lit(PASSES)) == i)
        # Partial minima and a join, which splits hot keys: a passage of millions of documents isn't one task.
        first = share.groupBy("run").agg(F.min(document).alias("source"), F.max(document).alias("last")).where(~F.col("source").eqNullSafe(F.col("last"))).drop("last")
        later = settle(share.join(first, "run").where(~document.eqNullSafe(F.col("source"))).select("id", "key", "start", "source"))
        out = later if out is None else out.union(later)
        del share, first
        release(runs.sparkSession)
    return out.groupBy("id", "key", "start").agg(F.min("source").alias("source"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES, anchor: int = ANCHOR, head: int = HEAD) -> DataFrame:
    """(id, key, start_word, end_word, source_id): spans of words that an earlier document has too, in runs of length words.

    A span is a maximal stretch of words in runs of length words that occur in
    a document before, by (id, hash of the text), a null id coming first;
    source_id is the least such document of its runs. Rows with equal id and
    text are one document, and repeats within one document don't count. Null,
    empty and shorter texts give nothing, as does an empty table; very long
    ones are indexed whole, and bytes that aren't UTF-8 count as U+FFFD. Other
    columns are ignored, whatever their names.
    """
    if not 0 < head < anchor <= length:
        raise ValueError("0 < head < anchor <= length must hold")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), valid(F.col(text_col)).alias("text"))
    schema = "batch int, suffix long, key long, place long"
    entries = settle(rows.select(F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"), "doc", "text").mapInArrow(_suffixes(length, anchor, head), schema))
    family = SuffixFamily(docs.sparkSession)
    for i in range(batches):
        family.add(entries.where(F.col("batch") == i).select("suffix", "key", "place"))
    places = family.shared()
    discard(entries)
    del family, entries
    shared = places.select(F.col("key").alias("doc_"), "places")
    found = rows.join(shared, rows["doc"] == shared["doc_"]).select("id", text_key(F.col("text")).alias("key"), "text", "places")
    runs = settle(found.mapInArrow(_runs(length, anchor), T.StructType([T.StructField("run", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("start", T.LongType())])))
    del shared, found
    discard(places)
    later = _later(runs)
    discard(runs)
    own = Window.partitionBy("id", "key").orderBy("start")
    opens = F.coalesce(F.col("start") > F.lag("start").over(own) + length, F.lit(True)).cast("int")
    spans = later.withColumn("opens", opens).withColumn("span", F.sum("opens").over(own))
    return spans.groupBy("id", "key", "span").agg(F.min("start").alias("start_word"), (F.max("start") + length).alias("end_word"), F.min("source").alias("source")).select("id", "key", "start_word", "end_word", F.col("source.id").alias("source_id"))
