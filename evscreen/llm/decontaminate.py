"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

All word n-grams of a test item are seeds. Their size is chosen so that every
alignment of min_score keeps some of them intact, whatever the edits, and how
many it keeps, within how many words, says which passages have to be aligned
with the item word by word; an item whose share of the best possible score
reaches min_score was copied, edits included. Nothing that would reach it is
left out.

What a scan of the corpus carries along are the items themselves, in parts of
about ITEM_CHARS characters; each part is a scan, and no text is moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import fresh, matched, settle, text_key, valid

GRAM = 3
MIN_SCORE = 0.6
BITMAP_BITS = 24
#: Of a part of the items; and of seeds in texts, with each item that owns them, that are held at once unless one text has more.
ITEM_CHARS, HITS_AT_ONCE = 1 << 21, 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and where it ends in passage (one past its last word), the first if there are several."""
    n = len(passage)
    steps = np.arange(n + 1) * GAP
    before = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for code in item:
        now = np.zeros(n + 1, np.int64)
        now[1:] = np.maximum(before[:-1] + np.where(passage == code, MATCH, MISMATCH), before[1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now - steps) + steps  # gaps in item
        top = int(now.argmax())
        if now[top] > best:
            best, end = int(now[top]), top
        before = now
    return best, end


def seed_rule(words: int, gram: int, least: float) -> tuple[int, int]:
    """(size, number): the longest seeds, of gram words at most, and how many of them any alignment of an item of so many words keeps intact.

    With m matches and p mismatches and gaps, 2m - p >= 2 * least * words. The
    matches lie in p + 1 runs at most, and a run of r words has r - size + 1
    intact seeds, so m - (size - 1)(2m - 2 * least * words + 1) remain at
    least; that falls with m, which is at most words.
    """
    for size in range(gram, 1, -1):
        number = math.ceil(words * (1 - 2 * (size - 1) * (1 - least)) - (size - 1) - 1e-9)
        if number >= 1:
            return size, number
    return 1, max(1, math.ceil(least * words - 1e-9))


class Index:
    """Some items, the seeds of each, and how long a passage an alignment with it can cover."""

    def __init__(self, names: pa.Array, codes: list[np.ndarray], gram: int, least: float):
        self.names, self.codes, self.gram, self.least = names, codes, gram, least
        rules = [seed_rule(len(c), gram, least) for c in codes]
        self.number = np.array([n for _, n in rules], np.int64)
        self.size = np.array([k for k, _ in rules], np.int64)
        self.reach = np.array([int(len(c) * (3 - 2 * least) + 1e-9) for c in codes], np.int64)
        self.tables = {}
        for size in sorted(set(self.size.tolist())):
            owners = np.flatnonzero(self.size == size)
            grams = [np.unique(tx.rolling(codes[i], size)) for i in owners]
            owner, grams = np.repeat(owners, [len(g) for g in grams]), np.concatenate(grams)
            order = np.argsort(grams, kind="stable")
            distinct, first = np.unique(grams[order], return_index=True)
            slots = np.zeros(1 << BITMAP_BITS, bool)
            slots[(distinct >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
            self.tables[size] = np.packbits(slots), distinct, np.r_[first, len(grams)], owner[order]
        self.bitmaps: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"bitmaps": {}}

    def hits(self, w: tx.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, first word) of each seed in a text, ordered so, for some rows at a time."""
        long = np.diff(w.first) >= self.gram
        for size, (packed, distinct, first, owner) in self.tables.items():
            if size not in self.bitmaps:
                self.bitmaps[size] = np.unpackbits(packed).view(bool)
            at, code = _hits(w, size, self.bitmaps[size])
            seed = np.minimum(np.searchsorted(distinct, code), len(distinct) - 1)
            row = np.searchsorted(w.first, at, "right") - 1
            true = (distinct[seed] == code) & long[row]
            at, seed, row = at[true], seed[true], row[true]
            count = first[seed + 1] - first[seed]
            total = np.r_[0, np.cumsum(count)]
            cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else np.zeros(1, np.int64)
            lo = 0
            while lo < len(cut) - 1:
                hi = max(lo + 1, int(np.searchsorted(total[cut], total[cut[lo]] + HITS_AT_ONCE, "right")) - 1)
                a, b = cut[lo], cut[hi]
                own = np.repeat(np.arange(a, b), count[a:b])
                item = owner[first[seed[own]] + np.arange(len(own)) - (total[own] - total[a])]
                order = np.lexsort((at[own], item, row[own]))
                yield row[own][order], item[order], at[own][order]
                lo = hi

    def passages(self, w: tx.Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, word after the last): where an alignment that is good enough can lie."""
        for row, item, at in self.hits(w):
            number, reach, size = self.number[item], self.reach[item], self.size[item]
            last = np.arange(len(at)) + number - 1
            fits = np.flatnonzero(last < len(at))
            last = last[fits]
            end = at[last] + size[fits]
            near = (row[last] == row[fits]) & (item[last] == item[fits]) & (end - at[fits] <= reach[fits])
            fits, end = fits[near], end[near]
            row, item = row[fits], item[fits]
            lo, hi = np.maximum(end - reach[fits], w.first[row]), np.minimum(at[fits] + reach[fits], w.first[row + 1])
            cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])]) if len(fits) else fits
            for a, b in zip(cut, np.r_[cut[1:], len(fits)]):
                yield int(row[a]), int(item[a]), int(lo[a]), int(hi[b - 1])


def _hits(w: tx.Words, size: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and codes of the n-grams within a text that are in the bitmap."""
    code = tx.rolling(w.code, size)
    at = np.flatnonzero(bitmap.take((code >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)))
    row = tx.row_of(w.first)
    at = at[row[at] == row[at + size - 1]]
    return at, code[at]


def _aligner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            rows, items, scores, ends = [], [], [], []
            for w in tx.words(batch.column(2)):
                for row, i, lo, hi in index.passages(w):
                    item, passage = index.codes[i], w.code[lo:hi]
                    if np.isin(item, passage).sum() < index.least * len(item) - 1e-9:  # even if all of them matched
                        continue
                    best, at = align(item, passage)
                    rows.append(w.lo + row)
                    items.append(i)
                    scores.append(best / (MATCH * len(item)))
                    ends.append(lo + at - w.first[row])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), index.names.take(pa.array(items, pa.int64())), pa.array(scores, pa.float64()), pa.array(ends, pa.int64())], ["id", "key", "item", "score", "end_word"])

    return run


def _index(items: pa.Table, gram: int, least: float) -> Index:
    codes = [w.code[w.first[i] : w.first[i + 1]] for w in tx.words(items.column(1)) for i in range(w.hi - w.lo)]
    long = np.flatnonzero([len(c) >= gram for c in codes])
    return Index(tx.as_array(items.column(0)).take(pa.array(long, pa.int64())), [codes[i] for i in long], gram, least)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, key, item, score, end_word): documents that copy a test item, with the best alignment of each pair.

    Items and texts with fewer than gram words, null and empty ones included,
    never match; very long ones are scanned whole, and bytes that aren't UTF-8
    count as U+FFFD. Rows with equal id and text are one document, items with
    equal item_col share one row with their best score. An empty table on
    either side gives an empty result; other columns are ignored, whatever
    their names. The result is written.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), valid(F.col(text_col)).alias("text"))
    items = settle(benchmark.select(F.col(item_col).alias("item"), valid(F.col(item_text_col)).alias("item_text")).where("item_text is not null").distinct())
    parts = -(-(items.agg(F.sum(F.length("item_text"))).first()[0] or 0) // ITEM_CHARS) or 1
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("item", items.schema["item"].dataType), T.StructField("score", T.DoubleType()), T.StructField("end_word", T.LongType())])
    scored, given = spark.createDataFrame([], out), []
    for part in range(parts):
        index = _index(items.where(F.pmod(F.xxhash64("item_text"), F.lit(parts)) == part).toArrow(), gram, min_score)
        if index.codes:
            given.append(spark.sparkContext.broadcast(index))  # about ITEM_CHARS characters, whatever the benchmark
            scored = scored.union(rows.mapInArrow(_aligner(given[-1]), out))
    best = scored.where(F.col("score") >= min_score).groupBy("id", "key", "item").agg(F.min(F.struct((-F.col("score")).alias("s"), "end_word")).alias("b"))
    found = settle(best.select("id", "key", "item", (-F.col("b.s")).alias("score"), F.col("b.end_word").alias("end_word")))
    for index in given:
        index.destroy()
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that leaks finds; the columns are those of docs, and rows without text stay."""
    gone = leaks(docs, benchmark, id_col, text_col, **options).select("id", "key").distinct()
    key = fresh(docs, "row_key")[0]
    rows = docs.withColumn(key, text_key(F.col(text_col)))
    gone = gone.toDF(*fresh(rows, "gone_id", "gone_key"))
    out = matched(rows, gone, {id_col: gone.columns[0], key: gone.columns[1]}, "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
