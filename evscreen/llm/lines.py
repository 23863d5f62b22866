"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Two lines match if the Jaccard similarity of
their sets is at least threshold. A line goes if any earlier line of the
corpus, in the order of (id, line number), matches it. (Words are told apart
by codes of 39 bits in a line's set and by 64 bits where a match is verified.)

Words are ordered by rarity (counts over the whole corpus, in a table of fixed
size; ties by hash), so two matching lines share a word among the first
n - ceil(threshold * n) + 1 of each. Lines meet in the lists of these prefix
words; pairs pass the length filter, the positional filter and a parity filter
(the Hamming distance of 64-bit parities of two sets never exceeds their
symmetric difference). No filter drops a match. Equal sets are one row in the
join, so lines repeated millions of times are cheap, and sets too small to be
near any other aren't in it.

A first pass over the lists keeps the sets that have a partner at all. A second
one has their lists in the order of the corpus and emits for each set its
earliest candidate, so a group of m near copies gives m pairs. These are
verified on their words; only where a candidate fails do the later ones of its
list follow, for that set. Lists over CHUNK rows are cut into chunks, each held
against each, so that a frequent word isn't one task. The words of sets with a
partner are fetched once, by a scan that a bitmap of fixed size thins out before
an exact join.

Rows of the lists move packed, some hundreds in one, by parts of the words that
each fit a task; a task with more passes its lists on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import bitmap, discard, fresh, in_bitmap, lean, matched, settle, text_key, valid

THRESHOLD = 0.85
#: Size of the table of word counts (the counts of words that share an entry are added; any order is exact).
RARITY_BITS = 18
#: Size of the bitmap of lines to verify.
WANTED_BITS = 26
#: Bytes of text scanned at once; the temporaries take 8 for each, and at this size they stay in a core's own cache.
SLICE = 1 << 18
#: Word counts in a row, slots that hold the sets met of late, list rows that are packed at once and in a row (which bounds a batch of rows), and the most that one task matches.
SLOTS, SEEN, PACK, PACKED, PART = 1 << 10, 1 << 18, 1 << 18, 1 << 8, 1 << 20
_LINES = 17  # bits of a line's number in a sort key
_CODE = 39  # bits of a word's code in a sort key
_CHUNK = 1 << 21  # pairs compared at once
#: Rows of a word's list that one task holds, at most twice as many; and of lists whose pairs are formed at once.
CHUNK, SHORT = 1 << 13, 256


def needed(x, y, threshold: float):
    """The least overlap that lets sets of sizes x and y reach threshold."""
    return np.ceil(threshold * (x + y) / (1 + threshold) - 1e-9)


def prefix_length(n, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _line_words(w: tx.Words, rarity: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of lines with words: row, line number, first entry; and the distinct codes of all of them, the rarest word of a line first."""
    newlines = np.flatnonzero(w.data == 10)
    row = tx.row_of(w.first)
    line = np.searchsorted(newlines, w.start) + row  # each row begins a line
    base = np.searchsorted(newlines, w.bounds[:-1]) + np.arange(w.hi - w.lo)
    if not len(line):
        return
    opens = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    dense = np.cumsum(np.r_[True, line[1:] != line[:-1]]) - 1
    for lo in range(0, len(opens), 1 << _LINES):
        hi = min(len(opens), lo + (1 << _LINES))
        a, b = opens[lo], opens[hi] if hi < len(opens) else len(line)
        key = ((dense[a:b] - lo).astype(np.uint64) << np.uint64(64 - _LINES)) | (w.code[a:b] >> np.uint64(64 - _CODE))
        if rarity is not None:
            key |= rarity[(w.code[a:b] >> np.uint64(64 - RARITY_BITS)).astype(np.int64)] << np.uint64(_CODE)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        own = (key >> np.uint64(64 - _LINES)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rows = row[opens[lo:hi]]
        yield rows, line[opens[lo:hi]] - base[rows], first, key & np.uint64((1 << _CODE) - 1)


def _set_code(first: np.ndarray, code: np.ndarray) -> np.ndarray:
    return tx.mix(np.add.reduceat(tx.mix(code + np.uint64(1)), first)).view(np.int64)


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with words; at the end, rows of SLOTS word counts each."""
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    names = ["bucket", "counts", "id", "key", "line", "s"]
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for w in tx.words(batch.column(2), SLICE):
            for rows, number, first, code in _line_words(w, None):
                counts += np.bincount((code >> np.uint64(_CODE - RARITY_BITS)).astype(np.int64), minlength=len(counts))
                at = pa.array(rows + w.lo)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array(number), pa.array(_set_code(first, code))], names)
    if kind is not None:
        raw = [x.tobytes() for x in counts.reshape(-1, SLOTS)]
        none = pa.nulls(len(raw), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(raw, pa.binary()), pa.nulls(len(raw), kind), none, none, none], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of counts (bucket, counts), those of a bucket added."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[bucket] = total.get(bucket, 0) + np.frombuffer(raw.as_buffer(), np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["bucket", "counts"])


def _packed(rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, rows): list rows of 4 numbers, the word first, packed by its part, at most PACKED in a row."""
    for lo in range(0, len(rows), 1 << 22):
        some = rows[lo : lo + (1 << 22)]
        part = ((tx.mix(some[:, 0].view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        some, part = some[order], part[order]
        opens = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        place = np.arange(len(part)) - np.repeat(opens, np.diff(np.r_[opens, len(part)]))
        cut = np.flatnonzero(place % PACKED == 0)
        bounds = (np.r_[cut, len(part)] * 32).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(some)])], ["part", "rows"])


def _prefixes(rarity, threshold: float, parts: int):
    """The prefix words of each set, (word, s, sizes, parity), packed by parts of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(rarity.value, np.uint8).astype(np.uint64)
        seen = ~np.arange(SEEN)  # no number that belongs in its slot
        held, total = [], 0
        for batch in batches:
            for w in tx.words(batch.column(0), SLICE):
                for _, _, first, code in _line_words(w, table):
                    size = np.diff(np.r_[first, len(code)])
                    sets = _set_code(first, code)
                    parity = np.bitwise_xor.reduceat(np.uint64(1) << (tx.mix(code) >> np.uint64(58)), first).view(np.int64)
                    _, keep = np.unique(sets, return_index=True)
                    keep = keep[(seen[sets[keep] & (SEEN - 1)] != sets[keep]) & (size[keep] >= threshold * (size[keep] + 1) - 1e-9)]  # smaller ones match equal sets only
                    seen[sets[keep] & (SEEN - 1)] = sets[keep]  # repeats of sets that lost their slot are collapsed where the words meet
                    many = prefix_length(size[keep], threshold)
                    at = np.repeat(keep, many)
                    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    held.append(np.stack([code[first[at] + place].view(np.int64), sets[at], (size[at] << 24) | place, parity[at]], 1))
                    total += len(at)
                    if total >= PACK:
                        yield from _packed(np.concatenate(held), parts)
                        held, total = [], 0
        if total:
            yield from _packed(np.concatenate(held), parts)

    return run


def _candidates(i: np.ndarray, j: np.ndarray, n: np.ndarray, place: np.ndarray, parity: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows pass the filters of length, parity and position."""
    both, least = n[i] + n[j], needed(n[i], n[j], threshold)
    good = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
    good &= np.bitwise_count(parity[i] ^ parity[j]) <= both - 2 * least
    return good & (np.minimum(n[i] - place[i], n[j] - place[j]) >= least)


def _pairs(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with start[i] <= j < stop[i], some millions at a time."""
    many = np.maximum(stop - start, 0)
    total, lo = np.cumsum(many), 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _CHUNK, "right")))
        own = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        yield i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        lo = hi


def partnered(word: np.ndarray, s: np.ndarray, sizes: np.ndarray, parity: np.ndarray, threshold: float) -> np.ndarray:
    """The rows, each set of a word once, of sets that have a candidate in the word's list."""
    order = np.lexsort((s, word))
    order = order[np.r_[True, (word[order][1:] != word[order][:-1]) | (s[order][1:] != s[order][:-1])]] if len(order) else order
    word, n, place, parity = word[order], sizes[order] >> 24, sizes[order] & 0xFFFFFF, parity[order].view(np.uint64)
    rank = np.cumsum(np.r_[False, word[1:] != word[:-1]]) if len(word) else word
    by = np.lexsort((n, rank))
    n, place, parity, rank = n[by], place[by], parity[by], rank[by]
    key = (rank << 24) | np.minimum(n, 0xFFFFFF)
    last = np.searchsorted(key, (rank << 24) | np.minimum(np.floor(n / threshold + 1e-9).astype(np.int64), 0xFFFFFF), "right")
    some = np.zeros(len(n), bool)
    for i, j in _pairs(np.arange(len(n)) + 1, last):
        good = _candidates(i, j, n, place, parity, threshold)
        some[i[good]] = some[j[good]] = True
    return np.sort(order[by[some]])


_LIST = ["word", "s", "sizes", "parity"]


def _meet(threshold: float):
    """Of packed rows, all those of a word in one task, what partnered finds; lists over CHUNK rows whole, and all of a task that has more than PART."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, over = [], 0, False

        def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], _LIST)

        for batch in batches:
            held += [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4) for x in batch.column(0)]
            total = sum(map(len, held))
            if over or total > PART:
                over = True
                for rows in held:
                    yield from out([np.ascontiguousarray(x) for x in rows.T])
                held = []
        if not held:
            return
        rows = np.concatenate(held)
        del held
        order = np.argsort(rows[:, 0])
        columns = [rows[:, i][order] for i in range(4)]
        size = _sizes(columns[0])
        yield from out([x[size > CHUNK] for x in columns])
        columns = [x[(size > 1) & (size <= CHUNK)] for x in columns]
        opens = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]][: len(columns[0])])
        lo = 0
        while lo < len(columns[0]):  # lists of some thousand rows at once
            after = np.searchsorted(opens, lo + CHUNK)
            hi = int(opens[after]) if after < len(opens) else len(columns[0])
            some = [x[lo:hi] for x in columns]
            at = partnered(*some, threshold)
            yield from out([x[at] for x in some])
            lo = hi

    return run


def _sizes(word: np.ndarray) -> np.ndarray:
    """Of each row of ordered lists, the rows of its list."""
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(word)])
    return np.repeat(size, size)


def earliest(group: np.ndarray, n: np.ndarray, place: np.ndarray, parity: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of lists in the order of the corpus the first earlier row of its list that is a candidate; -1 for none."""
    first = np.full(len(n), len(n))
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[cut, len(n)])
    stop = np.repeat(np.where(size <= SHORT, cut + size, 0), size)
    for i, j in _pairs(np.arange(len(n)) + 1, stop):
        good = _candidates(i, j, n, place, parity, threshold)
        np.minimum.at(first, j[good], i[good])
    for a, b in zip(cut[size > SHORT], (cut + size)[size > SHORT]):
        left = np.arange(a + 1, b)
        for lo in range(a, b, 64):  # against those that have found none so far
            hi = min(b, lo + 64)
            i, j = np.repeat(np.arange(lo, hi), len(left)), np.tile(left, hi - lo)
            good = (i < j) & _candidates(i, j, n, place, parity, threshold)
            np.minimum.at(first, j[good], i[good])
            left = left[(first[left] == len(n)) & (left >= hi)]
            if not len(left):
                break
    return np.where(first < len(n), first, -1)


def _by_list(threshold: float, work):
    """Apply work to whole lists, rows (word, lo, hi, s, sizes, parity, ...) ordered by list and then by corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            group = _group(table)
            at = int(np.searchsorted(group, group[-1]))
            yield from work(table.slice(0, at), group[:at], threshold)
            held = table.slice(at).combine_chunks()
        if held is not None:
            yield from work(held, _group(held), threshold)

    return run


def _group(table: pa.Table) -> np.ndarray:
    keys = np.stack([table.column(i).to_numpy() for i in range(3)], 1)
    return np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, sizes, parity = (table.column(c).to_numpy() for c in ("s", "sizes", "parity"))
    return s, sizes >> 24, sizes & 0xFFFFFF, parity.view(np.uint64)


def _first_pairs(table: pa.Table, group: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    s, *filters = _unpacked(table)
    first = earliest(group, *filters, threshold)
    at = np.flatnonzero(first >= 0)
    if len(at):
        yield pa.RecordBatch.from_arrays([*(pa.array(table.column(i).to_numpy()[at]) for i in range(3)), pa.array(s[at]), pa.array(s[first[at]])], ["word", "lo", "hi", "s", "other"])


def _later_pairs(table: pa.Table, group: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """All candidates before the rows that are marked as failed."""
    s, *filters = _unpacked(table)
    start = np.searchsorted(group, group)
    asked = table.column("failed").to_numpy()
    stop = np.where(asked, np.arange(len(s)), 0)
    for i, j in _pairs(start, stop):
        good = _candidates(i, j, *filters, threshold)
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(s[i[good]]), pa.array(s[j[good]])], ["s", "other"])


def _line_code(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return tx.mix(doc.view(np.uint64) + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_line_code(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))], ["code"])


def _wanted_lines(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            texts = pc.fill_null(tx.as_array(batch.column(2)), "")
            data, bounds = tx.raw_bytes(texts)
            doc = batch.column(0).to_numpy()
            newlines = np.flatnonzero(data == 10)
            many = np.diff(np.searchsorted(newlines, bounds)) + 1
            row = np.repeat(np.arange(len(many)), many)
            line = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            hit = np.flatnonzero(in_bitmap(bits, _line_code(doc[row], line), WANTED_BITS))
            start, end = bounds[:-1].repeat(many), bounds[1:].repeat(many)  # a row's first line starts with it, its last one ends with it
            start[line > 0] = newlines + 1
            end[np.r_[line[1:] > 0, False]] = newlines
            row, line, start, end = row[hit], line[hit], start[hit], end[hit]
            raw = memoryview(data)
            content = pa.py_buffer(b"".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())]))
            code, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for w in tx.words(pa.Array.from_buffers(pa.large_string(), len(hit), [None, pa.py_buffer(np.cumsum(np.r_[0, end - start])), content]), SLICE):
                own = tx.row_of(w.first)
                order = np.lexsort((w.code, own))
                own, now = own[order], w.code[order]
                once = np.r_[True, (own[1:] != own[:-1]) | (now[1:] != now[:-1])][: len(now)]
                code.append(now[once])
                sizes.append(np.bincount(own[once], minlength=w.hi - w.lo))
            sets = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(code).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), batch.column(1).take(pa.array(row)), pa.array(line), sets], ["doc", "key", "line", "words"])

    return run


def _in_sets(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(raw, batch.column(0).to_numpy().view(np.uint64), WANTED_BITS)))

    return run


def _fetch(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(s, at, words), written: the words' codes of each set of firsts (s, at), from its first line."""
    doc = F.xxhash64(F.col("at.id"), F.col("at.key"))
    asked = firsts.select("s", "at", doc.alias("doc"), "at.key", "at.line")
    shared = bitmap(asked.select("doc", "line").mapInArrow(_codes, "code long"), WANTED_BITS)
    found = rows.select(F.xxhash64("id", "key").alias("doc"), "key", "text").mapInArrow(_wanted_lines(shared), "doc long, key long, line long, words array<long>")
    out = settle(found.join(asked, ["doc", "key", "line"]).dropDuplicates(["doc", "key", "line"]).select("s", "at", "words"))  # in the order of the join, so it moves nothing
    shared.destroy()
    return out


def _lists(met: DataFrame, firsts: DataFrame) -> DataFrame:
    """(word, lo, hi, s, sizes, parity, at), written: lists of words, those over CHUNK rows as pairs of chunks."""
    rows = met.join(firsts, "s").withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    chunks = settle(met.groupBy("word").count().where(F.col("count") > CHUNK).select("word", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    if not chunks.isEmpty():
        many = F.coalesce("chunks", F.lit(1))
        rows = rows.join(chunks, "word", "left").withColumn("own", F.pmod(F.xxhash64("s", "word"), many).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), many - 1)))
        rows = rows.withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")})
    return settle(rows.select("word", "lo", "hi", "s", "sizes", "parity", "at"))


def _ordered(lists: DataFrame) -> DataFrame:
    return lists.repartition("word", "lo", "hi").sortWithinPartitions("word", "lo", "hi", "at", "s").drop("at")


def _true(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(s, other, at), written: the pairs that match, and other's first line."""
    both = pairs.join(sets.select("s", "words"), "s").join(sets.select(F.col("s").alias("other"), "at", F.col("words").alias("other_words")), "other")
    both = both.withColumn("overlap", F.size(F.array_intersect("words", "other_words")))
    return settle(both.where(F.col("overlap") >= threshold * (F.size("words") + F.size("other_words") - F.col("overlap")) - 1e-9).select("s", "other", "at"))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, line, first_id, first_key, first_line): each line that goes, with the earliest line that matches it.

    Lines are numbered from 0 and end at line feeds. Lines without words, null
    and empty texts match nothing; very long ones are read whole. Bytes that
    aren't UTF-8 count as U+FFFD. Rows with equal id and text are one
    document: their equal lines are the same line. A null id comes before all
    others. An empty table gives an empty result; other columns are ignored,
    whatever their names. The result is written.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), valid(F.col(text_col)).alias("text"))
    place = [T.StructField("id", rows.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("line", T.LongType())]
    scanned = settle(rows.mapInArrow(lean(_scan_lines), T.StructType([T.StructField("bucket", T.LongType()), T.StructField("counts", T.BinaryType()), *place, T.StructField("s", T.LongType())])))
    counts = scanned.where("bucket is not null").select("bucket", "counts").mapInArrow(_added, "bucket long, counts binary")
    table = counts.repartition("bucket").mapInArrow(_added, counts.schema).toArrow()
    count = np.zeros(((1 << RARITY_BITS) // SLOTS, SLOTS), np.int64)
    for bucket, raw in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
        count[bucket] = np.frombuffer(raw, np.int64)
    rarity = np.minimum(255, 8 * np.log2(np.maximum(count.ravel(), 1))).astype(np.uint8)
    parts = 1 + int(count.sum() * (1.15 - threshold)) // PACK
    shared = spark.sparkContext.broadcast(rarity.tobytes())  # of fixed size

    prefixes = rows.select("text").mapInArrow(lean(_prefixes(shared, threshold, parts)), "part int, rows binary")
    met = settle(prefixes.repartitionById(parts, "part").select("rows").mapInArrow(lean(_meet(threshold)), "word long, s long, sizes long, parity long").distinct())
    shared.destroy()

    # Sets with a partner, and those of several lines; all others are of no more use.
    lines = scanned.where("s is not null").select("s", F.struct("id", "key", "line").alias("at"))
    asked = met.select("s").distinct().withColumn("asked", F.lit(True))
    firsts = lines.groupBy("s").agg(F.min("at").alias("at"), F.count("*").alias("n")).join(asked, "s", "left")
    firsts = settle(firsts.where("asked or n > 1").select("s", "at", "n", F.coalesce("asked", F.lit(False)).alias("asked")))
    lists = _lists(met, firsts.where("asked").select("s", "at"))
    kinds = "word long, lo int, hi int, s long, other long"
    found = settle(_ordered(lists).mapInArrow(_by_list(threshold, _first_pairs), kinds))
    sets = _fetch(rows, firsts.where("asked").select("s", "at"))  # nearly all are in a first pair, and later pairs need no more
    true = _true(found.select("s", "other").distinct(), sets, threshold)
    failed = settle(found.join(true, ["s", "other"], "left_anti").select("word", "lo", "hi", "s"))
    if not failed.isEmpty():
        again = lists.join(failed.select("word", "lo", "hi").distinct(), ["word", "lo", "hi"], "left_semi").join(failed.withColumn("failed", F.lit(True)), ["word", "lo", "hi", "s"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
        more = settle(_ordered(again.select("word", "lo", "hi", "s", "sizes", "parity", "failed", "at")).mapInArrow(_by_list(threshold, _later_pairs), "s long, other long").distinct())
        true = true.union(_true(more, sets, threshold))

    # Only lines of sets that are repeated or matched move once more.
    best = true.groupBy("s").agg(F.min("at").alias("other"))
    heads = firsts.join(best, "s", "left").where("n > 1 or other is not null").select("s", F.least("at", "other").alias("first"))
    heads = settle(heads)
    shared = bitmap(heads.select("s"), WANTED_BITS)
    some = scanned.where("s is not null").select("s", "id", "key", "line")
    some = some.mapInArrow(_in_sets(shared), some.schema).select("s", F.struct("id", "key", "line").alias("at"))
    out = some.join(heads, "s").where("at > first")
    out = settle(out.select("at.id", "at.key", "at.line", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.line").alias("first_line")).distinct())
    shared.destroy()
    discard(scanned, met, firsts, lists, heads)
    return out


def drop_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, drop_emptied: bool = True, length_col: str | None = None) -> DataFrame:
    """docs without the lines that matches finds.

    A document that loses its last word goes, unless drop_emptied is false.
    Texts that lose no line stay as they are, null and empty ones too, and
    very long ones are handled whole.
    length_col, if given, is set to the characters of a text that lost lines.
    The columns are those of docs.
    """
    gone = matches(docs, id_col, text_col, threshold).groupBy("id", "key").agg(F.collect_set(F.col("line").cast("int")).alias("gone"))
    key, left = fresh(docs, "row_key", "row_text")
    rows = docs.withColumn(key, text_key(F.col(text_col)))
    gone = gone.toDF(*fresh(rows, "gone_id", "gone_key", "gone_lines")).hint("shuffle_hash")  # a row for each document: texts needn't be sorted
    g = gone.columns
    out = matched(rows, gone, {id_col: g[0], key: g[1]}, "left")
    lost = F.col(g[2]).isNotNull()
    text = F.when(lost, F.array_join(F.filter(F.split(valid(F.col(text_col)), "\n", -1), lambda x, i: ~F.array_contains(F.col(g[2]), i)), "\n")).otherwise(F.col(text_col))
    # One row or none: a where on the new text would make it twice.
    kept = F.filter(F.array(text), lambda x: ~lost | F.lower(x).rlike("[0-9a-z\\x{80}-\\x{10FFFF}]")) if drop_emptied else F.array(text)
    out = out.withColumn(left, F.explode(kept))
    new = {text_col: F.col(left)} | ({length_col: F.when(lost, F.length(left)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
