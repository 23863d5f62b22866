"""Near-duplicate documents by SimHash and pigeonhole blocks.

Each text gets a fingerprint of blocks x block_bits bits: the signs of a
random projection of its distinct words, each weighted by how few documents of
the corpus have it (so texts of one language don't look alike for their common
words). Fingerprints are split into blocks, in ARRANGEMENTS different orders
of their bits, and rows meet by (block, value): pairs that differ in fewer
bits than there are blocks always meet, and of the pairs at max_distance itself
over 0.9 do (closer ones more often), which the tests hold against drawn pairs
at each distance and against brute force. Pairs that meet are verified by the
Hamming distance of whole fingerprints, and by that of a second fingerprint,
of runs of words: very long texts of one language are near in words, though
they share few runs. Groups are connected components.

Exact copies are collapsed to one fingerprint first, so a text repeated
millions of times costs one row. To the blocks go a number of each fingerprint
and SKETCH bits of it. In a block of FEW rows at most, pairs whose sketches are
near go on to be verified; in a larger one, whole fingerprints are fetched and
linked by breadth-first search, which for a group of m mutual copies takes
about m comparisons. Blocks over CHUNK rows are cut into chunks, each held
against each, so that no task has more than two of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import discard, fresh, lean, matched, release, settle, text_key, valid

#: Entries of the table of word weights; words are hashed to them.
FEATURES = 1 << 16
BLOCKS, BLOCK_BITS, MAX_DISTANCE = 42, 24, 151
#: How often the bits are split into blocks, each time in another order: so often that a pair at MAX_DISTANCE meets with a probability over 0.9.
ARRANGEMENTS = 3

#: Bits that go along to the blocks. Of a pair at max_distance more than SKETCH_LIMIT of them differ with a probability of about 1e-6 (the share in the test).
SKETCH, SKETCH_LIMIT = 64, 24
FEW, CHUNK = 8, 4096
#: Fingerprints that the exact search holds at once against as many others, values that it looks up and pairs that it verifies at once.
HELD, LOOKED_UP, AT_ONCE = 1 << 19, 1 << 15, 1 << 17

#: Copies also agree in their runs of words: by a second fingerprint, of SHINGLE_BITS bits and runs of SHINGLE words, of which at most MAX_SHINGLE_DISTANCE differ.
SHINGLE, SHINGLE_BITS, MAX_SHINGLE_DISTANCE = 3, 256, 102



_KEYS = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64)


def _signs(code: np.ndarray, bits: int) -> np.ndarray:
    """The signs of words or runs, a row of 0 and 1 for each: hashes of their codes, so there is no table of them."""
    return np.unpackbits(tx.mix(code[:, None] ^ _KEYS[: -(-bits // 64)]).astype("<u8", copy=False).view(np.uint8), axis=1)[:, :bits]


def weights(found: np.ndarray, texts: int) -> np.ndarray:
    """The weight of each entry, from how many of so many texts have it: the logarithm (of base 2) of the inverse share, 1 at least."""
    return np.maximum(1, np.rint(np.log2((1 + texts) / (1 + found)))).astype(np.uint8)


def fingerprint_words(code: np.ndarray, bits: int, weight: np.ndarray | None = None) -> bytes:
    """The fingerprint of one text, from its words' codes; all weigh the same if weight is None."""
    code = np.unique(code)
    own = weight[(code % np.uint64(FEATURES)).astype(np.int64)] if weight is not None else np.ones(len(code), np.uint8)
    ones = np.zeros(bits)
    for lo in range(0, len(code), 1024):  # single precision is exact for sums of so many small whole numbers
        ones += own[lo : lo + 1024].astype(np.float32) @ _signs(code[lo : lo + 1024], bits).astype(np.float32)
    return np.packbits(2 * ones > own.sum(dtype=np.int64)).tobytes()


def shingle_print(code: np.ndarray) -> bytes:
    """The fingerprint of one text's distinct runs of SHINGLE words (of its words, if it has fewer), from its words' codes."""
    value = np.unique(tx.rolling(code, min(SHINGLE, len(code))))
    ones = np.zeros(SHINGLE_BITS, np.int64)
    for lo in range(0, len(value), 255):  # 255 ones fit a byte
        ones += np.add.reduce(_signs(value[lo : lo + 255], SHINGLE_BITS), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(value)).tobytes()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, n): in how many texts a feature is; under -1 the texts that have words."""
    seen, texts = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for w in tx.words(batch.column(0)):
            pairs = np.unique(tx.row_of(w.first) * FEATURES + (w.code % np.uint64(FEATURES)).astype(np.int64))
            seen += np.bincount(pairs % FEATURES, minlength=FEATURES)
            texts += int((np.diff(w.first) > 0).sum())
    if texts:
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[texts, seen[at]])], ["feature", "n"])


def corpus_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """weights() over all rows of docs; a table of FEATURES numbers, whatever the corpus."""
    found = docs.select(valid(F.col(text_col))).mapInArrow(lean(_features), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = (found.column(i).to_numpy() for i in range(2))
    seen = np.zeros(FEATURES, np.int64)
    seen[feature[feature >= 0]] = n[feature >= 0]
    return weights(seen, int(n[feature < 0].sum()))


def _fingerprinter(bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            out: list[bytes | None] = []
            runs: list[bytes | None] = []
            for w in tx.words(batch.column(2)):
                for i in range(w.hi - w.lo):
                    a, b = w.first[i], w.first[i + 1]
                    out.append(fingerprint_words(w.code[a:b], bits, weight) if b > a else None)
                    runs.append(shingle_print(w.code[a:b]) if b > a else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(runs, pa.binary())], ["id", "key", "fp", "runs"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BLOCKS * BLOCK_BITS) -> DataFrame:
    """(id, key, fp, runs), written: the fingerprints of the words and of the runs of words of each row that has words."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), valid(F.col(text_col)).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("key", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("runs", T.BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast(corpus_weights(docs, text_col).tobytes())  # of fixed size
    out = settle(rows.mapInArrow(lean(_fingerprinter(bits, shared)), schema).where("fp is not null"))
    shared.destroy()
    return out


def block_values(fp: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """Of fingerprints (rows of bytes) the numbers of their blocks, the block's place included, for every arrangement."""
    bits = np.unpackbits(fp, axis=1)[:, : blocks * width]
    power, every = (1 << np.arange(width)).astype(np.float64), blocks * ARRANGEMENTS
    order = [np.arange(blocks * width), *(np.random.default_rng(20 + i).permutation(blocks * width) for i in range(1, ARRANGEMENTS))]
    value = np.concatenate([bits[:, o].reshape(len(fp) * blocks, width).astype(np.float64).dot(power).reshape(len(fp), blocks) for o in order], axis=1)
    return value.astype(np.int64) * every + np.arange(every)


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A binary column of values of one length, as rows of bytes."""
    column = tx.as_array(column)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].reshape(len(column), -1)


def _blocks(blocks: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fp = _rows(part.column(1))
                value = block_values(fp, blocks, width)
                sketch = np.zeros((len(fp), SKETCH // 8), np.uint8)
                sketch[:, : fp.shape[1]] = fp[:, : SKETCH // 8]
                node = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(value.ravel()), pa.array(np.repeat(node, value.shape[1])), pa.array(np.repeat(sketch.view(np.int64)[:, 0], value.shape[1]))], ["bucket", "node", "sketch"])

    return run


def _meet(limit: int):
    """Of rows (bucket, node, sketch) ordered by bucket: (a, b, null), pairs of small buckets with near sketches; (node, null, bucket), the rows of large ones."""

    def pairs(bucket: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for step in range(1, FEW):
            i = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(i):
                break
            i = i[np.bitwise_count((sketch[i] ^ sketch[i + step]).view(np.uint64)) <= limit]  # of signed numbers it would count the absolute value's
            a.append(np.minimum(node[i], node[i + step]))
            b.append(np.maximum(node[i], node[i + step]))
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "bucket"])

    def large(bucket: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(bucket)], ["a", "b", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        over = None  # the bucket that is known to be large
        for batch in batches:
            bucket, node, sketch = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held))
            if not len(bucket):
                continue
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[cut, len(bucket)])
            many = np.repeat(size, size)
            big = (many > FEW) | (bucket == (bucket[0] - 1 if over is None else over))
            last = np.arange(len(bucket)) >= cut[-1]
            yield from large(bucket[big], node[big])
            some = ~big & ~last & (many > 1)
            yield from pairs(bucket[some], node[some], sketch[some])
            over = int(bucket[-1]) if big[-1] else None
            wait = last & ~big
            held = [bucket[wait], node[wait], sketch[wait]]
        if len(held[0]) > 1:
            yield from pairs(*held)

    return run


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether rows (the bytes of both fingerprints) are copies: within most bits in words, and near in runs."""
    apart, tail = np.bitwise_count(x ^ y), SHINGLE_BITS // 8
    return (apart[:, :-tail].sum(axis=1, dtype=np.int64) <= most) & (apart[:, -tail:].sum(axis=1, dtype=np.int64) <= MAX_SHINGLE_DISTANCE)


def link(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of copies among rows of fp (the bytes of both fingerprints)."""
    left, edges = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(fp[left], fp[at], most)
            edges += [(int(at), int(x)) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return edges


def _verifier(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pa.array(np.flatnonzero(_near(_rows(batch.column(2)), _rows(batch.column(3)), most)))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(near) for i in range(2)], ["u", "v"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in their first columns."""
    held: list[pa.Table] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(columns)], 1)
        cut = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for a, b in zip(cut[:-1], cut[1:]):
            if held and tuple(keys[a]) != now:
                yield pa.concat_tables(held)
                held = []
            now = tuple(keys[a])
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)


def _linker(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            node = group.column("node").to_numpy()
            edges = np.array(link(_rows(group.column("both")), most), np.int64).reshape(-1, 2)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], ["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex but the least of its component, with that least vertex.

    edges has columns u and v of any orderable type. Alternates large-star and
    small-star steps until nothing changes, in about log^2 rounds; every
    round's table is written to the shared folder. Least neighbours are
    partial sums joined back, so the edges of a hub may be split.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old = now
        now = settle(least.toDF("u", "v").union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        discard(old, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = state


def links(distinct: DataFrame, blocks: int, block_bits: int, max_distance: int) -> DataFrame:
    """(u, v): links between different fingerprints, rows (node, fp, both), that hold their groups together."""
    limit = SKETCH_LIMIT if max_distance * SKETCH >= SKETCH_LIMIT * 2 else SKETCH  # no sketch loses what the blocks guarantee
    buckets = distinct.select("node", "fp").mapInArrow(_blocks(blocks, block_bits), "bucket long, node long, sketch long")
    met = settle(buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(limit), "a long, b long, bucket long"))
    pairs = met.where("b is not null").select("a", "b").distinct()
    pairs = pairs.join(distinct.select(F.col("node").alias("a"), F.col("both").alias("x")), "a").join(distinct.select(F.col("node").alias("b"), F.col("both").alias("y")), "b")
    edges = pairs.select("a", "b", "x", "y").mapInArrow(_verifier(max_distance), "u long, v long")
    crowded = met.where("b is null").select("bucket", F.col("a").alias("node")).withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    sizes = settle(crowded.groupBy("bucket").count().where(F.col("count") > CHUNK).select("bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    if not sizes.isEmpty():
        cut = crowded.join(sizes, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.coalesce("chunks", F.lit(1))).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        crowded = cut.select("bucket", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    groups = crowded.join(distinct.select("node", "both"), "node").select("bucket", "lo", "hi", "node", "both")
    groups = groups.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")
    return edges.union(groups.mapInArrow(_linker(max_distance), "u long, v long"))


def parts(bits: int, most: int, rows: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of parts of fingerprints: two that differ in most bits at most lie within its radius in one part at least.

    Radii plus one sum up to most + 1, so a pair beyond each of them differs in
    more bits. The width is the cheapest for so many rows, by the values to
    look up and the pairs that agree by chance.
    """

    def split(width: int) -> list[tuple[int, int, int]]:
        n = bits // width
        own = [(i * width, width, (most + 1) // n + (i < (most + 1) % n) - 1) for i in range(n)]
        return [(at, width, min(radius, width)) for at, width, radius in own if radius >= 0]

    def cost(own: list[tuple[int, int, int]]) -> float:
        values = sum(sum(math.comb(width, i) for i in range(radius + 1)) for _, width, radius in own)
        return values * (4e-5 + rows * 3e-9) + values / 2 ** own[0][1] * rows * rows * 1e-8

    return min((split(width) for width in range(1, min(24, bits) + 1)), key=cost)


def _values(fp: np.ndarray, at: int, width: int) -> np.ndarray:
    """Of rows of bytes the number that is written in width bits from bit at on."""
    end = -(-(at + width) // 8)
    out = np.zeros(len(fp), np.int64)
    for i in range(at // 8, end):
        out = out << 8 | fp[:, i]
    return out >> (8 * end - at - width) & ((1 << width) - 1)


class _Part:
    """Rows ordered by their values in the first part of a chain: their groups and values, there and in the whole chain; the different values, where each begins, how many rows it has and the groups among them."""

    def __init__(self, fp: np.ndarray, root: np.ndarray, chain: list[tuple[int, int, int]]):
        value = _values(fp, *chain[0][:2])
        self.order = np.argsort(value, kind="stable")
        self.value, self.root = value[self.order], root[self.order]
        self.first = np.flatnonzero(np.r_[True, self.value[1:] != self.value[:-1]])
        self.different, self.size = self.value[self.first], np.diff(np.r_[self.first, len(value)])
        self.low, self.high = np.minimum.reduceat(self.root, self.first), np.maximum.reduceat(self.root, self.first)
        self.chain = self.value.astype(np.uint64)
        for at, width, _ in chain[1:]:
            self.chain = self.chain << np.uint64(width) | _values(fp, at, width)[self.order].astype(np.uint64)


def _words(fp: np.ndarray) -> np.ndarray:
    """Rows of the bytes of both fingerprints as whole words, those of the second last; no copy of rows that are padded so already."""
    first = fp.shape[1] - SHINGLE_BITS // 8
    if first % 8 == 0 and fp.flags.c_contiguous:
        return fp.view(np.uint64)
    out = np.zeros((len(fp), -(-first // 8) * 8 + SHINGLE_BITS // 8), np.uint8)
    out[:, :first], out[:, -SHINGLE_BITS // 8 :] = fp[:, :first], fp[:, first:]
    return out.view(np.uint64)


def _flips(width: int, radius: int, once: bool) -> Iterator[tuple[int | None, int]]:
    """(highest bit, mask) of all sets of at most radius of width bits; the highest is None if a pair of values may come twice."""
    yield None, 0
    for top in range(width):
        for n in range(radius):
            for rest in itertools.combinations(range(top), n):
                yield top if once else None, 1 << top | sum(1 << i for i in rest)


def _crossed(x: _Part, y: _Part, row: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of x, each with the rows of its value of y, about AT_ONCE at most at once (more only for one row's); not with values of more than FEW rows that all are of its group."""
    count = y.size.take(to)
    large = np.flatnonzero(count > FEW)
    if len(large):
        low = y.low.take(to.take(large))
        left = np.ones(len(row), bool)
        left[large] = (low != y.high.take(to.take(large))) | (low != x.root.take(row.take(large)))
        row, to, count = row[left], to[left], count[left]
    begin, end = y.first.take(to), np.cumsum(count)
    begin -= end - count
    lo = 0
    while lo < len(row):
        before = int(end[lo - 1]) if lo else 0
        hi = len(row) if end[-1] <= before + AT_ONCE else max(lo + 1, int(np.searchsorted(end, before + AT_ONCE, side="right")))
        yield np.repeat(row[lo:hi], count[lo:hi]), np.arange(before, end[hi - 1]) + np.repeat(begin[lo:hi], count[lo:hi])
        lo = hi


def _copies(words: np.ndarray, their_words: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """_near() of rows i and j, in whole words."""
    apart, tail = np.bitwise_count(words[i] ^ their_words[j]), SHINGLE_BITS // 64
    return (apart[:, :-tail].sum(axis=1, dtype=np.int64) <= most) & (apart[:, -tail:].sum(axis=1, dtype=np.int64) <= MAX_SHINGLE_DISTANCE)


def across(fp: np.ndarray, root: np.ndarray, other: np.ndarray | None, other_root: np.ndarray | None, most: int, own: list[tuple[int, int, int]], starts: Sequence[int] | None = None) -> np.ndarray:
    """Rows (i, j) for pairs of copies of different groups, of those that are found from one of the parts own (numbered starts, if given).

    Rows of fp are the bytes of both fingerprints. Pairs are of rows of fp and
    of other, or of fp alone if that is None. Of each two groups one pair stays.

    own is a ring of all parts. Radii plus one sum up to most + 1 and a pair's
    bits in them to most at most, so from one part on, around the ring, the
    bits in the first part, the first two, the first three ... all stay below
    the sum of their radii plus one (the cycle lemma). Pairs are therefore
    held to that sum over as many parts as a word holds; few others pass.
    """
    alone = other is None
    words = _words(fp)
    theirs, their_root, their_words = (fp, root, words) if alone else (other, other_root, _words(other))
    found = np.zeros((0, 2), np.int64)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal found
        for lo in range(0, len(i), AT_ONCE):
            a, b = i[lo : lo + AT_ONCE], j[lo : lo + AT_ONCE]
            near = _copies(words, their_words, a, b, most)
            if near.any():
                found = np.concatenate([found, np.stack([a[near], b[near]], 1)])
                groups = np.sort(np.stack([root[found[:, 0]], their_root[found[:, 1]]], 1), axis=1)
                found = found[np.unique(groups, axis=0, return_index=True)[1]]

    for k in range(len(own)) if starts is None else starts:
        width, radius = own[k][1:]
        chain = [own[(k + i) % len(own)] for i in range(min(64 // width, len(own)))]
        bound = sum(r + 1 for _, _, r in chain) - 1
        x = _Part(fp, root, chain)
        y = x if alone else _Part(theirs, their_root, chain)
        there, place = np.zeros(1 << width, bool), np.zeros(1 << width, np.int32)
        there[y.different], place[y.different] = True, np.arange(len(y.different))
        held, count = [], 0
        now, at, value = None, None, x.value
        for top, mask in _flips(width, radius, alone):
            if top != now:  # each pair of values once: from the one without the highest bit
                now, at = top, np.flatnonzero(x.value >> top & 1 == 0)
                value = x.value[at]
            for lo in range(0, len(value), LOOKED_UP):
                flipped = value[lo : lo + LOOKED_UP] ^ mask
                hit = there.take(flipped).nonzero()[0]
                if not len(hit):
                    continue
                to = place.take(flipped.take(hit))
                hit += lo
                for a, b in _crossed(x, y, hit if at is None else at.take(hit), to):
                    near = np.flatnonzero(np.bitwise_count(x.chain.take(a) ^ y.chain.take(b)) <= bound)
                    if not len(near):
                        continue
                    a, b = a.take(near), b.take(near)
                    apart = x.root.take(a) != y.root.take(b)
                    if alone and not mask:
                        apart &= a < b
                    held.append((x.order[a[apart]], y.order[b[apart]]))
                    count += len(held[-1][0])
                if count >= AT_ONCE:
                    keep(*(np.concatenate(c) for c in zip(*held)))
                    held, count = [], 0
        if count:
            keep(*(np.concatenate(c) for c in zip(*held)))
    return found


def dealt(own: list[tuple[int, int, int]], shares: int) -> list[list[int]]:
    """The numbers of parts in so many shares, with about as many values to look up in each."""
    out, load = [[] for _ in range(shares)], [0] * shares
    for k in sorted(range(len(own)), key=lambda k: -own[k][2]):
        least = load.index(min(load))
        out[least].append(k)
        load[least] += sum(math.comb(own[k][1], i) for i in range(own[k][2] + 1))
    return out


def _searcher(bits: int, most: int, shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            task = batch.column(0).to_numpy()
            for t in np.unique(task):
                own = pa.array(task == t)
                held.setdefault(int(t), []).append([batch.column(1).filter(own).to_numpy(), batch.column(2).filter(own).to_numpy(), _words(_rows(batch.column(3).filter(own))).view(np.uint8)])
        while held:
            t, rows = held.popitem()
            chunk, root, fp = (np.concatenate(c) for c in zip(*rows))
            del rows
            if chunk.min() == chunk.max():
                other = other_root = None
            else:
                second = chunk == chunk.max()
                other, other_root, fp, root = fp[second], root[second], fp[~second], root[~second]
                del second
            own = parts(bits, most, len(fp))
            pairs = across(fp, root, other, other_root, most, own, dealt(own, shares)[t % shares])
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(root[pairs[:, 0]]), pa.array((root if other is None else other_root)[pairs[:, 1]])], ["u", "v"])

    return run


def missed(grouped: DataFrame, bits: int, max_distance: int) -> DataFrame:
    """(u, v), written: roots of groups between which there are copies, of rows (root, both); exact, whatever the blocks found.

    Rows are dealt into chunks of about HELD; each two of them, and each with
    itself, are a task. Few chunks are shared among tasks by parts.
    """
    rows = grouped.count()
    chunks = max(1, -(-rows // HELD))
    tasks = chunks * (chunks + 1) // 2
    shares = max(1, -(-grouped.sparkSession.sparkContext.defaultParallelism // tasks)) if rows > FEW * CHUNK else 1
    dealt = grouped.select("root", "both", F.pmod(F.xxhash64("both", F.lit(5)), F.lit(chunks)).cast("long").alias("chunk"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    dealt = dealt.withColumn("pair", F.floor(high * (high + 1) / 2) + low).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = dealt.select((F.col("pair") * shares + F.col("share")).cast("long").alias("task"), "chunk", "root", "both")
    dealt = dealt.repartitionById(tasks * shares, F.col("task").cast("int"))
    return settle(dealt.mapInArrow(lean(_searcher(bits, max_distance, shares)), "u long, v long").distinct())


def _classes(prints: DataFrame, blocks: int, block_bits: int, max_distance: int) -> DataFrame:
    """(id, key, kept): each row of prints, with the least (id, key) of its group."""
    node = F.xxhash64("fp", "runs").alias("node")
    distinct = settle(prints.groupBy("fp", "runs").agg(F.min(F.struct("id", "key")).alias("n")).select("n", "fp", F.concat("fp", "runs").alias("both"), node))
    roots = components(links(distinct, blocks, block_bits, max_distance))
    grouped = distinct.join(roots, distinct["node"] == roots["v"], "left").select("node", "n", F.coalesce("root", "node").alias("root"), "both")
    release(distinct.sparkSession)
    more = missed(grouped.select("root", "both"), blocks * block_bits, max_distance)
    if not more.isEmpty():
        joined = components(more).toDF("part", "whole")
        grouped = grouped.join(joined, grouped["root"] == joined["part"], "left").select("node", "n", F.coalesce("whole", "root").alias("root"))
    least = grouped.groupBy("root").agg(F.min("n").alias("kept"))
    kept = grouped.join(least, "root").select(F.col("node").alias("own"), "kept")
    rows = prints.select("id", "key", node)
    return rows.join(kept, rows["node"] == kept["own"]).select("id", "key", "kept")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, block_bits: int = BLOCK_BITS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, key, kept_id, kept_key): each document that copies another, with the one that stays.

    The least (id, key) of a group stays, a null id coming first. Repeated
    rows (same id and text) are one document here. Null and empty texts and
    texts without words resemble nothing and never appear; very long ones are
    read whole. Bytes that aren't UTF-8 count as U+FFFD. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    if blocks * block_bits % 8:
        raise ValueError("blocks x block_bits must be a multiple of 8")
    prints = fingerprints(docs, id_col, text_col, blocks * block_bits)
    found = _classes(prints, blocks, block_bits, max_distance)
    return found.where(~F.struct("id", "key").eqNullSafe(F.col("kept"))).select("id", "key", F.col("kept.id").alias("kept_id"), F.col("kept.key").alias("kept_key")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, block_bits: int = BLOCK_BITS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs without the copies that near_duplicates finds; of repeated rows with words one stays.

    Rows without words all stay. The columns are those of docs. Texts move
    once at most: only rows that are repeated are ranked.
    """
    if blocks * block_bits % 8:
        raise ValueError("blocks x block_bits must be a multiple of 8")
    prints = fingerprints(docs, id_col, text_col, blocks * block_bits)
    found = _classes(prints, blocks, block_bits, max_distance)
    many = found.groupBy("id", "key").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    copy = ~F.struct("id", "key").eqNullSafe(F.col("kept"))
    marked = settle(many.where(copy | (F.col("n") > 1)).select("id", "key", copy.alias("copy")))
    key, rank = fresh(docs, "row_key", "row_rank")
    rows = docs.withColumn(key, text_key(F.col(text_col)))
    out = matched(rows, marked.select("id", "key").toDF(*fresh(rows, "gone_id", "gone_key")), {id_col: fresh(rows, "gone_id")[0], key: fresh(rows, "gone_key")[0]}, "left_anti")
    twice = marked.where("not copy").select("id", "key").toDF(*fresh(rows, "gone_id", "gone_key"))
    if not twice.isEmpty():
        some = matched(rows, twice, {id_col: twice.columns[0], key: twice.columns[1]}, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(id_col, key).orderBy(key)))
        out = out.union(some.where(F.col(rank) == 1).drop(rank))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
