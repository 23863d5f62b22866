"""License scans by conditional compression.

Blocks are lines, and paragraphs of several lines (less the marks of comments),
in which a wording may run on from line to line. A block is compared with the
templates that it has enough words of: it is compressed alone and with each of
these as a zstandard raw dictionary; templates are ranked by how much smaller
that makes the block. Each is confirmed, whatever its rank (in a long block a
notice saves little), by exact wording: wherever the wording stands in the
block, enough of the words there and of the template must agree in order, and
the words that differ are reported. Words that tell licenses apart (names and
version numbers) must agree exactly. What is left out before compression
could not be confirmed: see Scanner.possible.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .license_texts import TEMPLATES
from .shared import text_key, valid

MIN_AGREEMENT = 0.8
#: Words that a placeholder stands for, at most.
WILD = 12
_WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_TELLING = re.compile(r"\d|^(mit|apache|gnu|gpl|lgpl|lesser|affero|bsd|mozilla|mpl|eclipse|eupl|isc|zlib|unlicense|wtfpl|cc|cc0|by(-\w+)*|two|three|attribution(-\w+)*|unencumbered|v\d)$|clause")
#: Marks at the head of a comment's lines, and at the end of one.
_MARKS = re.compile(r"^[\s/*#;%!\->]+|[\s*/\-]+$")
_HOLE = re.compile(r"\{[^}]*\}")


def wording(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Template:
    """A wording, ready to compress with and to compare."""

    def __init__(self, name: str, text: str):
        self.name, self.text = name, text
        self.given = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        parts = [wording(p) for p in _HOLE.split(text)]
        self.words = [w for p in parts for w in p]
        self.holes = None
        if len(parts) > 1:
            gap = rf"(?: \S+){{1,{WILD}}}?"
            self.holes = re.compile(gap.join("".join(f" {re.escape(w)}" for w in p) for p in parts) + "(?= |$)")
        self.telling = {w for w in self.words if _TELLING.search(w)}
        self.least = len(self.words) if self.holes else math.ceil(len(self.words) * MIN_AGREEMENT - 1e-9)
        self.most = int(len(self.words) / MIN_AGREEMENT + 1e-9)
        self.masks: dict[str, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        # Any block with this wording has one of these words: a name of the license, or one of so many that not all can be missing.
        spare = sorted(set(self.words), key=lambda w: (self.words.count(w), -len(w), w))
        own, lost = [], 0
        for w in spare:
            own.append(w)
            lost += self.words.count(w)
            if lost > len(self.words) - self.least:
                break
        self.anchors = {max(self.telling, key=lambda w: (len(w), w))} if self.telling else set(own)

    def place(self, own: list[str]) -> tuple[int, int, int] | None:
        """(words that agree in order, start, end): where a block's words agree best with this wording, the first if there are several."""
        words, telling, n = self.words, self.telling, len(self.words)
        if self.holes:
            found = self.holes.search(" " + " ".join(own))
            if not found:
                return None
            start = found.string[: found.start()].count(" ")
            return n, start, start + found.group().count(" ")
        if not telling.issubset(own):
            return None
        shared = np.fromiter(map(self.masks.__contains__, own), bool, len(own))
        total, at = np.r_[0, np.cumsum(shared)], np.arange(len(own))
        best = None
        for first in np.flatnonzero(shared & (total[np.minimum(at + self.most, len(own))] - total[:-1] >= self.least)).tolist():
            open_ = full = (1 << n) - 1  # a bit for each word that isn't matched yet: longest common subsequences, bit by bit
            seen = set()
            for last in range(first, min(first + self.most, len(own))):
                w = own[last]
                if _TELLING.search(w):
                    if w not in telling:
                        break
                    seen.add(w)
                hit = open_ & self.masks.get(w, 0)
                open_ = ((open_ + hit) | (open_ - hit)) & full
                agreed = n - open_.bit_count()
                agreement = agreed / max(n, last + 1 - first)
                if agreement >= MIN_AGREEMENT and seen == telling and (best is None or agreement > best[0]):
                    best = agreement, agreed, first, last + 1
        return best and best[1:]


class Scanner:
    """The templates of a task, and what it has found so far."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.known = [Template(name, t) for name, texts in templates.items() for t in texts]
        self.plain = zstandard.ZstdCompressor(level=3)
        anchors = sorted({w for t in self.known for w in t.anchors})
        self.anchor = r"(?:^|[^0-9a-z])(?:" + "|".join(map(re.escape, anchors)) + r")(?:[^0-9a-z]|$)"
        self.search = re.compile(self.anchor).search
        self.found: dict[str, tuple | None] = {}

    def possible(self, own: list[str]) -> list[int]:
        """Templates that the words could confirm: with all their telling words, and no more words missing than may be."""
        here = set(own)
        return [i for i, t in enumerate(self.known) if t.telling <= here and sum(w in here for w in t.words) >= t.least]

    def reductions(self, block: str, among: list[int] | None = None) -> list[tuple[float, int]]:
        """(share of the compressed size saved, template), best first; ties by template order."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        some = range(len(self.known)) if among is None else among
        return sorted(((1 - len(self.known[i].given.compress(raw)) / alone, i) for i in some), key=lambda x: (-x[0], x[1]))

    def scan(self, block: str, lines: tuple[int, ...] | None = None) -> tuple | None:
        """(license, reduction, agreement, missing words, added words, first word's line) of the best template that its wording confirms.

        lines: the line of each word; a wording within a single line doesn't count then.
        """
        if lines is not None:
            return self._scan(block, lines)
        if block not in self.found:
            if len(self.found) > 10_000:
                self.found.clear()
            self.found[block] = self._scan(block, None)
        return self.found[block]

    def _scan(self, block: str, lines: tuple[int, ...] | None) -> tuple | None:
        own = wording(block)
        among = self.possible(own)
        confirmed = []
        for reduction, i in self.reductions(block, among) if among else ():
            template = self.known[i]
            found = template.place(own)  # the wording may stand within a longer block
            if not found:
                continue
            agreed, start, end = found
            if lines is not None and lines[start] == lines[end - 1]:
                continue
            a, b = template.words, own[start:end]
            missing, added = [w for w in a if w not in b], [] if template.holes else [w for w in b if w not in a]
            agreement = 1.0 if template.holes else agreed / max(len(a), len(b))
            confirmed.append((len(missing) + len(added), -reduction, i, reduction, agreement, missing, added, lines[start] if lines else 0))
        if not confirmed:
            return None
        _, _, i, *rest = min(confirmed)
        return self.known[i].name, *rest

    def blocks(self, text: str) -> Iterator[tuple[int, tuple]]:
        """(line, what scan gives) of the lines, and of the paragraphs of several lines, of a text."""
        paragraph: list[tuple[int, str]] = []
        for n, line in enumerate([*text.split("\n"), ""]):
            bare = _MARKS.sub("", line)
            if bare:
                paragraph.append((n, bare))
            if self.search(line.lower()) and (found := self.scan(line)):
                yield n, found
            if not bare:
                if len(paragraph) > 1:
                    joined = " ".join(x for _, x in paragraph)
                    if self.search(joined.lower()):
                        found = self.scan(joined, tuple(i for i, x in paragraph for _ in wording(x)))
                        if found:
                            yield found[-1], found
                paragraph = []


_FIELDS = [("block", T.LongType()), ("license", T.StringType()), ("reduction", T.DoubleType()), ("agreement", T.DoubleType()), ("missing", T.ArrayType(T.StringType())), ("added", T.ArrayType(T.StringType()))]


def _scan(templates: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            texts = pc.fill_null(tx.as_array(batch.column(2)), "")
            hit = pc.match_substring_regex(pc.utf8_lower(texts), scanner.anchor)
            rows, out = [], []
            for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
                for n, found in scanner.blocks(texts[int(i)].as_py()):
                    rows.append(int(i))
                    out.append((n, *found[:-1]))
            take = pa.array(rows, pa.int64())
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds))], ["id", "key", *(n for n, _ in _FIELDS)])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, key, block, license, reduction, agreement, missing, added): each block that gives a license; block is its line, from 0.

    A line, or a paragraph of several lines, gives one license at most: of the
    confirmed templates the one with the fewest differing words, then the
    largest reduction, then the first in TEMPLATES. A paragraph counts for
    wordings that go over its lines only; its block is the first such line.
    Words that a placeholder stands for aren't differences. Null and empty
    texts give none; very long ones are scanned whole; bytes that aren't UTF-8
    count as U+FFFD. Rows with equal id and text are one document. An empty
    table gives an empty result; other columns are ignored, whatever their
    names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), valid(F.col(text_col)).alias("text"))
    schema = T.StructType([rows.schema["id"], rows.schema["key"], *(T.StructField(n, t) for n, t in _FIELDS)])
    return rows.mapInArrow(_scan(templates or TEMPLATES), schema).distinct()
