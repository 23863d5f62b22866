"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text; everything else separates words. Words are
identified by 64-bit hashes that are the same on every machine. All functions
work on whole texts, whatever their length; a null text counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, so that temporaries stay in cache; one longer text is handled alone.
SLICE_BYTES = 1 << 20

_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 2**64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

PATTERN = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def plain_words(text: str | None) -> list[str]:
    """The words of one text, for tests and for small inputs."""
    return PATTERN.findall((text or "").lower())


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 2)
        _powers, _inverses = _geometric(_MULT, size), _geometric(_INV, size)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit codes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts (one more for the end)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


@dataclass
class Words:
    """Words of rows lo..hi-1 of a batch: where they start and end in data, their hashes, and each row's first word."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> str:
        """Words a..b-1, which lie in one row, as they stand in the lower-cased text."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes().decode("utf-8", "replace") if b > a else ""


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Words]:
    """Scan a column slice by slice; the slices together cover every row."""
    column = pc.utf8_lower(pc.fill_null(as_array(column), ""))
    data, bounds = raw_bytes(column)
    for lo, hi in slices(bounds, most):
        part, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        yield _scan(lo, hi, part, own)


def _scan(lo: int, hi: int, part: np.ndarray, own: np.ndarray) -> Words:
    n = len(part)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(lo, hi, part, own, none, none, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
    inside = (part - np.uint8(97) < 26) | (part - np.uint8(48) < 10) | (part > 127)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = own[1:-1]
    edges = edges[(edges > 0) & (edges < n)]  # a word never runs on from one text to the next
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    powers, inverses = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE.take(part) * powers[:n], out=total[1:])
    code = mix((total[end] - total[start]) * inverses[start])
    return Words(lo, hi, part, own, start, end, code, np.searchsorted(start, own))


def hash_words(tokens: list[str]) -> np.ndarray:
    """The codes of given words."""
    if not tokens:
        return np.zeros(0, np.uint64)
    data = [np.frombuffer(t.encode(), np.uint8) for t in tokens]
    powers, _ = _tables(max(map(len, data)) + 1)
    return mix(np.array([np.sum(_BYTE_CODE[d] * powers[: len(d)], dtype=np.uint64) for d in data], np.uint64))


def rolling(code: np.ndarray, size: int) -> np.ndarray:
    """Codes of all runs of size words; entry i is for words i..i+size-1. Runs across texts must be masked by the caller."""
    n = len(code)
    if n < size:
        return np.zeros(0, np.uint64)
    powers, inverses = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code * powers[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverses[: n - size + 1] + np.uint64(size))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
