"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weighted character n-grams (1 to 3 characters of the
lower-cased text, everything but letters being a blank), hashed to a fixed
number of dimensions and scaled to unit length. Document frequencies are
counted over the whole corpus. The model is trained with FTRL-proximal and
elastic-net penalties on a bounded sample of labelled rows; a temperature
fitted on a held-out part of the sample calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import fresh, lean, valid

DIMENSIONS = 1 << 14
#: Labelled rows that the model is fitted on, at most; of these every fifth calibrates.
SAMPLE_ROWS = 3000
MIN_CONFIDENCE = 0.5
#: Answer for texts without any letter.
UNKNOWN = "und"
_SLICE = 1 << 18


def _letters(data: np.ndarray) -> np.ndarray:
    """Characters as code points; ASCII other than a-z becomes a blank."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.where((points > 127) | ((points >= 97) & (points <= 122)), points, 32).astype(np.uint64)


def _counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """lo, hi and the n-gram counts of rows lo..hi-1, a line of DIMENSIONS for each; zero where there are no letters."""
    column = pc.utf8_lower(pc.fill_null(tx.as_array(column), ""))
    data, bounds = tx.raw_bytes(column)
    length = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in tx.slices(bounds, _SLICE):
        for at in range(lo, hi, 16):
            to = min(hi, at + 16)
            chars, own = _letters(data[bounds[at] : bounds[to]]), length[at:to]
            if own.sum() != len(chars):
                raise ValueError("lengths of texts disagree with their bytes")
            row = np.repeat(np.arange(to - at), own)
            blank = chars == 32
            out = np.zeros(((to - at) * DIMENSIONS), np.int64)
            code = chars
            for size in (1, 2, 3):
                if size > 1:
                    code = code[:-1] * np.uint64(0x100000001B3) + chars[size - 1 :]
                keep = (row[: len(code)] == row[size - 1 :]) & ~(blank[: len(code)] & blank[size - 1 :])
                slot = (tx.mix(code[keep] + np.uint64(size << 50)) >> np.uint64(50)).astype(np.int64)
                out += np.bincount(row[: len(code)][keep] * DIMENSIONS + slot, minlength=len(out))
            yield at, to, out.reshape(to - at, DIMENSIONS)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for _, _, counts in _counts(batch.column(0)):
            seen += (counts > 0).sum(0)
            rows += int(counts.any(1).sum())
    if rows:
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[rows, seen[at]])], ["slot", "n"])


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for _, _, counts in _counts(batch.column(0)):
                for x in _weighted(counts, idf):
                    at = np.flatnonzero(x)
                    slots.append(at.astype(np.int32))
                    values.append(x[at].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "h", "t", "slots", "weights"])

    return run


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (dimension x language) and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax(_weighted(counts, self.idf) @ self.weights / self.temperature)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> np.ndarray:
    """FTRL-proximal for softmax regression; rows are (slots, weights, class). Weights that l1 holds down are exactly 0."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for slots, x, y in rows:
            zs, ns = z[slots], n[slots]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[slots] = ns + g * g
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 1/50 and 5 of least held-out log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-300)).sum()

    lo, hi, ratio = np.log(0.02), np.log(5), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the labelled rows of docs; None if no row has a label and letters.

    The sample is the sample_rows labelled rows of least hash of the id, then
    of the text, so it is the same however rows are spread and repeated; of
    these, rows without letters are left out.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("h"), valid(F.col(text_col)).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    table = rows.select("text").mapInArrow(lean(_document_frequencies), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(table.column("slot").to_pylist(), table.column("n").to_pylist()))
    total = found.pop(-1, 0)
    if not total:
        return None
    idf = np.full(DIMENSIONS, np.log(1 + total) + 1)
    idf[list(found)] = np.log((1 + total) / (1 + np.array(list(found.values())))) + 1
    labelled = rows.where("lang is not null and text is not null").withColumn("t", F.xxhash64("text"))
    last = labelled.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return None
    vectors = labelled.where(F.col("h") <= last).select("text", "lang", "h", "t").mapInArrow(lean(_vectors(idf)), "lang string, h long, t long, slots array<int>, weights array<float>")
    sample = vectors.orderBy("h", "t", "lang").limit(sample_rows).where(F.size("slots") > 0).toArrow().sort_by([("h", "ascending"), ("t", "ascending"), ("lang", "ascending")])
    langs = sorted(set(sample.column("lang").to_pylist()))
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    slots, weights = (sample.column(c).combine_chunks() for c in ("slots", "weights"))
    own = [(s.values.to_numpy(), w.values.to_numpy(), number[y]) for s, w, y in zip(slots, weights, sample.column("lang").to_pylist())]
    held = own[::5] if len(own) >= 50 else []
    learned = ftrl([x for i, x in enumerate(own) if not held or i % 5], len(langs))
    scores = np.array([x @ learned[s] for s, x, _ in held]).reshape(len(held), len(langs))
    return Model(langs, idf, learned, temperature(scores, np.array([y for *_, y in held], int)))


def _predict(shared, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array(model.langs, object)
        for batch in batches:
            lang, sure = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for lo, hi, counts in _counts(batch.column(columns)):
                p = model.probabilities(counts)
                some = counts.any(1)
                lang[lo:hi][some], sure[lo:hi][some] = names[p.argmax(1)][some], p.max(1)[some]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(lang, pa.string()), pa.array(sure)], names=[f"c{i}" for i in range(columns + 2)])

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: Sequence[str] | None = None, names: tuple[str, str] = ("predicted", "confidence")) -> DataFrame:
    """The columns keep of docs (all if None), with the predicted language and its calibrated probability.

    Texts that are null, empty or without letters are UNKNOWN with confidence
    0, and so is everything if the model is None. Of languages that tie the
    first by name wins. Very long texts are counted whole; bytes that aren't
    UTF-8 count as U+FFFD. New names that docs has already get an underscore.
    """
    keep = list(docs.columns if keep is None else keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    new = fresh(rows, *names)
    if model is None:
        return rows.withColumns({new[0]: F.lit(UNKNOWN), new[1]: F.lit(0.0)})
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)]
    fields += [T.StructField(f"c{len(keep)}", T.StringType()), T.StructField(f"c{len(keep) + 1}", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    given = docs.select(*[F.col(f"`{c}`") for c in keep], valid(F.col(text_col)).alias("scanned text"))
    return given.toDF(*[f"c{i}" for i in range(len(keep) + 1)]).mapInArrow(lean(_predict(shared, len(keep))), T.StructType(fields)).toDF(*keep, *new)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: Sequence[str] | None = None, min_confidence: float = MIN_CONFIDENCE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """predict with a model trained on docs itself, and a column accepted: whether the language is known with min_confidence."""
    model = train(docs, id_col, text_col, lang_col, sample_rows)
    out = predict(docs, model, text_col, keep)
    new = out.columns[-2:]
    return out.withColumn(fresh(out, "accepted")[0], (F.col(new[0]) != UNKNOWN) & (F.col(new[1]) >= min_confidence))
