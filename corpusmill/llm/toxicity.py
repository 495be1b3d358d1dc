"""Toxicity scores by a character n-gram linear classifier with naive Bayes log-count ratios.

A text's features are its distinct n-grams of characters (code points), with ASCII letters lowered, hashed to a
fixed number of buckets. In training, the number of toxic and of clean texts with each bucket is
counted over all labelled rows, on the executors. The log-count ratio of a bucket scales its feature; a
logistic regression over the scaled features is then fitted on a bounded sample of labelled rows. A score is
a function of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmill.llm.common import bounded_batches, forget, fresh_names, hashed_sample, id_remainder, text_or_empty, written
from corpusmill.llm.tokens import slices

#: Code points below 128 as they count: ASCII letters lowered, white space one kind of character.
LOWER = np.arange(128, dtype=np.uint32)
LOWER[65:91] += 32
LOWER[9:14] = 32
#: Multiplies the code of a gram before its next character is added, modulo 2 ** 32.
BASE = 0x01000193


@dataclass(frozen=True)
class Settings:
    """`sample`: the most labelled rows of each class that the regression is fitted on (the counts use all)."""

    orders: tuple[int, ...] = (3, 4)
    bits: int = 18
    sample: int = 2000
    smoothing: float = 10.0
    ridge: float = 1e-3
    rounds: int = 40
    rate: float = 0.05


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        z = self.bias + (float(self.weights[features].sum()) / np.sqrt(len(features)) if len(features) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def features_of(text: str, settings: Settings) -> np.ndarray:
    """Distinct buckets of a text's n-grams; a space is set before and after the text."""
    chars = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    chars = LOWER[chars] if text.isascii() else np.where(chars < 128, LOWER[np.minimum(chars, 127)], chars)
    found = []
    code, n = np.zeros(len(chars), np.uint32), len(chars)
    for k in range(max(settings.orders)):
        code = code[: n - k] * np.uint32(BASE) + chars[k:] + np.uint32(1)
        if not len(code):
            break
        if k + 1 in settings.orders:
            mixed = code * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
            found.append(mixed >> np.uint32(32 - settings.bits))
    return distinct(np.concatenate(found), settings.bits) if found else np.empty(0, np.int64)


def distinct(values: np.ndarray, bits: int) -> np.ndarray:
    """Sorted distinct values; a table of flags is faster than sorting for long texts."""
    if len(values) > 1 << (bits - 4):
        flags = np.zeros(1 << bits, bool)
        flags[values] = True
        return np.flatnonzero(flags)
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])].astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with a label of 0 or 1, without the held-out ones. Ids that repeat in `labels` count once, with the larger label."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(~held_out("doc_id")).select("doc_id", text_or_empty().alias("text"))
    # Always by shuffle: labels may be as many as documents.
    return rows.hint("merge").join(known, "doc_id")


def held_out(column: str) -> Column:
    return id_remainder(column, 5) == 0


def bucket_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, toxic texts with it, clean texts with it); bucket -1 counts the texts themselves. Summed in each task first."""
    size = 1 << settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts[toxic, features_of(text, settings)] += 1
                    texts[toxic] += 1
        if texts.any():
            used = np.flatnonzero(counts.any(axis=0))
            columns = [np.append(used, -1), np.append(counts[1, used], texts[1]), np.append(counts[0, used], texts[0])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "toxic", "clean"])

    made = bounded_batches(rows).select("text", F.col("toxic").cast("int")).mapInArrow(run, "bucket long, toxic long, clean long")
    return made.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def sampled_features(rows: DataFrame, settings: Settings) -> list[tuple[int, np.ndarray]]:
    """Features of the bounded sample: of each class rows picked by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes = [features_of(t, settings).astype("<u4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.binary())], names=["toxic", "features"])

    sample = []
    for toxic in (0, 1):
        picked = hashed_sample(rows.where(F.col("toxic") == toxic), settings.sample, "doc_id", "text")
        sample += picked.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, features binary").collect()
    return sorted(((r["toxic"], np.frombuffer(r["features"], "<u4")) for r in sample), key=lambda x: (x[0], len(x[1]), x[1].tobytes()))


def fit_regression(sample: list[tuple[int, np.ndarray]], ratio: np.ndarray, settings: Settings, part: int = 256) -> tuple[np.ndarray, float]:
    """Logistic regression with adaptive steps over features scaled by `ratio`; both classes weigh the same. Works through `part` texts at a time."""
    y = np.array([t for t, _ in sample], float)
    if not len(y) or y.min() == y.max():
        return np.zeros_like(ratio), (0.0 if not len(y) else 3.0 if y[0] else -3.0)
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    parts = []
    for k in range(0, len(y), part):
        found = [f if len(f) else np.zeros(1, "<u4") for _, f in sample[k : k + part]]
        lengths = np.array([len(f) for f in found])
        # A text without features holds bucket 0 with weight 0.
        scale = np.array([len(f) > 0 for _, f in sample[k : k + part]]) / np.sqrt(lengths)
        parts.append((np.concatenate(found).astype(np.int32), lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]), scale, y[k : k + part], each[k : k + part]))
    sample.clear()
    w, bias = np.zeros(len(ratio)), 0.0
    m, v, step = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), settings.rate
    for k in range(1, settings.rounds + 1):
        own, slope, lean = w * ratio, np.zeros(len(ratio)), 0.0
        for flat, lengths, begins, scale, truth, weight in parts:
            z = np.add.reduceat(own[flat], begins) * scale + bias
            error = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - truth)
            slope += np.bincount(flat, np.repeat(error * scale, lengths), minlength=len(ratio))
            lean += error.sum()
        slope = np.append(slope * ratio + settings.ridge * w / len(y), lean)
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope * slope
        move = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def log_ratios(counts: np.ndarray, texts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log of a bucket's share in toxic texts over its share in clean ones. The smoothing is split as the texts are, so a rare bucket leans to neither."""
    part = (smoothing * (texts / max(1.0, texts.sum())))[:, None]
    share = (counts + part + 1e-9) / (texts[:, None] + 2 * part + 1e-9)
    return np.log(share[1] / share[0])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Bucket counts, at most 2 ** bits rows, and the bounded sample reach the driver."""
    rows = written(labelled(docs, labels), "toxic-labelled")
    size = 1 << settings.bits
    counts, texts = np.zeros((2, size)), np.zeros(2)
    for bucket, toxic, clean in bucket_counts(rows, settings).toPandas().itertuples(index=False):
        if bucket < 0:
            texts[:] = clean, toxic
        else:
            counts[:, bucket] = clean, toxic
    ratio = log_ratios(counts, texts, settings.smoothing)
    w, bias = fit_regression(sampled_features(rows, settings), ratio, settings)
    forget(rows)
    return Model(settings, (w * ratio).astype(np.float32), float(bias))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` and, last, the score (0 to 1): `toxic_score`, with `_` behind it if `docs` has such a column. A null text scores as an empty one."""
    settings = model.settings
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    names = docs.columns
    score, own_text = fresh_names(names, "toxic_score", "toxic_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        own = Model(settings, weights, bias)
        for batch in batches:
            for part in slices(batch):
                scores = [own.score(features_of(t or "", settings)) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*names, score])

    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return bounded_batches(docs).select(*names, text_or_empty().alias(own_text)).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`.

    Training reads labelled rows whose crc32(doc_id) mod 5 is not 0. Labels other than 0 and 1 and labels of
    unknown ids are left out; rows with null ids are never labelled. With no label or labels of one class, scores
    are the same for all texts. Repeated rows are scored each; very long texts are scored whole; an empty table
    gives no rows; other columns are ignored.
    """
    model = train(docs, labels, settings)
    scored = score_documents(docs.select("doc_id", F.col("text")), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), limit: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `limit`, with their columns."""
    scored = score_documents(docs, train(docs, labels, settings))
    return scored.where(F.col(scored.columns[-1]) < limit).select(*docs.columns)
