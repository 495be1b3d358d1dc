"""A hidden Markov language model.

Tokens are words and one end per text. Frequent words are symbols of their own; all other words share one symbol,
below which each has its add-one unigram share. Latent states are trained by Baum-Welch: each task runs scaled
forward and backward recursions over its texts, many texts side by side, and gives expected counts; these are
summed over all tasks, and the sums make the next model. The log-probability of a text is exact: the logs of the
forward recursion's scale factors, plus the shares of its rare words.

The counts of all words come from all training texts. Symbols are bounded in number, so what the driver and the
executors hold of the model is bounded; counts of rare words stay in a table and meet their texts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, hashed_sample, id_remainder, text_or_empty, written
from corpusmill.llm.tokens import slices

ENCODED = "doc_id long, held_out boolean, n_tokens long, ids binary, known_tokens long, base double, rare array<struct<word:string,n:long>>"


@dataclass(frozen=True)
class Settings:
    """`symbols`: frequent words at most; `rounds`: Baum-Welch rounds over all training texts; `start_rows`, `start_rounds`: texts and rounds of the start, on the driver."""

    states: int = 8
    symbols: int = 100_000
    rounds: int = 2
    start_rows: int = 1500
    start_rounds: int = 15
    start_tokens: int = 1_000_000
    prior: float = 5.0
    seed: int = 13


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    #: states x symbols, as symbols x states so that a token's row lies together.
    emit: np.ndarray


def held_out(column: str = "doc_id") -> Column:
    return id_remainder(column, 7) == 2


def words_of(text: str) -> list[bytes]:
    """Words between spaces and U+0009 to U+000D, A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) over the texts; each task sums what it holds, in parts of `most` words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    counts.update(words_of(text))
                if len(counts) > most:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    def table(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts.keys()), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return bounded_batches(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(vocabulary: DataFrame, most: int) -> list[Row]:
    """The words of the highest frequencies, in classes of like frequency, as many classes as hold `most` words at most; ordered."""
    rank = F.floor(F.log2("n") * 64).cast("int")
    left, least = most, None
    for r in vocabulary.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["rank"]
    rows = vocabulary.where(rank >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r["n"], r["word"]))


def encoded(docs: DataFrame, symbols: dict[bytes, int], logs: np.ndarray, end_known: bool) -> DataFrame:
    """Texts as symbol ids (the rare symbol, then the end, are last), with the base score of frequent words and the end, and the rare words with counts."""
    shared = docs.sparkSession.sparkContext.broadcast((symbols, logs))
    rare_id = len(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, log10 = shared.value
        get = known.get
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, out, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = words_of(text)
                    ids = np.fromiter((get(w, rare_id) for w in words), np.int32, len(words))
                    rare = Counter([words[i] for i in np.flatnonzero(ids == rare_id).tolist()])
                    frequent = ids[ids != rare_id]
                    base = float(log10[frequent].sum() + log10[rare_id + 1])
                    ids = np.append(ids, np.int32(rare_id + 1))
                    rows.append((doc_id, out, len(ids), ids.tobytes(), len(frequent) + end_known, base, [{"word": w.decode(), "n": n} for w, n in rare.items()]))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "ids", "known_tokens", "base", "rare"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, ENCODED)


def side_by_side(texts: list[np.ndarray], cells: int = 400_000, most: int = 512) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts of like length as a block of steps x texts: their places, ids (0 where a text has ended) and lengths, longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    k = 0
    while k < len(order):
        width = max(1, min(most, cells // max(1, len(texts[order[k]]))))
        some = order[k : k + width]
        lengths = np.array([len(texts[i]) for i in some])
        ids = np.zeros((int(lengths[0]), len(some)), np.int32)
        for j, i in enumerate(some):
            ids[: lengths[j], j] = texts[i]
        yield some, ids, lengths
        k += width


def forward(model: Model, ids: np.ndarray, lengths: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Natural log-likelihoods; with `keep`, the scaled forward values and scales of each step. Step t holds the texts that are longer than t, which come first."""
    steps, n = ids.shape
    logs = np.zeros(n)
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    values = np.zeros((steps, n, len(model.start)), model.emit.dtype) if keep else None
    scales = np.ones((steps, n), model.emit.dtype) if keep else None
    now = None
    for t in range(steps):
        m = int(live[t])
        prior = model.start if now is None else now[:m] @ model.move
        now = prior * model.emit[ids[t, :m]]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        logs[:m] += np.log(scale)
        if keep:
            values[t, :m], scales[t, :m] = now, scale
    return logs, values, scales


class Expected:
    """Expected counts of starts, moves and emissions."""

    def __init__(self, states: int, symbols: int):
        self.start, self.move = np.zeros(states), np.zeros((states, states))
        self.emit = np.zeros((symbols, states))
        self.log = 0.0

    def add(self, model: Model, texts: list[np.ndarray]) -> None:
        for _, ids, lengths in side_by_side(texts):
            steps = len(ids)
            logs, values, scales = forward(model, ids, lengths, True)
            self.log += float(logs.sum())
            live = np.searchsorted(-lengths, -np.arange(steps + 1), side="left")
            states = len(model.start)
            back = np.ones((ids.shape[1], states), model.emit.dtype)
            moved = np.zeros((states, states))
            for t in range(steps - 1, -1, -1):
                m = int(live[t])
                ahead = int(live[t + 1])
                if ahead:
                    weighed = model.emit[ids[t + 1, :ahead]] * back[:ahead] / scales[t + 1, :ahead, None]
                    moved += values[t, :ahead].T @ weighed
                    back[:ahead] = weighed @ model.move.T
                # From here `values` holds the share of each state.
                values[t, :m] *= back[:m]
            self.move += moved * model.move
            self.start += values[0].sum(axis=0)
            inside = np.arange(steps)[:, None] < lengths[None, :]
            flat, gamma = ids[inside], values[inside]
            used, place = np.unique(flat, return_inverse=True)
            for s in range(states):
                self.emit[used, s] += np.bincount(place, gamma[:, s], minlength=len(used))


def model_of(expected: Expected, unigram: np.ndarray, rare_extra: float, prior: float) -> Model:
    """Normalised counts; each state leans on the unigram with `prior` counts, and the rare symbol also stands for words not seen."""
    start = expected.start + 1.0
    move = expected.move + 1.0
    emit = expected.emit.copy()
    rare = emit.shape[0] - 2
    total = emit[rare].sum()
    emit[rare] += rare_extra * (emit[rare] / total if total > 0 else 1.0 / emit.shape[1])
    emit += prior * unigram[:, None]
    return Model((start / start.sum()).astype(np.float32), (move / move.sum(axis=1, keepdims=True)).astype(np.float32), (emit / emit.sum(axis=0)).astype(np.float32))


def first_model(unigram: np.ndarray, settings: Settings) -> Model:
    """States differ by a random factor on each symbol, and mostly stay, so that states come to stand for kinds of text."""
    rng = np.random.default_rng(settings.seed)
    k = settings.states
    emit = unigram[:, None] * np.exp(0.3 * rng.standard_normal((len(unigram), k)))
    move = np.full((k, k), 0.05 / max(1, k - 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(k, 1.0 / k, np.float32), (move / move.sum(axis=1, keepdims=True)).astype(np.float32), (emit / emit.sum(axis=0)).astype(np.float32))


def expected_counts(texts: DataFrame, model: Model, piece: int = 4096, fan: int = 64) -> Expected:
    """One Baum-Welch pass over all texts: each task sums its own counts, then pieces of the table are summed over `fan` tasks at a time."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    n_symbols, k = model.emit.shape
    schema = "at long, bucket long, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, size = Expected(k, n_symbols), [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.int32))
                size += len(held[-1])
                if size > 2_000_000:
                    found.add(shared.value, held)
                    held, size = [], 0
        found.add(shared.value, held)
        at = [-1, *range(0, n_symbols, piece)]
        parts = [np.concatenate([found.start, found.move.ravel(), [found.log]]), *(found.emit[i : i + piece].ravel() for i in at[1:])]
        bucket = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([bucket] * len(at), pa.int64()), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], names=["at", "bucket", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(raw, "<f4").astype(float) for raw in pdf["counts"]], axis=0)
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "bucket": pdf["bucket"].iloc[:1], "counts": [total.astype("<f4").tobytes()]})

    sums, tasks = texts.select("ids").mapInArrow(run, schema), texts.rdd.getNumPartitions()
    while tasks > 0:
        sums = sums.withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long")).groupBy("at", "bucket").applyInPandas(add, schema)
        tasks = (tasks - 1) // fan
    out = Expected(k, n_symbols)
    for at, _, raw in sums.collect():
        part = np.frombuffer(raw, "<f4").astype(float)
        if at < 0:
            out.start, out.move, out.log = part[:k].copy(), part[k : k + k * k].reshape(k, k).copy(), float(part[-1])
        else:
            out.emit[at : at + piece] = part.reshape(-1, k)
    return out


def start_model(texts: DataFrame, unigram: np.ndarray, settings: Settings) -> Model:
    """Where Baum-Welch begins: rounds over a few texts on the driver."""
    model = first_model(unigram, settings)
    some, size = [], 0
    for r in hashed_sample(texts.select("ids"), settings.start_rows, "ids").toLocalIterator():
        if size < settings.start_tokens:
            some.append(np.frombuffer(r["ids"], np.int32))
            size += len(some[-1])
    for _ in range(settings.start_rounds if some else 0):
        begun = Expected(settings.states, len(unigram))
        begun.add(model, some)
        model = model_of(begun, unigram, 0.0, 0.02 * size / settings.states)
    return model


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """row_id and the log10 probability of its symbols."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            raw = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            logs = np.zeros(len(raw))
            for places, ids, lengths in side_by_side(raw):
                logs[places] = forward(own, ids, lengths, False)[0] / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs)], names=["row_id", "symbols_score"])

    return texts.select("row_id", "ids").mapInArrow(run, "row_id long, symbols_score double")


def language_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), a row for each row of `docs`.

    Texts whose crc32(doc_id) mod 7 is not 2 train the model; a null id counts as the empty text and trains. Null
    and empty texts are their end alone. With no training text, every word and the end are unseen: N and V are 0,
    and the model has one rare symbol. Repeated rows are scored each and count each in training. Texts are read
    whole; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"))
    train = rows.where("not held_out")
    vocabulary = written(word_counts(train), "hmm-words")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train = train.count()
    n_all, v_all = int(total) + n_train, int(kinds) + (n_train > 0)
    top = frequent_words(vocabulary, settings.symbols)
    symbols = {r["word"].encode(): k for k, r in enumerate(top)}
    frequent = np.array([r["n"] for r in top], float)
    rare_n, rare_v = int(total) - int(frequent.sum()), int(kinds) - len(top)
    base_bits, rare_bits = math.log10(n_all + v_all + 1), math.log10(rare_n + rare_v + 1)
    logs = np.append(np.log10(frequent + 1) - base_bits, [0.0, math.log10(n_train + 1) - base_bits])
    unigram = np.concatenate([frequent, [rare_n + rare_v + 1, n_train]]) + 1e-3
    unigram /= unigram.sum()
    keyed_ids = written(encoded(rows, symbols, logs, n_train > 0).withColumn("row_id", F.monotonically_increasing_id()), "hmm-encoded")
    texts = keyed_ids.where("not held_out")
    model = start_model(texts, unigram, settings)
    for _ in range(settings.rounds if n_train else 0):
        model = model_of(expected_counts(texts, model), unigram, rare_v + 1.0, settings.prior)
    forward_scores = scored(keyed_ids, model)
    rare_words = keyed_ids.select("row_id", F.explode("rare").alias("r")).select("row_id", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    joined = rare_words.join(vocabulary, "word", "left")
    rare_scores = joined.groupBy("row_id").agg(
        F.sum(F.col("times") * (F.log10(count + 1.0) - base_bits)).alias("rare_base"),
        F.sum(F.col("times") * (F.log10(count + 1.0) - rare_bits)).alias("rare_score"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    out = keyed_ids.select("row_id", "doc_id", "held_out", "n_tokens", "known_tokens", "base").join(forward_scores, "row_id").join(rare_scores, "row_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known_tokens") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("symbols_score") + F.coalesce("rare_score", zero)).alias("score"),
    )
