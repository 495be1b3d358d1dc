from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import hmm
from tests.llm.helpers import doc, frame, odd_docs, words


def random_model(k=3, symbols=6, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((symbols, k)), 0))


def paths(model, x):
    for path in itertools.product(range(len(model.start)), repeat=len(x)):
        p = model.start[path[0]] * model.emit[x[0], path[0]]
        for a, b, w in zip(path, path[1:], x[1:]):
            p *= model.move[a, b] * model.emit[w, b]
        yield path, p


def test_forward_sums_over_all_paths():
    model = random_model()
    texts = [np.array(x) for x in ([0], [1, 2, 3], [5, 5, 0, 1, 4], [2, 2])]
    got = np.zeros(len(texts))
    for places, ids, lengths in hmm.side_by_side(texts):
        got[places] = hmm.forward(model, ids, lengths, False)[0]
    for x, log in zip(texts, got):
        assert log == pytest.approx(math.log(sum(p for _, p in paths(model, x))))


def test_expected_counts_are_those_of_all_paths():
    model = random_model()
    texts = [np.array(x) for x in ([0], [1, 2, 3], [5, 5, 0, 1, 4], [2, 2])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for x in texts:
        total = sum(p for _, p in paths(model, x))
        for path, p in paths(model, x):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for s, w in zip(path, x):
                emit[w, s] += p / total
    got = hmm.Expected(3, 6)
    got.add(model, texts)
    assert np.allclose(got.start, start) and np.allclose(got.move, move) and np.allclose(got.emit, emit)
    assert got.log == pytest.approx(sum(math.log(sum(p for _, p in paths(model, x))) for x in texts))


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 10, 30) + 10 * (i % 2) for i in range(60)]
    unigram = np.full(22, 1 / 22)
    s = hmm.Settings(states=3)
    model, logs = hmm.first_model(unigram, s), []
    for _ in range(12):
        e = hmm.Expected(3, 22)
        e.add(model, texts)
        logs.append(e.log)
        model = hmm.model_of(e, unigram, 0.0, 1e-6)
    assert logs[-1] > logs[0] and all(b > a - 2 for a, b in zip(logs[1:], logs[2:]))
    assert logs[-1] / (60 * 30) > math.log(1 / 20) + 0.2


def test_tasks_sum_to_one_pass(spark):
    model, rng = random_model(symbols=9), np.random.default_rng(5)
    texts = [rng.integers(0, 9, rng.integers(1, 40)).astype(np.int32) for _ in range(200)]
    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in texts], "ids binary").repartition(7)
    whole = hmm.Expected(3, 9)
    whole.add(model, texts)
    for fan in (64, 2):
        got = hmm.expected_counts(rows, model, piece=4, fan=fan)
        assert np.allclose(got.move, whole.move, rtol=1e-4) and np.allclose(got.emit, whole.emit, rtol=1e-4, atol=1e-4)
        assert got.log == pytest.approx(whole.log, rel=1e-5)


def test_scores(spark):
    rows = odd_docs() + [doc(1000 + i, words(30 + i % 50, i, 60 + 200 * (i % 2))) for i in range(150)]
    s = hmm.Settings(states=3, symbols=100, start_rows=50, start_rounds=4)
    got = hmm.language_scores(frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n int"), s).collect()
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    cut = [[*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower)), "\n"] for r in rows]
    out = [zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for r in rows]
    counts = Counter(w for x, o in zip(cut, out) if not o for w in x)
    n, v = sum(counts.values()), len(counts)
    want = sorted((r[0] if r[0] is not None else -1, o, len(x), sum(counts[w] > 0 for w in x), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for r, x, o in zip(rows, cut, out))
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert [x[:4] for x in have] == [x[:4] for x in want] and np.allclose([x[4] for x in have], [x[4] for x in want], atol=1e-4)
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_short_texts_sum_to_one(spark):
    """All texts of one or two known or unknown words: with one symbol for each kind of rare word the sum stays at or below 1."""
    rows = [doc(i, "a b a") for i in range(20)] + [doc(100 + i, x) for i, x in enumerate(["", "a", "b", "c", "a a", "a b", "b a", "b b", "a c", "c a", "c c", "b c", "c b"])]
    got = hmm.language_scores(frame(spark, rows), hmm.Settings(states=2, symbols=2, start_rounds=2)).where("doc_id >= 100").collect()
    assert 0 < sum(10**r.score for r in got) <= 1


def test_without_training_or_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = hmm.language_scores(frame(spark, [doc(held, "a b")])).first()
    assert got.held_out and got.train_tokens == 0 and got.n_known == 0 and got.base_score == 0 and got.n_tokens == 3
    assert hmm.language_scores(frame(spark, [])).count() == 0
