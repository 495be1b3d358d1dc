from __future__ import annotations

import random
import zlib

import numpy as np

from corpusmill.llm import toxicity
from tests.llm.helpers import doc, frame, odd_docs, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = words(40, i)
        if bad:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["Scumbag", "idiotic", "trashy."]))
            text = " ".join(parts)
        docs.append(doc(i, text))
        if i % 2 or i < 300:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_features_are_the_distinct_grams_of_the_whole_text():
    s = toxicity.Settings(orders=(3,), bits=18)
    assert np.array_equal(toxicity.features_of("AbC  abc", s), toxicity.features_of("abc  abc", s))
    assert len(toxicity.features_of("ab", s)) == 2  # " ab", "ab "
    assert len(toxicity.features_of("", toxicity.Settings(orders=(4,)))) == 0
    long = words(30_000, 1)
    assert np.array_equal(toxicity.features_of(long, s), np.unique(toxicity.features_of(long + " " + long, s)))
    values = np.random.default_rng(1).integers(0, 1 << 12, 5000)
    assert np.array_equal(toxicity.distinct(values, 12), np.unique(values))


def plain_buckets(text, orders=(3, 4), bits=18):
    """Distinct grams as strings, and their hashes in whole numbers."""
    chars = [32 if 9 <= ord(c) <= 13 else ord(c) + 32 * ("A" <= c <= "Z") for c in f" {text} "]
    grams = {tuple(chars[i : i + n]) for n in orders for i in range(len(chars) - n + 1)}
    out = set()
    for g in grams:
        code = 0
        for c in g:
            code = (code * 0x01000193 + c + 1) % 2**32
        code = code * 2654435761 % 2**32
        code ^= code >> 15
        out.add((code * 2246822519 % 2**32) >> (32 - bits))
    return out


def test_grams_are_of_characters():
    for text in ["Straße über Ähre", "Привет, мир", "日本語のテキスト", "Yes\tNo \u00a0 x", "a", "", "😀 ok 😀", words(60, 3)]:
        assert set(toxicity.features_of(text, toxicity.Settings()).tolist()) == plain_buckets(text), text
    assert len(toxicity.features_of("日本語", toxicity.Settings(orders=(3,)))) == 3


def test_regression_against_a_dense_one():
    s = toxicity.Settings(bits=6, rounds=15)
    rng = np.random.default_rng(6)
    sample = [(int(k % 3 == 0), np.sort(rng.choice(64, rng.integers(1, 20), replace=False)).astype("<u4")) for k in range(50)]
    ratio = rng.standard_normal(64)
    x = np.zeros((50, 64))
    for row, (_, f) in zip(x, sample):
        row[f] = ratio[f] / np.sqrt(len(f))
    y = np.array([t for t, _ in sample], float)
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, m, v = np.zeros(65), np.zeros(65), np.zeros(65)
    for k in range(1, s.rounds + 1):
        error = each * (1 / (1 + np.exp(-(x @ w[:64] + w[64]))) - y)
        slope = np.append(x.T @ error + s.ridge * w[:64] / len(y), error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - s.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    got, bias = toxicity.fit_regression(list(sample), ratio, s, part=16)
    assert np.allclose(got, w[:64], atol=1e-8) and abs(bias - w[64]) < 1e-8


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    got = toxicity.toxicity(frame(spark, docs), frame(spark, labels, LABELS)).toPandas()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(docs)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95


def test_scores_know_texts_alone_and_counts_match_a_plain_count(spark):
    docs, labels = corpus(200)
    s = toxicity.Settings()
    d, lab = frame(spark, docs), frame(spark, labels, LABELS)
    plain = np.zeros((2, 1 << s.bits), int)
    truth = {i: t for i, _, t in labels}
    for i, text, *_ in docs:
        if i in truth and zlib.crc32(str(i).encode()) % 5:
            plain[truth[i], toxicity.features_of(text, s)] += 1
    got = toxicity.bucket_counts(toxicity.labelled(d, lab), s).where("bucket >= 0").toPandas()
    assert (plain[1, got.bucket] == got.toxic).all() and (plain[0, got.bucket] == got.clean).all()
    assert got.toxic.sum() == plain[1].sum() and got.clean.sum() == plain[0].sum()
    swapped = frame(spark, [(i, t, "xx", "zz", 0) for i, t, *_ in docs])
    a = toxicity.toxicity(d, lab).orderBy("doc_id").toPandas()
    b = toxicity.toxicity(swapped, lab).orderBy("doc_id").toPandas()
    assert np.allclose(a.score, b.score)


def test_odd_rows(spark):
    rows = odd_docs()
    docs = frame(spark, [(*r, 1, 0.5, 0.1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, toxic int, score double, toxic_score double, toxic_text string")
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (1, 1, 1), (None, 1, 1), (5, None, None), (9, 0, 0), (77, 1, 1), (7, 1, 9)]):
        got = toxicity.toxicity(docs, frame(spark, labels, LABELS)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.without_toxic(docs, frame(spark, [(1, 1, 0)], LABELS))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity.toxicity(frame(spark, []), frame(spark, [], LABELS)).count() == 0
