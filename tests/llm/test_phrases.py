from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from corpusmill.llm import phrases
from tests.llm.helpers import doc, frame, odd_docs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, most_words=3):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def plain(rows, most_words=3, least=10, held_within=50, most=2000):
    f, n = plain_counts(rows, most_words)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in found.items():
        if longer[lang, w] and 100 * longer[lang, w] >= held_within * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most]))


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    pool = ["the", "of", "New", "York", "city", "a", "é", "ça", "The", "x\x01y", "\x01", "日本", "and"]
    text = lambda: "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b "]) for _ in range(rng.randrange(80)))
    return [(i, text(), rng.choice(["en", "fr", None, "und", "x y", "100%\t"]), "s", 1) for i in range(n)]


def made(spark, rows, **options):
    return sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), **options).collect())


def test_against_plain_counts(spark):
    rows = corpus()
    assert made(spark, rows) == plain(rows)
    assert made(spark, rows, most=7) == plain(rows, most=7)
    assert made(spark, rows, least=4, held_within=80, most=None) == plain(rows, 3, 4, 80, 10**9)
    assert made(spark, rows, most_words=4, least=3, most=None) == plain(rows, 4, 3, 50, 10**9)


def test_parts_of_counts_meet_wherever_hot_words_go(spark, monkeypatch):
    rows = corpus(2, 200)
    want = {f"{phrases.quoted(lang)}\t{' '.join(w)} ": a for (lang, w), a in plain_counts(rows)[0].items() if a >= 10}
    docs = frame(spark, rows).repartition(6)
    for hot in (1, 8, 100000):
        monkeypatch.setattr(phrases, "HOT", hot)
        got = {r.key: r.f for r in phrases.phrase_counts(docs).collect() if not r.key.endswith("\t")}
        assert got == want


def test_stack_goes_on_between_batches(spark):
    rows = corpus(3, 150)
    whole = made(spark, rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    real = phrases.gathered
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    phrases.gathered = lambda batches: (b for b in batches if b.num_rows)
    try:
        assert made(spark, rows) == whole == plain(rows)
    finally:
        phrases.gathered = real
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_words_of_any_text():
    texts = ["", "a", "b c", ".x.", "", "d.e f", "﻿ g h", " \t"]
    found, of, pieces = phrases.words_of(pa.array(texts))
    assert found.to_pylist() == ["a", "b", "c", "x", "d", "e", "f", "﻿", "g h"]
    assert of.tolist() == [1, 2, 2, 3, 5, 5, 5, 6, 6]
    assert [x == y for x, y in zip(pieces[:-1], pieces[1:])] == [False, True, False, False, False, True, False, True]


def test_numbers_of_many_columns_stay_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500) for _ in range(3)]
    number, firsts = phrases.numbered(np.zeros(500, np.int64), columns, 1 << 40)
    rows = list(zip(*columns))
    assert len(firsts) == len(set(rows))
    assert all(rows[firsts[k]] == r for k, r in zip(number, rows))


@pytest.mark.xfail(reason="open: the SQL counts some phrases of this odd corpus lower than the operator and the plain version do; the cause is not found yet")
def test_sql_agrees(spark, tmp_path):
    rows = corpus(4, 150) + odd_docs()
    frame(spark, rows).write.parquet(f"{tmp_path}/d")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(duck.sql(f"select lang, rank, phrase, a, l, r, n, score from ({phrases.oracle()})").fetchall()) == plain(rows)


def test_odd_rows(spark):
    rows = odd_docs() + [doc(50 + k, "Same words. same words, SAME WORDS", "a") for k in range(9)]
    assert made(spark, rows) == plain(rows)
    assert made(spark, []) == []
    more = frame(spark, [(*r, 1, 2, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, f int, key int, head string")
    assert sorted(tuple(r) for r in phrases.collocations(more).collect()) == plain(rows)


def test_one_word_in_all_places(spark):
    rows = [(i, "the " * 400 + words(30, i), "en", "s", 1) for i in range(40)]
    assert made(spark, rows) == plain(rows)


def test_batches_sent_on_are_small(monkeypatch):
    taken = {}

    class Rows:
        def mapInArrow(self, run, schema):
            taken["run"] = run
            return self

    monkeypatch.setattr(phrases, "bounded_batches", lambda rows: rows)
    phrases.suffixes(Rows(), 3, frozenset())
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50000)}" for _ in range(2000)) for _ in range(150)]
    made_batches = list(taken["run"](iter([pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])])))
    assert max(b.num_rows for b in made_batches) <= 1 << 15
    assert sum(sum(b.column(1).to_pylist()) for b in made_batches) == 2000 * 150
