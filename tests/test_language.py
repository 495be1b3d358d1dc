from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import language


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def runs(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def plain_bleu(pairs, most_n=4):
    hits, totals, r, g = Counter(), Counter(), 0, 0
    for reference, generated in pairs:
        a, b = split(reference), split(generated)
        r, g = r + len(a), g + len(b)
        for n in range(1, most_n + 1):
            x, y = runs(a, n), runs(b, n)
            hits[n] += sum((x & y).values())
            totals[n] += sum(y.values())
    precision = [hits[n] / totals[n] if totals[n] else 0.0 for n in range(1, most_n + 1)]
    brevity = 1.0 if g >= r else math.exp(1 - r / g) if g else 0.0
    return (len(pairs), g, r, *precision, brevity, brevity * math.exp(sum(map(math.log, precision)) / most_n) if min(precision) else 0.0)


def test_bleu_pools_clipped_counts(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "The", "cat", "sat", "é", "on", "mat"]) for _ in range(rng.randrange(0, 14)))
    rows = [(i, text(), text() if i % 4 else None, "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, f"one two three four five {i}", f"one two three four five {i}", "same") for i in range(3)] + [(200, "a b", "", "none"), (201, None, "a b c d e", "none"), (300, "the cat", "the the the the the the the", None)]
    got = {r.g: tuple(r)[1:] for r in language.bleu(spark.createDataFrame(rows, "id int, reference string, generated string, g string"), "reference", "generated", "id", "g").collect()}
    for g in {r[3] for r in rows}:
        assert got[g] == pytest.approx(plain_bleu([(a, b) for _, a, b, k in rows if k == g])), g
    assert got["same"][-1] == 1.0 and got["none"][-1] == 0.0 and got[None][3] == pytest.approx(1 / 7)
    (whole,) = language.bleu(spark.createDataFrame(rows, "id int, reference string, generated string, g string"), "reference", "generated", "id").collect()
    assert tuple(whole) == pytest.approx(plain_bleu([(a, b) for _, a, b, _ in rows]))


def starred(words):
    """Words that are no start or end, which stand as brackets here."""
    return [f"{w}*" if w in "()" else w for w in words]


def plain_model(learned):
    three = Counter()
    for words in learned:
        t = ["(", "(", *starred(words), ")"]
        three.update(zip(t, t[1:], t[2:]))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)

    def discount(table):
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    d3, d2, d1 = map(discount, (three, two, one))

    def p(u, v, w):
        own = 1 / (len(one) + 1)
        if one:
            own = (max(one[w] - d1, 0) + d1 * len(one) * own) / sum(one.values())
        after = [c for (x, _), c in two.items() if x == v]
        if after:
            own = (max(two[v, w] - d2, 0) + d2 * len(after) * own) / sum(after)
        after = [c for (x, y, _), c in three.items() if (x, y) == (u, v)]
        if after:
            own = (max(three[u, v, w] - d3, 0) + d3 * len(after) * own) / sum(after)
        return own

    return p, {w for _, _, w in three}


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("a b c d e".split()) if rng.random() < 0.8 else f"r{rng.randrange(40)}" for _ in range(rng.randrange(0, 25)))) for i in range(n)]


def test_perplexity_against_a_plain_model(spark):
    rows = corpus(2, 40) + [(900, None), (901, " \t "), (902, "Never seen words, (not) ( )"), (903, "A a A a A")]
    got = {r.doc_id: r for r in language.perplexity(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 != 1).collect()}
    p, vocabulary = plain_model([split(t) for i, t in rows if i % 5 != 1])
    assert got.keys() == {i for i, _ in rows}
    for i, text in rows:
        t = ["(", "(", *starred(split(text)), ")"]
        logs = [math.log10(p(*t[k : k + 3])) for k in range(len(t) - 2)]
        assert got[i].n_tokens == len(logs)
        assert got[i].log10_prob == pytest.approx(sum(logs)) and got[i].perplexity == pytest.approx(10 ** (-sum(logs) / len(logs)))
    # What may follow a context, all unknown words as one, adds up to 1.
    for u, v in (("(", "("), ("a", "b"), ("never", "seen"), ("r1", "a")):
        assert sum(p(u, v, w) for w in vocabulary) + p(u, v, "unknown") == pytest.approx(1.0)


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame(corpus(3, 5), "doc_id long, text string")
    assert {r.perplexity for r in language.perplexity(docs, F.lit(False)).collect()} == {1.0}
    assert language.perplexity(docs.limit(0), F.lit(True)).count() == 0
    assert language.discounts(language.model_counts(language.gram_counts(docs.limit(0), "doc_id", "text", F.lit(True)))).first().d_3 == 0.5


def shuffled_by(df):
    """The first column of each hash exchange of a plan."""
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_discounts_shuffle_runs_once(spark):
    docs = spark.createDataFrame(corpus(4, 30), "doc_id long, text string")
    tables = language.model_counts(language.gram_counts(docs, "doc_id", "text", F.col("doc_id") % 5 != 1))
    assert shuffled_by(language.discounts(tables)) in (["bucket", "w"], ["w", "bucket"])
    whole = Counter(r for i, t in corpus(4, 30) if i % 5 != 1 for r in runs([" (", " (", *split(t), " )"], 3).elements())
    assert {(r.u, r.v, r.w): r.c for r in tables["three"].collect()} == whole


def test_perplexity_deals_runs_by_their_middle_word_alone(spark):
    texts = dict(enumerate(["a b a b", None, "é\tÉ a", "b b b", "a b a b"]))
    rows = [(k, texts[i]) for i, k in enumerate(["x\ty\n", "/", "", None, "é%2F +"])]
    own = language.perplexity(spark.createDataFrame(rows, "name string, text string"), F.lit(True), "name")
    assert set(shuffled_by(own)) == {"bucket", "w", "k"}
    p, _ = plain_model([split(t) for t in texts.values()])
    got = {r.name: r.log10_prob for r in own.collect()}
    for k, text in rows:
        t = ["(", "(", *split(text), ")"]
        assert got[k] == pytest.approx(sum(math.log10(p(*t[i : i + 3])) for i in range(len(t) - 2)))


def test_perplexity_packs_runs_as_numbers_and_spreads_hot_words(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(2000)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(2000)], k=400))) for i in range(200)] + [(900, "a a a a"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    own = language.perplexity(docs, F.col("doc_id") % 5 != 1)
    # Runs are neither sorted as rows nor joined to any.
    assert "Window" not in own._jdf.queryExecution().executedPlan().toString()
    counts = Counter(w for _, t in rows for w in split(t))
    dealing = language.Dealing([(w, n) for w, n in counts.most_common() if n > 1], sum(counts.values()), 16)
    packed = language.packed_runs(docs.select("text", (F.col("doc_id") % 5 != 1).alias("l"), F.col("doc_id").cast("string")), dealing).collect()
    runs_of = Counter()
    for r in packed:
        if r.bucket >= 0:
            runs_of[r.bucket] += len(language.unsqueezed(r.d))
    assert sum(runs_of.values()) == sum(len(split(t)) + 1 for _, t in rows)
    # "word0" has an eighth of all words, a bucket is meant to hold a 16th.
    assert dealing.hot and max(runs_of.values()) < sum(runs_of.values()) / 8
    assert sum(len(x) for r in packed if r.bucket >= 0 for x in (r.v, r.w, r.u, r.d, r.words)) < 12 * sum(runs_of.values())
    p, _ = plain_model([split(t) for i, t in rows if i % 5 != 1])
    got = {r.doc_id: r for r in own.collect()}
    for i in (0, 1, 7, 900, 901):
        t = ["(", "(", *split(dict(rows)[i]), ")"]
        assert got[i].n_tokens == len(t) - 2
        assert got[i].log10_prob == pytest.approx(sum(math.log10(p(*t[k : k + 3])) for k in range(len(t) - 2)))
