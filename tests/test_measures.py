from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import garble
from corpusmill.operators import integrity, sampling


def brute_repeated(text, least=2, repeats=4):
    covered = set()
    for p in range(1, len(text) // repeats + 1):
        size = repeats * p * -(-least // p)
        start = 0
        while start + p < len(text):
            end = start
            while end + p < len(text) and text[end] == text[end + p]:
                end += 1
            if end + p - start >= size:
                covered.update(range(start, end + p))
            start = max(end, start + 1)
    return len(covered)


def test_repeated_characters_against_all_periods():
    rng = random.Random(1)
    for _ in range(400):
        parts = [rng.choice(["ab", "a", "abc", "xyxz", "日本"]) * rng.randrange(1, 9) if rng.random() < 0.5 else "".join(rng.choice("abx") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        for least, repeats in ((2, 4), (1, 3), (5, 3)):
            assert integrity.repeated_characters(text, least, repeats) == brute_repeated(text, least, repeats), (text, least, repeats)


def test_repetition_rates_by_task(spark):
    rows = [("a", "ha" * 10 + "!"), ("a", "plain words"), ("a", None), ("b", ""), ("b", "x" * 50_000 + "yz"), (None, "abcabcabcabc")]
    got = {r.task: r for r in integrity.repetition_rates(spark.createDataFrame(rows, "task string, t string"), "t", "task").collect()}
    assert (got["a"].texts, got["a"].characters, got["a"].repeated, got["a"].looping_texts) == (3, 32, 20, 1)
    assert got["a"].rate == pytest.approx(20 / 32) and got["a"].mean_rate == pytest.approx(20 / 21 / 3)
    assert got["b"].repeated == 50_000 and got[None].rate == 1.0
    with pytest.raises(ValueError):
        integrity.repetition(F.col("t"), repeats=2)


def plain_double(text, codec):
    """Characters of a text whose bytes were read by another codec, found by reading them back."""
    return len(re.findall("[^\x00-\x7f]", text)), text.encode().decode(codec)


def test_doubly_encoded_text_is_counted(spark):
    texts = ["naïve café", "Größe — “quoted” €5", "日本語 text", "😀 smile", "plain"]
    rows = []
    for t in texts:
        rows.append((t, 0))
        for codec in ("latin-1", "cp1252"):
            try:
                n, spoilt = plain_double(t, codec)
            except UnicodeDecodeError:
                continue
            rows.append((spoilt, n))
    rows += [("Ã", 0), ("â€", 0), ("ÃÃ©", 1), ("", 0), (None, None), ("é è ñ Ü", 0)]
    df = spark.createDataFrame(rows, "t string, n long")
    for r in df.select("t", "n", garble.doubly_encoded(F.col("t")).alias("got"), garble.doubly_encoded_length(F.col("t")).alias("length")).collect():
        assert r.got == r.n, r
        assert r.length is None if r.t is None else (r.length > 0) == (r.n > 0)


def test_spoilt_tails(spark):
    rows = [("end�", "replacement"), ("a‍", "joiner"), ("\U0001f1e6", "half_flag"), ("x\U0001f1e6\U0001f1e7", None), ("x\U0001f1e6\U0001f1e7\U0001f1e8", "half_flag"), ("smile ðŸ˜", "encoded_cut"), ("â€", "encoded_cut"), ("â€™", None), ("", None), (None, None), ("� end", None)]
    df = spark.createDataFrame(rows, "t string, want string").select("want", garble.tail(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    (whole,) = garble.garbling(spark.createDataFrame([(1, "Ã©a"), (1, None), (1, "b�")], "g int, t string"), "t", "g").collect()
    assert (whole.texts, whole.characters, whole.garbled, whole.replaced, whole.garbled_texts, whole.spoilt_tails) == (3, 5, 2, 1, 1, 1) and whole.rate == pytest.approx(0.6)


def test_weighted_sample(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.5, 1.0, 4.0]), f"g{i % 3}") for i in range(300)] + [(900, None, "g0"), (901, 0.0, "g0"), (902, -1.0, "g0"), (903, float("nan"), "g0"), (904, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, w double, g string")
    key = lambda i, w: -math.log((int(hashlib.sha256(f"5:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w
    for parts in (1, 7):
        got = sorted((r.g or "", r.sample_rank, r.id) for r in sampling.weighted_sample(df.repartition(parts), "id", F.col("w"), 12, "g", seed=5, salts=4).collect())
        want = []
        for g in ("g0", "g1", "g2", None):
            own = sorted((key(i, w), i) for i, w, own in rows if own == g and w is not None and w > 0)
            want += [(g or "", n + 1, i) for n, (_, i) in enumerate(own[:12])]
        assert got == sorted(want)
    alone = sampling.weighted_sample(df, "id", F.col("w"), 5).collect()
    assert len(alone) == 5 and sorted(r.sample_rank for r in alone) == [1, 2, 3, 4, 5]


def test_inclusion_follows_weight(spark):
    rows = spark.range(3).selectExpr("id", "case id when 0 then 1.0 when 1 then 2.0 else 5.0 end as w")
    seeds = [sampling.weighted_sample(rows.select(F.concat_ws("-", "id", F.lit(s)).alias("k"), "id", "w"), "k", F.col("w"), 1, seed=s) for s in range(2)]
    assert all(s.count() == 1 for s in seeds)
    many = spark.range(6000).selectExpr("id", "id div 3 as g", "case id % 3 when 0 then 1.0 when 1 then 2.0 else 5.0 end as w")
    first = sampling.weighted_sample(many, "id", F.col("w"), 1, "g", seed=1)
    counts = {r["k"]: r["count"] for r in first.groupBy((F.col("id") % 3).alias("k")).count().collect()}
    for k, w in ((0, 1), (1, 2), (2, 5)):
        assert abs(counts[k] / 2000 - w / 8) < 5 * math.sqrt(w / 8 * (1 - w / 8) / 2000)


def test_batch_plan(spark):
    rng = random.Random(4)
    lengths = [rng.randrange(1, 300) for _ in range(990)] + [5000] * 8 + [None]
    half = spark.createDataFrame([(x, "a") for x in lengths[:500]], "length int, g string"), spark.createDataFrame([(x, "a") for x in lengths[500:]], "length int, g string")
    whole = sampling.merged_sketches(*(sampling.length_sketch(h, 1024, "g") for h in half))
    assert whole.count() <= 1025 and whole.agg(F.sum("n")).first()[0] == 998
    (row,) = sampling.batch_plan(whole, 10**9, 10**8, 10_000, 10**8, group="g").collect()
    capped = sorted(min(x, 1024) for x in lengths if x is not None)
    planned = -(-capped[math.ceil(0.99 * 998) - 1] // 64) * 64
    assert (row.samples, row.planned_length, row.longest) == (998, planned, 1024)
    assert row.batch_size == 8 * 10**8 // (planned * 10_000) and row.batch_size_by_longest == 8 * 10**8 // (1024 * 10_000)
    assert row.over_plan == sum(x > planned for x in capped)
    (none,) = sampling.batch_plan(sampling.length_sketch(half[0], 1024), 10, 20, 1, 0).collect()
    assert none.batch_size == 0
