from __future__ import annotations

import random
import re
import sys
import tracemalloc
import unicodedata
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat, metrics, text, tokens
from corpusmill.functions.numbers import rounded


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one_column(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [v for _, v in sorted((r.i, r.v) for r in rows)] if all(r.v is not None for r in rows) else [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_white_space_is_pythons(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c < 0x3100)]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    found = {r.c for r in rows.where(F.col("t").rlike(f"^{text.SPACE}$")).collect()}
    assert found == {c for c in range(sys.maxunicode) if re.match(r"\s", chr(c))} and len(found) == 29


def test_folding_and_compacting_are_pythons(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x600 or chr(c).casefold() != chr(c).lower())]
    assert one_column(spark, points, text.casefold) == [p.casefold() for p in points]
    samples = [" 彝文：“ꀀ ꁌ” ", "Straße_ﬁ é", "éÉ", "", "…", "ǅ ΣΑΣ"]
    want = [re.sub(r"[\s\W_]+", "", unicodedata.normalize("NFC", s).casefold()) for s in samples]
    assert one_column(spark, samples, text.compact) == want and want[0] == "彝文ꀀꁌ"


def test_normalising_and_counting(spark):
    samples = ["  A \n B  ", "a 　b\x1c", "é", "", "\x85"]
    assert one_column(spark, samples, text.normalize) == [re.sub(r"\s+", " ", unicodedata.normalize("NFC", s)).strip() for s in samples]
    assert one_column(spark, samples, text.strip) == [s.strip() for s in samples]
    assert values(spark, [("ꀀꁁ中文",), ("",), ("꒐ x",)], "t string", text.count_yi_syllables(F.col("t")), text.count_visible(F.col("t")), text.yi_ratio(F.col("t")), text.count_yi_radicals(F.col("t"))) == [(2, 4, 0.5, 0), (0, 0, 0.0, 0), (0, 2, 0.0, 1)]


@pytest.mark.parametrize(
    ("prompt", "reference", "want"),
    [
        ("请翻译成中文：", "x", "zh"),
        ("请翻译成彝语：", "x", "yi"),
        ("用彝文回答", "x", "yi"),
        ("ꀀꀁ", "词", "zh"),
        ("Say it IN ENGLISH", "x", "en"),
        ("汉语怎么说", "ꀀ", "zh"),
        ("Translate into English", "x", "en"),
        ("判断：翻译成中文", "ꀀ", "unknown"),
        ("hello", "x", "unknown"),
        ("hello", "ꀀ", "yi"),
        ("翻译成中文 用英文", "x", "zh"),
    ],
)
def test_target_language(spark, prompt, reference, want):
    assert values(spark, [(prompt, reference)], "p string, r string", metrics.target_language(F.col("p"), F.col("r"))) == [(want,)]


def test_phrase_tables_have_all_entries():
    assert [len(t) for t in (metrics.ZH_PHRASES, metrics.YI_PHRASES, metrics.EN_PHRASES, metrics.OTHER_TASKS)] == [28, 18, 27, 5]


def test_thinking_spans(spark):
    rows = {"<think> 2 + 2 = 4 </think>4": "2 + 2 = 4", "reasoning without opener</think>answer": "reasoning without opener", "answer only": None, "a<think>b<think> c</THINK>d</think>": "c", "</think>": "", "ß</think>x": "ß"}
    assert one_column(spark, list(rows), metrics.thinking_span) == list(rows.values())


def plain_chrf(reference, hypothesis):
    scores = []
    for n in range(1, 7):
        r, h = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (reference, hypothesis))
        if r and h:
            both = sum((r & h).values())
            p, q = both / sum(h.values()), both / sum(r.values())
            scores.append(5 * p * q / (4 * p + q) if p + q else 0.0)
    return 100 * sum(scores) / len(scores) if scores else 0.0


def test_chrf_holds_few_characters_at_once():
    rng = random.Random(7)
    own = pd.Series(["".join(rng.choices("abcdefgh é日", k=1000)) for _ in range(400)])
    other = own[::-1].reset_index(drop=True)
    tracemalloc.start()
    got = metrics.chrf2_column.func(own, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    assert got.tolist() == metrics.gram_scores(own.tolist(), other.tolist()).tolist()


def test_chrf_and_error_rate(spark):
    pairs = [("abc", "abc"), ("abc", "axc"), ("ꀀꁌꂷ", "ꀀꁌꂷ"), ("", ""), ("", "abc"), ("ab", ""), ("abcdefgh", "abxdefghi"), ("aaaa", "aa"), ("x", "y")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, r string, h string")
    got = {r.k: r.chrf2 for r in metrics.chrf2(rows, ["k"], "r", "h").collect()}
    for i, (r, h) in enumerate(pairs):
        assert got[i] == pytest.approx(plain_chrf(r, h), abs=1e-9)
        assert metrics.gram_scores([r], [h])[0] == pytest.approx(plain_chrf(r, h), abs=1e-9)
    rng = random.Random(2)
    pairs += [("".join(rng.choice("abç \U0001f600ꀀ") for _ in range(rng.randrange(60))), "".join(rng.choice("abç \U0001f600") for _ in range(rng.randrange(60)))) for _ in range(200)]
    want = [pytest.approx(plain_chrf(r, h), abs=1e-9) for r, h in pairs]
    assert metrics.gram_scores(*zip(*pairs)).tolist() == want
    many = spark.createDataFrame([(i, *p) for i, p in enumerate([*pairs, (None, "a"), ("a", None)])], "k int, r string, h string")
    assert [r.c for r in many.select("k", metrics.chrf2_column(F.col("r"), F.col("h")).alias("c")).orderBy("k").collect()] == [*want, None, None]
    cer = [r.c for r in rows.orderBy("k").select(metrics.character_error_rate(F.col("r"), F.col("h")).alias("c")).collect()]
    assert cer[:5] == [0, pytest.approx(1 / 3), 0, 0, 3]


def test_smoke_reasons(spark):
    got = values(spark, [("北京是中国的首都。", "北京"), ("乱码�", "Paris"), (" \n", "x")], "a string, e string", metrics.smoke_reasons(F.col("a"), F.col("e")))
    assert got == [([],), (["unicode_replacement_character", "expected_text_missing"],), (["empty", "expected_text_missing"],)]


def test_stop_tokens(spark):
    rows = [([7, 8, 151645, 9], [151643, 151645]), ([1, 2], [3]), ([], [3])]
    ids, stops = F.col("i"), F.col("s")
    assert values(spark, rows, "i array<bigint>, s array<bigint>", tokens.generated_length(ids, stops), tokens.stop_reason(ids, stops)) == [(3, "eos"), (2, "length"), (0, "length")]
    got = values(spark, [([5, 2], [9, -1, 7, 2], 7), (None, [4], None)], "e array<bigint>, n array<bigint>, u bigint", tokens.stop_ids(F.col("e"), F.col("n"), F.col("u")))
    assert got == [([2, 5, 9],), ([4],)]


def test_plug_in_tokenizers(spark):
    tokens.register("pairs", lambda t: [t[i : i + 2] for i in range(0, len(t), 2)])
    assert one_column(spark, ["abc", "", "ꀀꁌ"], lambda c: tokens.token_count(c, "pairs")) == [2, 0, 1]
    for encode in (lambda t: [1, 2], lambda t: [[1, 2]], lambda t: {"input_ids": [1, 2]}):
        assert one_column(spark, ["x"], tokens.ids_column(encode)) == [[1, 2]]


def test_templates(spark):
    h = chat.START + "assistant\n"
    got = values(spark, [("x" + h, chat.EMPTY_THINKING + "y", "x", "x" + chat.EMPTY_THINKING), ("x", "y", chat.EMPTY_THINKING, "x")], "a string, b string, c string, d string", F.size(chat.rendering_failures(*(F.col(c) for c in "abcd"))))
    assert got == [(0,), (4,)]


def test_rounding_is_of_the_binary_value(spark):
    numbers = [2.675, 0.125, 318.155, 1.005, 0.5, 1.5, -0.125]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(rounded(F.col("x"), 2)).collect()]
    assert [round(x, 2) for x in numbers][1] == 0.12 and got == pytest.approx([round(x, 2) for x in numbers], abs=0.0101)
    assert got[1] == 0.12 and got[2] == pytest.approx(318.15)


def test_sets_of_characters_that_need_no_python():
    """Every character of the sets is a starter in normal form C that no composition ends with, and those without case fold to themselves."""
    java = lambda x: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)) if m[1] != "2ff" else "\u02ff", x)
    composed, folded = (re.compile(java(x)) for x in (text.COMPOSED, text.FOLDED))
    ends = set()
    for c in map(chr, range(0x110000)):
        d = unicodedata.decomposition(c)
        if d and "<" not in d and len(d.split()) == 2:
            ends.add(chr(int(d.split()[1], 16)))
    for c in map(chr, range(0x300, 0x110000)):
        if composed.match(c):
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in ends, hex(ord(c))
        if folded.match(c):
            assert c.casefold() == c == c.lower(), hex(ord(c))


def python_steps(df):
    """Nodes of a plan that wait for a Python worker of their own."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_chrf2_needs_two_python_steps(spark, tmp_path):
    from corpusmill.plans import catalogue

    spark.createDataFrame([(i, t, "assistant", x) for i in range(9) for t, x in enumerate(["Ångström Å ΣΑΣ", "in  English", "İ ﬁ ꀀ", None])], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert python_steps(catalogue.chrf2(spark, str(tmp_path))) == 2
    both = catalogue.chrf2(spark, str(tmp_path)).join(catalogue.generation_scores(spark, str(tmp_path)).select("conv_id", "turn", F.col("chrf2").alias("own")), ["conv_id", "turn"]).collect()
    assert both and all(r.chrf2 == r.own for r in both)
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFC", t).casefold() if c.isalnum())
    texts = spark.createDataFrame([("Å  ́x ΣΑΣ",), ("ǰ ŉ J̌ İ",), ("ẞ ß ﬁ",)], "t string")
    assert all(r.c == plain(r.t) == r.n for r in texts.select("t", text.compact(F.col("t")).alias("c"), text.compact(text.normalize(F.col("t"))).alias("n")).collect())


def test_scores_need_two_python_steps(spark):
    from corpusmill.operators import scoring

    rows = spark.createDataFrame([(1, "Ⅳ IN\u2003ENGLISH", "Å  x", "Å x", "eos", 1, 0.5)], "k int, prompt string, reference string, response string, stop_reason string, generated_tokens int, batch_seconds_per_sample double")
    scores = scoring.score(rows, ["k"])
    assert python_steps(scores) == 2
    (row,) = scores.collect()
    assert row.target_language == "en" and row.exact and row.compact_exact and row.chrf2 == 100
    assert python_steps(scoring.summarize(scores)) == 2



def test_loops_read_bounded_batches(spark, tmp_path):
    from corpusmill.plans import catalogue

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        spark.createDataFrame([(1, "abcabcabcabc"), (2, "abc"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        assert {r.doc_id: r.loops for r in catalogue.repetition_loops(spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: None}
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
