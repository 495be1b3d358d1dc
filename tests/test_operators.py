from __future__ import annotations

import math
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.operators import chunk, config, gates, integrity, leakage, numeric, profile, reshape, resume, scoring, stages, statistics

SFT = "id string, messages array<struct<role:string,content:string>>, reference string"


def m(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


def test_prompts_and_completions(spark):
    rows = [
        ("a", m(("system", "s"), ("user", "翻译成彝文：你好 \n"), ("assistant", "ꀋ")), None),
        ("b", m(("user", "x"),), None),
        ("c", m(("user", "first"), ("assistant", "y"), ("user", "keep /no_think  "), ("assistant", "z")), None),
        ("d", m(("system", "s"), ("assistant", "z")), None),
        ("e", [], None),
        ("f", None, None),
    ]
    good, bad = reshape.prompt_completion(spark.createDataFrame(rows, SFT), append_no_think=True)
    got = {r.id: r for r in good.collect()}
    assert got.keys() == {"a", "c"}
    assert [x.content for x in got["a"].prompt] == ["s", "翻译成彝文：你好\n\n/no_think"] and got["a"].completion[0].content == "ꀋ"
    assert [x.content for x in got["c"].prompt] == ["first", "y", "keep /no_think  "]
    assert got["a"].messages[1].content == "翻译成彝文：你好 \n"
    assert {r.id: r.error for r in bad.collect()} == {"b": "last_message_not_assistant", "d": "no_user_message", "e": "messages_empty", "f": "messages_empty"}
    assert reshape.prompt_completion(spark.createDataFrame(rows, SFT))[0].count() == 3


def test_evaluation_projection(spark):
    rows = [
        ("1", m(("user", "q"), ("assistant", " a ")), None),
        ("2", m(("user", "q")), " kept "),
        ("3", m(("user", "q")), " "),
        ("4", m(("user", "q"), ("assistant", " ")), "r"),
        ("5", m(("user", "q"), ("assistant", "a")), "b"),
        ("6", m(("user", "q"), ("assistant", "x"), ("assistant", "a")), None),
        ("7", m(("assistant", "a")), None),
        ("8", [], "r"),
        ("9", m(("user", "q"), ("assistant", "a")), " a "),
    ]
    got = {r.id: (len(r.messages), r.reference, r.error) for r in reshape.evaluation_projection(spark.createDataFrame(rows, SFT)).collect()}
    assert got["1"] == (1, "a", None) and got["2"] == (1, " kept ", None) and got["9"] == (1, "a", None)
    assert [got[k][2] for k in "345678"] == ["reference_empty", "assistant_reference_empty", "reference_mismatch", "prompt_ends_with_assistant", "prompt_ends_with_assistant", "messages_empty"]


def test_overfit_split_and_exact_limit(spark):
    rows = spark.createDataFrame([(f"{i:02d}", m(("user", "q"), ("assistant", f"a{i}")) if i % 3 else m(("user", "q")), None) for i in range(20)], SFT)
    out = reshape.overfit_split(rows, 5)
    assert [(r.id, r.reference, len(r.eval_messages), r.split) for r in out.orderBy("id").collect()] == [(f"{i:02d}", f"a{i}", 1, "overfit_gate") for i in (1, 2, 4, 5, 7)]
    assert reshape.exactly(out, 5).count() == 5
    with pytest.raises(Exception, match="exactly 64"):
        reshape.exactly(out, 64).collect()
    with pytest.raises(ValueError, match="at least 1"):
        reshape.overfit_split(rows, 0)


def test_benchmark_items(spark):
    rows = spark.createDataFrame([(7, " 翻译 ", "ꀀꀁ", "参考答案"), (8, "t", " ", "o"), (9, "t", None, ""), (10, "", "x", "o")], "source_row int, instruction string, input string, output string")
    got = {r.source_row: r for r in reshape.benchmark_items(rows, "bench", "x/y").collect()}
    assert got[7].id == "bench-test-000007" and got[7].messages[0].content == "翻译\n\nꀀꀁ" and got[7].reference == "参考答案"
    assert got[8].messages[0].content == "t" and [got[k].error for k in (7, 9, 10)] == [None, "output_empty", "instruction_empty"]


def test_rendering_and_mask(spark):
    rows = spark.createDataFrame([("a", m(("user", "q"), ("assistant", "r")), None)], SFT)
    text = rows.select(chat.render(F.col("messages"), True).alias("t")).first().t
    assert text == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|endoftext|><|im_start|>assistant\n"
    segments = rows.select(chat.target_segments(F.col("messages")).alias("s")).first().s
    assert "".join(s.segment for s in segments) + "<|im_start|>assistant\n" == text
    assert [s.segment for s in segments if s.is_target] == ["r<|endoftext|>"]


def lengths(spark, values):
    return spark.createDataFrame([(v,) for v in values], "length long")


def test_padding_equals_the_direct_sum(spark):
    rng = random.Random(1)
    for n, b in ((0, 4), (3, 8), (17, 4), (64, 8), (50, 1)):
        values = [rng.randrange(1, 30) for _ in range(n)]
        ordered = sorted(values)
        want = sum(max(ordered[i : i + b]) * len(ordered[i : i + b]) for i in range(0, n, b))
        assert profile.padded_tokens(lengths(spark, values), b).first().padded == want


def test_profile(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 20, 100):
        raw = [rng.randrange(1, 60) for _ in range(n)]
        cut = sorted(min(v, 40) for v in raw)
        got = profile.length_profile(lengths(spark, raw), 40, 8).first()
        rank = lambda f: cut[max(0, min(n - 1, math.ceil(f * n) - 1))] if n else 0  # noqa: B023, E731
        assert (got.samples, got.raw_total, got.total, got.truncated_samples) == (n, sum(raw), sum(cut), sum(v > 40 for v in raw))
        assert (got.p50, got.p90, got.p95, got.p99, got.max) == (rank(0.5), rank(0.9), rank(0.95), rank(0.99), cut[-1] if n else 0)
        assert got.packed_sequences == math.ceil(sum(cut) / 40) and got.samples_per_sequence == got.compression_ratio


def test_bucket_limit_is_short(spark):
    rows = lengths(spark, [511, 512, 513]).withColumn("split", F.lit("train"))
    got = profile.bucket_manifest(rows).first()
    assert (got.total, got.short, got.long, got.max_length) == (3, 2, 1, 513)


def test_chunks_lose_nothing(spark):
    texts = ["彝语语料abcdefghi", "abc", "", "🙂é" * 9, None]
    rows = spark.createDataFrame([(i, t, i * 10) for i, t in enumerate(texts)], "doc_id int, text string, more int")
    encode = lambda t: [c for c in t for _ in range(2 if c == "é" else 1)]
    for cut in (None, chunk.token_chunks(encode, 4)):
        good, bad = chunk.chunked(rows, 4, cut=cut)
        got = good.collect()
        for i, t in enumerate(texts):
            own = sorted((r.derived_chunk.chunk_index, r.text) for r in got if r.doc_id == i)
            assert "".join(x for _, x in own) == (t or "") and all(len(encode(x) if cut else x) <= 4 for _, x in own)
            assert all(r.derived_chunk.chunk_count == len(own) and r.more == i * 10 for r in got if r.doc_id == i)
        assert {r.doc_id: r.error for r in bad.collect()} == {2: "text_empty", 4: "text_empty"}
        manifest = chunk.require_conserved(chunk.chunk_manifest(rows, good)).first()
        assert manifest.conserved and manifest.records == 3 and manifest.split_records == 2
    assert chunk.cut_text(lambda t: 9, "a", 4) is None
    with pytest.raises(ValueError, match="2 tokens"):
        chunk.chunked(rows, 1)
    broken = chunk.chunk_manifest(rows, chunk.chunked(rows, 4)[0].where("doc_id > 0"))
    with pytest.raises(Exception, match="all characters"):
        chunk.require_conserved(broken).collect()


def test_leakage(spark):
    schema = "label string, record int, part int, value string"
    bench = spark.createDataFrame([("x", 1, 0, "Same  text"), ("y", 2, 1, "Same text "), ("z", 2, 0, "Same text"), ("w", 3, 0, " "), ("v", 4, 0, "é")], schema)
    train = spark.createDataFrame([(1, "Same text"), (1, " Same\ntext"), (2, "same text"), (3, "é"), (4, ""), (5, None)], "line int, value string")
    for limit in (100, 0):
        got = sorted((r.line, r.label) for r in leakage.overlaps(train, bench, limit).collect())
        assert got == [(1, "y"), (1, "y"), (3, "v")]
    s = leakage.leakage_summary(train, bench).first()
    assert (s.benchmark_strings, s.training_strings, s.exact_overlaps, s.clean) == (2, 4, 3, False)
    assert leakage.overlap_details(train, bench, ["line"], 2).count() == 2


GEN = "source_index long, prompt string, reference string, response string, stop_reason string, generated_tokens int, batch_seconds_per_sample double"


def test_scores_and_summary(spark):
    rows = [(0, "翻译成彝文", "ꀀꁌ", "ꀀꁌ", "eos", 2, 0.5), (1, "翻译成中文", "测试", "测试", "length", 4, 1.5), (2, "判断", "", None, None, None, None), (3, "用彝文", "no yi", "!", "eos", 1, 0.0)]
    scores = scoring.score(spark.createDataFrame(rows, GEN), ["source_index"])
    by = {r.source_index: r for r in scores.collect()}
    assert by[0].yi_exact and by[0].chrf2 == pytest.approx(100) and by[0].cer == 0 and by[1].length_truncated and not by[1].yi_exact
    assert by[2].empty and by[2].exact and by[2].compact_exact and not by[2].reference_contained and by[2].chrf2 == 0 and by[2].cer == 0
    assert not by[3].yi_exact and not by[3].yi_reference_contained
    summary = {r.grp: r for r in scoring.summarize(scores).collect()}
    assert summary.keys() == {"overall", "yi", "zh", "unknown"}
    assert summary["overall"].records == 4 and summary["overall"].yi_exact_match == 0.5 and summary["zh"].yi_exact_match == 0.0 and summary["overall"].mean_seconds_per_sample == 0.5
    text = scoring.report("run", scoring.summarize(scores))
    assert [x.split(" | ")[0] for x in text.splitlines()[4:]] == ["| overall", "| yi", "| zh", "| unknown"] and text.endswith(" |\n")
    empty = scoring.summarize(scores.limit(0)).collect()
    assert [r.grp for r in empty] == ["overall"] and empty[0].records == 0 and empty[0].mean_chrf2 == 0


@pytest.mark.parametrize(("values", "want"), [((0.5, 70.0, 0.01, 0.05), True), ((0.499, 70.0, 0.01, 0.05), False), ((0.5, 69.99, 0.01, 0.05), False), ((0.5, 70.0, 0.011, 0.05), False), ((0.5, 70.0, 0.01, 0.051), False)])
def test_overfit_gate(spark, values, want):
    row = spark.createDataFrame([("overall", *values), ("yi", 0.0, 0.0, 1.0, 1.0)], "grp string, compact_exact_match double, mean_chrf2 double, replacement_character_rate double, length_truncation_rate double")
    assert [r.passed for r in gates.overfit_gate(row).collect()] == [want]


def test_retention_gate(spark):
    schema = "grp string, compact_exact_match double, thinking_terminated_rate double, length_truncation_rate double"
    frame = lambda *v: spark.createDataFrame([("overall", *v)], schema)
    assert gates.retention_gate(frame(0.8, 1.0, 0.0), frame(0.76, 0.95, 0.0)).first().passed
    assert not gates.retention_gate(frame(0.8, 1.0, 0.0), frame(0.75, 1.0, 0.0)).first().passed
    assert not gates.retention_gate(frame(0.8, 1.0, 0.0), frame(0.8, 0.94, 0.0)).first().passed
    assert not gates.retention_gate(frame(0.8, 1.0, 0.0), frame(0.8, 1.0, 0.1)).first().passed
    rows = spark.createDataFrame([("a", "x 2", "2"), ("b", "", "2")], "id string, response string, expected string")
    assert gates.smoke_gate(gates.smoke_results(rows), 1).first().passed and not gates.smoke_gate(gates.smoke_results(rows)).first().passed


def test_tensor_health(spark):
    rows = [("a", [1.0, -3.0, 0.0, math.nan]), ("a", [math.inf, -math.inf]), ("b", []), ("b", None)]
    frame = spark.createDataFrame(rows, "name string, v array<float>")
    got = {r.name: r for r in numeric.tensor_health(frame, "v", "name").collect()}
    assert (got["a"].tensors, got["a"].elements, got["a"].nonfinite_elements, got["a"].max_abs) == (2, 6, 3, 3.0)
    assert got["a"].zero_fraction == pytest.approx(1 / 3) and got["a"].mean_abs == pytest.approx(4 / 3) and got["a"].rms == pytest.approx(math.sqrt(10 / 3))
    assert tuple(got["b"])[1:] == (2, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert numeric.tensor_health(frame.limit(0), "v").first().elements == 0


def test_manifest_statuses(spark):
    required = spark.createDataFrame([(n,) for n in "abcdef"], "name string")
    declared = spark.createDataFrame([("a", "AA", 1), ("b", "bb", 2), ("c", "cc", 3), ("d", None, 4), ("f", "ff", 6)], "name string, sha256 string, records long")
    actual = spark.createDataFrame([("a", "aa", 10, 1), ("b", "xx", 20, 2), ("d", "dd", 40, 4), ("f", "ff", 60, 7)], "name string, sha256 string, bytes long, records long")
    got = {r.name: r.status for r in integrity.verify_manifest(required, declared, actual).collect()}
    assert got == {"a": "ok", "b": "sha_mismatch", "c": "missing", "d": "undeclared", "e": "undeclared", "f": "records_mismatch"}


def test_resume_and_merge(spark):
    rows = spark.range(20).withColumnRenamed("id", "source_index")
    left = resume.pending(rows, rows.where("source_index % 3 = 0"))
    assert left.count() == 13
    for n in (1, 4):
        parts = [rows.where(resume.shard(F.col("source_index"), n) == k) for k in range(n)]
        assert [r.source_index for r in resume.merged([*parts, parts[0]]).collect()] == list(range(20))
    with pytest.raises(ValueError, match="at least 1"):
        resume.first_rows(rows, ["source_index"], 0)


def test_loops_have_units_of_any_length(spark):
    rng = random.Random(4)

    def brute(t, least=2, repeats=4):
        return any(t[i : i + p] * repeats == t[i : i + p * repeats] for p in range(least, len(t) // repeats + 1) for i in range(len(t) - p * repeats + 1))

    texts = ["", "a", "aaaaaaa", "aaaaaaaa", "x" * 3 + "abab" * 2, "\U0001f600b" * 4]
    for k in range(400):
        unit = "".join(rng.choice("ab" if k % 2 else "abcdefgh ") for _ in range(rng.randrange(1, 60)))
        texts.append((unit * rng.randrange(2, 6))[: rng.randrange(1, 300)] + "".join(rng.choice("abc") for _ in range(rng.randrange(20))))
    sentence = "This sentence is much longer than forty characters and is said again. "
    texts += ["own words first " + sentence * 4, sentence * 3 + sentence[:-3]]
    rows = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (-1, None)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", integrity.has_loop(F.col("t"))).collect()}
    assert got == {**{i: brute(t) for i, t in enumerate(texts)}, -1: None}
    assert got[len(texts) - 2] and not got[len(texts) - 1] and 100 < sum(map(bool, got.values())) < 350


def test_loops_and_samples(spark):
    rows = spark.createDataFrame([("abababab",), ("abcabcabcabc",), ("aabbccdd",), ("xy\nxy\nxy\nxy\n",), ("aaaa",)], "t string")
    assert [r[0] for r in rows.select(integrity.has_loop(F.col("t"))).collect()] == [True, True, False, True, False]
    many = spark.range(300).select("id", (F.col("id") % 3).alias("s"))
    got = integrity.stratified_sample(many, "s", "id", 10).groupBy("s").count().collect()
    assert [r["count"] for r in got] == [10, 10, 10]
    splits = {r.s: r["count"] for r in spark.range(2000).select(integrity.hash_split(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()}
    assert 1500 < splits["train"] < 1700 and sum(splits.values()) == 2000


def test_config(tmp_path):
    good = {"stage": "sft", "base_model": "x", "train_file": "t", "output_dir": "o", "lora": {}, "training": {"completion_only_loss": True, "prompt_completion": True}}
    config.validate(good)
    for change, match in (({"stage": "rl"}, "cpt or sft"), ({"training": {}}, "exactly one"), ({"training": {"completion_only_loss": True}}, "prompt_completion"), ({"training": {"completion_only_loss": True, "assistant_only_loss": True}}, "exactly one")):
        with pytest.raises(config.ConfigError, match=match):
            config.validate(good | change)
    with pytest.raises(config.ConfigError, match="lora, stage"):
        config.validate({k: v for k, v in good.items() if k not in ("lora", "stage")})
    out = config.overridden(good, base_model="y", max_steps=0, train_file="")
    assert out["base_model"] == "y" and out["training"]["max_steps"] == 0 and out["train_file"] == "t" and "max_steps" not in good["training"]
    with pytest.raises(FileNotFoundError):
        config.verified_model({"base_model": str(tmp_path)})
    (tmp_path / "VERIFIED.sha256").touch()
    assert config.verified_model({"base_model": str(tmp_path)}) == tmp_path
    assert config.effective_batch(3, 2, 8) == 48 and config.sampling_strategy(True) == "group_by_length"


def test_statistics(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (None, 1)], "a int, b int")
    got = statistics.agreement(pairs, "a", "b").first()
    assert (got.pairs, got.observed, got.expected) == (4, 0.75, 0.5) and got.kappa == pytest.approx(0.5)
    assert statistics.agreement(pairs.where("a = 2"), "a", "b").first().kappa == 1
    rows = spark.createDataFrame([("x", r) for r in (1, 5, 5, 9, None)], "g string, rating int")
    assert tuple(statistics.rating_summary(rows, "g").first())[1:] == (3, pytest.approx(11 / 3), 1, 0, 0, 0, 2)
    rng = random.Random(1)
    items = spark.createDataFrame([(i, rng.gauss(10, 2)) for i in range(400)], "id int, m double")
    a, b = (statistics.bootstrap_interval(items.repartition(n), "id", "m").first() for n in (1, 7))
    assert a.low < a.mean < a.high and 0.3 < a.high - a.low < 0.5 and a.low == pytest.approx(b.low) and a.high == pytest.approx(b.high)
    assert statistics.across_runs(items.withColumn("g", F.lit(1)), "m", "g").first().runs == 400


def test_zipped_arrays(spark):
    frame = lambda *r: spark.createDataFrame(r, "x array<int>, y array<string>")
    assert [tuple(z) for z in frame(([1, 2], ["a", "b"])).select(reshape.zipped("x", "y").alias("z")).first().z] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="differ in size"):
        frame(([1], ["a", "b"])).select(reshape.zipped("x", "y")).collect()


def test_truncation_kinds(spark):
    rows = [("length", "abababababab", 9, 3), ("length", "words", 9, 3), ("length", "words", 2, 3), ("eos", "abababab", 9, 3)]
    got = scoring.truncation_kind(spark.createDataFrame(rows, "stop_reason string, response string, r int, generated_tokens int"), "r").collect()
    assert [r.truncation for r in got] == ["runaway_repetition", "reference_too_long", "other", None]


def test_stages_run_once(spark, tmp_path):
    made, root = [], f"file://{tmp_path}"
    run = lambda name, needs=(): stages.run_stage(spark, f"{root}/{name}", lambda p: made.append(p.rsplit("/")[-1]), needs)
    assert run("a") and not run("a") and run("b", (f"{root}/a/{stages.DONE}",)) and made == ["a", "b"]
    with pytest.raises(FileNotFoundError, match="not finished"):
        run("c", (f"{root}/x",))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/part").touch()
    with pytest.raises(FileExistsError, match="without DONE"):
        run("d")


def test_hashes_of_groups_are_folded(spark):
    rows = [(i, f"g{i % 3}", None if i % 7 == 0 else f"text {i}") for i in range(-20, 60)]
    got = {r.g: (r.sha256, r.bytes, r.records) for r in integrity.folded_hashes(spark.createDataFrame(rows, "i int, g string, t string").repartition(4), "g", "i", "t", per=8).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for g in ("g0", "g1", "g2"):
        own = [(i, t) for i, k, t in rows if k == g]
        parts = sorted({i // 8 for i, _ in own})
        want = sha("".join(sha("".join(sha(t) if t is not None else "" for i, t in own if i // 8 == p)) for p in parts))
        assert got[g] == (want, sum(len(t or "") for _, t in own), len(own))


def test_template_choice():
    assert chat.template_for("plain", False) == "plain" and chat.template_for("plain", True) == chat.GENERATION_TEMPLATE == chat.template_for(None, True)
    assert chat.template_for(chat.GENERATION_TEMPLATE + " ", True) == chat.GENERATION_TEMPLATE + " "


def test_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice([5, 5, 5, rng.randrange(1000)]), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, i int")
    want = [(p, *r) for p, r in enumerate(sorted(rows))]
    for n in (None, 1, 7, 64):
        assert sorted(tuple(r) for r in resume.with_places(frame.repartition(5), "k", ["k", "i"], buckets=n).collect()) == want
    assert resume.with_places(frame.limit(0), "k", ["k", "i"]).count() == 0
