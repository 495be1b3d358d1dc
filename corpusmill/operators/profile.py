"""Token lengths: profiles, padding, packing bounds, length buckets, tokenizer comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.functions.numbers import rounded
from corpusmill.functions.text import count_yi_syllables, normalize
from corpusmill.functions.tokens import token_count


def message_lengths(records: DataFrame, tokenizer: str = "char") -> DataFrame:
    """`records` with `length`, the tokens of their rendered messages (or of prompt and completion)."""
    messages = F.col("messages") if "messages" in records.columns else F.concat("prompt", "completion")
    return records.withColumn("length", token_count(chat.render(messages), tokenizer))


def padded_tokens(lengths: DataFrame, batch_size: int) -> DataFrame:
    """One row `padded`: what batches of `batch_size` consecutive lengths, in order, cost when each is padded to its longest.

    Lengths are counted first. Of the ranks a length holds, each that ends a batch costs a whole batch of that
    length; the ranks after the last whole batch cost the longest. The window runs over distinct lengths alone.
    """
    counts = lengths.groupBy("length").agg(F.count("*").alias("n"))
    to = F.sum("n").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("to", to).withColumn("ends", F.floor(F.col("to") / batch_size) - F.floor((F.col("to") - F.col("n")) / batch_size))
    return ranks.agg((F.coalesce(F.sum(F.col("ends") * F.col("length")), F.lit(0)) * batch_size + F.coalesce(F.sum("n") % batch_size * F.max("length"), F.lit(0))).cast("long").alias("padded"))


def length_profile(lengths: DataFrame, max_length: int = 2048, batch_size: int = 8) -> DataFrame:
    """One row of counts, nearest-rank percentiles, truncation loss, padding efficiency and packing bound. All but `raw_*` use lengths cut at `max_length`. No rows give zeros."""
    capped = lengths.select(F.col("length").alias("raw"), F.least("length", F.lit(max_length)).cast("long").alias("length"))
    rank = lambda f: F.expr(f"coalesce(percentile_disc({f}) within group (order by length), 0)").cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    stats = capped.agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("raw") > max_length).alias("truncated_samples"),
        zero(F.max("raw")).alias("raw_max_length"),
        zero(F.sum("raw")).alias("raw_total"),
        zero(F.sum("length")).alias("total"),
        *(rank(f / 100).alias(f"p{f}") for f in (50, 90, 95, 99)),
        zero(F.max("length")).alias("max"),
    )
    ratio = lambda a, b, digits: F.coalesce(rounded(F.try_divide(F.col(a), F.col(b)), digits), F.lit(0.0))
    joined = stats.crossJoin(padded_tokens(capped, batch_size)).withColumn("packed_sequences", F.ceil(F.col("total") / max_length))
    return joined.select(
        "samples",
        F.lit(max_length).cast("long").alias("max_length"),
        "truncated_samples",
        "raw_max_length",
        "raw_total",
        "total",
        (F.col("raw_total") - F.col("total")).alias("discarded_by_truncation"),
        ratio("total", "raw_total", 6).alias("retained_ratio"),
        ratio("total", "samples", 2).alias("mean"),
        "p50",
        "p90",
        "p95",
        "p99",
        "max",
        F.lit(batch_size).cast("long").alias("batch_size"),
        ratio("total", "padded", 4).alias("padding_efficiency"),
        F.col("packed_sequences").cast("long").alias("packed_sequences"),
        ratio("samples", "packed_sequences", 2).alias("samples_per_sequence"),
        ratio("samples", "packed_sequences", 2).alias("compression_ratio"),
    )


def with_bucket(records: DataFrame, threshold: int = 512) -> DataFrame:
    """`bucket` short or long by `length`; the threshold itself is short."""
    return records.withColumn("bucket", F.when(F.col("length") <= threshold, "short").otherwise("long"))


def bucket_manifest(records: DataFrame, split: str = "split", threshold: int = 512) -> DataFrame:
    return with_bucket(records, threshold).groupBy(split).agg(
        F.count("*").alias("total"), F.count_if(F.col("bucket") == "short").alias("short"), F.count_if(F.col("bucket") == "long").alias("long"), F.max("length").cast("long").alias("max_length")
    )


def tokenizer_audit(lines: DataFrame, text: str, tokenizers: list[str]) -> DataFrame:
    """A row per tokenizer: lines that are not blank, Yi characters, tokens, tokens per Yi character, unknown tokens (replacement characters). The lines are read once."""
    clean = lines.select(normalize(F.col(text)).alias("t")).where("t <> ''")
    sums = clean.agg(F.count("*").alias("sentences"), F.sum(count_yi_syllables(F.col("t"))).cast("long").alias("yi_characters"), F.sum(F.regexp_count("t", F.lit("�"))).cast("long").alias("unknown_tokens"), *(F.sum(token_count(F.col("t"), n)).alias(f"tokens_{n}") for n in tokenizers))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.col(f"tokens_{n}").alias("tokens")) for n in tokenizers)))
    rows = sums.select("sentences", "yi_characters", "unknown_tokens", each.alias("m"))
    return rows.select("m.model", "sentences", "yi_characters", "m.tokens", rounded(F.try_divide(F.col("m.tokens"), F.col("yi_characters")), 4).alias("tokens_per_yi_character"), "unknown_tokens")
