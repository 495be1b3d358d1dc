"""Scores of generations, their summary overall and by target language, and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import metrics
from corpusmill.functions.arrow import bounded_batches
from corpusmill.functions.numbers import rounded
from corpusmill.functions.text import REPLACEMENT, compact, normalize, or_empty, yi_only
from corpusmill.operators.integrity import has_loop

LANGUAGES = ("yi", "zh", "en", "unknown")


def last_content(messages: Column) -> Column:
    """Content of the last message, whatever its role; empty without messages."""
    return or_empty(F.try_element_at(messages, F.lit(-1))["content"])


def score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, 17 scores) of generations with `prompt`, `reference`, `response`, `stop_reason`, `generated_tokens` and `batch_seconds_per_sample`; `keys` name a row."""
    # What is compact does not depend on white space, so it is folded from the text itself, beside the normal forms.
    text = bounded_batches(rows).select(
        *keys,
        normalize(or_empty(F.col("reference"))).alias("reference"),
        normalize(or_empty(F.col("response"))).alias("response"),
        or_empty(F.col("prompt")).alias("prompt"),
        compact(or_empty(F.col("reference"))).alias("ref"),
        compact(or_empty(F.col("response"))).alias("hyp"),
        F.coalesce(F.col("stop_reason") == "length", F.lit(False)).alias("length_truncated"),
        F.coalesce(F.col("generated_tokens"), F.lit(0)).cast("long").alias("generated_tokens"),
        F.coalesce(F.col("batch_seconds_per_sample"), F.lit(0.0)).cast("double").alias("seconds"),
    )
    wide = text.withColumns({"ref_yi": yi_only(F.col("reference")), "hyp_yi": yi_only(F.col("response")), "thought": metrics.thinking_span(F.col("response"))})
    return wide.select(
        *keys,
        metrics.target_language(F.col("prompt"), F.col("reference")).alias("target_language"),
        (F.col("response") == F.col("reference")).alias("exact"),
        (F.col("hyp") == F.col("ref")).alias("compact_exact"),
        metrics.contained(F.col("ref"), F.col("hyp")).alias("reference_contained"),
        metrics.character_error_rate(F.col("ref"), F.col("hyp")).alias("cer"),
        (F.col("response") == "").alias("empty"),
        F.length("response").cast("long").alias("response_chars"),
        F.contains("response", F.lit(REPLACEMENT)).alias("replacement_character"),
        "length_truncated",
        F.col("thought").isNotNull().alias("thinking_terminated"),
        F.coalesce(F.col("thought") != "", F.lit(False)).alias("thinking_nonempty"),
        F.length(or_empty(F.col("thought"))).cast("long").alias("thinking_chars"),
        ((F.col("ref_yi") != "") & (F.col("hyp_yi") == F.col("ref_yi"))).alias("yi_exact"),
        metrics.contained(F.col("ref_yi"), F.col("hyp_yi")).alias("yi_reference_contained"),
        "generated_tokens",
        "seconds",
        metrics.chrf2_column(F.col("ref"), F.col("hyp")).alias("chrf2"),
    )


def summarize(scores: DataFrame) -> DataFrame:
    """A row for all scores (`grp` overall) and one for each target language that occurs. Means over no row are 0; Yi rates are over rows whose target is Yi."""
    yi = F.col("target_language") == "yi"

    def mean(column: str, digits: int, where: Column | None = None) -> Column:
        value = F.col(column).cast("double")
        return rounded(F.coalesce(F.avg(F.when(where, value) if where is not None else value), F.lit(0.0)), digits)

    rows = scores.rollup("target_language").agg(
        F.grouping("target_language").alias("all_rows"),
        F.count("*").alias("records"),
        mean("exact", 6).alias("exact_match"),
        mean("compact_exact", 6).alias("compact_exact_match"),
        mean("reference_contained", 6).alias("reference_contained"),
        mean("chrf2", 4).alias("mean_chrf2"),
        mean("cer", 6).alias("mean_cer"),
        mean("empty", 6).alias("empty_rate"),
        mean("replacement_character", 6).alias("replacement_character_rate"),
        mean("length_truncated", 6).alias("length_truncation_rate"),
        mean("thinking_terminated", 6).alias("thinking_terminated_rate"),
        mean("thinking_nonempty", 6).alias("thinking_nonempty_rate"),
        mean("thinking_chars", 3).alias("mean_thinking_chars"),
        mean("response_chars", 3).alias("mean_response_chars"),
        mean("yi_exact", 6, yi).alias("yi_exact_match"),
        mean("yi_reference_contained", 6, yi).alias("yi_reference_contained"),
        mean("generated_tokens", 3).alias("mean_generated_tokens"),
        mean("seconds", 6).alias("mean_seconds_per_sample"),
    )
    named = rows.select(F.when(F.col("all_rows") == 1, "overall").otherwise(F.col("target_language")).alias("grp"), *rows.columns[2:])
    # A rollup of no rows has no row at all.
    overall = scores.sparkSession.range(1).select(F.lit("overall").alias("grp"))
    return overall.join(named, "grp", "full").na.fill(0)


REPORT = (
    ("Records", "records", "%d"),
    ("Exact", "compact_exact_match", "%.4f"),
    ("chrF2", "mean_chrf2", "%.2f"),
    ("CER", "mean_cer", "%.3f"),
    ("Empty", "empty_rate", "%.4f"),
    ("Length stop", "length_truncation_rate", "%.4f"),
    ("Think closed", "thinking_terminated_rate", "%.4f"),
    ("Think chars", "mean_thinking_chars", "%.1f"),
    ("Replacement char", "replacement_character_rate", "%.4f"),
    ("Yi exact", "yi_exact_match", "%.4f"),
    ("Tokens", "mean_generated_tokens", "%.1f"),
    ("sec/sample", "mean_seconds_per_sample", "%.4f"),
)


def report_lines(summary: DataFrame) -> DataFrame:
    """(place, line): the summary's rows as lines of a Markdown table, overall first, then languages in their order."""
    place = F.array_position(F.array(*(F.lit(g) for g in ("overall", *LANGUAGES))), F.col("grp"))
    line = F.concat(F.lit("| "), F.col("grp"), *(F.concat(F.lit(" | "), F.format_string(f, F.col(c) if f == "%d" else rounded(F.col(c), int(f[2])))) for _, c, f in REPORT), F.lit(" |"))
    return summary.select(place.alias("place"), line.alias("line"))


def report(label: str, summary: DataFrame) -> str:
    """A Markdown report; the summary has five rows at most. The column Exact shows compact exact matches."""
    head = ["Split", *(n for n, _, _ in REPORT)]
    rows = [r["line"] for r in report_lines(summary).orderBy("place").collect()]
    return "\n".join([f"# Evaluation: {label}", "", f"| {' | '.join(head)} |", "|---" + "|---:" * len(REPORT) + "|", *rows]) + "\n"


def truncation_kind(rows: DataFrame, reference_tokens: str, generated_tokens: str = "generated_tokens") -> DataFrame:
    """`rows` with `truncation`: null unless a length limit stopped a row; then runaway_repetition, reference_too_long or other."""
    kind = F.when(has_loop(or_empty(F.col("response"))), "runaway_repetition").when(F.col(reference_tokens) > F.col(generated_tokens), "reference_too_long").otherwise("other")
    return rows.withColumn("truncation", F.when(F.col("stop_reason") == "length", kind))
