"""Pass or fail of metric rows against thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import metrics
from corpusmill.functions.numbers import rounded


@dataclass(frozen=True)
class OverfitGate:
    # The default limits of the gate.
    least_compact_exact: float = 0.5
    least_chrf2: float = 70.0
    most_replacement: float = 0.01
    most_length_stop: float = 0.05


def overfit_gate(summary: DataFrame, gate: OverfitGate = OverfitGate()) -> DataFrame:
    """A row of checks over the `overall` row, and `passed`, all of them. A limit itself passes."""
    checks = {
        "compact_exact_ok": F.col("compact_exact_match") >= gate.least_compact_exact,
        "chrf2_ok": F.col("mean_chrf2") >= gate.least_chrf2,
        "replacement_ok": F.col("replacement_character_rate") <= gate.most_replacement,
        "length_stop_ok": F.col("length_truncation_rate") <= gate.most_length_stop,
    }
    passed = None
    for c in checks.values():
        passed = c if passed is None else passed & c
    return summary.where("grp = 'overall'").select(*(c.alias(n) for n, c in checks.items()), passed.alias("passed"))


def retention_gate(base: DataFrame, adapted: DataFrame, least_retention: float = 0.95, most_thinking_drop: float = 0.05) -> DataFrame:
    """A row that compares two `overall` rows: answers kept, thinking kept; a run that a length limit cut is invalid."""
    names = ("compact_exact_match", "thinking_terminated_rate", "length_truncation_rate")
    row = lambda s, p: s.where("grp = 'overall'").select(*(F.col(n).alias(p + n) for n in names))
    return compared(row(base, "base_").crossJoin(row(adapted, "adapted_")), least_retention, most_thinking_drop)


def retention_of_scores(scores: DataFrame, base: Column, adapted: Column, least_retention: float = 0.95, most_thinking_drop: float = 0.05) -> DataFrame:
    """`retention_gate` of two parts of one table of scores, which is read once."""
    means = {"compact_exact_match": "compact_exact", "thinking_terminated_rate": "thinking_terminated", "length_truncation_rate": "length_truncated"}
    part = lambda p, where: [rounded(F.coalesce(F.avg(F.when(where, F.col(c).cast("double"))), F.lit(0.0)), 6).alias(p + n) for n, c in means.items()]
    return compared(scores.agg(*part("base_", base), *part("adapted_", adapted)), least_retention, most_thinking_drop)


def compared(both: DataFrame, least_retention: float, most_thinking_drop: float) -> DataFrame:
    retention = F.when(F.col("base_compact_exact_match") > 0, F.col("adapted_compact_exact_match") / F.col("base_compact_exact_match")).otherwise(1.0)
    drop = F.col("base_thinking_terminated_rate") - F.col("adapted_thinking_terminated_rate")
    valid = (F.col("base_length_truncation_rate") == 0) & (F.col("adapted_length_truncation_rate") == 0)
    rows = both.select(rounded(retention, 6).alias("answer_retention"), rounded(drop, 6).alias("thinking_drop"), valid.alias("valid"))
    return rows.withColumn("passed", F.col("valid") & (F.col("answer_retention") >= least_retention) & (F.col("thinking_drop") <= most_thinking_drop))


def smoke_results(rows: DataFrame) -> DataFrame:
    """(id, passed, reasons) of (id, response, expected)."""
    reasons = metrics.smoke_reasons(F.col("response"), F.col("expected"))
    return rows.select("id", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"))


def smoke_gate(results: DataFrame, least: int = 2) -> DataFrame:
    return results.agg(F.count("*").alias("prompts"), F.count_if("passed").alias("passes")).withColumn("passed", F.col("passes") >= least)
