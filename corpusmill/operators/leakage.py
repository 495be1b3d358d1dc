"""Exact overlap of training strings with benchmark strings, by fingerprints of normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import fingerprint, is_blank

#: Benchmarks of up to this many strings are broadcast; larger ones meet the training strings in a shuffle.
BROADCAST_ROWS = 200_000


def benchmark_fingerprints(strings: DataFrame) -> DataFrame:
    """(fingerprint, label) from (label, record, part, value): of strings that share a fingerprint the last one names it."""
    known = strings.where(~is_blank(F.col("value"))).withColumn("fingerprint", fingerprint(F.col("value")))
    return known.groupBy("fingerprint").agg(F.max_by("label", F.struct("record", "part")).alias("label"))


def overlaps(training: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Training strings (any columns and `value`) that a benchmark string equals, with its label: one row per string."""
    found = benchmark_fingerprints(benchmark)
    size = benchmark.limit(broadcast_rows + 1).count()
    build = F.broadcast(found) if size <= broadcast_rows else found
    own = training.where(~is_blank(F.col("value"))).withColumn("fingerprint", fingerprint(F.col("value")))
    return own.join(build, "fingerprint")


def leakage_summary(training: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row: distinct benchmark strings, training strings with repeats, overlapping training strings, whether it is clean."""
    kept = lambda rows: rows.where(~is_blank(F.col("value")))
    counts = kept(benchmark).agg(F.countDistinct(fingerprint(F.col("value"))).alias("benchmark_strings"))
    total = kept(training).agg(F.count("*").alias("training_strings"))
    hits = overlaps(training, benchmark).agg(F.count("*").alias("exact_overlaps"))
    return counts.crossJoin(total).crossJoin(hits).withColumn("clean", F.col("exact_overlaps") == 0)


def overlap_details(training: DataFrame, benchmark: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """The first `most` overlaps in the given order."""
    return overlaps(training, benchmark).orderBy(*order).limit(most)
