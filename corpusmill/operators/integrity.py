"""Checks of files and rows against what a manifest declares; exact duplicates and hash splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import bounded_batches


def verify_manifest(required: DataFrame, declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, status, bytes, records) for each required name.

    `declared` has name, sha256 and records, `actual` name, sha256, bytes and, where known, records. Statuses, the
    first that holds: undeclared, missing, sha_mismatch, records_mismatch, ok.
    """
    has_records = "records" in actual.columns
    told = declared.select("name", F.lower("sha256").alias("told_sha"), F.col("records").alias("told_records"))
    seen = actual.select("name", F.col("sha256").alias("seen_sha"), "bytes", (F.col("records") if has_records else F.lit(None).cast("long")).alias("seen_records"))
    rows = required.select("name").distinct().join(told, "name", "left").join(seen, "name", "left")
    status = (
        F.when(F.coalesce(F.col("told_sha"), F.lit("")) == "", "undeclared")
        .when(F.col("seen_sha").isNull(), "missing")
        .when(F.col("told_sha") != F.col("seen_sha"), "sha_mismatch")
        .when(F.col("seen_records").isNotNull() & F.col("told_records").isNotNull() & (F.col("told_records") != F.col("seen_records")), "records_mismatch")
        .otherwise("ok")
    )
    return rows.select("name", status.alias("status"), "bytes", F.col("told_records").alias("records"))


def folded_hashes(rows: DataFrame, group: str, order: str, text: str, per: int = 1024) -> DataFrame:
    """(group, sha256, bytes, records): one hash of all texts of a group, from hashes of texts in order, so that no text is collected.

    The texts' SHA-256 (nothing for a null) are joined and hashed in parts of `per` numbers of `order`, and so are the
    parts' hashes; `order` is a whole number.
    """
    part = F.floor(F.col(order) / per).alias("part")
    sums = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.sha2(text, 256), F.lit("")).alias("sum")))), lambda x: x["sum"]), "")
    size = F.sum(F.octet_length(text)).cast("long")
    parts = rows.groupBy(group, part).agg(F.sha2(sums, 256).alias("sum"), size.alias("bytes"), F.count("*").alias("records"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sum"))), lambda x: x["sum"]), "")
    return parts.groupBy(group).agg(F.sha2(whole, 256).alias("sha256"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))


def without_exact_duplicates(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows that share a key the one with the smallest `order`."""
    least = rows.groupBy(key.alias("exact_key")).agg(F.min(order).alias("exact_first"))
    return rows.withColumn("exact_key", key).join(least, "exact_key").where(F.col(order) == F.col("exact_first")).select(*rows.columns)


def hash_split(key: Column, train: int = 80, validation: int = 10) -> Column:
    """train, validation or test by the first 8 hex digits of SHA-256, modulo 100."""
    place = F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(100))
    return F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test")


def runs(text: str, least: int = 2, repeats: int = 4) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the stretches in which some run of `least` characters or more, of any length, comes `repeats` times (3 at least) in a row, as long as they go on.

    Such a stretch has a smallest period p. Of windows of W characters, p < W <= 2p, those in it come again p places
    on and not before, so the distance to a window's next occurrence tells p; W goes through the powers of two.
    """
    t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, width = len(t), 2
    marks = t.astype(np.uint64)
    while repeats * (width // 2) <= n and width <= n:
        half = width // 2
        # Hashes of twice the length from pairs of hashes; equal windows always have equal hashes.
        mixed = (marks[:-half] ^ marks[:-half] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(width)
        marks = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) + marks[half:]
        order = np.argsort(marks, kind="stable")
        again = np.flatnonzero(marks[order[1:]] == marks[order[:-1]])
        gaps = np.zeros(len(marks), np.int64)
        gaps[order[again]] = order[again + 1] - order[again]
        cuts = np.flatnonzero(np.diff(gaps, prepend=-1))
        lengths = np.diff(cuts, append=len(gaps))
        gap = gaps[cuts]
        whole = gap * -(-least // np.maximum(gap, 1))  # the least multiple of the period that is long enough
        found = (gap >= half) & (gap < width) & (lengths + width - 1 + gap >= repeats * whole)
        for start, p, size in zip(cuts[found].tolist(), gap[found].tolist(), (lengths + width - 1)[found].tolist(), strict=True):
            if np.array_equal(t[start : start + size], t[start + p : start + p + size]):
                yield start, start + size + p, p
        width *= 2


def loops(text: str, least: int = 2, repeats: int = 4) -> bool:
    """Whether there is one of `runs`."""
    return next(runs(text, least, repeats), None) is not None


def repeated_characters(text: str, least: int = 2, repeats: int = 4) -> int:
    """How many characters of a text lie in one of `runs` or more."""
    covered = end = 0
    for low, high, _ in sorted(runs(text, least, repeats)):
        covered += max(0, high - max(low, end))
        end = max(end, high)
    return covered


def repetition(text: Column, least: int = 2, repeats: int = 4) -> Column:
    """How many characters of a text repeat what is before or after them in a loop; null for a null text."""
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else repeated_characters(t, least, repeats) for t in texts], dtype="Int64")

    return F.pandas_udf(run, "long")(text.cast("string"))


def repetition_rates(rows: DataFrame, text: str, group: str) -> DataFrame:
    """Per group: texts, characters, repeated ones, looping_texts, rate (the share of characters) and mean_rate (the mean of the texts' own shares; empty ones have 0)."""
    own = bounded_batches(rows).select(F.col(group).alias("own_group"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"), F.coalesce(repetition(F.col(text)), F.lit(0)).alias("r"))
    share = lambda r, n: F.coalesce(F.try_divide(r, n), F.lit(0.0))
    out = own.groupBy("own_group").agg(F.count("*").alias("texts"), F.sum("n").alias("characters"), F.sum("r").alias("repeated"), F.count_if(F.col("r") > 0).alias("looping_texts"), F.avg(share(F.col("r"), F.col("n"))).alias("mean_rate"))
    return out.withColumn("rate", share(F.col("repeated"), F.col("characters"))).withColumnRenamed("own_group", group)


def has_loop(text: Column, least: int = 2, repeats: int = 4) -> Column:
    """Whether a run of `least` characters or more comes `repeats` times in a row; null for a null text. Units have any length."""
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else loops(t, least, repeats) for t in texts], dtype="object")

    return F.pandas_udf(run, "boolean")(text.cast("string"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, per: int) -> DataFrame:
    """`per` rows of each stratum at most, those whose hashed keys are smallest: the same on every run."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("stratum_rank", rank).where(F.col("stratum_rank") <= per)
