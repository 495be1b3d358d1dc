"""Samples that follow weights, and batch sizes that fit a memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampling_key(key: Column, weight: Column, seed: int) -> Column:
    """An exponential number of rate `weight`, the same on every run: the smaller, the earlier a row is drawn. Null where the weight is null, no number, or not positive.

    The uniform number behind it is the middle of one of 2^52 equal parts, told by 13 hex digits of a SHA-256.
    """
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = F.greatest(weight, F.lit(0.0))
    return F.when((drawn > 0) & ~F.isnan(drawn), -F.log(uniform) / drawn)


def weighted_sample(rows: DataFrame, key: str, weight: Column, n: int, group: str | None = None, seed: int = 0, salts: int = 32) -> DataFrame:
    """`n` rows of each group (or of all) at most, drawn by weight without replacement, with `sample_rank` in the order they are drawn.

    The next row drawn is each time one of those left with chances in proportion to their weights. Rows without a key
    or a positive weight are not drawn; equal numbers go by key. The first of each part of a group are found before
    those of the group, so no task sorts a whole one.
    """
    drawn = rows.withColumn("sample_key", sampling_key(F.col(key), weight.cast("double"), seed)).where("sample_key is not null")
    groups = [F.col(group)] if group else [F.lit(1)]
    order = ("sample_key", key)
    part = F.pmod(F.xxhash64(key), F.lit(salts))
    few = drawn.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*groups, part).orderBy(*order))).where(F.col("sample_rank") <= n)
    ranked = few.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("sample_rank") <= n).drop("sample_key")


def length_sketch(lengths: DataFrame, cap: int, *groups: str) -> DataFrame:
    """(groups, length, n): a count for each length, those over `cap` as `cap`. It holds `cap` + 1 rows a group at most, and sketches are merged by adding counts."""
    capped = F.greatest(F.least(F.col("length"), F.lit(cap)), F.lit(0)).cast("long")
    return lengths.where("length is not null").groupBy(*groups, capped.alias("length")).agg(F.count("*").alias("n"))


def merged_sketches(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy(*(c for c in out.columns if c != "n")).agg(F.sum("n").alias("n"))


def batch_plan(sketch: DataFrame, memory: int, fixed: int, per_token: int, headroom: int, share: float = 0.99, multiple: int = 64, group: str | None = None) -> DataFrame:
    """Per group (or one row): samples, planned_length, longest, batch_size, batch_size_by_longest, over_plan.

    The planned length is the nearest-rank quantile `share` of the sketch, rounded up to a `multiple`; the batch is the
    largest whose tokens, at `per_token` bytes each, fit beside `fixed` bytes and leave `headroom` free; 0 if none does.
    `over_plan` samples are longer than planned, so a batch that holds one must be split.
    """
    groups = [group] if group else []
    window = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("length")
    so_far = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("n").over(Window.partitionBy(*(groups or [F.lit(1)])))
    told = sketch.withColumn("so_far", so_far).withColumn("samples", whole)
    found = told.groupBy(*groups).agg(
        F.max("samples").alias("samples"),
        F.min(F.when(F.col("so_far") >= F.ceil(F.lit(share) * F.col("samples")), F.col("length"))).alias("quantile"),
        F.max("length").alias("longest"),
        F.collect_list(F.struct("length", "n")).alias("held"),
    )
    rounded_up = lambda c: (F.ceil(F.greatest(c, F.lit(1)) / multiple) * multiple).cast("long")
    fits = lambda c: F.greatest(F.floor(F.lit(max(0, memory - fixed - headroom)) / (c * per_token)), F.lit(0)).cast("long")
    planned = rounded_up(F.col("quantile"))
    over = F.aggregate(F.filter("held", lambda h: h["length"] > planned), F.lit(0).cast("long"), lambda s, h: s + h["n"])
    return found.select(*groups, "samples", planned.alias("planned_length"), "longest", fits(planned).alias("batch_size"), fits(rounded_up(F.col("longest"))).alias("batch_size_by_longest"), over.alias("over_plan"))
