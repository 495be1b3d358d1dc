"""Ratings, agreement, spread across runs and intervals by resampling; described in words by what this engine follows, so the formulas are its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rating_summary(ratings: DataFrame, group: str, rating: str = "rating") -> DataFrame:
    """Per group the number of ratings, their mean and how often each of 1 to 5 was given; other values and nulls are left out."""
    known = ratings.where(F.col(rating).isin(1, 2, 3, 4, 5))
    each = [F.count_if(F.col(rating) == k).alias(f"n{k}") for k in range(1, 6)]
    return known.groupBy(group).agg(F.count("*").alias("ratings"), F.avg(rating).alias("mean_rating"), *each)


def agreement(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """One row: pairs rated by both, observed and expected agreement, Cohen's kappa (1 if agreement by chance is certain)."""
    known = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    counts = known.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    rows = counts.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("v"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))).alias("r"))
    chance = rows.groupBy("r.v").agg(F.sum("r.x").alias("x"), F.sum("r.y").alias("y")).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    both = total.crossJoin(chance).select("pairs", F.try_divide("same", "pairs").alias("observed"), F.try_divide(F.col("xy"), F.col("pairs").cast("double") * F.col("pairs")).alias("expected"))
    return both.withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def across_runs(runs: DataFrame, metric: str, group: str) -> DataFrame:
    """Per group the number of runs, mean and sample deviation of a metric."""
    return runs.groupBy(group).agg(F.count(metric).alias("runs"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("deviation"))


#: Cumulative shares of a Poisson variable with mean 1: how often a row comes in one resample.
POISSON = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758850)


def bootstrap_interval(items: DataFrame, key: str, metric: str, resamples: int = 200, level: float = 0.95, seed: int = 1) -> DataFrame:
    """One row: mean, low and high end of an interval for the mean of `metric`.

    Each item comes a Poisson number of times in each resample, decided by a hash of key, resample and seed, so
    no item is moved and reruns agree. Sums per resample are made in each task before they meet.
    """
    known = items.where(F.col(metric).isNotNull())
    drawn = known.select(F.col(metric).cast("double").alias("m"), F.col(key).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    digits = F.substring(F.md5(F.concat_ws("|", F.col("k").cast("string"), F.col("b"), F.lit(seed))), 1, 10)
    u = F.conv(digits, 16, 10).cast("double") / float(1 << 40)
    times = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    means = drawn.withColumn("t", times).groupBy("b").agg((F.sum(F.col("m") * F.col("t")) / F.sum("t")).alias("mean"))
    low, high = (1 - level) / 2, (1 + level) / 2
    ends = means.agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"))
    return known.agg(F.avg(metric).alias("mean")).crossJoin(ends)
