"""Work that was done before, shards of what is left, and one ordered result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, key: str = "source_index") -> DataFrame:
    """Rows whose key is not among those done. Keys are places in the source, so rows without ids are told apart too."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def with_places(rows: DataFrame, key: str, order: list[str], name: str = "source_index", buckets: int | None = None) -> DataFrame:
    """`rows` with their 0-based places in `order`, which begins with the number `key`.

    The key's range is cut at approximate quantiles; rows are ranked within a bucket, after the sizes of the
    buckets before it. Only the window over bucket sizes is one task, so no task holds all rows; where the cuts
    fall does not change the places.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(key, [k / n for k in range(1, n)], 0.5 / n))) if n > 1 else []
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
    marked = rows.withColumn("place_bucket", bucket)
    sizes = marked.groupBy("place_bucket").agg(F.count("*").alias("n"))
    before = sizes.select("place_bucket", (F.sum("n").over(Window.orderBy("place_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("place_before"))
    rank = F.row_number().over(Window.partitionBy("place_bucket").orderBy(*order)) - 1
    ranked = marked.withColumn("place_rank", rank).join(F.broadcast(before), "place_bucket")
    return ranked.select((F.col("place_before") + F.col("place_rank")).alias(name), *rows.columns)


def shard(key: Column, shards: int) -> Column:
    """Round-robin shard of a 0-based place."""
    return F.pmod(key, F.lit(shards))


def merged(parts: list[DataFrame], key: str = "source_index") -> DataFrame:
    """All parts in order of key; the number of parts does not matter, and a key that was done twice counts once."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key]).orderBy(key)


def first_rows(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return rows.orderBy(*order).limit(limit)
