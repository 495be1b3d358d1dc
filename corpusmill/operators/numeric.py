"""Health of numeric tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tensor_health(tensors: DataFrame, values: str, group: str | None = None) -> DataFrame:
    """Per group (or one row): tensors, elements, nonfinite_elements, zero_fraction, mean_abs, rms, max_abs, over finite elements; 0 without any.

    Each tensor is folded where it lies, without a row per element. `health` does the rest.
    """
    v = F.transform(F.coalesce(F.col(values), F.array().cast("array<double>")), lambda x: x.cast("double"))
    finite = F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    total = lambda f: F.aggregate(finite, F.lit(0.0), lambda acc, x: acc + f(x))
    own = tensors.select(
        *([group] if group else []),
        F.size(v).cast("long").alias("n"),
        F.size(finite).cast("long").alias("ok"),
        F.size(F.filter(finite, lambda x: x == 0)).cast("long").alias("zeros"),
        total(F.abs).alias("a"),
        total(lambda x: x * x).alias("q"),
        F.coalesce(F.array_max(F.transform(finite, F.abs)), F.lit(0.0)).alias("m"),
    )
    return health(own, *([group] if group else []))


def merged_moments(own: DataFrame, *keys: str) -> DataFrame:
    """Moments of parts of a tensor added up: n, ok (finite elements), zeros, a (sum of absolute values), q (of squares), m (largest absolute value)."""
    return own.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "ok", "zeros", "a", "q")), F.max("m").alias("m"))


def health(own: DataFrame, *groups: str) -> DataFrame:
    """The summary of `tensor_health` from a row of moments per tensor."""
    known = F.greatest(F.sum("ok"), F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.groupBy(*groups).agg(
        F.count("*").alias("tensors"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("elements"),
        F.coalesce(F.sum("n") - F.sum("ok"), F.lit(0)).alias("nonfinite_elements"),
        zero(F.sum("zeros") / known).alias("zero_fraction"),
        zero(F.sum("a") / known).alias("mean_abs"),
        zero(F.sqrt(F.sum("q") / known)).alias("rms"),
        zero(F.max("m")).alias("max_abs"),
    )
