"""Rounding of the binary value, as Python does it; Spark's `round` works on the decimal text of a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(value * scale) / scale
