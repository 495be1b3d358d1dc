"""Bounds of the batches in which rows go to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bounds of an Arrow batch. Texts may be long, and each running task holds a few batches on either side.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering the session's bounds of Arrow batches to those above, if they are higher or unset."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        digits = "".join(c for c in conf.get(key) if c.isdigit() or c == "-")
        if not 0 < int(digits or 0) <= most:
            conf.set(key, str(most))
    return df
