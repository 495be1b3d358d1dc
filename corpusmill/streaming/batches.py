"""Records that arrive over time, handled in micro-batches that may be broken off and taken up again.

A batch writes to a folder of its own, named by the run and the batch number, and counts from the moment its commit is
there; a batch that is handled again replaces what it left. Keys seen in a run are kept as keyed state, which expires
behind a watermark. A lost checkpoint begins a new run, and its batches leave out what other runs have committed: each
reads the keys of those commits alone whose range of keys meets its own. So the work of a batch does not grow with what
was done before it.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.resume import pending
from corpusmill.sources.files import Store

ARRIVED = "arrived_at"


@dataclass(frozen=True)
class Commit:
    """What a batch left: the number of its rows, and its least and largest key (None without rows)."""

    run: int
    batch: int
    rows: int
    least: int | None
    most: int | None

    @property
    def folder(self) -> str:
        return f"run={self.run}/batch={self.batch}"

    @property
    def name(self) -> str:
        return f"run={self.run},batch={self.batch},rows={self.rows},least={self.least},most={self.most}"

    @staticmethod
    def parse(name: str) -> Commit | None:
        found = re.fullmatch(r"run=(\d+),batch=(\d+),rows=(\d+),least=(None|-?\d+),most=(None|-?\d+)", name)
        if not found:
            return None
        run, batch, rows, least, most = (None if x == "None" else int(x) for x in found.groups())
        return Commit(run, batch, rows, least, most)

    def meets(self, least: int, most: int) -> bool:
        return self.rows > 0 and self.least <= most and self.most >= least


def commits(spark: SparkSession, out: str) -> list[Commit]:
    """Commits of a table in order; a marker file each."""
    found = map(Commit.parse, Store(spark, f"{out}/_commits").names())
    return sorted((c for c in found if c), key=lambda c: (c.run, c.batch))


def committed(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all committed batches; what a broken batch left is not among them."""
    done = commits(spark, out)
    if not done:
        raise ValueError(f"{out} has no commits")
    return spark.read.parquet(*(f"{out}/{c.folder}" for c in [c for c in done if c.rows] or done[:1]))


def this_run(spark: SparkSession, out: str, checkpoint: str) -> int:
    """The run that a checkpoint belongs to. One that names none, as it is new, begins the next."""
    known = Store(spark, checkpoint)
    runs = [int(n[4:]) for n in known.names() if re.fullmatch(r"run=\d+", n)]
    if runs:
        return max(runs)
    run = 1 + max((c.run for c in commits(spark, out)), default=-1)
    known.make()
    known.touch(f"run={run}")
    return run


def first_of_key(stream: DataFrame, key: str, arrival: str | None, keep: str) -> DataFrame:
    """Rows whose key has not come before, as far back as `keep`; `arrival` is a time column, or None for the time of the batch. Rows without a key are refused."""
    checked = stream.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"a record has no {key}")).cast(stream.schema[key].dataType)))
    timed = checked.withColumn(ARRIVED, F.current_timestamp() if arrival is None else F.col(arrival).cast("timestamp"))
    return timed.withWatermark(ARRIVED, keep).dropDuplicatesWithinWatermark([key]).drop(ARRIVED)


def left_over(batch: DataFrame, out: str, earlier: list[Commit], key: str) -> DataFrame:
    """Rows of a batch that other runs have not committed."""
    least, most = batch.agg(F.min(key), F.max(key)).first()
    met = [c for c in earlier if least is not None and c.meets(least, most)]
    if not met:
        return batch
    done = batch.sparkSession.read.parquet(*(f"{out}/{c.folder}" for c in met)).where(F.col(key).between(least, most))
    return pending(batch, done, key)


def handle_available(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "source_index", arrival: str | None = None, keep: str = "7 days", every: int = 20) -> StreamingQuery:
    """Adds `handle(batch)`, which keeps `key`, to the table `out` for all input there is, then stops. `committed` reads it.

    No key comes twice: within a run, as long as its repetition is not later than `keep`; across runs, at any time.
    A batch cut short is handled again, one committed is not. Progress is logged after each `every` batches.
    """
    spark = stream.sparkSession
    run = this_run(spark, out, checkpoint)
    earlier = [c for c in commits(spark, out) if c.run != run]
    mine = {c.batch: c.rows for c in commits(spark, out) if c.run == run}
    ledger = Store(spark, f"{out}/_commits")
    ledger.make()

    def one(batch: DataFrame, number: int) -> None:
        if number in mine:
            return
        path = f"{out}/run={run}/batch={number}"
        if earlier:
            batch = batch.persist()
        try:
            handle(left_over(batch, out, earlier, key) if earlier else batch).write.mode("overwrite").parquet(path)
        finally:
            if earlier:
                batch.unpersist()
        rows, least, most = batch.sparkSession.read.parquet(path).agg(F.count("*"), F.min(key), F.max(key)).first()
        ledger.touch(Commit(run, number, rows, least, most).name)
        mine[number] = rows
        if len(mine) % every == 0:
            logging.getLogger(__name__).info("%s: %d batches, %d rows", out, len(mine), sum(mine.values()))

    return first_of_key(stream, key, arrival, keep).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
