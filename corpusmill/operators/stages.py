"""Stages of a longer run: each is done once, refused over foreign output, and needs the marks of those before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from corpusmill.sources.files import Store

DONE = "DONE"


def run_stage(spark: SparkSession, folder: str, produce: Callable[[str], None], needs: tuple[str, ...] = ()) -> bool:
    """Runs `produce(folder)` and marks the folder as done; False if it was done before. Folders may be in any store that Spark reaches.

    Output without a mark is what a broken run left or what someone else wrote, so it is refused, never replaced.
    """
    store = Store(spark, folder)
    if store.exists(DONE):
        return False
    for path in needs:
        if not Store(spark, path).exists():
            raise FileNotFoundError(f"a stage before this one has not finished: {path} is missing")
    if store.names():
        raise FileExistsError(f"{folder} holds output without {DONE}")
    store.make()
    produce(folder)
    store.touch(DONE)
    return True
