"""Where a run came from: the machine, the state of its code, devices, and the files it read."""

from __future__ import annotations

import os
import subprocess
import sys
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.files import listed, with_hashes

#: Columns of a device listing, in the order they are asked for.
DEVICE = "index string, name string, driver_version string, memory_total string, compute_capability string"


@dataclass
class CodeState:
    """What `git status` says of a working tree; all empty outside one."""

    commit: str = ""
    branch: str = ""
    changed: list[str] = field(default_factory=list)

    @property
    def clean(self) -> bool:
        return bool(self.commit) and not self.changed


def parse_status(text: str) -> CodeState:
    """From the second porcelain format with branch headers: lines of `#` tell commit and branch, others name changed paths."""
    state = CodeState()
    fields = {"1": 8, "2": 9, "u": 10, "?": 1}
    for line in text.splitlines():
        kind, _, rest = line.partition(" ")
        if kind == "#":
            key, _, value = rest.partition(" ")
            if key == "branch.oid" and value != "(initial)":
                state.commit = value
            elif key == "branch.head" and value != "(detached)":
                state.branch = value
        elif kind in fields:
            state.changed.append(line.split(" ", fields[kind])[-1].split("\t")[0])
    return state


def code_state(folder: str, seconds: float = 30) -> CodeState:
    """One call of git; a missing git, a folder without a repository and a call that takes too long give an empty state."""
    try:
        done = subprocess.run(["git", "-C", folder, "status", "--porcelain=v2", "--branch"], capture_output=True, text=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return CodeState()
    return parse_status(done.stdout) if done.returncode == 0 else CodeState()


def device_rows(spark: SparkSession, listing: str | None) -> DataFrame:
    """Rows of a comma-separated device listing, one per line, fields stripped."""
    lines = spark.createDataFrame([(x,) for x in (listing or "").splitlines() if x.strip()], "line string")
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return lines.select(F.from_csv("line", DEVICE, options).alias("d")).select("d.*")


def input_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of the files that `paths` name, of any size, read side by side on executors."""
    return with_hashes(listed(spark, paths), paths).select("path", F.col("length").alias("bytes"), "sha256")


def run_record(spark: SparkSession, folder: str, inputs: list[str], devices: str | None = None) -> DataFrame:
    """One row: when, where and with what a run was made."""
    code = code_state(folder)
    files = input_rows(spark, inputs).agg(F.sort_array(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("inputs"))
    cards = device_rows(spark, devices).agg(F.collect_list(F.struct(*(c.split(" ")[0] for c in DEVICE.split(", ")))).alias("devices"))
    made = spark.createDataFrame([(time.time(), os.uname().nodename, sys.version.split()[0], spark.version, asdict(code) | {"clean": code.clean})], "at double, machine string, python string, spark string, code struct<commit:string,branch:string,changed:array<string>,clean:boolean>")
    # Three tables of one row each.
    return made.withColumn("at", F.timestamp_seconds("at")).crossJoin(cards).crossJoin(files)
