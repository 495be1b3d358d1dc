"""Tensor files read in slices, so that a tensor of any size is the work of many tasks.

A file is an 8-byte size of its header, a JSON header that names types, shapes and byte ranges, and the data. Headers are
read first, one file at a time, and give a row for each slice; slices are dealt out and read on their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.numeric import merged_moments
from corpusmill.sources.files import TENSOR_TYPES, opened

#: Bytes of a slice, a whole number of elements of every type.
SLICE = 64 << 20
RANGES = "file string, name string, kind string, shape array<long>, first long, begin long, length long"


def tensor_ranges(spark: SparkSession, path: str, slice_bytes: int = SLICE) -> DataFrame:
    """A row for each slice of each tensor: file, name, kind, shape, first (place of its first element), begin and length (bytes of the file). An empty tensor has one slice of length 0."""
    if slice_bytes % 8 or slice_bytes < 8:
        raise ValueError("slice_bytes must be a multiple of 8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with opened(file) as source:
                    size = int.from_bytes(source.read(8), "little")
                    header = json.loads(source.read(size))
                for name, about in header.items():
                    if name == "__metadata__":
                        continue
                    begin, end = about["data_offsets"]
                    width = np.dtype(TENSOR_TYPES[about["dtype"]]).itemsize
                    starts = np.arange(begin, max(end, begin + 1), slice_bytes, dtype=np.int64)
                    n = len(starts)
                    columns = [pa.array([x] * n) for x in (file, name, about["dtype"])]
                    columns.append(pa.array([about["shape"]] * n, pa.list_(pa.int64())))
                    columns += [pa.array(x.astype(np.int64)) for x in ((starts - begin) // width, starts + 8 + size, np.minimum(end, starts + slice_bytes) - starts)]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "name", "kind", "shape", "first", "begin", "length"])

    # Without `content` Spark lists the files and reads none.
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, RANGES)


def dealt_out(ranges: DataFrame) -> DataFrame:
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "name", "first")


def read_range(file: str, kind: str, begin: int, length: int) -> np.ndarray:
    with opened(file) as source:
        source.seek(begin)
        held = source.read(length)
    if len(held) != length:
        raise ValueError(f"{file} ends within a tensor")
    raw = np.frombuffer(held, TENSOR_TYPES[kind])
    return (raw.astype("<u4") << 16).view("<f4") if kind == "BF16" else raw


def tensor_slices(spark: SparkSession, path: str, slice_bytes: int = 1 << 20) -> DataFrame:
    """(file, name, shape, first, values): a row for each slice, in any order; `first` is the place of its first element in the tensor, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = read_range(row["file"], row["kind"], row["begin"], row["length"]).astype("<f8")
                held = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]]) for c in ("file", "name")), pa.array([row["shape"]], pa.list_(pa.int64())), pa.array([row["first"]]), held], names=["file", "name", "shape", "first", "values"])

    return dealt_out(tensor_ranges(spark, path, slice_bytes)).mapInArrow(run, "file string, name string, shape array<long>, first long, values array<double>")


def moments(values: np.ndarray, part: int = 1 << 20) -> tuple[int, int, int, float, float, float]:
    """Elements, finite ones, zeros, and the sum of absolute values, the sum of squares and the largest absolute value of the finite ones."""
    n = ok = zeros = 0
    total = squares = most = 0.0
    for k in range(0, len(values), part):
        x = values[k : k + part].astype(np.float64)
        n += len(x)
        x = np.abs(x[np.isfinite(x)])
        ok += len(x)
        if len(x):
            zeros += int((x == 0).sum())
            total += float(x.sum())
            squares += float(x @ x)
            most = max(most, float(x.max()))
    return n, ok, zeros, total, squares, most


def tensor_moments(spark: SparkSession, path: str, slice_bytes: int = SLICE) -> DataFrame:
    """Per tensor (file, name, shape): the moments that `numeric.health` is made of, merged from those of its slices. A task holds one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["file"], r["name"], r["shape"], *moments(read_range(r["file"], r["kind"], r["begin"], r["length"]))) for r in batch.to_pylist()]
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "name", "shape", "n", "ok", "zeros", "a", "q", "m"])

    own = dealt_out(tensor_ranges(spark, path, slice_bytes)).mapInArrow(run, "file string, name string, shape array<long>, n long, ok long, zeros long, a double, q double, m double")
    return merged_moments(own, "file", "name", "shape")
