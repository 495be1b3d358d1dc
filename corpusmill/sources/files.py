"""Files as rows: inventories, checksum files, manifests and tensors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import suppress
from datetime import UTC, datetime
from itertools import groupby
from pathlib import Path
from typing import Any
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.functions.arrow import bounded_batches

MARKERS = ("VERIFIED.sha256", "snapshot_manifest.json")


#: Bytes of a file held at a time: shorter files are hashed by Spark itself, others in blocks, or by lines in stores that only Spark reads.
BLOCK = 8 << 20
#: Names that Spark's line reader would decompress. In stores that only Spark reads such files are held whole below this limit.
CODED, WHOLE_FILE = r"\.(gz|bz2|zstd?|snappy|lz4|deflate|lzo\w*)$", 1 << 30
#: Spark's line reader drops this mark at the head of a file.
MARK = b"\xef\xbb\xbf"


def with_hashes(found: DataFrame, paths: str | list[str], limit: int = BLOCK, **options: str) -> DataFrame:
    """`found` (uri, length, content and other columns of files below `paths`, see `listed`) with `sha256`, without content.

    A file of `limit` bytes or more takes the memory of a block; by lines, of its longest line.
    """
    near, coded, length = F.col("uri").startswith("file:"), F.col("uri").rlike(CODED), F.col("length")
    held = (length < limit) | (~near & coded & (length < WHOLE_FILE))
    far = ~held & ~near & ~coded
    short = found.where(held).withColumn("sha256", F.sha2("content", 256)).drop("content")
    long = found.drop("content").where(~held & (near | coded))
    sums = short.unionByName(long.mapInArrow(block_hashes, StructType([*long.schema.fields, StructField("sha256", StringType())])))
    if all(n.startswith("file:") for n in found.inputFiles()):
        return sums
    read = whole_lines(found.sparkSession, paths, **options).where(far).mapInArrow(line_hashes, "uri string, sha256 string").distinct()
    return sums.unionByName(bounded_batches(found).drop("content").where(far).join(read, "uri"))


def block_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with opened(path) as source:
                while block := source.read(BLOCK):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "sha256"])


def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, sha256) from the lines of whole files. The length of a file tells whether a last line feed or a mark at its head is not among them."""
    rows = (r for uris, lengths, lines in batches for r in zip(uris.to_pylist(), lengths.to_pylist(), lines.view(pa.binary()).to_pylist(), strict=True))
    for (uri, length), found in groupby(rows, lambda r: r[:2]):
        sums, left = (hashlib.sha256(), hashlib.sha256(MARK)), length
        for k, (_, _, line) in enumerate(found):
            part = b"\n" + line if k else line
            left -= len(part)
            for digest in sums:
                digest.update(part)
        if left not in (0, 1, len(MARK), len(MARK) + 1):
            raise ValueError(f"{uri}: lines hold {length - left} of {length} bytes")
        marked, ended = divmod(left, len(MARK))
        sums[marked].update(b"\n" * ended)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([sums[marked].hexdigest()])], names=["uri", "sha256"])


def whole_lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(uri, length, line) of files, in order; lines hold any bytes, not UTF-8 alone. A session of its own keeps Spark from splitting files: each is one task."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        with suppress(AnalysisException):  # a static setting, which sessions share
            own.conf.set(key, value)
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(key, str(1 << 44))
    read = own.read.format("text").options(**options).option("lineSep", "\n").load(paths)
    return read.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("length"), F.col("value").alias("line"))


def opened(path: str) -> Any:
    """A stream of a file that Arrow's file systems reach by its URI, or by a local path as Spark writes it (`file:/a b`, not encoded)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return pyarrow.fs.LocalFileSystem().open_input_file(path[5:])
    store, local = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(local)


def listed(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(path, uri, length, content) of files. Spark's scans pass over empty files, so these are added from the list of files that it holds.

    `uri` and `length` are known from the listing, so files that a filter on them leaves out are not read.
    """
    read = spark.read.format("binaryFile").options(**options).load(paths)
    found = read.select("path", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("length"), "content")
    names = [("file:" + n[7:] if n.startswith("file:///") else n,) for n in map(unquote, found.inputFiles())]
    every = spark.createDataFrame(names, "path string")
    empty = every.join(found.select("path"), "path", "left_anti")
    return found.unionByName(empty.select("path", F.col("path").alias("uri"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def inventory(spark: SparkSession, root: str, pattern: str | None = None, skip_folder: str = ".cache", skip_names: tuple[str, ...] = MARKERS, limit: int = BLOCK) -> DataFrame:
    """(path, bytes, sha256) of all files below `root`, paths relative; what lies in a skipped folder, and marker files, are left out. Files may have any size."""
    options = {"recursiveFileLookup": "true"} | ({"pathGlobFilter": pattern} if pattern else {})
    found = listed(spark, root, **options)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.element_at(F.split("path", r"^\w+:(//[^/]*)?", 2), -1), "^" + regex_quoted(base) + "/+", "")
    parts = F.split(path, "/")
    kept = found.where(~F.array_contains(parts, skip_folder) & ~F.element_at(parts, -1).isin(*skip_names))
    named = with_hashes(kept.withColumn("name", path), root, limit, **options)
    return named.select(F.col("name").alias("path"), F.col("length").alias("bytes"), "sha256")


def regex_quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def checksum_lines(files: DataFrame) -> DataFrame:
    return files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of a checksum file's lines."""
    line = spark.read.text(path)
    return line.select(F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 2).alias("path")).where("sha256 <> ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, records, bytes) from a manifest whose `files` maps names to these."""
    entry = "map<string,struct<sha256:string,records:bigint,bytes:bigint>>"
    files = spark.read.option("multiLine", True).schema(f"files {entry}").json(path)
    return files.select(F.explode("files").alias("name", "f")).select("name", "f.sha256", "f.records", "f.bytes")


def write_manifest(path: str | Path, content: dict[str, Any], stamp: str | None = None) -> None:
    """Sorted JSON, with the time under `stamp` if given."""
    if stamp:
        content = content | {stamp: datetime.now(UTC).isoformat()}
    Path(path).write_text(json.dumps(content, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def write_marker(folder: str | Path, passed: bool, spark: SparkSession | None = None) -> Any:
    """PASSED or FAILED, the other one removed. With `spark`, in any store that it reaches."""
    kept, gone = ("PASSED", "FAILED") if passed else ("FAILED", "PASSED")
    if spark is None:
        (Path(folder) / gone).unlink(missing_ok=True)
        (Path(folder) / kept).touch()
        return Path(folder) / kept
    store = Store(spark, str(folder))
    store.remove(gone)
    store.touch(kept)
    return f"{folder}/{kept}"


class Store:
    """Names below a folder of a file system that Spark reaches, shared ones among them."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._root = self._path(folder)
        self._system = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self._path(self._root, name) if name else self._root

    def exists(self, name: str = "") -> bool:
        return self._system.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._system.listStatus(self._root)) if self.exists() else []

    def touch(self, name: str) -> None:
        self._system.create(self._at(name), True).close()

    def remove(self, name: str) -> None:
        self._system.delete(self._at(name), True)

    def make(self) -> None:
        self._system.mkdirs(self._root)


def write_verification(spark: SparkSession, root: str, **about: Any) -> DataFrame:
    """Writes the manifest and the checksum file of a folder and returns its inventory; the checksum file holds the manifest too.

    Every file is hashed once; rows are kept by the executors, and pass through the driver a few at a time.
    """
    rows = inventory(spark, root).orderBy("path").persist()
    manifest, sums = Path(root) / MARKERS[1], Path(root) / MARKERS[0]
    content = {**about, "files": None, "verified_at": datetime.now(UTC).isoformat()}
    with open(manifest, "w", encoding="utf-8") as out:
        for k, name in enumerate(sorted(content)):
            out.write(f"{',' if k else '{'}\n  {json.dumps(name)}: ")
            if name != "files":
                out.write(json.dumps(content[name], ensure_ascii=False, indent=2, sort_keys=True))
                continue
            first = True
            for r in rows.toLocalIterator():
                out.write(f"{'{' if first else ','}\n    {json.dumps(r['path'], ensure_ascii=False)}: {json.dumps({'bytes': r['bytes'], 'sha256': r['sha256']})}")
                first = False
            out.write("{}" if first else "\n  }")
        out.write("\n}\n")
    with open(manifest, "rb") as written:
        own = spark.createDataFrame([(MARKERS[1], hashlib.file_digest(written, "sha256").hexdigest())], "path string, sha256 string")
    with open(sums, "w", encoding="utf-8") as out:
        for r in checksum_lines(rows.select("path", "sha256").unionByName(own)).toLocalIterator():
            out.write(r["value"] + "\n")
    return rows


#: Array types of the tensor file format; bfloat16 is read as the upper half of a float32.
TENSOR_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1"}


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, shape, values) of tensor files of any size: an 8-byte header size, a JSON header, then the data. A task holds one tensor at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with opened(file) as source:
                    size = int.from_bytes(source.read(8), "little")
                    header = json.loads(source.read(size))
                    for name, t in header.items():
                        if name == "__metadata__":
                            continue
                        begin, end = t["data_offsets"]
                        source.seek(8 + size + begin)
                        raw = np.frombuffer(source.read(end - begin), TENSOR_TYPES[t["dtype"]])
                        values = (raw.astype("<u4") << 16).view("<f4") if t["dtype"] == "BF16" else raw
                        values = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype("<f8")))
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([t["shape"]], pa.list_(pa.int64())), values], names=["file", "name", "shape", "values"])

    # Without `content` Spark lists the files and reads none.
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, "file string, name string, shape array<long>, values array<double>")
