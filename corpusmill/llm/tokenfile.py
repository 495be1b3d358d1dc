"""Token ids in files of shuffled planes.

Ids are stored in blocks of fixed size. A block is transposed: plane k holds byte (or bit) k of every id, and
each plane is compressed with zstandard. Low planes hold the entropy, high ones are constant and vanish.

    file   = MAGIC, chunk*, documents, index, trailer
    chunk  = compressed planes of one block of ids, low plane first
    documents = zstandard of: has-id flags (1 byte each), ids (int64), lengths (uint64)
    index  = JSON: mode, block, n_ids, n_docs, chunks [offset, n_ids, plane sizes], documents [offset, size]
    trailer = index offset (uint64), index size (uint64), MAGIC
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, new_path, partitions, text_or_empty
from corpusmill.llm.tokens import encoder, gathered, with_end

MAGIC = b"PLANEID1"
MANIFEST = "part int, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    if mode == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in bits.T]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    """Writes documents one after another; holds one block of ids and the documents' lengths."""

    def __init__(self, out, mode: str = "byte", block: int = 65_536, level: int = 3):
        if mode not in ("byte", "bit"):
            raise ValueError(f"unknown plane mode {mode}")
        self.out, self.mode, self.block = out, mode, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.pending, self.n_pending, self.chunks = [], 0, []
        self.doc_ids, self.known, self.lengths, self.at, self.n_ids = [], [], [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None] | pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order: their ids, how many tokens each has, and all tokens one after another."""
        doc_ids = doc_ids if isinstance(doc_ids, pa.Array) else pa.array(doc_ids, pa.int64())
        self.known.append(doc_ids.is_valid().to_numpy(zero_copy_only=False))
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.lengths.append(np.asarray(lengths).astype("<u8"))
        self.pending.append(np.asarray(ids, "<u4"))
        self.n_pending += len(ids)
        if self.n_pending >= self.block:
            data = np.concatenate(self.pending)
            whole = len(data) - len(data) % self.block
            for k in range(0, whole, self.block):
                self._chunk(data[k : k + self.block])
            self.pending, self.n_pending = [data[whole:].copy()], len(data) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.mode)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self.n_ids += len(ids)
        for p in planes:
            self._put(p)

    def close(self) -> None:
        if self.n_pending:
            self._chunk(np.concatenate(self.pending))
        raw = b"".join(x.astype(t).tobytes() for parts, t in ((self.known, np.uint8), (self.doc_ids, "<i8"), (self.lengths, "<u8")) for x in parts)
        docs, at = self.zip.compress(raw), self.at
        self._put(docs)
        index, where = json.dumps({"mode": self.mode, "block": self.block, "n_ids": self.n_ids, "n_docs": sum(map(len, self.doc_ids)), "chunks": self.chunks, "documents": [at, len(docs)]}).encode(), self.at
        self._put(index)
        self._put(struct.pack("<QQ", where, len(index)) + MAGIC)


class PlaneReader:
    """Reads a file by its index: all documents in order, or one chunk."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.seek(0, io.SEEK_END)
        tail = self._get((source.tell() if size is None else size) - 24, 24)
        if tail[16:] != MAGIC:
            raise ValueError("not a file of token planes")
        self.index = json.loads(self._get(*struct.unpack("<QQ", tail[:16])))
        raw, n = self.unzip.decompress(self._get(*self.index["documents"])), self.index["n_docs"]
        self.known = np.frombuffer(raw, np.uint8, n)
        self.doc_ids = np.frombuffer(raw, "<i8", n, n)
        self.lengths = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        raw, planes = self._get(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unzip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n, self.index["mode"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.empty(0, "<u4"), 0
        for known, doc_id, length in zip(self.known, self.doc_ids, self.lengths, strict=True):
            parts, have = [held], len(held)
            while have < length:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (int(doc_id) if known else None), held[:length]
            held = held[length:]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, spaces: bool, end_id: int, mode: str = "byte", block: int = 65_536) -> DataFrame:
    """Writes every document's ids and `end_id` in ascending order of doc_id (nulls first, ties by text) and returns the manifest, a row per file.

    A file is written beside its place and moved there when whole, so a task that runs again does no harm.
    """
    ordered = bounded_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/ids-{part:06d}.planes"
        draft = f"{path}.{context.taskAttemptId()}"
        codes, n_docs = encoder(tokenizer, spaces), 0
        with store.open_output_stream(draft) as out:
            writer = PlaneWriter(out, mode, block)
            for batch in gathered(batches):
                writer.add(batch.column(0), *with_end(*codes.encode(batch.column(1)), end_id))
                n_docs += batch.num_rows
            writer.close()
        if store.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            store.move(draft, path)
        else:  # an earlier run of this task has written the same
            store.delete_file(draft)
        names = ["part", "path", "n_docs", "n_tokens"]
        values = [pa.array([part], pa.int32()), pa.array([f"{folder}/ids-{part:06d}.planes"]), pa.array([n_docs]), pa.array([writer.n_ids])]
        yield pa.RecordBatch.from_arrays(values, names=names)

    return ordered.mapInArrow(run, MANIFEST)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has one row per file; its running total of ids is made on the driver.
    """
    spark = manifest.sparkSession
    files, before = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        if row["n_docs"]:
            files.append((row["path"], before))
        before += row["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, local = pyarrow.fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(local) as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield table_of(rows)
                            rows = []
                if rows:
                    yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files))).mapInArrow(run, ROWS)


def token_round_trip(docs: DataFrame, tokenizer: str, spaces: bool = False, end_id: int = 2, **options) -> DataFrame:
    """Writes all documents to files in the shared folder and returns what is read back from them.

    Null and empty texts hold their end id alone; repeated rows and null ids are kept; an empty table gives
    no rows; other columns are ignored.
    """
    manifest = write_tokens(docs, new_path(docs.sparkSession, "token-planes"), tokenizer, spaces, end_id, **options)
    return read_tokens(manifest)
