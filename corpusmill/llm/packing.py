"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, pieces of documents, and attention cost (the sum of squared piece
lengths). Pieces go longest first into the open sequence where, under every constraint, the weighted residual
is smallest (`rule="norm"`) or the weighted dot-product of demand and residual is largest (`rule="dot"`).
Blocks of pieces, dealt by a hash, are packed apart from each other, so no group grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, blocks_for, text_or_empty, written
from corpusmill.llm.tokens import encoder, gathered, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END = 0


def cut_points(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece number, start and length of the pieces of documents of `sizes` ids: all of `most` ids, but for the first of a document."""
    n = np.maximum(1, -(-sizes // most))
    first = sizes - (n - 1) * most
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * most)
    return doc, piece, start, np.where(piece == 0, first[doc], most)


def token_pieces(docs: DataFrame, tokenizer: str, most: int) -> DataFrame:
    """A row per piece of every document's ids and the end id 0; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer, spaces=True)
        for batch in gathered(batches):
            sizes, ids = with_end(*codes.encode(batch.column(1)), END)
            doc, piece, start, length = cut_points(sizes, most)
            raw, ends = memoryview(ids.astype("<u4", copy=False)), np.cumsum(length)
            checks = [zlib.crc32(raw[i:j]) for i, j in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), *(pa.array(c, t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (checks, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; `lengths` descend."""
    scale = np.asarray(weights, float) / np.asarray(capacity, float) ** 2
    n = len(lengths)
    place, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    room = np.empty((3, 64), float)
    number = np.empty(64, np.int64)
    opened = used = 0
    least = int(lengths[-1]) if n else 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], float)
        best = -1
        if used:
            rest = room[:, :used] - need[:, None]
            fits = rest.min(axis=0) >= 0
            if fits.any():
                if rule == "dot":
                    score = np.where(fits, -(scale * need) @ room[:, :used], np.inf)
                else:
                    score = np.where(fits, scale @ (rest * rest), np.inf)
                best = int(score.argmin())
        if best < 0:
            if used == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            room[:, used], number[used], best = capacity, opened, used
            opened += 1
            used += 1
        place[i], offset[i] = number[best], capacity[0] - int(room[0, best])
        room[:, best] -= need
        if room[0, best] < least or room[1, best] < 1 or room[2, best] < least * least:
            used -= 1
            room[:, best], number[best] = room[:, used], number[used]
    return place, offset


def pack_pieces(pieces: DataFrame, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", block_rows: int = 8192) -> DataFrame:
    """`pieces` (any table with doc_id, piece, length) with sequence_id and offset. Ties in length go by doc_id and piece."""
    rows = pieces.count()
    blocks = blocks_for(rows, block_rows)
    # Row numbers keep rows that are alike from sharing a block.
    block = F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    dealt = pieces.withColumn("block", block)
    schema = dealt.drop("block").schema.add("sequence_id", "long").add("offset", "long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        place, offset = best_fit(pdf["length"].to_numpy(), capacity, weights, rule)
        pdf["sequence_id"] = place + (pdf["block"].to_numpy() << 32)
        pdf["offset"] = offset
        return pdf.drop(columns="block")

    return dealt.groupBy("block").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, most: int = 2048, most_pieces: int = 2048, most_cost: int | None = None, **options) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than `most` ids are cut. A null or empty text is its end id alone; repeated rows and
    null ids are packed like others; an empty table gives no rows; other columns are ignored. `most_pieces` and
    `most_cost` bound a sequence's pieces and its sum of squared lengths; their defaults never bind before `most`.
    """
    pieces = written(token_pieces(docs, tokenizer, most), "pack-pieces")
    return pack_pieces(pieces, (most, most_pieces, most_cost or most * most), **options)
