"""What the two vector operators share: vectors as Arrow binaries, their cosines, and codebooks fitted on bounded samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import hashed_sample
from corpusmill.llm.tokens import slices

VECTOR = "vec_id long, vector binary"


def scaled_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector in double precision; null for vectors that are null, empty or zero or hold null or non-finite components.

    Vectors are scaled by a power of two, which changes no cosine by a bit, so that squares neither vanish nor overflow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                out = []
                for row in part.column(1):
                    values = None if not row.is_valid else row.values
                    if values is None or not len(values) or values.null_count:
                        out.append(None)
                        continue
                    v = values.to_numpy(zero_copy_only=False)
                    most = np.abs(v).max()
                    if not np.isfinite(most) or most == 0:
                        out.append(None)
                        continue
                    out.append(np.ldexp(v, -np.frexp(most)[1]).astype("<f8").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, VECTOR)


def rows_of(raw: list[bytes]) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix."""
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def units_of(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of `x` and `y`, each by its own sums, so that equal rows have equal cosines wherever they stand."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


#: Parts of one side of a join in a band.
BAND = 8


def banded(rows: DataFrame, place: str, other_bands: Column, first: bool) -> DataFrame:
    """`rows`, whose parts are numbered by `place`, once for each band of the other side: columns band_a (of the first side) and band_b.

    Where two sides meet by a key that may hold most rows, the bands spread a key's parts over many tasks. With one
    band on the other side nothing is copied.
    """
    own, other = ("band_a", "band_b") if first else ("band_b", "band_a")
    return rows.select("*", F.floor(F.col(place) / BAND).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.greatest(other_bands.cast("int"), F.lit(1)) - 1)).alias(other))


def sample_units(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most `rows` unit vectors, those whose hashed vectors are smallest, of the most common dimension."""
    got = [r["vector"] for r in hashed_sample(vectors.where("vector is not null").select("vector"), rows, "vector").collect()]
    if not got:
        return np.zeros((0, 1))
    most = np.bincount([len(x) for x in got]).argmax()
    return units_of(rows_of([x for x in got if len(x) == most]))


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)[None, :])


def nearest_centres(x: np.ndarray, centres: np.ndarray, part: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each row's nearest centre, `part` rows at a time."""
    places, distances = np.zeros(len(x), np.int64), np.zeros(len(x))
    for k in range(0, len(x), part):
        d = squared_distances(x[k : k + part], centres)
        places[k : k + part] = d.argmin(1)
        distances[k : k + part] = d.min(1)
    return places, distances


def codebook(sample: np.ndarray, size: int, rounds: int = 12, seed: int = 3, direct: int = 1024) -> np.ndarray:
    """Centres by Lloyd's algorithm. More than `direct` are made in two levels, so that the work grows with the root of their number."""
    if size <= direct or len(sample) <= size:
        return lloyd(sample, size, rounds, seed)
    top = lloyd(sample, math.isqrt(size), rounds, seed)
    own = nearest_centres(sample, top)[0]
    counts = np.bincount(own, minlength=len(top))
    share = np.maximum(1, np.round(size * counts / len(sample))).astype(int)
    return np.concatenate([lloyd(sample[own == k], int(share[k]), rounds, seed + 1 + k) for k in np.flatnonzero(counts).tolist()])


def lloyd(sample: np.ndarray, size: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from sampled rows; a centre without rows takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    size = max(1, min(size, len(distinct)))
    if not len(distinct):
        return np.zeros((1, sample.shape[1]))
    centres = distinct[rng.permutation(len(distinct))[:size]].copy()
    for _ in range(rounds):
        own, distance = nearest_centres(sample, centres)
        counts = np.bincount(own, minlength=size)
        sums = np.stack([np.bincount(own, sample[:, j], minlength=size) for j in range(sample.shape[1])], axis=1)
        far = np.argsort(-distance, kind="stable")
        centres = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = sample[far[: len(empty)]]
    return centres


def sample_rows(centres: int, width: int, least: int = 8192, most_bytes: int = 256 << 20) -> int:
    """Rows to fit `centres` on: 16 each, 8,192 at least, 256 MB of doubles at most (half a million rows of 64 components)."""
    return int(max(least, min(16 * centres, most_bytes // (8 * max(1, width)))))


def most_centres(width: int, most_bytes: int = 256 << 20) -> int:
    """As many as a sample of the largest size has 16 rows for."""
    return max(512, most_bytes // (128 * max(1, width)))


def width_of(vectors: DataFrame) -> int:
    """The most components that a vector has."""
    return int((vectors.agg(F.max(F.octet_length("vector"))).first()[0] or 8) // 8)
