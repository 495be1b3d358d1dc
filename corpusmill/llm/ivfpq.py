"""Nearest neighbours by an inverted file with product-quantised residuals.

Every distinct vector belongs to the list of its nearest coarse centroid, and its residual is kept as one code per
sub-space. A query visits the lists whose centroids are nearest. In a list its distances to all codes of a sub-space
form a table; the distance of a code is the sum of the entries that it names (asymmetric distance). Of the codes of all
lists that it visits a query keeps the nearest, one depth for the whole query; vectors are read only in the lists of
these, and those with these codes, and no others, are ranked again by their cosine in double precision.

How many lists to visit, and the depth, are measured: for a few vectors that the codebooks were not fitted on the true
neighbours among all rows are found, and how far in either order they stand. Lists are cut into chunks of a fixed size,
and each chunk gives a query its few best, so neither a long list nor a popular one meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, forget, written
from corpusmill.llm.vectors import BAND, banded, codebook, cosines, most_centres, nearest_centres, rows_of, sample_rows, sample_units, scaled_vectors, squared_distances, units_of, width_of

#: Lists whose codes are read together, so that a query's vector is sent once for all of them; vectors that ask in the measurement.
TOGETHER, ASKED = 16, 128


@dataclass
class Index:
    """`books`: a codebook for each sub-space, `bounds`: where sub-spaces begin and end; `probes`: lists to visit; `depth`: how many of a query's nearest codes to read the vectors of."""

    coarse: np.ndarray
    books: list[np.ndarray]
    bounds: list[tuple[int, int]]
    probes: int
    depth: int

    def nearest_list(self, x: np.ndarray) -> np.ndarray:
        return nearest_centres(x, self.coarse)[0]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[lists]
        return np.stack([nearest_centres(rest[:, i:j], b)[0] for (i, j), b in zip(self.bounds, self.books, strict=True)], axis=1).astype(np.uint8)

    def approximate(self, x: np.ndarray, one_list: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries `x` to codes of a list."""
        rest, out = x - self.coarse[one_list], np.zeros((len(x), len(codes)))
        for n, ((i, j), book) in enumerate(zip(self.bounds, self.books, strict=True)):
            out += squared_distances(rest[:, i:j], book)[:, codes[:, n]]
        return out

    def list_ranks(self, x: np.ndarray) -> np.ndarray:
        """For each of `x` the place of every list in the order of nearness."""
        order = np.argsort(squared_distances(x, self.coarse), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
        return rank

    def distances(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to codes of many lists, infinite in lists that a query does not visit."""
        out = np.full((len(x), len(codes)), np.inf)
        for one in np.unique(lists).tolist():
            own, asks = np.flatnonzero(lists == one), np.flatnonzero(visited[:, one])
            if len(asks):
                out[np.ix_(asks, own)] = self.approximate(x[asks], one, codes[own])
        return out


def fit_index(sample: np.ndarray, lists: int, spaces: int, seed: int = 11) -> Index:
    """Coarse centroids and codebooks fitted on three quarters of `sample`. It visits all lists and keeps all codes until `measured`."""
    fitted = sample[: len(sample) - len(sample) // 4]
    coarse = codebook(fitted, min(lists, max(1, len(fitted) // 16)), seed=seed)
    width = sample.shape[1]
    cuts = np.linspace(0, width, min(spaces, width) + 1).astype(int)
    bounds = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    index = Index(coarse, [np.zeros((1, j - i)) for i, j in bounds], bounds, len(coarse), 1 << 30)
    if len(sample):
        inner = fitted - coarse[index.nearest_list(fitted)]
        index.books = [codebook(inner[:, i:j], 256, rounds=8, seed=seed + n) for n, (i, j) in enumerate(bounds)]
    return index


def measured(index: Index, rows: DataFrame, kinds: DataFrame, asked: np.ndarray, recall: float, k: int) -> Index:
    """`index` with the probes and the depth by which the share `recall` of the true `k` nearest of `asked`, among all rows, is found.

    Rows of equal vectors do not count. Each task sends on its few best, and then a number for each neighbour.
    """
    if not len(asked):
        return index
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((index, asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = shared.value
        held = [np.empty((0, 3))] * len(x)
        for batch in batches:
            lists, raw, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fit = np.flatnonzero(lists >= 0)
            if not len(fit):
                continue
            score = x @ units_of(rows_of([raw[i] for i in fit.tolist()])).T
            score[score > 1 - 1e-12] = -2.0
            code = np.frombuffer(b"".join(codes[i] for i in fit.tolist()), np.uint8).reshape(len(fit), -1)
            for q, near in enumerate(np.argsort(-score, axis=1, kind="stable")[:, :k]):
                near = near[score[q, near] > -2]
                more = np.array([(score[q, i], lists[fit[i]], own.approximate(x[q : q + 1], int(lists[fit[i]]), code[i : i + 1])[0, 0]) for i in near.tolist()]).reshape(-1, 3)
                whole = np.concatenate([held[q], more])
                held[q] = whole[np.argsort(-whole[:, 0], kind="stable")[:k]]
        out = [(q, *row) for q, some in enumerate(held) for row in some.tolist()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) if n in (0, 2) else pa.array(c, pa.float64()) for n, c in enumerate(columns)], names=["q", "score", "list", "distance"])

    found = rows.select("list", "vector", "codes").mapInArrow(best, "q long, score double, list long, distance double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list", "distance"))
    true = [(r["q"], r["list"], r["distance"]) for r in found.withColumn("rank", rank).where(F.col("rank") <= k).orderBy("q", "rank").collect()]
    if not true:
        return index
    ranks = index.list_ranks(asked)
    index.probes = int(np.quantile([ranks[q, one] for q, one, _ in true], recall, method="higher")) + 1
    # A neighbour in a list that is not visited is lost whatever the depth.
    near = [(q, d) for q, one, d in true if ranks[q, one] < index.probes]
    limits = spark.sparkContext.broadcast((index, asked, near, ranks < index.probes))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, wanted, visited = limits.value
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            lists, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            fit = lists >= 0
            if fit.any():
                code = np.frombuffer(b"".join(codes), np.uint8).reshape(int(fit.sum()), -1)
                distance = own.distances(x, lists[fit], code, visited)
                counts += [int((distance[q] < d - 1e-12).sum()) for q, d in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(counts)], names=["n", "passed"])

    counts = kinds.select("list", "codes").mapInArrow(passed, "n long, passed long").groupBy("n").agg(F.sum("passed").alias("passed")).collect()
    index.depth = k + int(np.quantile([r["passed"] for r in counts], recall, method="higher"))
    return index


def in_second_order(sample: np.ndarray) -> np.ndarray:
    """`sample` in the order of another hash than it was picked by, so that its last quarter is like the rest of it."""
    marks = [xxhash.xxh64_intdigest(np.ascontiguousarray(row, "<f8").tobytes(), 7) for row in sample]
    return sample[np.argsort(np.array(marks, np.uint64), kind="stable")]


def indexed(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, vector, vec_ids, codes) of every vector of the index's dimension; those of another have list -dimension and no codes."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width = own.coarse.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(0).to_pylist()
            lists, codes = [-(len(u) // 8) for u in raw], [b""] * len(raw)
            fit = [i for i, u in enumerate(raw) if len(u) == 8 * width]
            if fit:
                x = units_of(rows_of([raw[i] for i in fit]))
                near = own.nearest_list(x)
                for i, n, c in zip(fit, near.tolist(), own.codes(x, near), strict=True):
                    lists[i], codes[i] = n, c.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *batch.columns, pa.array(codes, pa.binary())], names=["list", "vector", "vec_ids", "codes"])

    return vectors.mapInArrow(run, "list long, vector binary, vec_ids array<long>, codes binary")


def visits(queries: DataFrame, index: Index) -> DataFrame:
    """(batch, query_id, query): a row for each batch of `TOGETHER` lists in which a query visits one; a query of another dimension has batch -dimension."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width = own.coarse.shape[1]
        for batch in batches:
            raw = batch.column(1).to_pylist()
            rows = [(k, -(len(u) // 8)) for k, u in enumerate(raw) if len(u) != 8 * width]
            fit = [k for k, u in enumerate(raw) if len(u) == 8 * width]
            if fit:
                ranks = own.list_ranks(units_of(rows_of([raw[k] for k in fit])))
                rows += [(k, n) for k, rank in zip(fit, ranks, strict=True) for n in np.unique(np.flatnonzero(rank < own.probes) // TOGETHER).tolist()]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), *(c.take(take) for c in batch.columns)], names=["batch", "query_id", "query"])

    return queries.mapInArrow(run, "batch long, query_id long, query binary")


def meetings(rows: DataFrame, asks: DataFrame, key: str, row_id: str, chunk_rows: int, query_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows and queries that meet by `key`, and the tables that they are read from.

    `rows` and `asks` are arrays of structs, cut into chunks and parts of about these sizes, which meet in bands.
    """
    own, other = ([c for c in df.columns if c != key] for df in (rows, asks))
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / chunk_rows).cast("long").alias("chunks"))
    loads = asks.groupBy(key).agg(F.ceil(F.count("*") / query_rows).cast("long").alias("parts"))
    limits = written(sizes.join(loads, key), "ivf-lists")
    chunk, part = F.pmod(F.xxhash64(row_id), "chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), "parts").alias("part")
    chunks = rows.join(limits, key).select("*", chunk).groupBy(key, "chunks", "parts", "chunk").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("rows"))
    parts = asks.join(limits, key).select("*", part).groupBy(key, "chunks", "parts", "part").agg(F.sort_array(F.collect_list(F.struct(*other))).alias("asks"))
    chunks = banded(chunks, "chunk", F.ceil(F.col("parts") / BAND), True).drop("chunk", "chunks", "parts")
    parts = banded(parts, "part", F.ceil(F.col("chunks") / BAND), False).drop("part", "chunks", "parts")
    tables = [written(chunks, "ivf-chunks"), written(parts, "ivf-parts")]
    forget(limits)
    return tables[0].join(tables[1], [key, "band_a", "band_b"]), tables


def nearest_codes(met: DataFrame, index: Index) -> DataFrame:
    """(query_id, list, distance): the `depth` nearest codes of each chunk for each query."""
    shared = met.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lists, codes, query_ids, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, lists = units_of(rows_of(queries)), np.array(lists)
                distance = own.distances(x, lists, np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), own.list_ranks(x) < own.probes)
                most = min(own.depth, distance.shape[1])
                near = np.argpartition(distance, most - 1, axis=1)[:, :most]
                kept = np.take_along_axis(distance, near, axis=1)
                seen = np.isfinite(kept)
                ids = np.broadcast_to(np.array(query_ids)[:, None], near.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(lists[near][seen]), pa.array(kept[seen])], names=["query_id", "list", "distance"])

    columns = (F.col("rows.list"), F.col("rows.codes"), F.col("asks.query_id"), F.col("asks.query"))
    return bounded_batches(met).select(*(c.alias(n) for c, n in zip(columns, ("lists", "codes", "query_ids", "queries"), strict=True))).mapInArrow(run, "query_id long, list long, distance double")


def best_of_chunk(index: Index, one_list: int, query_ids: list[int], q: np.ndarray, limits: np.ndarray, ids: list[list[int]], x: np.ndarray, codes: np.ndarray | None, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, score): for each query the `k` best by cosine of the rows whose codes are within its limit. A row has the smallest ids of its vector."""
    distance = None if codes is None else index.approximate(units_of(q), one_list, codes)
    out = []
    for n, query_id in enumerate(query_ids):
        # The limit comes from the same sums in another batch, which may be added in another order.
        near = np.arange(len(x)) if distance is None else np.flatnonzero(distance[n] <= limits[n] * (1 + 1e-9) + 1e-12)
        if not len(near):
            continue
        score = cosines(x[near], q[n][None, :])
        last = np.sort(-score)[min(len(score) - 1, k)]
        found = [(-s, v) for i, s in zip(near.tolist(), score.tolist(), strict=True) if -s <= last for v in ids[i] if v != query_id]
        out += [(query_id, v, -s) for s, v in sorted(found)[:k]]
    return out


def search_chunks(met: DataFrame, index: Index, k: int) -> DataFrame:
    """The `k` best of each chunk for each query. Vectors of another dimension than the index's have no codes, and are all ranked."""
    shared = met.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for one_list, vectors, vec_ids, codes, query_ids, queries, limits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1) if one_list >= 0 else None
                out += best_of_chunk(own, one_list, query_ids, rows_of(queries), np.array(limits), vec_ids, rows_of(vectors), code, k)
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    columns = {"list": F.col("list"), **{c: F.col(f"rows.{c}") for c in ("vector", "vec_ids", "codes")}, **{c: F.col(f"asks.{c}") for c in ("query_id", "query", "limit")}}
    return bounded_batches(met).select(*(c.alias(n) for n, c in columns.items())).mapInArrow(run, "query_id long, vec_id long, score double")


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(vector, vec_ids): distinct vectors with their `k` + 1 smallest ids, which are all that `k` neighbours can be taken from."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.select("vec_id", "vector").distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))


def nearest(embeddings: DataFrame, modulus: int = 50, k: int = 5, recall: float = 0.97, spaces: int = 32, chunk_rows: int = 1024, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the `k` nearest found for each query, the rows whose vec_id `modulus` divides.

    All rows but the query's own are candidates; ties go to the smaller vec_id. Vectors that are null, empty, zero
    or hold null or non-finite components, or have a null id, take no part; vectors of unlike dimensions never
    meet. A query among fewer than `k` candidates found gets those. Repeated rows with one id are one vector: the
    id's own row is never its neighbour; of different vectors with one id the query is the one whose bytes are
    smallest, and each is a candidate. There are about as many lists as the root of the number of vectors. They
    and the codebooks are fitted on a sample of distinct vectors (16 a list, 8,192 at least, 256 MB at most), so
    lists of 64 components stop at 32,768 (a billion vectors) and grow longer from there; every vector is
    indexed. An empty table gives no rows; other columns are ignored.
    """
    vectors = written(scaled_vectors(embeddings).where("vector is not null and vec_id is not null"), "ivf-vectors")
    distinct = written(distinct_vectors(vectors, k), "ivf-distinct")
    width, n_rows = width_of(distinct), distinct.count()
    lists = int(np.clip(np.sqrt(n_rows), 1, most_centres(width)))
    sample = in_second_order(sample_units(distinct, sample_rows(lists, width)))
    index = fit_index(sample, lists, spaces)
    rows = written(indexed(distinct, index), "ivf-rows")
    kinds = written(rows.where("list >= 0").select("list", "codes").distinct(), "ivf-codes")
    index = measured(index, rows, kinds, sample[len(sample) - len(sample) // 4 :][:ASKED], recall, k)
    asked = written(vectors.where(F.pmod("vec_id", F.lit(modulus)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query")), "ivf-asked")
    visited = written(visits(asked, index), "ivf-visits")
    batched = kinds.withColumn("batch", F.floor(F.col("list") / TOGETHER))
    met, tables = meetings(batched, visited.where("batch >= 0"), "batch", "codes", chunk_rows * 4, query_rows)
    codes = nearest_codes(met, index)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "list"))
    kept = codes.withColumn("rank", order).where(F.col("rank") <= index.depth).groupBy("query_id").agg(F.max("distance").alias("limit"), F.collect_set("list").alias("lists"))
    asks = kept.join(asked, "query_id").select(F.explode("lists").alias("list"), "query_id", "query", "limit")
    others = visited.where("batch < 0").select(F.col("batch").alias("list"), "query_id", "query", F.lit(float("inf")).alias("limit"))
    asks = written(asks.unionByName(others), "ivf-asks")
    forget(*tables)
    met, _ = meetings(rows, asks, "list", "vector", chunk_rows, query_rows)
    forget(vectors, distinct, rows, kinds, visited, asked, asks)
    once = search_chunks(met, index, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
