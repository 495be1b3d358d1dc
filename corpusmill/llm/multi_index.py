"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut into halves, each with a codebook of its own, and the product of the codebooks is a grid of
cells. A vector visits cells in the order of the multi-sequence algorithm: ascending sums of its squared
distances to the two half centres. It stops at a distance that is set on a sample so that a vector at the
threshold's angle is reached with the target recall, whatever the number of vectors. Candidates in a visited
cell are verified by their cosine in double precision.

A pair is verified in one cell only, the smaller of the two vectors' own cells, so links are counted, not
listed. Cells are cut into chunks; every chunk meets the visitors of its cell in parts of a fixed size, and
gives numbers of links and a tree of links, never all pairs. Equal vectors are one row with a count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, written
from corpusmill.llm.components import connected
from corpusmill.llm.tokens import slices
from corpusmill.llm.vectors import BAND, banded, codebook, cosines, most_centres, rows_of, sample_rows, sample_units, scaled_vectors, squared_distances, units_of, width_of


@dataclass
class Grid:
    """`reach`: how much farther than its nearest cell a vector looks."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared_distances(x[:, : self.half], self.first), squared_distances(x[:, self.half :], self.second)


def multi_sequence(a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by ascending a[i] + b[j], as long as the sum is at most the least one plus `reach`."""
    x, y = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    p, q = a[x], b[y]
    limit = p[0] + q[0] + reach
    heap, seen = [(p[0] + q[0], 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            return
        yield int(x[i]), int(y[j])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(p) and n[1] < len(q) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (p[n[0]] + q[n[1]], *n))


def fit_grid(sample: np.ndarray, size: int, threshold: float, recall: float, seed: int = 5) -> Grid:
    """Codebooks of `size` centres for either half, and the reach.

    The reach is the `recall` quantile, over the sample, of what is needed to get from a vector turned by the
    threshold's angle in a random direction to the cell of the vector itself.
    """
    half = max(1, sample.shape[1] // 2)
    grid = Grid(codebook(sample[:, :half], size), codebook(sample[:, half:], size) if sample.shape[1] > half else np.zeros((1, sample.shape[1] - half)), 0.0)
    if len(sample):
        rng = np.random.default_rng(seed)
        away = rng.standard_normal(sample.shape)
        away -= (away * sample).sum(1)[:, None] * sample
        away /= np.maximum(1e-12, np.sqrt((away * away).sum(1)))[:, None]
        turned = threshold * sample + np.sqrt(1 - threshold**2) * away
        a, b = grid.distances(sample)
        c, d = grid.distances(turned)
        n = np.arange(len(sample))
        need = c[n, a.argmin(1)] + d[n, b.argmin(1)] - c.min(1) - d.min(1)
        grid.reach = float(np.quantile(need, recall)) + 1e-9
    return grid


def visits(groups: DataFrame, grid: Grid) -> DataFrame:
    """A row per group and cell: its own cell (home) and visited cells with smaller numbers."""
    shared = groups.sparkSession.sparkContext.broadcast(grid)
    width = grid.first.shape[1] + grid.second.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        n_second = len(g.second)
        for batch in batches:
            for part in slices(batch, 1024):
                vectors = part.column(1).to_pylist()
                fit = [k for k, u in enumerate(vectors) if len(u) == 8 * width]
                rows: list[tuple[int, int, bool]] = [(k, -len(vectors[k]), True) for k in range(len(vectors)) if len(vectors[k]) != 8 * width]
                if fit:
                    a, b = g.distances(units_of(rows_of([vectors[k] for k in fit])))
                    home = a.argmin(1) * n_second + b.argmin(1)
                    for k, own, x, y in zip(fit, home.tolist(), a, b, strict=True):
                        rows.append((k, own, True))
                        for i, j in multi_sequence(x, y, g.reach):
                            if i * n_second + j < own:
                                rows.append((k, i * n_second + j, False))
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), *(c.take(take) for c in part.columns)], names=["cell", "home", "first_id", "vector", "copies"])

    return groups.select("first_id", "vector", "copies").mapInArrow(run, "cell long, home boolean, first_id long, vector binary, copies long")


def chunk_links(met: DataFrame, threshold: float) -> DataFrame:
    """Numbers of links and trees of links of (home chunk, part of the members) pairs.

    Rows (kind, a, b): kind 0 is a link between groups a and b, kind 1 says that a has b more linked vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, left, right = [], [], []
            for ids, vectors, copies, other_ids, other_vectors, other_copies, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = linked(rows_of(vectors), rows_of(other_vectors), threshold)
                ids, other_ids = np.array(ids), np.array(other_ids)
                if same:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                for who, number in ((ids, near @ np.array(other_copies)), (other_ids, np.array(copies) @ near)):
                    some = np.flatnonzero(number)
                    kinds += [1] * len(some)
                    left += who[some].tolist()
                    right += number[some].tolist()
                a, b = tree(near)
                kinds += [0] * len(a)
                left += ids[a].tolist()
                right += other_ids[b].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["kind", "a", "b"])

    columns = ["ids", "vectors", "copies", "other_ids", "other_vectors", "other_copies", "same"]
    return bounded_batches(met).select(*columns).mapInArrow(run, "kind int, a long, b long")


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the rows of `x` and `y` reach the threshold. A matrix product finds them; those within its rounding error of the threshold are computed one by one from the vectors."""
    product = units_of(x) @ units_of(y).T
    near = product >= threshold
    i, j = np.nonzero(np.abs(product - threshold) < 1e-12)
    near[i, j] = cosines(x[i], y[j]) >= threshold
    return near


def tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that `near` (rows x columns) joins: at most one per row and one per column."""
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    first_column, first_row = near[rows].argmax(1), near[:, columns].argmax(0)
    a, b = np.concatenate([rows, first_row]), np.concatenate([first_column, columns])
    # What these leave apart is joined by one more link for each pair of parts that meet.
    label = np.arange(near.shape[0] + near.shape[1])

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    off = near.shape[0]
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        label[root(i)] = root(off + j)
    roots = np.array([root(i) for i in range(len(label))])
    x, y = np.nonzero(near & (roots[:off][:, None] != roots[off:][None, :]))
    more_a, more_b = [], []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        if root(i) != root(off + j):
            label[root(i)] = root(off + j)
            more_a.append(i)
            more_b.append(j)
    return np.concatenate([a, np.array(more_a, int)]).astype(int), np.concatenate([b, np.array(more_b, int)]).astype(int)


def dealt_parts(rows: DataFrame, size: str, part_rows: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows of each cell in parts of about `part_rows`, as arrays in order of id; `size` is the column with the cell's number of rows."""
    part = F.pmod(F.xxhash64("first_id"), F.ceil(F.col(size) / part_rows).cast("long"))
    members = F.sort_array(F.collect_list(F.struct("first_id", "vector", "copies")))
    grouped = rows.groupBy("cell", "homes", "rows", part.alias("part")).agg(members.alias("m"))
    return grouped.select("cell", "homes", "rows", "part", *(F.col(f"m.{c}").alias(n) for c, n in zip(("first_id", "vector", "copies"), names, strict=True)))


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, recall: float = 0.995, cell_rows: int = 64, part_rows: int = 256) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of `embeddings`.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay. Vectors of
    unlike dimensions never link. Equal vectors link with each other. Cells hold about `cell_rows` vectors; their
    codebooks are fitted on a sample of distinct vectors (16 a centre, 8,192 at least, 256 MB at most, so that halves
    have 32,768 centres for 64 components at most), every vector is indexed. A row with a null id is a row like others, its component is the smallest
    known id. An empty table gives no rows; other columns are ignored.
    """
    vectors = written(scaled_vectors(embeddings), "grid-vectors")
    groups = written(vectors.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "grid-groups")
    # A null id cannot name a group: groups are named by their smallest id, or by a negative hash of the vector.
    groups = groups.withColumn("first_id", F.coalesce("first_id", -1 - F.pmod(F.xxhash64("vector"), F.lit(2**62))))
    width = width_of(groups)
    size = int(np.clip(np.ceil(np.sqrt(max(1, groups.count()) / cell_rows)), 1, most_centres(width)))
    grid = fit_grid(sample_units(groups, sample_rows(size, width)), size, threshold, recall)
    members = written(visits(groups, grid), "grid-visits")
    sizes = members.groupBy("cell").agg(F.count("*").alias("rows"), F.sum(F.col("home").cast("long")).alias("homes"))
    dealt = members.join(written(sizes.where("homes > 0 and rows > 1"), "grid-cells"), "cell")
    homes = written(dealt_parts(dealt.where("home"), "homes", part_rows, ("ids", "vectors", "copies")), "grid-homes")
    guests = written(dealt_parts(dealt.where("not home"), "rows", part_rows, ("other_ids", "other_vectors", "other_copies")), "grid-guests")
    # The parts of a cell meet band by band, so that a cell which holds most rows is spread over many tasks.
    h, g = (F.ceil(F.ceil(F.col(c) / part_rows) / BAND) for c in ("homes", "rows"))
    others = homes.select("cell", "homes", "rows", F.col("part").alias("other_part"), F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"), F.col("copies").alias("other_copies"))
    meet, columns = ["cell", "band_a", "band_b"], ["ids", "vectors", "copies", "other_ids", "other_vectors", "other_copies"]
    first = banded(homes, "part", h, True).where("band_a <= band_b")
    within = first.join(banded(others, "other_part", h, False).drop("homes", "rows").where("band_a <= band_b"), meet).where("part <= other_part")
    within = within.select(*columns, (F.col("part") == F.col("other_part")).alias("same"))
    across = banded(homes, "part", g, True).join(banded(guests, "part", h, False).drop("part", "homes", "rows"), meet).select(*columns, F.lit(False).alias("same"))
    links = written(chunk_links(within.unionByName(across), threshold), "grid-links")
    joined = connected(links.where("kind = 0"), "a", "b")
    counts = links.where("kind = 1").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "first_id")
    found = groups.join(joined.withColumnRenamed("node", "first_id"), "first_id", "left").join(counts, "first_id", "left")
    found = written(found.select("vector", "first_id", "copies", F.coalesce("component", "first_id").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "grid-found")
    named = found.join(found.groupBy("component").agg(F.min(F.when(F.col("first_id") >= 0, F.col("first_id"))).alias("named")), "component")
    named = written(named.select(F.col("vector").alias("group_vector"), "named", (F.col("copies") - 1 + F.col("links")).alias("group_links")), "grid-named")
    result = vectors.join(named, F.col("vector") == F.col("group_vector"), "left")
    component = F.coalesce("named", "vec_id")
    return result.select("vec_id", F.coalesce("group_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle(threshold: float = 0.95) -> str:
    """DuckDB SQL over all pairs, for vectors that all take part; the index finds the same where its recall is whole."""
    return f"""
with recursive e as (select vec_id, embedding::double[] as v from embeddings),
pairs as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= {threshold}),
reached(vec_id, c) as (select vec_id, vec_id from e union select p.b, r.c from reached r join pairs p on p.a = r.vec_id),
least as (select vec_id, min(c) as component_id from reached group by vec_id),
links as (select a, count(*) as n from pairs group by a)
select l.vec_id, coalesce(links.n, 0)::bigint as n_links, component_id, l.vec_id = component_id as kept from least l left join links on links.a = l.vec_id"""
