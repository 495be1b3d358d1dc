"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two that differ in at most 3 bits differ in at most 3 bytes, so they share at least
5 positional bytes: the guaranteed minimum. Of the 8 positions two halves of 4 are made, and the index has a
posting list for each 3 positions within a half and their bytes; 5 shared positions always have 3 in one
half, so no pair is missed. Within a posting list the shared positional bytes are tallied per pair, pairs
that reach the minimum are verified bit by bit, and one tree of links per list goes on.

Distinct fingerprints alone are indexed. A posting list longer than `longest` would be quadratic, so it is
split by every 2 of the other 5 positions: two of its fingerprints that reach the minimum share 2 of them. A list
of one whole set of 5 positions that is still longer holds only pairs that have reached the minimum; what is left
is to verify them, in linear time: two fingerprints differ in at most 3 bits of the other 3 bytes if and only if
some 24-bit value lies within 1 bit of one and within 2 bits of the other. Such values are one more index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, forget, fresh_names, text_or_empty, written
from corpusmill.llm.components import connected
from corpusmill.llm.tokens import slices

#: 3 positions within a half.
KEYS = tuple(c for half in (range(4), range(4, 8)) for c in combinations(half, 3))
#: The sets of positions that a pair at the minimum shares.
FIVES = tuple(combinations(range(8), 5))
SEED = 42
NEAR = 3
MINIMUM = 8 - NEAR


def fingerprint(text: str, width: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the hashes of all shingles, repeats included; no word: 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    codes = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for k in range(0, n, 65_536):
        counts += np.unpackbits(codes[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def fingerprints(docs: DataFrame, width: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number; if `keyed`, also simhash_key, a hash of id and text."""
    keys = [row_key().alias("simhash_key")] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                marks = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(marks)], names=["doc_id", *part.schema.names[2:], "mark"])

    schema = "doc_id long, simhash_key long, mark long" if keyed else "doc_id long, mark long"
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *keys).mapInArrow(run, schema)


def key_column(k: int, positions: tuple[int, ...]) -> Column:
    mask = sum(0xFF << (8 * p) for p in positions)
    mask -= (mask >> 63) << 64
    return F.xxhash64(F.lit(k), F.col("mark").bitwiseAND(F.lit(mask)))


def posted(rows: DataFrame, keys: dict[int, tuple[int, ...]]) -> DataFrame:
    """A posting (k, key, mark) of each fingerprint for each of the sets of positions."""
    posts = F.array(*(F.struct(F.lit(k).alias("k"), key_column(k, positions).alias("key")) for k, positions in keys.items()))
    return rows.select(F.explode(posts).alias("post"), "mark").select("post.k", "post.key", "mark")


def short_and_long(posts: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Links within the lists of at most `longest` fingerprints, and the postings of the longer lists; both are written tables."""
    sizes = posts.groupBy("key").count().where("count > 1")
    short = written(sizes.where(F.col("count") <= longest).select("key"), "simhash-short")
    long = written(sizes.where(F.col("count") > longest).select("key"), "simhash-long")
    lists = posts.join(short, "key").groupBy("key").agg(F.collect_list("mark").alias("marks"))
    links = written(list_links(lists), "simhash-links")
    left = written(posts.join(long, "key"), "simhash-left")
    forget(short, long)
    return links, left


def forest(marks: np.ndarray, near: int = NEAR) -> tuple[list[int], list[int]]:
    """Links that join what the verified pairs of `marks` join: from each fingerprint not yet reached, a search over near ones."""
    left = np.arange(len(marks))
    codes = marks.view(np.uint8).reshape(-1, 8)
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            shared = (codes[left] == codes[i]).sum(axis=1)
            close = shared >= 8 - near
            close[close] = np.bitwise_count(marks[left[close]] ^ marks[i]) <= near
            found = left[close]
            a += [int(marks[i])] * len(found)
            b += marks[found].tolist()
            queue += found.tolist()
            left = left[~close]
    return a, b


def list_links(index: DataFrame, near: int = NEAR) -> DataFrame:
    """Links within posting lists (key, array of fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for marks in batch.column(0).to_pylist():
                x, y = forest(np.array(sorted(marks), np.int64).view(np.uint64), near)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return index.select("marks").mapInArrow(run, "a long, b long")


def balls(bits: list[int], radius: int) -> np.ndarray:
    flips = [0] + [1 << b for b in bits]
    if radius == 2:
        flips += [1 << b | 1 << c for b, c in combinations(bits, 2)]
    return np.array(flips, np.uint64)


def long_list_links(rows: DataFrame, part: int = 1024) -> DataFrame:
    """Links within lists that share a whole set of 5 positions, from rows (k, mark): `k` says which.

    Each fingerprint is posted to the values within 1 bit (near) and within 2 bits (far) of it, over the bits its
    list does not share. If a value has a near posting, all its postings are within 3 bits of that one.
    """
    tables = {k: [balls([8 * p + b for p in range(8) if p not in positions for b in range(8)], r) for r in (1, 2)] for k, positions in enumerate(FIVES)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, own in frame.groupby("k")["mark"]:
                one, two = tables[k]
                for at in range(0, len(own), part):
                    marks = own.to_numpy()[at : at + part]
                    values = (two[None, :] ^ marks.view(np.uint64)[:, None]).view(np.int64)
                    near = np.zeros(values.shape, bool)
                    near[:, : len(one)] = True
                    yield pd.DataFrame({"value": values.ravel(), "mark": np.repeat(marks, len(two)), "near": near.ravel()})

    around = rows.select("k", "mark").distinct().mapInPandas(run, "value long, mark long, near boolean").select("value", "mark", "near")
    centre = around.groupBy("value").agg(F.min(F.when(F.col("near"), F.col("mark"))).alias("head"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    centre = written(centre.where("head is not null and low < high").select("value", "head"), "simhash-centres")
    return around.join(centre, "value").where("mark != head").select(F.col("head").alias("a"), F.col("mark").alias("b")).distinct()


def near_links(marks: DataFrame, longest: int = 512) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `marks` (distinct, column `mark`) at 3 or fewer bits."""
    posts = written(posted(marks, dict(enumerate(KEYS))), "simhash-posts")
    links, left = short_and_long(posts, longest)
    forget(posts)
    if left.isEmpty():
        forget(left)
        return links
    split = [posted(left.where(F.col("k") == k), {n: five for n, five in enumerate(FIVES) if set(own) <= set(five)}) for k, own in enumerate(KEYS)]
    further = split[0]
    for more in split[1:]:
        further = further.unionByName(more)
    further = written(further.distinct(), "simhash-further")
    more, full = short_and_long(further, longest)
    every = links.unionByName(more)
    if not full.isEmpty():
        every = every.unionByName(long_list_links(full))
    out = written(every, "simhash-all-links")
    forget(left, further, links, more, full)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, longest: int = 512) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable), a row for each row of `docs`.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal fingerprints, repeated
    rows among them, share a component. A null id takes part; it is never the smallest unless all ids of its
    component are null. Texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    marked = written(fingerprints(docs, width), "simhash-marks")
    heads = written(marked.groupBy("mark").agg(F.min("doc_id").alias("first_id")), "simhash-heads")
    groups = written(connected(near_links(heads.select("mark"), longest), "a", "b"), "simhash-groups")
    joined = heads.join(groups.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    least = written(joined.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-least")
    of_mark = written(joined.join(least, "component").select("mark", "component_id"), "simhash-components")
    forget(heads, groups, least)
    return marked.join(of_mark, "mark").select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, longest: int = 512) -> DataFrame:
    """One row of each component, with all columns: that with the smallest id, then the smallest hash of id and text.

    A null id comes after all others, so a component whose ids are all null keeps a row too. Rows that share an id
    but not a component stand for themselves; of rows with one id and one text any one stays.
    """
    marked = written(fingerprints(docs, width, keyed=True), "simhash-marks")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "simhash_key")
    heads = written(marked.groupBy("mark").agg(F.min(row).alias("head")), "simhash-heads")
    groups = written(connected(near_links(heads.select("mark"), longest), "a", "b"), "simhash-groups")
    joined = heads.join(groups.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    best = joined.groupBy("component").agg(F.min("head").alias("head"))
    key, kept_id, kept_key = fresh_names(docs.columns, "simhash_key", "kept_id", "kept_key")
    kept = written(best.select(F.col("head.doc_id").alias(kept_id), F.col("head.simhash_key").alias(kept_key)), "simhash-kept")
    forget(marked, heads, groups)
    rows = docs.withColumn(key, row_key())
    same = (F.col(key) == F.col(kept_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
