"""Mixing sources to target weights by balanced sampling with the cube method.

Every document starts with an inclusion probability that gives its source the target. The flight phase
moves probabilities through the null space of two constraints, the number of words and the number of
documents, until they are 0 or 1. The largest undecided document goes first, and each move is the one that
is nearest to a move of that document alone, so all others make up for it, each a little. Thus both totals
stay as they are, and the smallest documents are left undecided. A document that outweighs all others
together can't move at a constant count; it is settled at a constant number of words. Flights run in blocks
of rows; what a block leaves undecided flies again with what other blocks of its source left, until a single
block holds the rest, and a landing step takes the nearest of all ways to decide its last twelve documents.
Documents that are large for a block are settled before the blocks, and all others of their source then make
up for them.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.llm.common import blocks_for, fresh_names, partitions, text_or_empty, word_count, written

NEAR = 1e-9
#: Documents that are left to the landing.
LANDED = 12
#: A document with more than this share of its block's words, on the average, is settled before the blocks.
LARGE = 1 / 16


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...], budget: float, most: float) -> dict[str | None, float]:
    """Shares `budget` times all sizes by weight; a target stops at `most` times its source's size, and what is above goes to the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets: dict[str | None, float] = {}
    open_names, left = list(names), budget * sum(sizes.values())
    while open_names:
        total = sum(weight[s] for s in open_names)
        share = {s: left * weight[s] / total for s in open_names}
        full = [s for s in open_names if share[s] > most * sizes[s]]
        if not full:
            targets |= share
            break
        for s in full:
            targets[s] = most * sizes[s]
            left -= targets[s]
        open_names = [s for s in open_names if s not in targets]
    return targets


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Moves `chances` to 0 or 1, but for two at most, and keeps their sum and their sum weighted by size."""
    out = list(chances)
    active: list[int] = []
    waiting = iter(range(len(out)))
    while True:
        active = [i for i in active if NEAR < out[i] < 1 - NEAR]
        for i in waiting:
            if NEAR < out[i] < 1 - NEAR:
                active.append(i)
                if len(active) == 3:
                    break
        if len(active) < 2:
            break
        a, b = sizes[active[0]], sizes[active[1]]
        if len(active) == 3:
            c = sizes[active[2]]
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif a == b:
            u = (1.0, -1.0)
        else:
            break
        step(out, active, u, rng)
    return out


def step(out: list[float], active: list[int], u: Iterable[float], rng: random.Random) -> None:
    """One move along `u`, forth or back until a chance is 0 or 1; the odds leave every expected value as it is."""
    pairs = [(i, d) for i, d in zip(active, u, strict=True) if d]
    forth = min((1 - out[i]) / d if d > 0 else out[i] / -d for i, d in pairs)
    back = min(out[i] / d if d > 0 else (1 - out[i]) / -d for i, d in pairs)
    move = forth if rng.random() * (forth + back) < back else -back
    for i, d in pairs:
        out[i] += move * d
        out[i] = 0.0 if out[i] < NEAR else 1.0 if out[i] > 1 - NEAR else out[i]


def flight_by_size(sizes: list[float], chances: list[float], rng: random.Random, leave: int = 2) -> list[float]:
    """Moves `chances` to 0 or 1, the largest sizes first, until `leave` at most are left; `sizes` descend.

    A move is the unit vector of the largest undecided document less its projection on the constraints. Its own share
    is 1 less its leverage. Where that is under half the mean share the count of documents is given up, and the words
    alone are kept. Documents without words, which make up for nothing, fly apart.
    """
    size, out = np.asarray(sizes, float), np.asarray(chances, float).copy()
    empty = np.flatnonzero(size == 0)
    out[empty] = flight([0.0] * len(empty), out[empty].tolist(), rng)
    open_ones = np.flatnonzero((out > NEAR) & (out < 1 - NEAR) & (size > 0))
    while len(open_ones) > leave:
        s, p = size[open_ones], out[open_ones]
        t = s - s.mean()
        squares = t @ t
        u = -t * (t[0] / squares) - 1 / len(s) if squares > 0 else np.full(len(s), -1 / len(s))
        u[0] += 1
        if u[0] < (len(s) - 2) / (2 * len(s)):
            rest, taken = s[1:] @ p[1:], (1 - p[0]) * s[0]
            free, given = s[1:] @ (1 - p[1:]), p[0] * s[0]
            if taken > rest or given > free:
                # The others can't make up for it both ways: it goes the way that they can follow, or follow nearest.
                p = p.copy()
                if taken - rest <= given - free:
                    p[0], p[1:] = 1.0, p[1:] * max(0.0, 1 - taken / rest)
                else:
                    p[0], p[1:] = 0.0, 1 - (1 - p[1:]) * max(0.0, 1 - given / free)
                u = None
            else:
                u = -s * (s[0] / (s @ s))
                u[0] += 1
        if u is not None:
            u[np.abs(u) < 1e-12] = 0
            moved, d = u != 0, u[u != 0]
            up, down = np.where(d > 0, 1 - p[moved], p[moved]) / np.abs(d), np.where(d > 0, p[moved], 1 - p[moved]) / np.abs(d)
            forth, back = up.min(), down.min()
            p = p + (forth if rng.random() * (forth + back) < back else -back) * u
        p[p < NEAR] = 0.0
        p[p > 1 - NEAR] = 1.0
        out[open_ones] = p
        open_ones = open_ones[(p > 0) & (p < 1)]
    return out.tolist()


def nearest_landing(sizes: list[float], chances: list[float], rng: random.Random, most: int = LANDED) -> list[float]:
    """Decides what a flight left, 12 documents with words or fewer: of all ways the one nearest in words, then in documents.

    A document without words goes by a coin.
    """
    size, out = np.asarray(sizes, float), np.asarray(chances, float).copy()
    undecided = (out > NEAR) & (out < 1 - NEAR)
    left = np.flatnonzero(undecided & (size > 0))
    if len(left) > most:
        raise ValueError(f"{len(left)} documents are left to land")
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words, count = np.abs(ways @ size[left] - size[left] @ out[left]), np.abs(ways.sum(axis=1) - out[left].sum())
        out[left] = ways[np.lexsort((count, words.round(6)))[0]]
    for k in np.flatnonzero(undecided & (size == 0)).tolist():
        out[k] = float(rng.random() < out[k])
    return out.tolist()


def fly_block(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Largest sizes first, so that the documents left undecided are the smallest."""
    pdf = pdf.sort_values(["size", "spread", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    if len(pdf):
        rng = random.Random(f"{seed} {int(pdf['source_no'].iloc[0])} {int(pdf['block'].iloc[0])}")
        sizes = pdf["size"].astype(float).tolist()
        chances = flight_by_size(sizes, pdf["chance"].tolist(), rng, LANDED if last else 2)
        pdf["chance"] = nearest_landing(sizes, chances, rng) if last else chances
    return pdf


def block_flight(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: fly_block(pdf, seed, last)


def balanced_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, block_rows: int = 1024, seed: int = 7) -> DataFrame:
    """How many words a mix takes of every document.

    Returns doc_id, source, size, source_size, target, copies and taken, a row for each row of `docs`
    (`taken` = `copies` x `size`; `copies` is the floor or the ceiling of target / source_size).
    Null texts have size 0, and so do empty ones: they are taken by the count constraint alone. A null source
    is a source of its own, last in order. A source without words has target 0. Repeated rows and null ids
    are documents like others, and rows alike in id, source and size are numbered, so that any number of them is
    dealt over blocks; an empty table gives no rows. Other columns are ignored. One row per source
    reaches the driver. Reruns agree: blocks and random numbers follow from ids, sizes and `seed` alone.
    """
    spark = docs.sparkSession
    sized = written(numbered_twins(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"))), "mix-sizes")
    found = [(r["source"], r["words"] or 0, r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()]
    targets = source_targets({s: w for s, w, _ in found}, weights, budget, most)
    rows, level_blocks = [], 1
    for no, (s, words, n) in enumerate(sorted(found, key=lambda r: (r[0] is None, r[0] or ""))):
        ratio = targets[s] / words if words else 0.0
        whole = min(int(most), math.floor(ratio + NEAR))
        blocks = blocks_for(n, block_rows)
        level_blocks = max(level_blocks, blocks)
        rows.append((s, no, words, float(targets[s]), whole, min(1.0, max(0.0, ratio - whole)), blocks))
    plan = spark.createDataFrame(rows, "mix_source string, source_no long, source_size long, target double, whole int, chance double, blocks long")
    spread = F.xxhash64("doc_id", "size", "twin")
    # A row per source, which the driver has made itself: counted above, and small beside the documents.
    state = (
        sized.join(plan, F.col("source").eqNullSafe(F.col("mix_source")))
        .drop("mix_source")
        .withColumn("spread", spread)
        .withColumn("block", F.pmod(F.col("spread"), F.col("blocks")))
    )
    schema = state.select("doc_id", "source", "size", "source_no", "source_size", "target", "whole", "chance", "spread", "block").schema
    large = (F.col("blocks") > 1) & (F.col("size") * F.col("blocks") > F.col("source_size") * LARGE)
    state, settled = settled_large(state, large, schema, block_rows, seed)
    level = 0
    while True:
        last = level > 0 and level_blocks == 1
        flown = written(state.groupBy("source_no", "block").applyInPandas(block_flight(seed * 1000 + level, last), schema), f"mix-flight-{level}")
        undecided = (F.col("chance") > NEAR) & (F.col("chance") < 1 - NEAR)
        if last:
            settled.append(flown)
            break
        settled.append(flown.where(~undecided))
        per = max(2, block_rows // 2)
        level_blocks = blocks_for(level_blocks, per)
        state = flown.where(undecided).withColumn("block", F.floor(F.col("block") / F.lit(per)).cast("long"))
        level += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("chance").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def settled_large(state: DataFrame, large: Column, schema: StructType, block_rows: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """`state` without large documents, with chances that make up for what these take; and a table of these, if there are any.

    A source has at most blocks / LARGE of them; they fly in blocks of their own.
    """
    spark = state.sparkSession
    per_source = state.where(large).groupBy("source_no", "source_size").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()
    if not per_source:
        return state.select(*schema.names), []
    blocks = spark.createDataFrame([(r["source_no"], blocks_for(r["n"], block_rows)) for r in per_source], "large_no long, large_blocks long")
    own = state.where(large).join(blocks, F.col("source_no") == F.col("large_no")).withColumn("block", -1 - F.pmod(F.col("spread"), F.col("large_blocks")))
    flown = written(own.select(*schema.names).groupBy("source_no", "block").applyInPandas(block_flight(seed * 1000 + 999, True), schema), "mix-large")
    taken = flown.join(state.where(large).groupBy("source_no").agg(F.max("chance").alias("first_chance")), "source_no")
    gaps = {r["source_no"]: r["gap"] for r in taken.groupBy("source_no").agg(F.sum(F.col("size") * (F.col("chance") - F.col("first_chance"))).alias("gap")).collect()}
    shifts = [(r["source_no"], float(gaps[r["source_no"]] / max(1, r["source_size"] - r["words"]))) for r in per_source]
    plan = spark.createDataFrame(shifts, "large_no long, shift double")
    rest = state.where(~large).join(plan, F.col("source_no") == F.col("large_no"), "left")
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("chance") - F.coalesce("shift", F.lit(0.0))))
    return rest.withColumn("chance", chance).select(*schema.names), [flown]


def numbered_twins(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """`rows` with `twin`, which numbers rows that are alike; made from their count, a chunk of numbers in one place at a time."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    # Chunks of hot rows go their own ways, whatever task the count was made in.
    dealt = chunks.repartition(partitions(rows.sparkSession), "chunk", *rows.columns)
    twin = F.explode(F.sequence(F.col("chunk") * chunk, F.least(F.col("n"), (F.col("chunk") + 1) * chunk) - 1))
    return dealt.select(*rows.columns, twin.alias("twin"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, as often as it takes them, with all their columns. Rows that agree in doc_id, source and size share their copies by rank.

    Both the join and the ranks are dealt by one hashed key, so texts are moved once.
    """
    mix = balanced_mix(docs, **options)
    size, key, copies, n_rows, share, copy, mix_id, mix_source, mix_size, mix_key = fresh_names(
        docs.columns, "own_size", "own_key", "mix_copies", "mix_rows", "mix_share", "mix_copy", "mix_id", "mix_source", "mix_size", "mix_key"
    )
    twins = mix.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(copies), F.count("*").alias(n_rows)).where(F.col(copies) > 0)
    twins = twins.withColumn(mix_key, F.xxhash64("doc_id", "source", "size")).withColumnsRenamed({"doc_id": mix_id, "source": mix_source, "size": mix_size})
    keyed = docs.withColumn(size, word_count(text_or_empty())).withColumn(key, F.xxhash64("doc_id", "source", size))
    # Within `coalesce` these are no join keys, so the hashed key alone deals the rows, for the ranks too.
    alike = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.col(a).isNull() & F.col(b).isNull())
    same = alike("doc_id", mix_id) & alike("source", mix_source) & alike(size, mix_size)
    taken = keyed.join(twins, F.col(key) == F.col(mix_key)).where(same)
    rank = F.row_number().over(Window.partitionBy(key, "doc_id", "source", size).orderBy(F.xxhash64("text")))
    own = F.floor(F.col(copies) / F.col(n_rows)) + (rank <= F.col(copies) % F.col(n_rows)).cast("long")
    shared = taken.withColumn(share, own.cast("int")).where(F.col(share) > 0)
    return shared.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(share))).alias(copy)).drop(copy)
