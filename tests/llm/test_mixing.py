from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from corpusmill.llm import mixing
from tests.llm.helpers import doc, frame, odd_docs, words


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Water filling by bisection on the common level."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        if sum(min(most * sizes[s], mid * w[s]) for s in names) < budget * sum(sizes.values()):
            low = mid
        else:
            high = mid
    return {s: min(most * sizes[s], high * w[s]) for s in names}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50}, {"z": 5, None: 70, "é": 900, "A": 3}, {"a": 0, "b": 10}, {"a": 7}])
def test_targets_are_water_filled(sizes):
    got, want = mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0), brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in sizes:
        assert got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6)


def test_flight_keeps_both_totals_and_leaves_two():
    rng = random.Random(1)
    sizes = [float(rng.randrange(1, 500)) for _ in range(300)]
    chances = [rng.random() for _ in sizes]
    out = mixing.flight(sizes, chances, random.Random(2))
    assert sum(out) == pytest.approx(sum(chances), abs=1e-6)
    assert sum(s * p for s, p in zip(sizes, out)) == pytest.approx(sum(s * p for s, p in zip(sizes, chances)), rel=1e-9)
    assert sum(1e-9 < p < 1 - 1e-9 for p in out) <= 2
    assert all(p in (0.0, 1.0) for p in mixing.nearest_landing(sizes, out, random.Random(3)))


def plain_flight(sizes, chances, rng):
    """The flight with null vectors from linear algebra: a move along one keeps both constraints, forth or back to the next wall."""
    out = np.array(chances, float)
    while True:
        active = [i for i in range(len(out)) if 1e-9 < out[i] < 1 - 1e-9][:3]
        rows = np.array([[1.0] * len(active), [sizes[i] for i in active]])
        if len(active) < 2 or np.linalg.matrix_rank(rows) == len(active):
            return out
        a, b = sizes[active[0]], sizes[active[1]]
        if len(active) == 3 and not (a == b == sizes[active[2]]):
            u = np.linalg.svd(rows)[2][-1]
            c = sizes[active[2]]
            u = u * np.sign(u[np.abs(u).argmax()]) * np.sign(np.array([b - c, c - a, a - b])[np.abs(u).argmax()])
        else:
            u = np.array([1.0, -1.0, 0.0])[: len(active)]
        walls = lambda d: min(((1 - out[i]) / x if x > 0 else out[i] / -x) for i, x in zip(active, d) if abs(x) > 1e-12)
        forth, back = walls(u), walls(-u)
        out[active] += u * (forth if rng.random() * (forth + back) < back else -back)
        out[np.abs(out) < 1e-9] = 0.0
        out[np.abs(1 - out) < 1e-9] = 1.0


def test_flight_against_null_vectors_of_linear_algebra():
    for seed in range(20):
        rng = random.Random(seed)
        sizes = [float(rng.choice([3, 3, 7, 20, rng.randrange(1, 99)])) for _ in range(40)]
        chances = [rng.choice([0.25, 0.5, rng.random()]) for _ in sizes]
        assert mixing.flight(sizes, chances, random.Random(seed)) == pytest.approx(plain_flight(sizes, chances, random.Random(seed)), abs=1e-6)


@pytest.mark.parametrize("fly", [mixing.flight, lambda *a: mixing.flight_by_size(*a, leave=12)])
def test_each_document_is_taken_with_its_chance(fly):
    rng = random.Random(11)
    sizes, chances = sorted((float(rng.randrange(5, 30)) for _ in range(30)), reverse=True), [rng.uniform(0.2, 0.8) for _ in range(30)]
    total, n = np.zeros(30), 4000
    for seed in range(n):
        total += fly(sizes, chances, random.Random(seed))
    assert np.abs(total / n - chances).max() < 5 * 0.5 / n**0.5


def test_the_smallest_are_left_and_both_totals_kept():
    for seed in range(20):
        rng = random.Random(seed)
        sizes = sorted((float(rng.randrange(1, 300)) for _ in range(rng.randrange(3, 200))), reverse=True)
        chances = [rng.random() for _ in sizes]
        out = mixing.flight_by_size(sizes, chances, random.Random(seed))
        left = [i for i, p in enumerate(out) if 0 < p < 1]
        assert len(left) <= 2
        gap = abs(sum(s * p for s, p in zip(sizes, out)) - sum(s * p for s, p in zip(sizes, chances)))
        assert gap <= sizes[-min(5, len(sizes))]
        if len(sizes) > 50:
            assert abs(sum(out) - sum(chances)) < 2 and min(left, default=len(sizes)) > len(sizes) // 2


def test_one_document_with_a_fifth_of_its_source():
    for seed in range(100):
        rng = random.Random(seed)
        sizes = sorted((float(rng.randrange(5, 64)) for _ in range(150)), reverse=True)
        sizes = [sum(sizes) / 4, *sizes]
        chances = [0.37] * len(sizes)
        out = mixing.nearest_landing(sizes, mixing.flight_by_size(sizes, chances, rng, 12), rng)
        assert abs(sum(s * p for s, p in zip(sizes, out)) - 0.37 * sum(sizes)) <= 1


def test_landing_is_the_nearest_of_all_ways():
    rng = random.Random(8)
    for _ in range(30):
        sizes = [float(rng.randrange(1, 40)) for _ in range(7)]
        chances = [rng.choice([0.0, 1.0, rng.random()]) for _ in sizes]
        want = sum(s * p for s, p in zip(sizes, chances))
        out = mixing.nearest_landing(sizes, chances, rng)
        ways = itertools.product(*[(p,) if p in (0.0, 1.0) else (0.0, 1.0) for p in chances])
        assert abs(sum(s * p for s, p in zip(sizes, out)) - want) == pytest.approx(min(abs(sum(s * p for s, p in zip(sizes, w)) - want) for w in ways))


def test_mix_meets_targets(spark):
    rows = [doc(i, words(5 + i % 60, i), f"s{i % 5}" if i % 3 else "s0") for i in range(1500)]
    got = mixing.balanced_mix(frame(spark, rows), block_rows=64).toPandas()
    assert len(got) == len(rows)
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"] == 0).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), source_size=("source_size", "first"), size=("size", "sum"))
    assert (by.source_size == by["size"]).all()
    assert ((by.taken - by.target).abs() <= 70).all()
    again = mixing.balanced_mix(frame(spark, rows).repartition(7), block_rows=64).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()


def test_mix_meets_targets_with_sizes_of_any_kind(spark):
    rng = random.Random(4)
    rows = [doc(i, "w " * int(rng.paretovariate(0.9) * 4 if i % 7 else rng.randrange(3)), f"s{i % 4}") for i in range(1200)]
    rows += [doc(5000, "w " * 9000, "s1"), doc(5001, "w " * 30000, "big"), *(doc(6000 + i, "w " * (20 + i % 30), "big") for i in range(3000))]
    for size in (64, 1024):
        got = mixing.balanced_mix(frame(spark, rows), block_rows=size).toPandas()
        for _, own in got.groupby("source"):
            assert abs(own.taken.sum() - own.target.iloc[0]) <= max(1, own["size"].median())


def test_rows_alike_are_numbered(spark):
    rows = [(1, "a", 3)] * 10 + [(None, None, 0)] * 25 + [(2, "a", 3)]
    alone = mixing.numbered_twins(frame(spark, rows, "doc_id long, source string, size long"), chunk=4)
    assert sorted(r.twin for r in alone.where("doc_id = 1").collect()) == list(range(10))
    assert sorted(r.twin for r in alone.where("doc_id is null").collect()) == list(range(25))
    assert [r.twin for r in alone.where("doc_id = 2").collect()] == [0]


def test_odd_rows(spark):
    rows = odd_docs()
    got = mixing.balanced_mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.balanced_mix(frame(spark, [])).count() == 0


def test_documents_come_as_often_as_taken(spark):
    rows = odd_docs() + [doc(100 + i, words(10 + i, i), "b") for i in range(60)]
    docs = frame(spark, [(*r, 1, 2, 777, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, copies int, own_size int, mix_id int, mix_key int, own_key int")
    mix = mixing.balanced_mix(docs)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r.own_size for r in out.collect()} == {777}
    assert out.count() == mix.agg({"copies": "sum"}).first()[0]
