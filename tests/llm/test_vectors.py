from __future__ import annotations

import math

import numpy as np

from corpusmill.llm import ivfpq, multi_index
from corpusmill.llm.vectors import codebook, nearest_centres, units_of

EMB = "vec_id long, embedding array<float>, label int"


def cloud(n=900, width=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    for k in range(0, n // 3, 3):
        x[k + 1] = x[k] + 0.05 * rng.standard_normal(width)
    x[500:560] = x[500] + 0.03 * rng.standard_normal((60, width))
    x[700:720] = x[700]
    return [(i * 5, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]


ODD = [
    (100_001, None, 0),
    (100_002, [], 0),
    (100_003, [0.0] * 16, 0),
    (100_004, [1.0, None] + [0.0] * 14, 0),
    (100_005, [math.nan] + [1.0] * 15, 0),
    (100_006, [math.inf] + [1.0] * 15, 0),
    (100_007, [1.0, 2.0], 0),
    (100_008, [1.0, 2.0], None),
    (100_010, [3e38] * 16, 0),
    (100_050, [1e-38] * 16, 0),
]


def usable(rows):
    out = []
    for i, v, _ in rows:
        if v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            out.append((i, x / np.sqrt(x @ x)))
    return out


def brute_links(rows, threshold=0.95):
    own = usable(rows)
    count, label = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, (i, x) in enumerate(own):
        for j, y in own[:a]:
            if len(x) == len(y) and x @ y >= threshold:
                count[i] += 1
                count[j] += 1
                p, q = root(i), root(j)
                label[max(p, q)] = min(p, q)
    return {i: (count[i], root(i), root(i) == i) for i in label}


def test_links_against_all_pairs(spark):
    rows = cloud() + ODD
    for options in ({}, {"cell_rows": 4, "part_rows": 16}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(spark.createDataFrame(rows, EMB), **options).collect()}
        want = brute_links(rows)
        assert got.keys() == want.keys()
        assert all(got[i][0] <= want[i][0] for i in got)
        assert sum(n for n, *_ in got.values()) >= 0.97 * sum(n for n, *_ in want.values())
        assert sum(got[i] == want[i] for i in got) >= 0.97 * len(want)
        assert all(got[i] == (0, i, True) for i in range(100_001, 100_007))


def test_multi_sequence_visits_in_ascending_order():
    rng = np.random.default_rng(4)
    a, b = rng.random(9), rng.random(7)
    cells = list(multi_index.multi_sequence(a, b, 10.0))
    sums = [a[i] + b[j] for i, j in cells]
    assert len(cells) == len(set(cells)) == 63 and sums == sorted(sums)
    few = list(multi_index.multi_sequence(a, b, 0.3))
    assert few == cells[: len(few)] and sums[len(few) - 1] <= sums[0] + 0.3 < sums[len(few)]


def test_trees_join_what_pairs_join():
    rng = np.random.default_rng(5)
    for _ in range(30):
        near = rng.random((12, 15)) < 0.12
        a, b = multi_index.tree(near)
        assert near[a, b].all() if len(a) else not near.any()

        def parts(pairs):
            label = list(range(27))
            for i, j in pairs:
                x, y = label[i], label[12 + j]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        assert parts(zip(*np.nonzero(near))) == parts(zip(a.tolist(), b.tolist()))


def test_codebooks_take_few_or_equal_rows():
    assert len(codebook(np.ones((5, 3)), 4)) == 1
    assert len(codebook(np.eye(3), 8)) == 3


def test_two_level_codebooks_are_nearly_as_good():
    x = np.random.default_rng(3).standard_normal((4000, 8))
    flat, tree = codebook(x, 200), codebook(x, 200, direct=100)
    assert 150 <= len(tree) <= 250
    assert nearest_centres(x, tree)[1].mean() < 1.15 * nearest_centres(x, flat)[1].mean()


def test_links_at_the_threshold_are_those_of_the_vectors_themselves():
    rng = np.random.default_rng(8)
    a = rng.integers(-9, 10, (300, 4)).astype(float)
    a = a[(a != 0).any(1)]
    for threshold in (0.6, 0.8, 0.95):
        want = [[float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())) >= threshold for y in a] for x in a]
        assert multi_index.linked(a, a, threshold).tolist() == want


def test_only_rows_near_by_their_codes_are_ranked_exactly():
    x = units_of(np.random.default_rng(2).standard_normal((3000, 16)))
    index = ivfpq.fit_index(x, 20, 8)
    lists = index.nearest_list(x)
    one = int(np.bincount(lists).argmax())
    ids = np.flatnonzero(lists == one)
    codes = index.codes(x[ids], lists[ids])
    distance = index.approximate(x[ids[:1]], one, codes)[0]
    limit = np.sort(distance)[[9]]
    own = [[int(i)] for i in ids]
    found = ivfpq.best_of_chunk(index, one, [-1], x[ids[:1]], limit, own, x[ids], codes, 5)
    assert found[0][1] == ids[0] and {v for _, v, _ in found} <= set(ids[distance <= limit].tolist())
    codes[0] = codes[distance.argmax()]  # with another row's codes the row itself is not looked at
    assert ids[0] not in [v for _, v, _ in ivfpq.best_of_chunk(index, one, [-1], x[ids[:1]], limit, own, x[ids], codes, 5)]


def test_distances_are_those_of_each_list():
    rng = np.random.default_rng(3)
    x = units_of(rng.standard_normal((600, 12)))
    index = ivfpq.fit_index(x, 9, 4)
    lists = index.nearest_list(x)
    codes = index.codes(x, lists)
    index.probes = 3
    visited = index.list_ranks(x[:7]) < 3
    assert (visited.sum(1) == 3).all() and all(visited[q, lists[q]] for q in range(7))
    got = index.distances(x[:7], lists, codes, visited)
    rebuilt = index.coarse[lists] + np.concatenate([b[codes[:, n]] for n, b in enumerate(index.books)], axis=1)
    want = ((x[:7, None, :] - rebuilt[None]) ** 2).sum(2)
    assert np.allclose(got[visited[:, lists]], want[visited[:, lists]]) and np.isinf(got[~visited[:, lists]]).all()


def test_probes_and_depth_are_measured_on_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 8))
    vectors = spark.createDataFrame([(i, row.astype("<f8").tobytes()) for i, row in enumerate(x)], "vec_id long, vector binary")
    distinct = ivfpq.distinct_vectors(vectors, 5)
    units = units_of(x)
    index = ivfpq.fit_index(units[:2000], 30, 4)
    rows = ivfpq.indexed(distinct, index).cache()
    asked = units[1500:1560]
    index = ivfpq.measured(index, rows, rows.select("list", "codes").distinct(), asked, 0.9, 5)
    lists = index.nearest_list(units)
    codes = index.codes(units, lists)
    ranks = index.list_ranks(asked)
    score = asked @ units.T
    score[score > 1 - 1e-12] = -2
    near = np.argsort(-score, axis=1)[:, :5]
    assert index.probes == int(np.quantile(np.take_along_axis(ranks, lists[near], 1), 0.9, method="higher")) + 1
    distance = index.distances(asked, lists, codes, ranks < index.probes)
    kinds = [np.unique(d[np.isfinite(d)].round(12)) for d in distance]
    passed = [int((kinds[q] < distance[q, v] - 1e-9).sum()) for q in range(60) for v in near[q] if np.isfinite(distance[q, v])]
    assert abs(index.depth - 5 - int(np.quantile(passed, 0.9, method="higher"))) <= 2
    assert index.depth < 200


def test_different_vectors_with_one_id(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [1.0, 0.1], 0), (2, [0.1, 1.0], 0), (2, [1.0, 0.0], 0)]
    want = None
    for parts in (1, 3, 5):
        got = sorted(tuple(r) for r in ivfpq.nearest(spark.createDataFrame(rows, EMB).repartition(parts)).collect())
        assert [(r[0], r[2]) for r in got] in ([(0, 1), (0, 2)], [(0, 2), (0, 1)]) and (want is None or got == want)
        want = got


def test_vectors_without_ids_or_rows(spark):
    same = [(None, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (6, [-1.0, 0.0], 0)]
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id or -1) for r in multi_index.near_vectors(spark.createDataFrame(same, EMB)).collect())
    assert got == [(-1, 0, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4), (6, 0, 6)]
    assert multi_index.near_vectors(spark.createDataFrame([], EMB)).count() == 0
    assert multi_index.near_vectors(spark.createDataFrame(ODD[:4], EMB)).count() == 4
    assert ivfpq.nearest(spark.createDataFrame([], EMB)).count() == 0
    assert ivfpq.nearest(spark.createDataFrame(ODD[:6], EMB)).count() == 0


def test_nearest_against_all_rows(spark):
    rows = cloud(1500, seed=2) + ODD
    for options in ({}, {"chunk_rows": 64, "query_rows": 8}):
        got = ivfpq.nearest(spark.createDataFrame(rows, EMB), modulus=50, k=5, **options).collect()
        own = usable(rows)
        by, hits, asked = {}, 0, 0
        for r in got:
            by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for i, x in own:
            if i % 50:
                continue
            score = sorted((-float(x @ y), j) for j, y in own if j != i and len(y) == len(x))
            have = sorted(by.get(i, []))
            assert [r for r, *_ in have] == list(range(1, min(5, len(score)) + 1))
            exact = {j: -s for s, j in score}
            assert all(abs(exact[j] - s) < 1e-12 for _, j, s in have)
            assert [(-s, j) for _, j, s in have] == sorted((-s, j) for _, j, s in have)
            hits += len({j for _, j, _ in have} & {j for _, j in score[:5]})
            asked += min(5, len(score))
        assert set(by) == {i for i, _ in own if i % 50 == 0}
        assert hits >= 0.9 * asked


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.5, 0.0, 0.0], 0) for i in range(200)] + [(300, [0.0, 1.0, 0.0, 0.0], 0)]
    got = ivfpq.nearest(spark.createDataFrame(rows, EMB), modulus=50, chunk_rows=32).collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 150)} == {0: [1, 2, 3, 4, 5], 150: [0, 1, 2, 3, 4]}


def test_many_equal_vectors_do_not_set_the_probes(spark):
    rng = np.random.default_rng(9)
    x = [[float(np.float32(v)) for v in row] for row in rng.standard_normal((1600, 8))]
    seen, fit, measure = [], ivfpq.fit_index, ivfpq.measured

    def watched(sample, *rest, **more):
        seen.append(sample)
        return fit(sample, *rest, **more)

    found = []
    ivfpq.fit_index = watched
    ivfpq.measured = lambda *a: found.append(measure(*a)) or found[-1]
    try:
        for k in (0, 1):  # whichever hash the repeated vector has
            rows = [(i, v, 0) for i, v in enumerate(x)] + [(10_000 + i, x[k], 0) for i in range(800)]
            ivfpq.nearest(spark.createDataFrame(rows, EMB), modulus=400)
    finally:
        ivfpq.fit_index, ivfpq.measured = fit, measure
    for sample, index in zip(seen, found, strict=True):
        assert len(np.unique(sample, axis=0)) == len(sample) == 1600
        assert index.probes > 1
    assert not (seen[0] == np.array(sorted(seen[0].tolist()))).all()
