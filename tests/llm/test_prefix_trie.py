from __future__ import annotations

import hashlib
import random
import zlib

import duckdb

from corpusmill.llm import prefix_trie
from tests.llm.helpers import frame

SCHEMA = "conv_id long, turn int, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c > 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        below = kids.get(seq, [])
        leaves[seq] = sum(leaves[k] for k in below) or 1
        saved[seq] = sum(saved[k] for k in below) + ((len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0)
    out = set()
    for seq, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if built[c] == seq))
        parent = min(members[seq[:-1]]) if seq else None
        out.add((min(ids), len(seq), parent, len(ids), len(kids.get(seq, [])), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def made(spark, rows, parts=5):
    got = prefix_trie.conversation_trie(frame(spark, rows, SCHEMA).repartition(parts))
    assert dict(got.dtypes) == {c: "bigint" for c in got.columns[:-1]} | {"ends_sha256": "string"}
    out = [tuple(r) for r in got.collect()]
    assert len(set(out)) == len(out)
    return set(out)


def conversations(seed, n, turns=9, texts=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]) if t > 2 else "user", f"é{rng.randrange(texts)}") for c in range(n) for t in range(rng.randrange(1, turns))]


def test_against_plain_trie(spark):
    for seed in range(3):
        rows = conversations(seed, 90)
        assert made(spark, rows) == plain(rows)


def test_sql_agrees(spark, tmp_path):
    rows = conversations(11, 40) + [(-3, 1, "user", "é1"), (2**40, None, None, "x"), (41, 3, "user", None)]
    frame(spark, rows, SCHEMA).write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from read_parquet('{tmp_path}/c/*.parquet')")
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert set(duck.sql(f"select {names} from ({prefix_trie.oracle()})").fetchall()) == plain(rows)


def test_odd_rows(spark):
    rows = conversations(7, 30)
    rows += [(None, 1, "user", "lost"), (31, None, "user", "first"), (31, 0, None, None), (31, 0, "a", None), (31, 0, "a", "x"), (31, 0, "a", "x"), (-3, 1, "user", "é1"), (-5, 1, "u", "b"), (-5, 2, "u", "c"), (2**40, 0, "user", "é0")]
    rows += [(50, t, "user", "same") for t in range(40)] + [(c, t, "user", "same") for c in (55, 60, 65) for t in range(40)]
    assert made(spark, rows) == plain(rows)
    assert made(spark, []) == set()
    assert made(spark, [(4, 1, "a", "alone")]) == plain([(4, 1, "a", "alone")])
    assert made(spark, [(None, 1, "a", "alone")]) == set()


def test_one_conversation_over_many_ranges_and_many_copies(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(3000)] + [(c, t, "user", "hello " * 3) for c in range(10, 2500, 5) for t in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert made(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_extra_columns_with_the_operators_own_names(spark):
    rows = conversations(9, 25)
    more = "place int, depth int, node int, n_turns int, turn_key int, parent int"
    docs = frame(spark, [(*r, 1, 2, 3, 4, 5, 6) for r in rows], f"{SCHEMA}, {more}")
    assert {tuple(r) for r in prefix_trie.conversation_trie(docs).collect()} == plain(rows)


def test_plain_trie_of_turns_as_they_are(spark):
    """The operator takes any table of turns, without the query's rebuilding."""
    turns = frame(spark, [(1, 1, b"a", 3), (1, 2, b"b", 5), (2, 1, b"a", 3), (2, 2, b"c", 7), (3, 1, b"a", 3)], "conv_id long, depth long, turn_key binary, bytes long")
    convs = frame(spark, [(1, 2), (2, 2), (3, 1)], "conv_id long, n_turns long")
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in prefix_trie.prefix_trie(turns, convs).collect()}
    assert got == {(1, 0): (3, 1, 2, 6), (1, 1): (3, 2, 2, 6), (1, 2): (1, 0, 1, 0), (2, 2): (1, 0, 1, 0)}
