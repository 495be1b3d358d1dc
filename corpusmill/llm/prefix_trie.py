"""Prefix trie of conversations, built level by level.

At each depth the conversations that still share their node are grouped by (parent node, next turn); a group is a
node and is called by its smallest conversation, which no other node of that depth has. A conversation alone in its
node leaves the loop: all its further nodes are its own, a row for each of its turns. So there are as many levels as
the longest prefix that two conversations share. Then leaves and savings are rolled up from the deepest level to the
root, each level joined with the sums of the one below.

Groups are pre-aggregated where rows lie. Nodes that hold a 256th of a level's conversations or more, 256 at most, are
joined back by broadcast, so a first turn that everyone has is no group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, delete, forget, new_path, partitions, written

#: Nodes with this share of a level's conversations are joined by broadcast; there are no more of them than this.
HOT_NODES = 256
LEVEL = "parent long, node long, n_convs long, bytes long, n_turns long"
NODE = "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_turns long"


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def in_order(rows: DataFrame) -> DataFrame:
    """Turns of conversations with `place`, from 0, in the order of turn (null first), role and text; null role or text becomes empty.

    Rows are dealt by ranges of that order, so one conversation may hold any share of them; a range counts on from
    those before it. Rows without conv_id belong to no conversation and are left out.
    """
    spark = rows.sparkSession
    plain = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    #: Beginnings of role and text are in the order of the whole ones, and short enough for limits of ranges.
    limits = ("conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 64))
    dealt = plain.repartitionByRange(partitions(spark), *limits).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    keyed = dealt.select("conv_id", turn_key().alias("turn_key"), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            new = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            place = np.arange(len(ids)) - np.maximum(starts, 0) + np.where(starts < 0, count, 0)
            last, count = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])

    counted = written(bounded_batches(keyed).mapInArrow(run, "conv_id long, turn_key binary, bytes long, part long, place long"), "trie-turns")
    ends = counted.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("n"))
    # Only a range's first and last conversation can lie in other ranges also: two rows a range at most.
    torn = ends.groupBy("conv_id").agg(F.count("*").alias("parts"), F.collect_list(F.struct("part", "n")).alias("ends")).where("parts > 1").select("conv_id", "ends")
    before = F.aggregate(F.filter("ends", lambda e: e["part"] < F.col("part")), long(0), lambda s, e: s + e["n"])
    return counted.join(F.broadcast(torn), "conv_id", "left").select("conv_id", (F.col("place") + F.coalesce(before, long(0))).alias("place"), "turn_key", "bytes")


def turn_key() -> Column:
    """A turn's digest: two turns have the same one if role and text are the same."""
    return F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256))


def rebuilt(turns: DataFrame, group: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one, as a table of turns with `depth` from 1, and a table of conversations.

    `turns` is that of `in_order`. Conversation c begins with the first h turns of c - c % group (all, if it has fewer;
    none, if it is absent) and goes on with its own turns after its first h; h is crc32 of c in decimal, modulo `modulus`.
    The second table has a row per conversation, with n_turns; some may have none.
    """
    lengths = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-lengths")
    convs = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("donor"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).alias("h"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("donor"), F.col("own").alias("given")), "donor", "left")
    convs = written(convs.select("conv_id", "donor", "h", "own", F.least("h", F.coalesce("given", long(0))).alias("head")), "trie-convs")
    heads = turns.where(F.col("place") < modulus - 1).withColumnRenamed("conv_id", "donor").join(convs.select("conv_id", "donor", "head"), "donor").where("place < head")
    tails = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("place >= h")
    whole = heads.select("conv_id", (F.col("place") + 1).alias("depth"), "turn_key", "bytes").unionByName(
        tails.select("conv_id", (F.col("head") + F.col("place") - F.col("h") + 1).alias("depth"), "turn_key", "bytes")
    )
    out = convs.select("conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), long(0))).alias("n_turns"))
    return whole, out


def joined_back(members: DataFrame, nodes: DataFrame, n_members: int) -> DataFrame:
    """`members` with the columns of their node among `nodes`, both by (parent, turn_key); no node is a hot key of the join."""
    hot = F.col("n_convs") * HOT_NODES >= n_members
    by = ["parent", "turn_key"]
    large, small = nodes.where(hot), nodes.where(~hot)
    # The sum of n_convs is n_members at most, so `large` has HOT_NODES rows at most.
    rest = members.join(F.broadcast(large), by, "left_anti")
    return members.join(F.broadcast(large), by).unionByName(rest.join(small, by))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of the trie of conversations.

    `turns` has a row per turn: conv_id, depth (from 1, without gaps), turn_key and bytes; `convs` a row per
    conversation: conv_id and n_turns, 0 among them. Returns, per distinct sequence of first turns: conv_id (smallest
    member), depth, parent_conv_id (null at the root, which has depth 0), n_convs, n_children, n_leaves (of its
    subtree), saved_tokens (bytes that its subtree's nodes spare by being stored once), ends_sha256 (digest of the
    members that end there). Without conversations there are no rows.
    """
    spark = turns.sparkSession
    turns = written(turns.join(convs, "conv_id").repartitionByRange(partitions(spark), "depth", "conv_id").sortWithinPartitions("depth"), "trie-rebuilt")
    levels, lives, nodes = (new_path(spark, f"trie-{name}") for name in ("levels", "live", "nodes"))

    def kept(df: DataFrame, path: str, depth: int) -> DataFrame:
        df.write.parquet(f"{path}/depth={depth}")
        return spark.read.schema(df.schema).parquet(f"{path}/depth={depth}")

    top = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("n_turns").alias("n_turns")).where("n_convs > 0")
    level = kept(top.select(F.lit(None).cast("long").alias("parent"), "node", "n_convs", long(0).alias("bytes"), "n_turns"), levels, 0)
    root = level.where("n_convs > 1").first()
    live = kept(convs.where(F.lit(root is not None)).select("conv_id", "n_turns", long(root["node"] if root else 0).alias("node")), lives, 0)
    depth = 0
    while not live.isEmpty():
        depth += 1
        here = turns.where(F.col("depth") == depth).select("conv_id", "n_turns", "turn_key", "bytes")
        here = written(here.join(live.select("conv_id", F.col("node").alias("parent")), "conv_id"), "trie-members")
        found = here.groupBy("parent", "turn_key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("n_turns").alias("n_turns"))
        level = kept(found, levels, depth)
        shared = level.where("n_convs > 1").select("parent", "turn_key", "n_convs", "node")
        n_live = shared.agg(F.coalesce(F.sum("n_convs"), long(0))).first()[0]
        live = kept(joined_back(here, shared, n_live).select("conv_id", "n_turns", "node"), lives, depth)
        forget(here)
    below = None
    for d in range(depth, -1, -1):
        below = kept(rolled_up(spark.read.schema(LEVEL).parquet(f"{levels}/depth={d}"), below, d), nodes, d)
    made = spark.read.schema(f"{NODE}, depth long").parquet(nodes)
    ends = written(digests_of_ends(spark.read.schema("conv_id long, n_turns long, node long, depth long").parquet(lives)), "trie-ends")
    delete(spark, lives)
    delete(spark, levels)
    own = F.when((F.col("n_convs") == 1) & (F.col("n_turns") == F.col("depth")), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    every = made.unionByName(nodes_alone(made, turns)).withColumn("own_end", own).join(ends, ["depth", "conv_id"], "left")
    digest = F.coalesce("own_end", "ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def rolled_up(level: DataFrame, below: DataFrame | None, depth: int) -> DataFrame:
    """Nodes of a level with the sums of their children, which are nodes of the level below; a sole member's further nodes are not in it."""
    if below is None:
        kids = level.limit(0).select(F.col("node").alias("of"), *(long(0).alias(c) for c in ("kids", "leaves", "saved")))
    else:
        kids = below.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return level.join(kids, F.col("node") == F.col("of"), "left").select(
        F.col("node").alias("conv_id"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("n_convs") == 1, (F.col("n_turns") > depth).cast("long")).otherwise(F.coalesce("kids", long(0))).alias("n_children"),
        F.coalesce("leaves", long(1)).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", long(0))).alias("saved_tokens"),
        "n_turns",
    )


def nodes_alone(made: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes below those with a sole member: one for each further turn."""
    since = made.where("n_convs = 1 and n_turns > depth").select("conv_id", F.col("depth").alias("since"))
    rest = turns.join(since, "conv_id").where("depth > since")
    return rest.select(
        "conv_id",
        F.col("conv_id").alias("parent_conv_id"),
        long(1).alias("n_convs"),
        (F.col("n_turns") > F.col("depth")).cast("long").alias("n_children"),
        long(1).alias("n_leaves"),
        long(0).alias("saved_tokens"),
        "n_turns",
        "depth",
    )


def digests_of_ends(lives: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256): per node, the SHA-256 of its members that end there, in decimal, ascending and comma-joined.

    A digest needs its ids in order, but not a row each: ranges of (node, id) are first joined to strings of up to a
    batch's rows, wherever they lie, and only those strings are brought together.
    """
    n = partitions(lives.sparkSession)
    ended = lives.where("n_turns = depth").select("depth", "node", "conv_id")
    dealt = ended.repartitionByRange(n, "depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, node, ids = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero((depth[1:] != depth[:-1]) | (node[1:] != node[:-1])) + 1).tolist(), len(ids)]
            joined = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            first = cuts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(depth[first]), pa.array(node[first]), pa.array(ids[first]), pa.array(joined, pa.string())], names=["depth", "node", "first", "ids"])

    parts = bounded_batches(dealt).mapInArrow(strings, "depth long, node long, first long, ids string")
    gathered = parts.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "first")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "conv_id", "ends_sha256"])

        for batch in batches:
            rows = []
            for depth, node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, node) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (depth, node), hashlib.sha256()
                state.update(ids.encode())
            yield made(rows)
        if key is not None:
            yield made([(*key, state.hexdigest())])

    return gathered.mapInArrow(hashed, "depth long, conv_id long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (see `rebuilt`).

    Rows without conv_id are left out; a null turn comes first; equal turns of one conversation come by role and text,
    and repeated rows are turns like others; null role or text becomes empty; texts count whole; an empty table gives
    no rows; other columns are ignored.
    """
    return prefix_trie(*rebuilt(in_order(conversations)))


def oracle() -> str:
    """DuckDB SQL. crc32 is spelled out, bit by bit; sequences are compared by digests of digests."""
    crc = "(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    return f"""
    WITH own AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, xor({crc}, 4294967295) % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)),
    sized AS (SELECT c.*, least(c.h, coalesce(g.n, 0)) AS head FROM convs c LEFT JOIN convs g ON g.conv_id = c.donor),
    built AS (
      SELECT s.conv_id, o.place + 1 AS depth, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.donor WHERE o.place < s.head
      UNION ALL
      SELECT s.conv_id, s.head + o.place - s.h + 1, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.conv_id WHERE o.place >= s.h),
    keyed AS (
      SELECT conv_id, depth, strlen(text) AS bytes,
        sha256(string_agg(sha256(length(role)::VARCHAR || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key
      FROM built UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    placed AS (SELECT conv_id, depth, bytes, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS n_turns FROM keyed),
    nodes AS (
      SELECT node, depth, count(*) AS n_convs, max(bytes) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256
      FROM placed GROUP BY node, depth),
    linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN placed p ON p.conv_id = n.node AND p.depth = n.depth - 1),
    kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM linked GROUP BY parent, depth),
    full_nodes AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.parent = l.node AND k.depth = l.depth),
    sums AS (
      SELECT a.node, a.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
      FROM full_nodes f JOIN placed a ON a.conv_id = f.node AND a.depth <= f.depth GROUP BY a.node, a.depth)
    SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
    FROM full_nodes f JOIN sums s ON s.node = f.node AND s.depth = f.depth
    """
