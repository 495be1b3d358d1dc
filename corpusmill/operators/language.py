"""Measures of language over a whole corpus: BLEU, and perplexity by an interpolated Kneser-Ney model."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import bounded_batches

#: Words hold no blanks, so these stand for nothing else.
START, END = " (", " )"


def words(text: Column) -> Column:
    """Lower-cased words (A-Z alone are changed) between blanks, as an array; none of a null or blank text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def grams(tokens: Column, n: int) -> Column:
    """All runs of `n` tokens, joined by spaces, as an array."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def bleu(rows: DataFrame, reference: str, generated: str, key: str, group: str | None = None, most_n: int = 4) -> DataFrame:
    """Corpus BLEU per group (or one row): pairs, generated_words, reference_words, precision_1 to precision_n, brevity, bleu.

    Matches of n-grams are clipped pair by pair and pooled over the group before any ratio is taken. `key` tells pairs
    apart; those with a null reference or text have no words there. A group without matches of some order scores 0.
    """
    groups = ["own_group"] if group else []
    pairs = rows.select(*([F.col(group).alias("own_group")] if group else []), F.col(key).alias("pair"), words(F.col(reference)).alias("r"), words(F.col(generated)).alias("g"))
    sizes = pairs.groupBy(*groups).agg(F.count("*").alias("pairs"), F.sum(F.size("g")).cast("long").alias("generated_words"), F.sum(F.size("r")).cast("long").alias("reference_words"))

    def marked(n: int, side: str, own: int) -> Column:
        return F.transform(grams(F.col(side), n), lambda x: F.struct(F.lit(n).alias("n"), x.alias("gram"), F.lit(own).alias("own")))

    orders = [marked(n, side, own) for n in range(1, most_n + 1) for side, own in (("r", 0), ("g", 1))]
    each = pairs.select(*groups, "pair", F.explode(F.concat(*orders)).alias("x")).select(*groups, "pair", "x.*")
    both = each.groupBy(*groups, "pair", "n", "gram").agg(F.sum("own").alias("g"), F.sum(1 - F.col("own")).alias("r"))
    pooled = both.groupBy(*groups).agg(
        *(F.sum(F.when(F.col("n") == n, F.least("g", "r"))).alias(f"match_{n}") for n in range(1, most_n + 1)),
        *(F.sum(F.when(F.col("n") == n, F.col("g"))).alias(f"total_{n}") for n in range(1, most_n + 1)),
    )
    if group:
        joined = sizes.join(pooled.withColumnRenamed("own_group", "pooled_group"), F.col("own_group").eqNullSafe(F.col("pooled_group")), "left").drop("pooled_group")
    else:
        joined = sizes.join(pooled, how="cross")
    precision = {n: F.when(F.coalesce(F.col(f"total_{n}"), F.lit(0)) > 0, F.col(f"match_{n}") / F.col(f"total_{n}")).otherwise(F.lit(0.0)) for n in range(1, most_n + 1)}
    brevity = F.when(F.col("generated_words") >= F.col("reference_words"), F.lit(1.0)).when(F.col("generated_words") == 0, F.lit(0.0)).otherwise(F.exp(1 - F.col("reference_words") / F.col("generated_words")))
    means = [F.col(f"precision_{n}") for n in range(1, most_n + 1)]
    out = joined.select(*groups, "pairs", "generated_words", "reference_words", *(precision[n].alias(f"precision_{n}") for n in precision), brevity.alias("brevity"))
    score = F.when(F.least(*means) > 0, F.col("brevity") * F.exp(sum((F.log(m) for m in means), F.lit(0.0)) / most_n)).otherwise(F.lit(0.0))
    out = out.withColumn("bleu", score)
    return out.withColumnRenamed("own_group", group) if group else out


#: Words whose runs are packed together, and bytes of text for which a task's share of the runs is meant.
PARCEL_WORDS, TASK_BYTES = 1 << 19, 16 << 20


def parcels(docs: DataFrame, text: str, learned: Column, key: str | None = None) -> DataFrame:
    """Runs of three words as rows (bucket, lines), dealt by bucket; a line holds v, w and u of a run, in this order, parted by tabs.

    Half a million words at a time are counted and packed where they lie, in sorted lines, which compress to a third
    of a row for each run. Without `key` the learned documents' runs are dealt by (v, w), and a count above 1 follows.
    With `key` all runs are dealt by v, one by one, and 1 or 0 (learned or not) and the key, percent-encoded, follow.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(learned, F.lit(False)).alias("l"), *([F.col(key).cast("string").alias("k")] if key else []))
    held = held if key else held.where("l")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # More buckets than tasks even out what a task gets.
    buckets, start, end = 4 * parts, START.encode(), END.encode()

    def packed(found: Counter) -> pa.RecordBatch:
        by: dict[int, list[bytes]] = {}
        for line in sorted(found):
            v, w, rest = line.split(b"\t", 2)
            n = found[line]
            own = [line] * n if key else [line if n == 1 else b"%b\t%d" % (line, n)]
            by.setdefault(zlib.crc32(v if key else b"%b\t%b" % (v, w)) % buckets, []).extend(own)
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([b"\n".join(x) for x in by.values()], pa.binary()).cast(pa.string())], names=["bucket", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = Counter(), 0
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(0)[i].as_py()
                # ASCII letters and blanks alone, as in `words`.
                t = [start, start, *(value or "").encode().lower().split(), end]
                if key:
                    own = batch.column(2)[i].as_py()
                    tail = [(b"1" if batch.column(1)[i].as_py() else b"0") + (b"/" if own is None else quote(own, safe="").encode())] * len(t)
                    found.update(map(b"\t".join, zip(t[1:], t[2:], t, tail)))
                else:
                    found.update(map(b"\t".join, zip(t[1:], t[2:], t)))
                size += len(t) - 2
                if size >= PARCEL_WORDS:
                    yield packed(found)
                    found, size = Counter(), 0
        if found:
            yield packed(found)

    return held.mapInArrow(run, "bucket int, lines string").repartition(parts, "bucket")


def unpacked(parcels: DataFrame) -> DataFrame:
    """(bucket, v, w, u, more) of each line of `parcels`; `more` is what follows u, or null."""
    line = parcels.select("bucket", F.explode(F.split("lines", "\n")).alias("x")).select("bucket", F.split("x", "\t").alias("x"))
    return line.select("bucket", *(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("v", "w", "u", "more"))))


def gram_counts(docs: DataFrame, key: str, text: str, learned: Column) -> DataFrame:
    """(bucket, v, w, u, n): how often the learned documents have w after u and v, in one row or more.

    Words follow two starts, and an end follows them. Rows lie by `bucket`, which follows from v and w. Documents are
    counted together, whatever their `key`.
    """
    return unpacked(parcels(docs, text, learned)).select("bucket", "v", "w", "u", F.coalesce(F.col("more").cast("long"), F.lit(1)).alias("n"))


def model_counts(counted: DataFrame) -> dict[str, DataFrame]:
    """The tables of a Kneser-Ney model of three words from rows that lie by bucket, as `gram_counts` makes them.

    `three` (bucket, v, w, u, c) counts the learned runs; `two` (bucket, v, w) and `one` (w) count the kinds of what
    goes before. Each rolls up the one before, with how many kinds were counted once and twice (once_n, twice_n), so
    runs are shuffled once, and after that partial counts of words alone.
    """
    twice = lambda n: [F.count_if(F.col("c") == k).alias(f"{m}_{n}") for k, m in ((1, "once"), (2, "twice"))]
    three = counted.groupBy("bucket", "v", "w", "u").agg(F.sum("n").alias("c"))
    two = three.where("c > 0").groupBy("bucket", "v", "w").agg(F.count("*").alias("c"), *twice(3))
    one = two.groupBy("w").agg(F.count("*").alias("c"), F.sum("once_3").alias("once_3"), F.sum("twice_3").alias("twice_3"), *twice(2))
    return {"three": three, "two": two, "one": one}


def discounts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: for each order the kinds counted once (once_n) and twice (twice_n), and the discount d_n: once / (once + 2 twice), a half if none is counted once."""
    sums = [F.coalesce(F.sum(f"{m}_{n}"), F.lit(0)).alias(f"{m}_{n}") for n in (3, 2) for m in ("once", "twice")]
    found = tables["one"].agg(*sums, F.count_if(F.col("c") == 1).alias("once_1"), F.count_if(F.col("c") == 2).alias("twice_1"))
    d = lambda n: F.when(F.col(f"once_{n}") > 0, F.col(f"once_{n}") / (F.col(f"once_{n}") + 2 * F.col(f"twice_{n}"))).otherwise(F.lit(0.5))
    return found.select(*(x for n in (3, 2, 1) for x in (f"once_{n}", f"twice_{n}", d(n).alias(f"d_{n}"))))


#: Words with this share of all words have numbers that all tasks know, so there are no more such words than this.
SHARE = 1 << 20
#: Words whose runs are packed together, and runs that a bucket is meant to hold.
BLOCK_WORDS, BUCKET_RUNS = 1 << 20, 2 << 20
PACKED = "bucket int, block string, v binary, w binary, u binary, d binary, words binary"


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all, compressed: high bytes are mostly alike."""
    planes = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").reshape(-1)


def squeezed_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unsqueezed_bytes(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, as `words` finds them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    found, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(found), 0)
    return found.filter(some), np.bincount(parents.filter(some).to_numpy(), minlength=len(texts))


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n): how often each word occurs in the one column of `texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = split_words(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([kinds.field(0).cast(pa.string()), kinds.field(1)], names=["w", "n"])

    return bounded_batches(texts).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Dealing:
    """Numbers of frequent words, and where runs go: by the middle word, or by the last one too if the middle word is hot, that is, holds more than a bucket's share of all words."""

    def __init__(self, counts: list[tuple[str, int]], total: int, parts: int) -> None:
        self.frequent, self.parts = [START, END, *(w for w, _ in counts)], parts
        self.hot: dict[int, tuple[int, int]] = {}
        self.buckets, most = parts, max(1, total // parts)
        for k, (_, n) in enumerate(counts, 2):
            if n > most:
                self.hot[k] = (self.buckets, -(-n // most))
                self.buckets += self.hot[k][1]

    def places(self, rare: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the frequent words and then the `rare` ones: a hash, their first bucket and how many they have."""
        if not hasattr(self, "known"):
            self.known = np.array([zlib.crc32(w.encode()) for w in self.frequent], np.int64)
        hashes = np.concatenate([self.known, np.array([zlib.crc32(w.encode()) for w in rare], np.int64)])
        first, many = hashes % self.parts, np.ones(len(hashes), np.int64)
        for k, (at, n) in self.hot.items():
            first[k], many[k] = at, n
        return hashes, first, many


def packed_runs(docs: DataFrame, dealing: Dealing) -> DataFrame:
    """Rows `PACKED` of documents (text, learned, key): for each bucket the runs of a block of a million words, sorted; buckets below 0 hold the keys of a block's documents.

    Numbers from the count of frequent words on stand for the words that a row brings. `d` is twice the place of the
    document in its block, and one more if it is learned.
    """
    frequent = len(dealing.frequent)

    def packed(block: str, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, n = split_words(batch.column(0))
        coded = found.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=pa.array(dealing.frequent, coded.dictionary.type))
        number = known.fill_null(-1).to_numpy().astype(np.int64)
        other = np.flatnonzero(number < 0)
        number[other] = frequent + np.arange(len(other))
        rare = coded.dictionary.take(pa.array(other)).to_pylist()
        starts = np.concatenate([[0], np.cumsum(n + 3)])
        tokens = np.zeros(starts[-1], np.int64)
        inner = np.ones(starts[-1], bool)
        inner[starts[:-1]] = inner[starts[:-1] + 1] = inner[starts[1:] - 1] = False
        tokens[inner] = number[coded.indices.to_numpy()]
        tokens[starts[1:] - 1] = 1
        is_run = np.ones(starts[-1], bool)
        is_run[starts[1:] - 1] = is_run[starts[1:] - 2] = False
        at = np.flatnonzero(is_run)
        u, v, w = tokens[at], tokens[at + 1], tokens[at + 2]
        d = np.repeat(2 * np.arange(len(n)) + batch.column(1).to_numpy(zero_copy_only=False), n + 1)
        hashes, first, many = dealing.places(rare)
        bucket = first[v] + hashes[w] % many[v]
        order = np.lexsort((w << 32 | u, bucket << 32 | v))
        bucket, v, w, u, d = (x[order] for x in (bucket, v, w, u, d))
        cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
        held: list[tuple] = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            ids = np.stack([v[i:j], w[i:j], u[i:j]])
            own = np.unique(ids[ids >= frequent])
            ids = np.where(ids >= frequent, frequent + np.searchsorted(own, ids), ids)
            text = "\n".join([rare[k - frequent] for k in own.tolist()]).encode()
            held.append((int(bucket[i]), block, squeezed(np.diff(ids[0], prepend=0)), squeezed(np.diff(ids[1], prepend=0)), squeezed(ids[2]), squeezed(d[i:j]), squeezed_bytes(text)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.select([2]).schema) as out:
            out.write_batch(batch.select([2]))
        held.append((-1 - zlib.crc32(block.encode()) % dealing.parts, block, b"", b"", b"", b"", squeezed_bytes(sink.getvalue().to_pybytes())))
        types = [pa.int32(), pa.string(), *[pa.binary()] * 5]
        for k in range(0, len(held), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held[k : k + 256]), types)], names=["bucket", "block", "v", "w", "u", "d", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n, task = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            # A word and the blank after it have some 6 bytes.
            size += batch.column(0).nbytes
            if size >= 6 * BLOCK_WORDS:
                yield from packed(f"{task}-{n}", pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size, n = [], 0, n + 1
        if sum(b.num_rows for b in held):
            yield from packed(f"{task}-{n}", pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return bounded_batches(docs).mapInArrow(run, PACKED).repartition(dealing.buckets, "bucket")


class Runs:
    """The runs of a bucket, sorted by v, w and u, with what can be counted here."""

    def __init__(self, rows: pa.Table, frequent: int) -> None:
        columns, brought = [[], [], [], []], []
        self.blocks = rows.column("block").to_pylist()
        for k in range(rows.num_rows):
            v, w, u, d = (unsqueezed(rows.column(c)[k].as_py()) for c in "vwud")
            offset = len(brought)
            own = unsqueezed_bytes(rows.column("words")[k].as_py())
            brought += own.split(b"\n") if own else []
            for to, x in zip(columns, (np.cumsum(v, dtype=np.int32), np.cumsum(w, dtype=np.int32), u)):
                to.append(np.where(x >= frequent, x + offset, x).astype(np.int32))
            columns[3].append(d)
        sizes = [len(d) for d in columns[3]]
        v, w, u, self.d = (np.concatenate(x) for x in columns)
        coded = pa.array(brought, pa.large_binary()).dictionary_encode()
        self.rare = coded.dictionary.to_pylist()
        if brought:
            codes = coded.indices.to_numpy().astype(np.int32) + frequent
            v, w, u = (np.where(x >= frequent, codes[np.maximum(x - frequent, 0)], x) for x in (v, w, u))
        order = np.lexsort((w.astype(np.int64) << 32 | u, v))
        self.v, self.w, self.u, self.d, self.block = v[order], w[order], u[order], self.d[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        learned = (self.d & 1).astype(np.int64)
        new_two = self.differs(self.v, self.w)
        three, two, one = (np.cumsum(x) - 1 for x in (new_two | self.differs(self.u), new_two, self.differs(self.v)))
        # Of each run the numbers of its three words, of its last two and of the middle one.
        self.three, self.two, self.one = three, two, one
        self.c_3 = np.bincount(three, learned).astype(np.int64)
        self.first_3, self.first_2, self.first_1 = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (three, two, one))
        self.c_2 = np.bincount(two[self.first_3], self.c_3 > 0).astype(np.int64)
        self.total_1 = np.bincount(one[self.first_2], self.c_2).astype(np.int64)
        self.kinds_1 = np.bincount(one[self.first_2], self.c_2 > 0).astype(np.int64)
        before = self.v[self.first_3].astype(np.int64) << 32 | self.u[self.first_3]
        self.before, place = np.unique(before, return_inverse=True)
        self.total_2, self.kinds_2 = (np.bincount(place, x).astype(np.int64) for x in (self.c_3, self.c_3 > 0))
        self.place = place

    def differs(self, *columns: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([np.diff(c, prepend=-1) != 0 for c in columns])

    def wanted(self, dealing: Dealing) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names of what is added up over buckets, with two sums each: last words (kinds before them), hot middle words and the words before these, and discounts."""
        name = lambda x: self.name(x, dealing)
        last, place = np.unique(self.w[self.first_2], return_inverse=True)
        kinds = np.bincount(place, self.c_2 > 0).astype(np.int64)
        hot_1 = np.flatnonzero(np.isin(self.v[self.first_1], list(dealing.hot)))
        hot_2 = np.flatnonzero(np.isin(self.before >> 32, list(dealing.hot)))
        names = [*map(name, last.tolist()), *(name(x) + "\t" for x in self.v[self.first_1][hot_1].tolist()), *(f"{name(x >> 32)}\t{name(x & 0xFFFFFFFF)}" for x in self.before[hot_2].tolist()), "\t3", "\t2"]
        ends = [[np.count_nonzero(c == k) for c in (self.c_3, self.c_2)] for k in (1, 2)]
        first = np.concatenate([kinds, self.total_1[hot_1], self.total_2[hot_2], ends[0]]).astype(np.int64)
        second = np.concatenate([np.zeros(len(last)), self.kinds_1[hot_1], self.kinds_2[hot_2], ends[1]]).astype(np.int64)
        self.last, self.last_place, self.hot_1, self.hot_2 = last, place, hot_1, hot_2
        return names, first, second

    def name(self, number: int, dealing: Dealing) -> str:
        return dealing.frequent[number] if number < len(dealing.frequent) else self.rare[number - len(dealing.frequent)].decode()

    def scores(self, dealing: Dealing, sums: pa.Table) -> np.ndarray:
        """log10 of the probability of each three words, with the sums of all buckets at hand."""
        names, _, _ = self.wanted(dealing)
        place = pc.index_in(pa.array(names), value_set=sums.column("w").combine_chunks().cast(pa.string())).to_numpy()
        first, second = (sums.column(c).to_numpy()[place] for c in ("c", "m"))
        a, b = len(self.last), len(self.last) + len(self.hot_1)
        c_1, end = first[:a], b + len(self.hot_2)
        self.total_1[self.hot_1], self.kinds_1[self.hot_1] = first[a:b], second[a:b]
        self.total_2[self.hot_2], self.kinds_2[self.hot_2] = first[b:end], second[b:end]
        whole = {c: sums.column(c)[0].as_py() for c in ("d_3", "d_2", "d_1", "total_0", "kinds_0")}
        lower = np.full(len(c_1), 1.0 / (whole["kinds_0"] + 1))
        one, two = self.one[self.first_2], self.two[self.first_3]
        steps = ((c_1, whole["total_0"], whole["kinds_0"], whole["d_1"], None), (self.c_2, self.total_1[one], self.kinds_1[one], whole["d_2"], self.last_place), (self.c_3, self.total_2[self.place], self.kinds_2[self.place], whole["d_3"], two))
        for c, total, kinds, d, at in steps:
            lower = lower if at is None else lower[at]
            lower = np.where(total > 0, (np.maximum(c - d, 0.0) + d * kinds * lower) / np.maximum(total, 1), lower)
        return np.log10(lower)


def perplexity(docs: DataFrame, learned: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (rows of one key are one): key, n_tokens (its words and an end), log10_prob and perplexity by a model of the documents where `learned` is true.

    Interpolated Kneser-Ney of three words: a run's count less a discount, over what its first words are followed by;
    the rest goes to the model of one word less, whose counts are kinds of words before, down to equal shares for all
    known words and one unknown. What has no history at one order is left to the next. Runs are shuffled once, as
    numbers, by their middle word (hot ones by the last word too), and read twice: first for the sums that go over
    buckets (kinds before a last word, what follows a hot word), then, with these, for the scores. Scores go back to
    the block that runs came from, and documents add up there.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(learned, F.lit(False)).alias("l"), F.col(key).cast("string").alias("k"))
    counts = word_counts(held.select("t"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).where(F.col("n") * SHARE >= F.col("total")).where("n > 1")
    found = sorted((-r.n, r.w, r.total) for r in counts.collect())
    total = found[0][2] if found else 0
    dealing = Dealing([(w, -n) for n, w, _ in found], total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_RUNS)))
    packed, frequent = packed_runs(held, dealing), len(dealing.frequent)

    def summed(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        if bucket < 0:
            names, first, second = [], [], []
        else:
            names, first, second = Runs(rows, frequent).wanted(dealing)
        return pa.table([pa.array(names, pa.string()), pa.array([bucket] * len(names), pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["w", "bucket", "c", "m"])

    parts = packed.groupBy("bucket").applyInArrow(summed, "w string, bucket int, c long, m long")
    sums = parts.groupBy("w").agg(F.sum("c").alias("c"), F.sum("m").alias("m"), F.collect_list("bucket").alias("buckets"))
    is_word, c = ~F.contains("w", F.lit("\t")), F.col("c")
    of = lambda name, column: F.coalesce(F.sum(F.when(F.col("w") == name, F.col(column))), F.lit(0))
    # `asked` keeps the buckets in this plan, so that the shuffle of `sums` is one for both uses.
    whole = sums.agg(
        *(of(f"\t{n}", c_).alias(f"{m}_{n}") for n in (3, 2) for m, c_ in (("once", "c"), ("twice", "m"))),
        *(F.count_if(is_word & (c == k)).alias(f"{m}_1") for k, m in ((1, "once"), (2, "twice"))),
        F.coalesce(F.sum(F.when(is_word, c)), F.lit(0)).alias("total_0"),
        F.count_if(is_word & (c > 0)).alias("kinds_0"),
        F.sum(F.size("buckets")).alias("asked"),
    )
    d = lambda n: F.when(F.col(f"once_{n}") > 0, F.col(f"once_{n}") / (F.col(f"once_{n}") + 2 * F.col(f"twice_{n}"))).otherwise(F.lit(0.5)).alias(f"d_{n}")
    whole = whole.select(*(d(n) for n in (3, 2, 1)), "total_0", "kinds_0", "asked")
    known = sums.select(F.explode("buckets").alias("bucket"), "w", "c", "m").repartition(dealing.buckets, "bucket").crossJoin(F.broadcast(whole))

    def scored(rows: pa.Table, sums: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and rows.column("bucket")[0].as_py() < 0:
            out = [(k, b"", b"", x) for k, x in zip(rows.column("block").to_pylist(), rows.column("words").to_pylist())]
        elif rows.num_rows:
            runs = Runs(rows, frequent)
            p = runs.scores(dealing, sums)[runs.three]
            at, place = np.unique(runs.block.astype(np.int64) << 32 | runs.d >> 1, return_inverse=True)
            p, n = np.bincount(place, p), np.bincount(place)
            cuts = np.concatenate([np.flatnonzero(np.diff(at >> 32, prepend=-1)), [len(at)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = np.concatenate([np.diff(at[i:j] & 0xFFFFFFFF, prepend=0), n[i:j]])
                out.append((runs.blocks[at[i] >> 32], squeezed(own), squeezed_bytes(p[i:j].tobytes()), b""))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), *[pa.binary()] * 3))], names=["k", "d", "p", "keys"])

    scores = packed.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(scored, "k string, d binary, p binary, keys binary")

    def added(rows: pa.Table) -> pa.Table:
        keys = next(x for x in rows.column("keys").to_pylist() if x)
        names = pa.ipc.open_stream(unsqueezed_bytes(keys)).read_all().column(0)
        n, p = np.zeros(len(names), np.int64), np.zeros(len(names))
        for own, some in zip(rows.column("d"), rows.column("p")):
            if own.as_py():
                at, more = unsqueezed(own.as_py()).reshape(2, -1)
                at = np.cumsum(at)
                n[at] += more
                p[at] += np.frombuffer(unsqueezed_bytes(some.as_py()))
        return pa.table([names.cast(pa.string()), pa.array(n), pa.array(p)], names=["k", "n", "p"])

    each = scores.groupBy("k").applyInArrow(added, "k string, n long, p double").groupBy("k").agg(F.sum("n").alias("n_tokens"), F.sum("p").alias("log10_prob"))
    return each.select(F.col("k").cast(docs.schema[key].dataType).alias(key), "n_tokens", "log10_prob", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")).alias("perplexity"))
