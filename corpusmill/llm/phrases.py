"""Phrases whose words go together, mined from counts by the suffix method.

Every word begins a suffix of its piece, cut after `most_words` words. Suffixes are shuffled by language and first word
and sorted in reverse, so that all phrases that begin alike lie together, longer ones first; one stack of open prefixes
then counts every phrase in a single pass. Parts of phrases are joined to them afterwards.

Suffixes are counted where they lie before they are shuffled. Words that hold a 512th of a sample of texts are dealt by
their second word too, and by the third where both are such: their counts are sums over tasks. The sample decides where
a suffix goes, never what is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import tokens
from corpusmill.llm.common import bounded_batches, hashed_sample, partitions, written

#: A word (or a part of phrases, when they are joined) with this share of all is hot; there are no more hot ones than this.
HOT = 512
SAMPLE = 2000
#: Bytes that are worked on at once, each of which takes some thirty while it is, and rows that are sent on at once.
BYTES_AT_ONCE, ROWS_AT_ONCE = 4 << 20, 1 << 15
gathered = partial(tokens.gathered, most=BYTES_AT_ONCE)
WORD_BYTE, BLANK, MARK = 0, 1, 2


def kinds_of_bytes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = BLANK
    kinds[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = MARK
    return kinds


KINDS = kinds_of_bytes()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, the text each is from, and the piece, counted over all texts."""
    texts = pc.ascii_lower(texts.cast(pa.large_string()))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    limits = ends - ends[0]
    kinds = KINDS[data]
    inside = kinds == WORD_BYTE
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[limits] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    first = np.flatnonzero(inside & (~before | starts_text[:-1]))
    letters = np.cumsum(inside, dtype=np.int32)
    offsets = np.concatenate([letters[first] - 1, [letters[-1] if len(data) else 0]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    breaks = (kinds == MARK) | starts_text[:-1]
    # A text that begins with a word's byte opens a new piece there; a mark opens one after it.
    pieces = np.cumsum(breaks, dtype=np.int32)[first] if len(data) else np.zeros(0, np.int64)
    return words, np.searchsorted(limits, first, side="right") - 1, pieces


def quoted(lang: str) -> str:
    """A language without blanks, as these part the fields of a key."""
    return lang.replace("%", "%25").replace(" ", "%20").replace("\t", "%09")


def unquoted(column: Column) -> Column:
    return F.replace(F.replace(F.replace(column, F.lit("%09"), F.lit("\t")), F.lit("%20"), F.lit(" ")), F.lit("%25"), F.lit("%"))


def suffixes(docs: DataFrame, most_words: int, hot: frozenset[tuple[str, str]]) -> DataFrame:
    """(key, f, dealt_by): suffixes of a batch of texts with their number.

    A key is the language, a tab, and the words with a space after each. `dealt_by` is the number of words that say
    where it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            langs = batch.column(0).dictionary_encode()
            words, texts, pieces = words_of(batch.column(1))
            n = len(words)
            if not n:
                continue
            coded = words.dictionary_encode()
            codes, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            lang_codes = langs.indices.to_numpy().astype(np.int64)[texts]
            # `size` stands for no word.
            columns = [codes] + [np.full(n, size, np.int64) for _ in range(most_words - 1)]
            for k in range(1, min(most_words, n)):
                same = pieces[k:] == pieces[:-k]
                columns[k][:-k][same] = codes[k:][same]
            number, firsts = numbered(lang_codes, columns, size + 1)
            counts = np.bincount(number, minlength=len(firsts))
            own = [c[firsts] for c in columns]
            spaced = pa.concat_arrays([pc.binary_join_element_wise(coded.dictionary, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())), pa.array([""], pa.large_string())])
            heads = pa.array([quoted(x) + "\t" for x in langs.dictionary.to_pylist()], pa.large_string())
            key = pc.binary_join_element_wise(heads.take(pa.array(lang_codes[firsts])), *(spaced.take(pa.array(c)) for c in own), pa.scalar("", pa.large_string()))
            is_hot = np.zeros((len(heads), size + 1), bool)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                known = pa.array([w for x, w in hot if x == lang], coded.dictionary.type)
                is_hot[k, :size] = pc.is_in(coded.dictionary, value_set=known).to_numpy(zero_copy_only=False)
            dealt, more = np.ones(len(firsts), np.int32), np.ones(len(firsts), bool)
            for c in own[:-1]:
                more &= is_hot[lang_codes[firsts], c]
                dealt += more
            yield from in_parts(pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dealt)], names=["key", "f", "dealt_by"]))

    return bounded_batches(docs).mapInArrow(run, "key string, f long, dealt_by int")


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in batches of few rows, as Spark takes in a whole one at a time, outside its heap."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def numbered(langs: np.ndarray, columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's distinct (language, words), and a row for each number."""
    key, held, firsts = langs, int(langs.max()) + 1, None
    for c in columns:
        if held * size >= 1 << 62:
            # Numbers are made dense again: there are no more than rows.
            found, key = np.unique(key, return_inverse=True)
            held = len(found)
        key, held = key * size + c, held * size
    _, firsts, key = np.unique(key, return_index=True, return_inverse=True)
    return key, firsts


def counted_by_stack(sorted_keys: DataFrame, most_words: int, least: int, hot: frozenset[tuple[str, str]]) -> DataFrame:
    """(key, f): prefixes of sorted keys with f >= `least`; and all that tasks count in parts: the languages, and those of hot words."""
    hot_keys = frozenset(f"{quoted(x)}\t{w} ".encode() for x, w in hot)

    def counted_in_parts(prefix: bytes) -> bool:
        head, _, rest = prefix.partition(b"\t")
        words = rest.split(b" ")[:-1]
        return len(words) < most_words and all(head + b"\t" + w + b" " in hot_keys for w in words)

    hot_words: dict[str, list[bytes]] = {}
    for x, w in sorted(hot):
        hot_words.setdefault(x, []).append(f"{w} ".encode())

    def is_hot(fields: pa.Array, langs: np.ndarray, words: np.ndarray) -> np.ndarray:
        found = np.zeros(len(words), bool)
        for x, some in hot_words.items():
            code = pc.index(fields, pa.scalar(f"{quoted(x)}\t".encode(), fields.type)).as_py()
            if code >= 0:
                found |= (langs == code) & pc.is_in(fields, value_set=pa.array(some, fields.type)).to_numpy(zero_copy_only=False)[words]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, int]] = []

        def wanted(prefix: bytes, f: int) -> bool:
            return f >= least or counted_in_parts(prefix)

        for batch in gathered(batches):
            keys, counts = batch.column(0).cast(pa.large_binary()), batch.column(1).to_numpy()
            ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
            data = np.frombuffer(keys.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            # Fields end with a tab or a space each, so they tile the keys.
            field_ends = np.flatnonzero((data == 0x20) | (data == 0x09)) + 1
            fields = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(field_ends), [None, pa.py_buffer(np.concatenate([[0], field_ends]).astype(np.int64)), pa.py_buffer(data)])
            coded = fields.dictionary_encode()
            codes = coded.indices.to_numpy()
            first = np.searchsorted(field_ends, ends[:-1], side="right")
            held = np.diff(np.append(first, len(field_ends)))
            out_keys, out_counts, still = [], [], []
            raw = data.tobytes()
            differs = np.zeros(len(keys), bool)
            differs[0] = True
            same, parted = True, np.ones(len(keys), bool)
            for depth in range(most_words + 1):
                has = held > depth
                own = np.where(has, codes[np.minimum(first + depth, len(codes) - 1)], -1)
                if depth:
                    parted &= has & is_hot(coded.dictionary, codes[first], own)
                differs[1:] |= own[1:] != own[:-1]
                starts = np.flatnonzero(differs)
                sums = np.add.reduceat(counts, starts)
                kept = has[starts]
                starts, sums, is_last = starts[kept], sums[kept], np.append(np.zeros(max(0, len(starts) - 1), bool), True)[kept]
                prefix_ends = field_ends[first[starts] + depth]
                open_one = stack[depth] if len(stack) > depth else None
                if open_one is not None:
                    mine = raw[ends[starts[0]] : prefix_ends[0]] if len(starts) and starts[0] == 0 else None
                    same = same and mine == open_one[0]
                    if same:
                        sums[0] += open_one[1]
                    elif wanted(*open_one):
                        out_keys.append(open_one[0])
                        out_counts.append(open_one[1])
                else:
                    same = False
                # The last run stays on the stack: the next batch may go on with it.
                if len(starts) and is_last[-1]:
                    still.append((raw[ends[starts[-1]] : prefix_ends[-1]], int(sums[-1])))
                    starts, sums, prefix_ends = starts[:-1], sums[:-1], prefix_ends[:-1]
                out = sums >= least
                if depth < most_words:
                    out |= parted[starts]
                out_keys += [raw[i:j] for i, j in zip(ends[starts[out]].tolist(), prefix_ends[out].tolist(), strict=True)]
                out_counts += sums[out].tolist()
            stack = still
            yield from in_parts(made(out_keys, out_counts))
        last = [(p, f) for p, f in stack if wanted(p, f)]
        yield made([p for p, _ in last], [f for _, f in last])

    def made(keys: list[bytes], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["key", "f"])

    return sorted_keys.select("key", "f").mapInArrow(run, "key string, f long")


def phrase_counts(docs: DataFrame, most_words: int = 3, least: int = 10) -> DataFrame:
    """(key, f) of every phrase of up to `most_words` words with f >= `least`, and of every language (no words: all its words)."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = suffixes(hashed_sample(plain, SAMPLE, "lang", "text"), 1, frozenset()).groupBy("key").agg(F.sum("f").alias("f"))
    some = written(seen, "phrase-sample")
    all_seen = some.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    fields = F.split(F.rtrim("key"), "\t")
    hot = frozenset((r[0], r[1]) for r in some.where(F.col("f") * HOT >= all_seen).select(unquoted(fields[0]), fields[1]).collect())
    dealt = suffixes(plain, most_words, hot).repartition(partitions(spark), F.expr("substring_index(key, ' ', dealt_by)"))
    ordered = dealt.sortWithinPartitions(F.col("key").desc())
    return counted_by_stack(ordered, most_words, least, hot).groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("key").endswith("\t"))


def with_count(rows: DataFrame, counts: DataFrame, key: str, name: str, hot: int) -> DataFrame:
    """`rows` with the count of `key` as `name`; keys counted `hot` times or more, of which there are few, by broadcast."""
    few = counts.where(F.col("f") >= hot).select(F.col("key").alias(key), F.col("f").alias(name))
    many = counts.where(F.col("f") < hot).select(F.col("key").alias(key), F.col("f").alias(name))
    rest = rows.join(F.broadcast(few), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(many, key))


def words_in(key: str) -> Column:
    return F.slice(F.split(F.substring_index(key, "\t", -1), " "), 1, F.size(F.split(key, " ")) - 1)


def key_of(words: Column) -> Column:
    return F.concat(F.col("head"), F.lit("\t"), F.array_join(words, " "), F.lit(" "))


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, held_within: int = 50, most: int | None = 2000) -> DataFrame:
    """Phrases of 2 to `most_words` words that occur `least` times, scored by the weakest place to cut them.

    Words and pieces are told apart by ASCII marks and blanks alone, A-Z are lower-cased, and all is per language (null:
    `und`). Cut after k words, a phrase of count a scores floor(1000000 a a / (l r)), l and r being the counts of its
    parts; its least score counts, the smallest k among equals. A phrase goes if a longer one holds it in `held_within`
    of 100 of its places or more. Returns lang, rank, phrase, a, l, r, n (words of the language), score: the `most`
    first of each language (None: all) by score and a, falling, and phrase in the order of its bytes. Null and empty
    texts have no words; repeated rows count each; long texts count whole; an empty table gives no rows; other columns
    are ignored. Counts may reach 4e15, as 38 digits hold the products.
    """
    spark = docs.sparkSession
    counts = written(phrase_counts(docs, most_words, least), "phrase-counts")
    is_lang = F.col("key").endswith("\t")
    langs = counts.where(is_lang).select(F.substring_index("key", "\t", 1).alias("head"), F.col("f").alias("n"))
    phrases = counts.where(~is_lang)
    hot = max(1, -(-(langs.agg(F.sum("n")).first()[0] or 0) // HOT))
    split = phrases.select("key", "f", F.substring_index("key", "\t", 1).alias("head"), words_in("key").alias("words"))
    found = split.where(F.size("words") > 1)
    # Longer candidates that hold a phrase: of those that fill half of its places there are few for each.
    part = lambda i, n: F.struct(key_of(F.slice("words", i, n)).alias("key"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: part(i, n))))
    held = found.where(F.size("words") > 2).select(F.explode(inner).alias("inner"), "f").groupBy("inner.key").agg(F.max("f").alias("longer"))
    left = found.join(held, "key", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * held_within)).drop("longer")
    cuts = left.select("key", "head", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("key", "head", "a", "k", key_of(F.slice("words", F.lit(1), F.col("k"))).alias("first"), key_of(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("rest"))
    # Phrases with a part in common are as many as a tenth of its count at most, so parts counted often are the hot ones.
    joined = with_count(with_count(written(cuts, "phrase-cuts"), phrases, "first", "l", hot), phrases, "rest", "r", hot)
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000000BD * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    least_cut = joined.withColumn("score", score).groupBy("key", "head", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = least_cut.select(unquoted(F.col("head")).alias("lang"), F.rtrim(F.substring_index("key", "\t", -1)).alias("phrase"), "a", "cut.l", "cut.r", F.col("cut.score").alias("score"))
    scored = written(scored, "phrase-scores")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    if most is not None:
        # The first of each part of a language, so that no task sorts a whole language.
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(max(16, partitions(spark)))))
        scored = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= most).drop("salt", "place")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    totals = langs.select(unquoted(F.col("head")).alias("lang"), "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """DuckDB SQL of the collocations of up to three words."""
    return r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
      FROM documents WHERE text IS NOT NULL),
    listed AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
    grams AS (
      SELECT lang, m.m AS m, unnest(list_transform(range(1, len(w) - m.m + 2), lambda i: array_to_string(w[i : i + m.m - 1], ' '))) AS phrase
      FROM listed, (SELECT unnest([1, 2, 3]) AS m) m WHERE len(w) >= m.m),
    counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
    found AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
    held AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM found WHERE m = 3),
    longest AS (SELECT lang, phrase, max(f) AS longer FROM held GROUP BY ALL),
    kept AS (SELECT f.* FROM found f LEFT JOIN longest h USING (lang, phrase) WHERE h.longer IS NULL OR 100 * h.longer < 50 * f.f),
    cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
    scored AS (
      SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """
