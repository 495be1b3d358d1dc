"""Byte-pair encoding by a contiguous rank array, and decoding.

A word starts as its bytes. Its parts lie side by side in one array, the ranks of neighbouring pairs in another.
The least rank is looked for, leftmost first; the boundary it stands for is deleted, which moves all that follows one
place to the left; and the ranks of the two new neighbours are looked up again. This goes on until no pair has a rank.
Words of one length are merged together, a row each: every round takes one boundary from every row that still has a
ranked pair, so the arrays stay rectangular. As each round passes over the whole row, this is for short words; longer
ones are merged through a heap, to the same ids.

Texts are cut into words, and words remembered, as in `tokens.PieceEncoder`.
"""

from __future__ import annotations

import heapq
import json
import threading
import unicodedata
from collections.abc import Iterator
from itertools import chain
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import tokens
from corpusmill.llm.common import bounded_batches, text_or_empty
from corpusmill.llm.tokens import SEPARATORS, SHOWN, IdTable, PieceEncoder, gathered

#: How byte-level tokenizers cut a text into words (a fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of a word up to which it is merged by the array; rows merged at once.
SHORT, ROWS = 64, 1 << 14
#: Marks that are words of their own after letters.
MARKS = frozenset(".,;:!?")
NO_RANK = np.int32(2**31 - 1)

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = f"{ENCODED}, text string"


class RankBpe:
    """Ids of words by one byte-level BPE file, and bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, cut = whole["model"], whole.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not whole.get("normalizer")
        asked = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or not plain or asked:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in whole.get("added_tokens", ())):
            raise ValueError(f"{path} has added tokens that look at what stands beside them")
        self.size = 1 + max(chain(vocab.values(), self.added.values()))
        self.byte_ids = np.array([vocab[SHOWN[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        #: The pairs in order, with their ranks and what they become; the last entry is no pair's.
        order = np.argsort(keys, kind="stable")
        self.pairs = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order.astype(np.int32), NO_RANK)
        self.becomes = np.append(np.array([vocab[a + b] for a, b in merges], np.int32)[order], np.int32(-1))
        shown = {c: b for b, c in SHOWN.items()}
        spelled = [b""] * self.size
        for token, k in chain(vocab.items(), self.added.items()):
            spelled[k] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in `pairs`; the last place for those that are none."""
        keys = left.astype(np.int64) * self.size + right
        places = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[places] == keys, places, len(self.pairs) - 1)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of one length."""
        out: list[list[int] | None] = [None] * len(words)
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)
        rows = np.arange(len(words))
        pairs = self.look_up(parts[:, :-1], parts[:, 1:])
        while len(rows):
            ranks = self.ranks[pairs]
            least = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            live = ranks[np.arange(len(rows)), least] != NO_RANK if ranks.shape[1] else np.zeros(len(rows), bool)
            for k, ids in zip(rows[~live].tolist(), parts[~live].tolist(), strict=True):
                out[k] = ids
            rows, parts, pairs, least = rows[live], parts[live], pairs[live], least[live]
            if not len(rows):
                break
            every, width = np.arange(len(rows)), parts.shape[1]
            parts[every, least] = self.becomes[pairs[every, least]]
            # The part after the boundary goes, and so does the pair that was merged.
            parts = parts[np.arange(width) != (least + 1)[:, None]].reshape(len(rows), width - 1)
            pairs = pairs[np.arange(width - 1) != least[:, None]].reshape(len(rows), width - 2)
            before, after = np.flatnonzero(least > 0), np.flatnonzero(least < width - 2)
            at = least[before]
            pairs[before, at - 1] = self.look_up(parts[before, at - 1], parts[before, at])
            at = least[after]
            pairs[after, at] = self.look_up(parts[after, at], parts[after, at + 1])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word of any length: a heap of ranked pairs over linked parts."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        places = self.look_up(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64))
        ranked = np.flatnonzero(places < len(self.pairs) - 1)
        heap = [(r, k, parts[k], parts[k + 1]) for r, k in zip(self.ranks[places[ranked]].tolist(), ranked.tolist(), strict=True)]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def ranked_pair(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in known:
                place = int(self.look_up(np.array([a]), np.array([b]))[0])
                known[a, b] = int(self.ranks[place]), int(self.becomes[place])
            return known[a, b]

        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = ranked_pair(a, b)[1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n:
                    rank = ranked_pair(parts[i], parts[after[i]])[0]
                    if rank != NO_RANK:
                        heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))
        return [p for p in parts if p >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words, in their order."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            places = np.flatnonzero(lengths == length)
            for some in np.split(places, range(ROWS, len(places), ROWS)) if 0 < length <= SHORT else ():
                for k, ids in zip(some.tolist(), self.merge_short([words[k] for k in some.tolist()]), strict=True):
                    out[k] = ids
            for k in places.tolist() if length > SHORT else ():
                out[k] = self.merge_long(words[k])
        return out

    def spell(self, ids: np.ndarray, part: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Number of bytes of each id, and all bytes one after another; ids that the file does not have are nothing."""
        known = ids.astype(np.int64)
        held = np.where(known < self.size, self.starts[np.minimum(known + 1, self.size)] - self.starts[np.minimum(known, self.size)], 0)
        out, at = np.empty(int(held.sum()), np.uint8), 0
        for k in range(0, len(known), part):
            some = held[k : k + part]
            ends = np.cumsum(some)
            n = int(ends[-1])
            begins = self.starts[np.minimum(known[k : k + part], self.size)]
            out[at : at + n] = self.bytes[np.repeat(begins - ends + some, some) + np.arange(n)]
            at += n
        return held, out


class RankTokenizer:
    """Encodes whole texts: added tokens are taken out, the rest is cut into words, and each distinct word is merged once."""

    def __init__(self, path: str):
        self.bpe, self.path = RankBpe(path), path
        longest_first = sorted(self.bpe.added, key=len, reverse=True)
        self.taken_out = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.newer = None

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens.

        The classes of characters are those of the `regex` module; the tokenizer's own rule decides for characters
        that Python's own tables do not have yet, as libraries differ in them.
        """
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text) if c > "\x7f"):
            return WORDS.findall(text)
        if self.newer is None:
            from tokenizers import Tokenizer

            self.newer = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[i:j] for _, (i, j) in self.newer.pre_tokenize_str(text)]

    def encode_words(self, lists: list[list[str]]) -> list[list[int]]:
        """Ids of lists of words, one after another."""
        known = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
        found = self.bpe.merge([w.encode() for w in known])
        return [found[known[own[0]]] if len(own) == 1 else list(chain.from_iterable(found[known[w]] for w in own)) for own in lists]

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        lists, marks = [], []
        for text in texts:
            ends, at = [], 0
            for hit in self.taken_out.finditer(text) if self.taken_out else ():
                lists.append(self.words(text[at : hit.start()]))
                ends.append(self.bpe.added[hit.group()])
                at = hit.end()
            lists.append(self.words(text[at:]))
            marks.append(ends)
        ids, out = iter(self.encode_words(lists)), []
        for ends in marks:
            own = list(next(ids))
            for mark in ends:
                own += [mark, *next(ids)]
            out.append(SimpleNamespace(ids=own))
        return out

    def encode(self, text: str, add_special_tokens: bool = False) -> SimpleNamespace:
        return self.encode_batch_fast([text])[0]


class RankEncoder(PieceEncoder):
    """The cutting and remembering of `PieceEncoder`, with words merged by the rank array."""

    def __init__(self, path: str, most: int = 400_000, keep: int = 300_000):
        self.tokenizer = RankTokenizer(path)
        self.spaces, self.most, self.keep = True, most, keep
        self.special = [(content, False) for content in self.tokenizer.bpe.added]
        self.line_id = int(self.tokenizer.bpe.byte_ids[ord("\n")])
        self.table, self.known, self.used = IdTable(), {}, 0.0

    def _learn(self, new: list[str], lead: str, head: list[int]) -> list[int]:
        rims = [k for k, p in enumerate(new) if not p or p[0].isspace() or p[-1].isspace() or SEPARATORS.search(p)]
        at_rim = set(rims)
        words = self.tokenizer.words
        lists = []
        for k, p in enumerate(new):
            if p.isalpha():
                lists.append([lead + p])
            elif p[-1:] in MARKS and p[:-1].isalpha():
                lists.append([lead + p[:-1], p[-1]])
            else:
                lists.append([] if k in at_rim else words(lead + p))
        ids = self.tokenizer.encode_words(lists)
        places = list(self.table.add([head + own for own in ids] if head else ids))
        for k in rims:
            places[k] = -1
        return places


def rank_encoder(path: str) -> RankEncoder:
    """One for each Python worker; given up when idle, like those of `tokens.encoder`."""
    one = tokens._encoders.get((path, "ranks"))
    if one is None:
        first, one = not tokens._encoders, RankEncoder(path)
        tokens._encoders[path, "ranks"] = one
        if first:
            threading.Thread(target=tokens.give_up_idle, daemon=True).start()
    return one


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers one after another).

    Ids are those of the tokenizers library without special tokens around the text; added tokens that stand in a text
    are taken as such. A null text is an empty one, with no ids; repeated rows and null ids are encoded like others; an
    empty table gives no rows; other columns are ignored. Long texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rank_encoder(tokenizer)
        for batch in gathered(batches):
            sizes, ids = codes.encode(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(sizes) * 4])
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4", copy=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), raw.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, ENCODED)


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """`rows` of `encoded` with the text their ids stand for, added tokens included.

    Bytes that are no UTF-8 become U+FFFD; ids that the tokenizer does not have, and null ids, are nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rank_encoder(tokenizer).tokenizer.bpe
        for batch in batches:
            raw = batch.column(2).fill_null(b"")
            ends = raw.offsets.to_numpy() if hasattr(raw, "offsets") else np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            ids = np.frombuffer(raw.buffers()[2] or b"", "<u4", (int(ends[-1]) - int(ends[0])) // 4, int(ends[0]))
            held, spelled = codes.spell(ids)
            cuts = np.concatenate([[0], np.cumsum(held)])[(ends - ends[0]) // 4].tolist()
            view = memoryview(spelled)
            texts = [str(view[i:j], "utf-8", "replace") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return bounded_batches(rows).select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def digests(rows: DataFrame) -> DataFrame:
    """Lowercase SHA-256 of the ids and of the decoded text of rows of `decoded`."""
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
