"""Token ids of whole texts, as little-endian unsigned 32-bit numbers.

A byte-pair tokenizer never joins characters across a single space, so texts are cut there in Arrow, the distinct
pieces of a batch are looked up once each, and the ids of all words are gathered from one table of ids. Where a
rule of the tokenizer does look across (runs of white space, special tokens), the whole text is encoded at once.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import threading
import time
from array import array
from collections.abc import Iterator
from itertools import chain, islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Python counts these as white space, Unicode does not.
SEPARATORS = re.compile(r"[\x1c-\x1f]")


def shown_bytes() -> dict[int, str]:
    """How byte-level vocabularies show bytes: printable ones as themselves, the others by the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


SHOWN = shown_bytes()


class IdTable:
    """Id lists one after another in one array; entry k is `ids[starts[k] : starts[k + 1]]`."""

    def __init__(self) -> None:
        self.ids, self.starts = array("I"), array("q", [0])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def add(self, lists: list[list[int]]) -> range:
        """Places of more entries."""
        first, lengths = len(self), np.fromiter(map(len, lists), np.int64, len(lists))
        ends = np.cumsum(lengths) + len(self.ids)
        self.ids.extend(chain.from_iterable(lists))
        self.starts.frombytes(ends.tobytes())
        return range(first, first + len(lists))

    def cut(self, n: int) -> None:
        """Keep the first `n` entries."""
        del self.starts[n + 1 :]
        del self.ids[self.starts[n] :]

    def gather(self, places: np.ndarray, part: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the entries at `places`, and their ids one after another."""
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.uint32)
        lengths = starts[places + 1] - starts[places]
        out, at = np.empty(int(lengths.sum()), np.uint32), 0
        for k in range(0, len(places), part):
            some, begins = lengths[k : k + part], starts[places[k : k + part]]
            ends = np.cumsum(some)
            n = int(ends[-1])
            out[at : at + n] = ids[np.repeat(begins - ends + some, some) + np.arange(n)]
            at += n
        return lengths, out


class PieceEncoder:
    """Ids of texts by one tokenizer file. `spaces`: a space belongs to the piece after it (byte level) or is dropped (False).

    About `most` pieces are remembered. Then the earliest `keep` stay, as frequent pieces come early; this changes no result.
    """

    def __init__(self, path: str, spaces: bool, most: int = 400_000, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.used = time.monotonic()
        self.spaces, self.most, self.keep = spaces, most, keep
        #: Strings that the tokenizer takes out of a text before any other rule.
        self.special = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of marks that end a piece after a run of letters.
        self.marks = {c: self.whole(c) for c in ".,;:!?"}
        #: Marks, with their ids, that part pieces which are encoded in one go; none of a piece's own.
        self.between = {c: self.whole(c)[0] for c in ("\n\t" if spaces else "!?")}
        self.line_id = self.whole("\n")[0] if spaces else -1
        self.table = IdTable()
        #: Place of a piece's ids; -1: a piece with white space at its rim, which the tokenizer could join with the space beside it.
        self.known: dict[str, int] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def _word(self, word: str, lead: str) -> list[int] | None:
        """Ids of a run of letters after `lead` by the tokenizer's model, as its rules keep it in one piece; None if they may change it."""
        if not self.spaces:
            if not word.isascii() and (not is_normalized("NFC", word) or "\u03a3" in word or not word.lower().isalpha()):
                return None
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(SHOWN)
        return [t.id for t in self.model.tokenize(lead + word)]

    def _joint(self, pieces: list[str], lead: str, part: int = 1000) -> list[list[int]]:
        """Ids of pieces, each after `lead`, many encoded at a time with a mark between them; pieces that hold all marks are encoded alone."""
        found: list[list[int] | None] = [None] * len(pieces)
        left = list(range(len(pieces)))
        for mark, mark_id in self.between.items():
            some = [k for k in left if mark not in pieces[k]]
            left = [k for k in left if mark in pieces[k]]
            gap = (mark if self.spaces else f" {mark} ") + lead
            for at in range(0, len(some), part):
                places = some[at : at + part]
                ids = self.tokenizer.encode_batch_fast([lead + gap.join([pieces[k] for k in places])], add_special_tokens=False)[0].ids
                cuts = np.flatnonzero(np.array(ids) == mark_id).tolist()
                for k, i, j in zip(places, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True):
                    found[k] = ids[i:j]
        for k in left:
            found[k] = self.whole(lead + pieces[k])
        return found

    def _learn(self, new: list[str], lead: str, head: list[int]) -> list[int]:
        """Places of pieces not known yet: `head`, and then what follows a space or, if `lead` is empty, nothing.

        A piece that is a run of letters and a mark has the ids of one and the other.
        """
        ids: list[list[int] | None] = [None] * len(new)
        rest, rims = [], []
        shown, marks, word_ids, spaces = "\u0120" if lead else "", self.marks, self._word, self.spaces
        for k, p in enumerate(new):
            if p.isalpha():
                ids[k] = word_ids(p, shown)
            elif p[-1:] in marks and p[:-1].isalpha():
                own = word_ids(p[:-1], shown)
                ids[k] = None if own is None else own + marks[p[-1]]
            elif spaces and (not p or p[0].isspace() or p[-1].isspace() or SEPARATORS.search(p)):
                ids[k] = []
                rims.append(k)
            if ids[k] is None:
                rest.append(k)
        for k, own in zip(rest, self._joint([new[k] for k in rest], lead), strict=True):
            ids[k] = own
        places = list(self.table.add([head + own for own in ids] if head else ids))
        for k in rims:
            places[k] = -1
        return places

    def _places(self, pieces: list[str], part: int = 1 << 15) -> np.ndarray:
        places = list(map(self.known.get, pieces))
        holes = [k for k, c in enumerate(places) if c is None]
        if holes:
            # The many small lists made here hold no cycles, so looking for some is wasted.
            collects = gc.isenabled()
            gc.disable()
            try:
                for lead in (" ", "\n") if self.spaces else ("",):
                    some = [k for k in holes if pieces[k][:1] == "\n"] if lead == "\n" else [k for k in holes if pieces[k][:1] != "\n"]
                    for at in range(0, len(some), part):
                        new = [pieces[k] for k in some[at : at + part]]
                        found = self._learn([p[1:] for p in new], "", [self.line_id]) if lead == "\n" else self._learn(new, lead, [])
                        self.known.update(zip(new, found, strict=True))
                        for k, place in zip(some[at : at + part], found, strict=True):
                            places[k] = place
            finally:
                if collects:
                    gc.enable()
        return np.array(places, np.int64)

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that may hold a special token."""
        odd = np.zeros(len(texts), bool)
        for content, normalized in self.special:
            odd |= pc.match_substring(texts, content, ignore_case=normalized).to_numpy(zero_copy_only=False)
        return odd

    def _blank_lines(self, places: np.ndarray, at: np.ndarray, begins: np.ndarray, first: np.ndarray) -> None:
        """A blank line is a line feed of its own if it is the only one, and the next line begins with no white space."""
        alone = np.zeros(len(places) + 1, bool)
        alone[at] = True
        alone[first] = False
        single = at[alone[at] & begins[np.minimum(at + 1, len(places) - 1)] & ~alone[at - 1]]
        follows = np.zeros(len(places) + 1, bool)
        follows[first] = True
        places[single[~follows[single + 1]]] = self.table.add([[self.line_id]])[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text (no nulls), and all ids one after another."""
        self.used = time.monotonic()
        if len(self.table) > self.most:
            self.known = dict(islice(self.known.items(), self.keep))
            self.table.cut(self.keep)
        n = len(texts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        odd = self._odd(texts)
        # Lines are cut like words: a byte-level piece that begins with a line feed stands for one after it.
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.spaces else " "), " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        # By way of numpy, as Arrow makes a list of strings one scalar at a time.
        pieces, indices = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        del cut, words
        if self.spaces:
            # A text's first piece has no space before it, so its ids are its own; they stay in the table for this batch alone.
            first = ends[:-1]
            heads = [pieces[k] for k in indices[first].tolist()]
            inner = np.ones(len(indices), bool)
            inner[first] = False
            seen = np.zeros(len(pieces), bool)
            seen[indices[inner]] = True
            used = np.flatnonzero(seen)
            places = np.zeros(len(pieces), np.int64)
            places[used] = self._places([pieces[k] for k in used.tolist()])
            places = places[indices]
            size = len(self.table)
            rims = [bool(h) and (h[-1].isspace() or SEPARATORS.search(h) is not None) for h in heads]
            places[first] = self.table.add([e.ids for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)])
            places[first[rims]] = -1
            empty = next((k for k, p in enumerate(pieces) if p == "\n"), None)
            if empty is not None:
                self._blank_lines(places, np.flatnonzero(indices == empty), np.array([p[:1] == "\n" and len(p) > 1 for p in pieces])[indices], first)
        else:
            places, size = self._places(pieces)[indices], len(self.table)
        counts = np.diff(ends)
        odd[np.repeat(np.arange(n), counts)[places < 0]] = True
        if odd.any():
            places = places[np.repeat(~odd, counts)]
            counts = np.where(odd, 0, counts)
        lengths, ids = self.table.gather(places)
        self.table.cut(size)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(ends)
        if odd.any():
            wholes = [np.array(self.whole(texts[k].as_py()), np.uint32) for k in np.flatnonzero(odd).tolist()]
            lengths[odd] = [len(w) for w in wholes]
            out, own = np.empty(int(lengths.sum()), np.uint32), np.repeat(odd, lengths)
            out[~own] = ids
            out[own] = np.concatenate(wholes)
            ids = out
        return lengths, ids


def with_end(lengths: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    ends = np.cumsum(lengths + 1)
    out = np.empty(len(ids) + len(lengths), np.uint32)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[last] = end
    out[~last] = ids
    return lengths + 1, out


def gathered(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, as large batches repeat more of their words."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            give_back()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def give_back() -> None:
    """Hands memory that is free but still held back to the system, as executors are limited by what their workers hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Seconds after which a worker that encodes nothing gives its encoders up: workers outlive tasks, and other work needs the memory.
IDLE = 5.0
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaces: bool) -> PieceEncoder:
    """One encoder for each Python worker, for as long as tasks that encode follow each other."""
    key = (path, spaces)
    one = _encoders.get(key)
    if one is None:
        first, one = not _encoders, PieceEncoder(path, spaces)
        _encoders[key] = one
        if first:
            threading.Thread(target=give_up_idle, daemon=True).start()
    one.used = time.monotonic()
    return one


def give_up_idle() -> None:
    """Only the references kept here go; a task that still holds its encoder goes on with it."""
    while _encoders:
        time.sleep(IDLE / 5)
        idle = [key for key, one in list(_encoders.items()) if time.monotonic() - one.used > IDLE]
        for key in idle:
            _encoders.pop(key, None)
        if idle:
            gc.collect()
            give_back()


def slices(batch, rows: int = 256):
    """An Arrow batch in parts of a few rows, so that little of it is held as Python objects."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
