from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing
from corpusmill.llm.tokens import PieceEncoder
from tests.llm.helpers import doc, frame, odd_docs, words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "  a", "a  b", "a \n b", " lead", "trail ", "don't 's x'll", "tab\tx \ty", "<|endoftext|> hi <|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y  <|ENDOFTEXT|>", "é é ́x", "\x1c a\x1cb", "ΑΣ ΑΣΣ Σ.", "a  b 　c", "x " * 50, "123 45.6 -- !!", "\n\nfoo\n bar", "İstanbul ǅ. ﬁ, straße!", "a! b !c d!e", "日本語 テスト。 word.", "one.\nTwo, three.", "one\n\ntwo.\n\n\nthree\n \nfour\n\n", "\n", "\n\n", "\nx", "\n\nx", "a\n\nb\n\nc d\n\ne.", "a\n\n", "b\n", "\n\n b", "a\n\tb", "a\n's b\n\n(c)", "a\n\n", "a\r\nb\r\n\r\nc", "²³ ½ x²"]


def reference(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaces"), [(BYTES, True), (WORDS, False)])
def test_pieces_give_the_tokenizers_ids(path, spaces):
    plain = reference(path)
    texts = TEXTS + [words(50, i) + ". " + words(5, i + 1).title() + ", end" for i in range(20)]
    for most in (1_000_000, 30):
        codes = PieceEncoder(path, spaces, most, most // 2)
        for some in (texts, texts[5:15], texts[::-1]):
            lengths, ids = codes.encode(pa.array(some))
            for text, own in zip(some, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                assert own.tolist() == plain(text), text
    assert [x.tolist() for x in codes.encode(pa.array([], pa.string()))] == [[], []]


def cuts(n, most):
    first = n if n <= most else n % most or most
    return [(0, first)] + [(k, most) for k in range(first, n, most)]


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (21, [(0, 5), (5, 8), (13, 8)])])
def test_cuts(n, want):
    assert cuts(n, 8) == want
    doc, piece, start, length = packing.cut_points(np.array([3, n, 30]), 8)
    own = doc == 1
    assert list(zip(start[own].tolist(), length[own].tolist(), strict=True)) == want and piece[own].tolist() == list(range(len(want)))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    place, offset = packing.best_fit(lengths, (100, 4, 5200), (1.0, 0.5, 0.5), rule)
    for s in set(place.tolist()):
        own = np.flatnonzero(place == s)
        order = own[np.argsort(offset[own])]
        assert lengths[own].sum() <= 100 and len(own) <= 4
        assert (lengths[own] ** 2).sum() <= 5200 or len(own) == 1
        assert offset[order].tolist() == [0, *np.cumsum(lengths[order])[:-1].tolist()]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("capacity", "weights"), [((100, 4, 5200), (1.0, 0.5, 0.5)), ((100, 100, 10_000), (1.0, 0.01, 0.01))])
def test_every_choice_is_the_best_of_all_open_sequences(rule, capacity, weights):
    """Replays the choices beside a plain search over every sequence opened so far, full ones included."""
    lengths = np.sort(np.random.default_rng(4).integers(1, 100, 300))[::-1]
    place, offset = packing.best_fit(lengths, capacity, weights, rule)
    used = []
    for length, s, at in zip(lengths.tolist(), place.tolist(), offset.tolist(), strict=True):
        need = (length, 1, length * length)
        scores = {}
        for k, load in enumerate(used):
            room = [c - x for c, x in zip(capacity, load, strict=True)]
            if all(n <= r for n, r in zip(need, room, strict=True)):
                if rule == "dot":
                    scores[k] = -sum(w * n * r / c**2 for w, n, r, c in zip(weights, need, room, capacity, strict=True))
                else:
                    scores[k] = sum(w * ((r - n) / c) ** 2 for w, n, r, c in zip(weights, need, room, capacity, strict=True))
        if s == len(used):
            assert not scores
            used.append([0, 0, 0])
        else:
            assert scores[s] <= min(scores.values()) + 1e-12
        assert at == used[s][0]
        used[s] = [x + n for x, n in zip(used[s], need, strict=True)]


def test_best_fit_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 2049, 4000))[::-1]
    place, _ = packing.best_fit(lengths, (2048, 2048, 2048**2), (1.0, 0.01, 0.01), "norm")
    assert place.max() + 1 <= 1.02 * np.ceil(lengths.sum() / 2048)


def test_packed_rows(spark):
    rows = odd_docs() + [doc(100 + i, words(20 + i, i)) for i in range(50)]
    docs = frame(spark, [(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, piece int")
    got = packing.packed_documents(docs, BYTES, most=64).toPandas()
    plain = reference(BYTES)
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array([*plain(text or ""), 0], "<u4")
        for k, (start, length) in enumerate(cuts(len(ids), 64)):
            want.append((doc_id if doc_id is not None else -1, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    have = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int)
    assert sorted(map(tuple, have.values.tolist())) == sorted(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 64 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert packing.packed_documents(frame(spark, []), BYTES).count() == 0
