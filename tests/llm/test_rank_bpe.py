from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import rank_bpe, registry
from tests.llm.helpers import doc, frame, odd_docs, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = list(" \n\t\r 　\u0085\x1cabcABC'stredvm.,!?12²½é日本ñ́\U0001f600\U0001e6e0ʰ​") + ["<|endoftext|>", "<|endof", "the ", "  ", "\n\n", " 's", "'ll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return rank_bpe.RankEncoder(PATH)


def odd_texts(n: int) -> list[str]:
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(n)]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x110000), rng.randrange(0x300)])) for _ in range(60)) for _ in range(n // 5)]


def test_ids_are_those_of_the_library(encoder, library):
    texts = [*odd_texts(6000), "", "a" * 5000, "ab" * 20000, "é" * 300, "x y" * 3000, "\x00", "<|endoftext|>" * 3]
    sizes, ids = encoder.encode(pa.array(texts))
    own = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert own == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_pieces_changes_no_ids(library):
    small = rank_bpe.RankEncoder(PATH, most=50, keep=20)
    for k in range(4):
        texts = [words(60, 10 * k + j) for j in range(5)] + odd_texts(40)
        sizes, ids = small.encode(pa.array(texts))
        assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_short_and_long_words_merge_alike(encoder):
    rng = random.Random(5)
    some = [bytes(rng.choice([rng.randrange(256), *b"theandio "]) for _ in range(rng.randrange(2, 60))) for _ in range(400)] + [b"a" * k for k in range(1, 40)]
    bpe = encoder.tokenizer.bpe
    assert bpe.merge(some) == [bpe.merge_long(w) for w in some]


def test_any_ids_decode_as_the_library_does(encoder, library):
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.randrange(50257 if rng.random() < 0.5 else 256) for _ in range(rng.randrange(1, 9))]
        held, spelled = encoder.tokenizer.bpe.spell(np.array(ids, np.uint32))
        assert str(memoryview(spelled), "utf-8", "replace") == library.decode(ids, skip_special_tokens=False)
    held, spelled = encoder.tokenizer.bpe.spell(np.array([70000, 4_000_000_000, 64], np.uint32))
    assert held.tolist() == [0, 0, 1]


def test_a_tokenizer_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        rank_bpe.RankBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_documents_of_any_kind(spark, library, tmp_path):
    rows = odd_docs() + [doc(100 + k, t) for k, t in enumerate(odd_texts(200))]
    docs = frame(spark, [(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, registry.QUERIES["op11_rank_bpe"](spark, str(tmp_path)).collect()))

    def row(r):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return f"Row(doc_id={r[0]}, n_tokens={len(ids)}, ids_sha256='{hashlib.sha256(np.array(ids, '<u4').tobytes()).hexdigest()}', decoded_sha256='{hashlib.sha256(text.encode()).hexdigest()}')"

    assert got == sorted(row(r) for r in rows)
    whole = rank_bpe.decoded(rank_bpe.encoded(docs, PATH), PATH)
    assert sorted(r.text for r in whole.collect()) == sorted(r[1] or "" for r in rows)
    assert rank_bpe.decoded(rank_bpe.encoded(frame(spark, []), PATH), PATH).count() == 0
