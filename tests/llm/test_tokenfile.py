from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import tokenfile
from tests.llm.helpers import doc, frame, odd_docs, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=12), st.sampled_from(["byte", "bit"]), st.integers(1, 17))
def test_round_trip(docs, mode, block):
    out = io.BytesIO()
    writer = tokenfile.PlaneWriter(out, mode, block)
    for at in range(0, len(docs), 2):
        some = docs[at : at + 2]
        names = [None if k == 2 else k - 5 for k in range(at, at + len(some))]
        writer.add(names, np.array([len(ids) for ids in some]), np.array([i for ids in some for i in ids], "<u4"))
    writer.close()
    reader = tokenfile.PlaneReader(io.BytesIO(out.getvalue()))
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(None if k == 2 else k - 5, ids) for k, ids in enumerate(docs)]
    assert sum(n for _, n, _ in reader.index["chunks"]) == sum(map(len, docs)) == reader.index["n_ids"]
    assert all(n == block for _, n, _ in reader.index["chunks"][:-1])
    for k, (_, n, sizes) in enumerate(reader.index["chunks"]):
        assert len(reader.chunk(k)) == n and len(sizes) == (4 if mode == "byte" else 32)


def test_a_damaged_file_is_refused():
    with pytest.raises(ValueError, match="not a file"):
        tokenfile.PlaneReader(io.BytesIO(b"x" * 100))


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_rows_from_files(spark, mode):
    rows = odd_docs() + [doc(100 + i, words(20 + i, i)) for i in range(40)]
    got = tokenfile.token_round_trip(frame(spark, rows), PATH, mode=mode, block=100).collect()
    t = Tokenizer.from_file(PATH)
    want = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x, *_ in rows]
    have = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in got)
    assert len(have) == len(want)
    key = lambda d, n, c: ((d is not None, d or 0), n, c)
    assert sorted((k, n, c) for k, _, n, c in have) == sorted(key(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    at = 0
    for _, start, n, _ in sorted(have, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [k for k, *_ in sorted(have, key=lambda r: r[1])] == sorted(k for k, *_ in have)
    assert tokenfile.token_round_trip(frame(spark, []), PATH).count() == 0
