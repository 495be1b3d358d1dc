from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from corpusmill.llm import simhash
from tests.llm.helpers import doc, frame, odd_docs, words


def plain(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(marks):
    """Smallest index reachable, over all pairs."""
    label = list(range(len(marks)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(marks))]


def test_fingerprints():
    for text in ["", "  ", "One", "one TWO", "a b c", "É É é", words(200, 1), "tab\tb\x0bc\n d", None]:
        assert simhash.fingerprint(text or "") == plain(text)


def near_marks(n, seed):
    """Clouds of fingerprints a few bits from each other, chains of them, and loners."""
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n // 10):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
        for _ in range(n // 20):
            centre ^= sum(1 << b for b in rng.sample(range(64), 3))
            out.add(centre)
    return sorted(out | {rng.getrandbits(64) for _ in range(n // 4)} | {0})


def test_links_give_the_components_of_all_pairs(spark):
    marks = near_marks(300, 3)
    want = plain_components(marks)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    for longest in (512, 12, 2):  # the less, the more lists are split by further positions; 2: most of those are still too long
        table = spark.createDataFrame([(m,) for m in signed], "mark long")
        links = simhash.near_links(table, longest).collect()
        at = {m: i for i, m in enumerate(signed)}
        label = list(range(len(marks)))

        def root(i, label=label):
            while label[i] != i:
                i = label[i]
            return i

        for a, b in links:
            assert (marks[at[a]] ^ marks[at[b]]).bit_count() <= 3
            x, y = root(at[a]), root(at[b])
            label[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(marks))] == want


def test_lists_are_split_by_the_positions_of_the_minimum():
    for k, own in enumerate(simhash.KEYS):
        rest = [p for p in range(8) if p not in own]
        further = [set(five) - set(own) for five in simhash.FIVES if set(own) <= set(five)]
        assert sorted(map(sorted, further)) == [[a, b] for i, a in enumerate(rest) for b in rest[i + 1 :]], k


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    base = words(120, 1).split(" ")
    rows = odd_docs()
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        rows.append(doc(200 + i, " ".join(w)))
    rows += [doc(400 + i, words(60, 50 + i)) for i in range(40)]
    got = simhash.near_duplicates(frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mark string")).collect()
    marks = [plain(r[1]) for r in rows]
    groups = plain_components(marks)
    least = {}
    for r, g in zip(rows, groups):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted((r[0] if r[0] is not None else -1, f"{m:016x}", least.get(g, -1)) for r, m, g in zip(rows, marks, groups))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [doc(3, words(50, 1)), doc(5, words(50, 1)), doc(4, words(50, 2)), doc(3, words(50, 1)), doc(9, None), doc(8, "")]
    out = simhash.one_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 8]
    assert out.columns == frame(spark, rows).columns


def test_every_component_keeps_exactly_one_row(spark):
    rows = [
        (None, words(50, 1), "en", "a", 1),  # null id, a text of its own
        (None, words(50, 2), "en", "a", 2),  # null ids alone, twice the same text
        (None, words(50, 2), "en", "a", 2),
        (None, words(50, 3), "en", "a", 3),  # a known id goes first
        doc(7, words(50, 3)),
        doc(8, words(50, 4)),  # one id, unrelated texts
        doc(8, words(50, 5)),
        (None, None, None, None, None),  # no text and the empty text are one component
        (None, "", None, None, None),
    ]
    got = [(r.doc_id, r.text or "") for r in simhash.one_of_each(frame(spark, rows)).collect()]
    want = [(None, words(50, 1)), (None, words(50, 2)), (7, words(50, 3)), (8, words(50, 4)), (8, words(50, 5)), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    odd = odd_docs()
    kept = simhash.one_of_each(frame(spark, odd)).collect()
    marks = [plain(r[1]) for r in odd]
    assert len(kept) == len(set(plain_components(marks)))
