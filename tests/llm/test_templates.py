from __future__ import annotations

import random
import re

from corpusmill.llm import templates
from tests.llm.helpers import doc, frame, odd_docs, words

SPACE = r"[\x20\x09-\x0D]+"


MASK = "<*>"


def brute(rows, depth=3, variable=15):
    """Kept lines by doc_id, for documents with ids of their own, from sets of distinct lines and templates written out as tuples."""
    cut = {}
    for doc_id, text, *_ in rows:
        for k, line in enumerate((text or "").split("\n")):
            tokens = tuple(MASK if re.search("[0-9]", t) else t for t in re.split(SPACE, line) if t)
            if any(t != MASK for t in tokens):
                cut[doc_id, k] = tokens
    leaves = {}
    for tokens in set(cut.values()):
        leaves.setdefault((len(tokens), tokens[:depth]), []).append(tokens)
    templates = {}
    for members in leaves.values():
        for tokens in members:
            places = [i for i in range(depth, len(tokens)) if tokens[i] != MASK]
            places.sort(key=lambda i: (sum(m[i] == tokens[i] for m in members), i))
            n_words = sum(t != MASK for t in tokens)
            made = list(tokens)
            own = [tuple(made)]
            for i in places[: n_words * variable // 100]:
                made[i] = MASK
                own.append(tuple(made))
            templates[tokens] = [(tokens[:depth], t) for t in own]
    first = {}
    for (doc_id, _), tokens in cut.items():
        for t in templates[tokens]:
            first[t] = min(first.get(t, doc_id), doc_id)
    gone = {key for key, tokens in cut.items() if any(first[t] < key[0] for t in templates[tokens])}
    out = {}
    for doc_id, text, *_ in rows:
        kept = [x for k, x in enumerate((text or "").split("\n")) if (doc_id, k) not in gone]
        out[doc_id] = (text if text is None else "\n".join(kept), sum(d == doc_id for d, _ in gone))
    return out


def corpus():
    rng = random.Random(3)
    shared = [words(n, 1000 + n) for n in (5, 9, 17, 30, 60)]
    rows = []
    for i in range(120):
        lines = [words(rng.randrange(1, 40), 7 * i + k) for k in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            line = rng.choice(shared).split(" ")
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = f"field{rng.choice(['', 5, 77])}"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(line))
        if rng.random() < 0.3:
            lines.append(f"Visited page {rng.randrange(1000)} on day {rng.randrange(30)} of this year")
        rows.append(doc(i, "\n".join(lines)))
    rows.append(doc(500, rows[7][1]))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.text, r.n_dropped) for r in templates.without_repeated_lines(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert sum(n for _, n in got.values()) > 50 and got[500][1] >= 1


def texts_after(spark, *texts, **options):
    got = templates.without_repeated_lines(frame(spark, [doc(k, t) for k, t in enumerate(texts)]), **options)
    return [r.text for r in got.orderBy("doc_id").collect()]


def test_fields_and_changed_words_are_generalised(spark):
    long = words(40, 1)
    changed = long.split(" ")
    for k in (7, 17, 29):
        changed[k] = f"other{'abc'[k % 3]}"
    texts = ["Order 12 was sent on 3 May\n" + long, "Order 990 was sent on 30 May\nown line of the second text", " ".join(changed), "Order twelve was sent on 3 May"]
    assert texts_after(spark, *texts) == [texts[0], "own line of the second text", "", texts[3]]


def test_a_name_is_a_variable_field(spark):
    texts = [f"Dear customer your order for {name} has been shipped today" for name in ("Alice", "Bob", "Carol", "Dave", "Alice")]
    assert texts_after(spark, *texts) == [texts[0], "", "", "", ""]


def test_pieces_of_several_lines_make_no_template(spark):
    texts = ["the quick brown fox jumps over lazy dogs near rivers", "the quick brown cat sleeps under warm sun all day", "the quick brown fox jumps under warm sun all day"]
    assert texts_after(spark, *texts) == texts


def test_short_lines_and_lines_of_numbers(spark):
    texts = ["All rights reserved.\n1 2 3\nYes\n\nx", "All rights reserved.\n4 5 6\nNo\n\ny", "All rights\n7\nYes no"]
    assert texts_after(spark, *texts) == [texts[0], "4 5 6\nNo\n\ny", texts[2]]


def test_white_space_within_a_line(spark):
    texts = ["some  words\tof a\x0bline \nend", " some words of a line\n\tend\t", "\t"]
    assert texts_after(spark, *texts) == [texts[0], "", "\t"]


def test_a_line_that_most_documents_hold(spark):
    texts = ["the same line\n" + words(12, k) for k in range(300)]
    assert texts_after(spark, *texts) == [texts[0], *(t.split("\n")[1] for t in texts[1:])]


def test_odd_rows(spark):
    rows = odd_docs()
    docs = frame(spark, [(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf int, row_key int, lines int, gone_lines int, n_dropped int")
    got = templates.without_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped_"]
    have = got.collect()
    assert len(have) == len(rows)
    # Rows 6 repeat row 1; rows that share an id do not repeat each other; short texts, nulls and empties stay.
    by = {}
    for r in have:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by[6]] == ["", ""] and by[1][0].text == rows[0][1]
    assert by[2][0].text is None and by[2][0].n_lines == 0 and by[3][0].text == "" and by[4][0].text == rows[3][1]
    assert by[5][0].text == rows[6][1]
    assert templates.without_repeated_lines(frame(spark, [])).count() == 0
    same = [doc(1, words(20, 3) + "\n" + words(20, 3)), doc(1, words(20, 3))]
    assert all(r.n_dropped == 0 for r in templates.without_repeated_lines(frame(spark, same)).collect())


def test_no_python_in_the_plan(spark):
    plan = templates.without_repeated_lines(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
