from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text))


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" if rng.random() < 0.5 else rng.choice(["the", "of", "and", "to", "in"]) for _ in range(n))


def odd_docs():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        doc(1, words(40, 1)),
        doc(2, None),
        doc(3, ""),
        doc(4, " \t\n\x0b "),
        (None, words(30, 2), None, None, None),
        (None, None, None, None, None),
        doc(5, words(9000, 3), "b"),
        doc(6, words(40, 1)),
        doc(6, words(40, 1)),
        doc(7, words(25, 4), None),
        doc(8, "x" * 5000, "b"),
        doc(9, "é ü   　 日本語 " + words(20, 5), "b"),
    ]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
