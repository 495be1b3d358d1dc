"""Tokenizers as columns: a registry of native ones, and plug-ins given as Python callables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE

Counter = Callable[[Column], Column]

WORD = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
assert SPACE[1:-1] in WORD

#: Token counts by tokenizer: characters, words and single marks, UTF-8 bytes.
TOKENIZERS: dict[str, Counter] = {
    "char": lambda t: F.length(t),
    "word": lambda t: F.regexp_count(t, F.lit(WORD)),
    "utf8byte": lambda t: F.octet_length(t),
}


def token_count(text: Column, tokenizer: str = "char") -> Column:
    return TOKENIZERS[tokenizer](text).cast("long")


def register(name: str, encode: Callable[[str], list[int]]) -> None:
    """A plug-in tokenizer by name; texts go to it in Arrow batches."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(encode(t)))

    TOKENIZERS[name] = count


def ids_column(encode: Callable[[str], list[int]]) -> Counter:
    """A function of text columns that gives token ids. Encoders may give a list, a list of one list, or a mapping with `input_ids`."""

    def plain(found) -> list[int]:
        found = found["input_ids"] if hasattr(found, "keys") else found
        return list(found[0] if len(found) and isinstance(found[0], (list, tuple)) else found)

    @F.pandas_udf("array<long>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else plain(encode(t)))

    return ids


def stop_ids(eos: Column, named: Column, unknown: Column) -> Column:
    """Sorted stop ids: the tokenizer's own and those of named end markers, without the unknown id and negative ones."""
    kept = F.filter(named, lambda i: (i >= 0) & ~i.eqNullSafe(unknown))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(eos, F.array().cast("array<long>")), kept)))


def generated_length(ids: Column, stops: Column) -> Column:
    """Place of the first stop id, itself counted, or all ids."""
    places = F.filter(F.transform(stops, lambda s: F.array_position(ids, s)), lambda p: p > 0)
    return F.coalesce(F.array_min(places), F.size(ids).cast("long"))


def stop_reason(ids: Column, stops: Column) -> Column:
    return F.when(F.arrays_overlap(ids, stops), "eos").otherwise("length")
