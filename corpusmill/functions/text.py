"""Unicode text functions as columns.

White space and folding follow Python's definitions, which Java's regular expressions and Spark's `trim` and
`lower` do not share. Text up to U+02FF is handled by built-ins; normal form C and full case folding above that
have no built-in and use Arrow functions, which then see those texts alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The 29 code points that count as white space; ranges of Yi syllables and radicals.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
YI_SYLLABLE = r"[\x{A000}-\x{A48F}]"
YI_RADICAL = r"[\x{A490}-\x{A4CF}]"
NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]+"
REPLACEMENT = "�"
#: Code points below U+0300 are in normal form C, in any order.
SIMPLE = r"^[\x00-\x{2ff}]*$"
#: Letters and signs above that of scripts without case and of Cyrillic, none of which combines with another character: texts of these are in normal form C.
CASELESS = r"\x{2010}-\x{2027}\x{2030}-\x{205e}\x{3001}-\x{3029}\x{3030}-\x{303e}\x{3041}-\x{3096}\x{30a0}-\x{30ff}\x{4e00}-\x{9fff}\x{a000}-\x{a48c}\x{a490}-\x{a4c6}\x{ac00}-\x{d7a3}"
COMPOSED = rf"^[\x00-\x{{2ff}}\x{{400}}-\x{{482}}\x{{48a}}-\x{{52f}}{CASELESS}]*$"
#: Full case folding leaves these letters as they are.
FOLDED = rf"^[\x00-\x{{2ff}}{CASELESS}]*$"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t).casefold())


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else t.casefold())


def or_empty(text: Column) -> Column:
    """Null reads as the empty text; other types are written as text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def nfc(text: Column) -> Column:
    simple = text.rlike(COMPOSED)
    return F.when(simple, text).otherwise(_nfc(F.when(~simple, text)))


def _folded(text: Column, other: Callable[[Column], Column]) -> Column:
    simple = text.rlike(FOLDED)
    native = F.translate(text, "µſ", "μs")
    for letter, folded in (("ß", "ss"), ("ŉ", "ʼn"), ("ǰ", "ǰ")):
        native = F.replace(native, F.lit(letter), F.lit(folded))
    return F.when(simple, F.lower(native)).otherwise(other(F.when(~simple, text)))


def casefold(text: Column) -> Column:
    """Full case folding. Below U+0300 five letters fold in another way than they are lowered."""
    return _folded(text, _casefold)


def nfc_casefold(text: Column) -> Column:
    """Normal form C, then full case folding, in one step: a task has a Python worker for each step that waits for another."""
    return _folded(text, _nfc_casefold)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def normalize(text: Column) -> Column:
    """Normal form C, runs of white space as one space, none at the ends."""
    return squeeze(nfc(text))


def compact(text: Column) -> Column:
    """Normal form C, case folded, letters and digits alone."""
    return F.regexp_replace(nfc_casefold(text), NOT_ALPHANUMERIC, "")


def count_yi_syllables(text: Column) -> Column:
    return F.regexp_count(text, F.lit(YI_SYLLABLE))


def count_yi_radicals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(YI_RADICAL))


def count_visible(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def yi_ratio(text: Column) -> Column:
    """Share of Yi syllables among visible characters, 0 without any."""
    visible = count_visible(text)
    return F.when(visible > 0, count_yi_syllables(text) / visible).otherwise(F.lit(0.0))


def yi_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x{A000}-\x{A48F}]", "")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalize(text), 256)
