"""Scores of generated texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusmill.functions.text import REPLACEMENT, YI_SYLLABLE, casefold, is_blank, nfc_casefold, normalize, squeeze, strip

# Phrases by which a prompt names the language it asks for, tried in this order of languages.
OTHER_TASKS = [
    "是否正确",
    "判断",
    "是否准确",
    "验证翻译",
    "选择",
]
ZH_PHRASES = [
    "中文翻译是什么",
    "汉语翻译是什么",
    "翻译成中文",
    "翻译成汉语",
    "翻译成普通话",
    "翻译为中文",
    "翻译为汉语",
    "翻译为普通话",
    "译成中文",
    "译成汉语",
    "译成普通话",
    "译为中文",
    "译为汉语",
    "译为普通话",
    "翻成中文",
    "翻成汉语",
    "翻成普通话",
    "用中文",
    "用汉语",
    "中文意思",
    "汉语意思",
    "在中文中",
    "在汉语中",
    "转写为中文",
    "转写为汉语",
    "中文怎么说",
    "汉语怎么说",
    "普通话怎么说",
]
YI_PHRASES = [
    "彝文翻译是什么",
    "彝语翻译是什么",
    "翻译成彝文",
    "翻译成彝语",
    "翻译为彝文",
    "翻译为彝语",
    "译成彝文",
    "译成彝语",
    "译为彝文",
    "译为彝语",
    "翻成彝文",
    "翻成彝语",
    "用彝文",
    "用彝语",
    "彝文表达",
    "彝语表达",
    "的彝文",
    "的彝语",
]
EN_PHRASES = [
    "英文翻译是什么",
    "英语翻译是什么",
    "翻译成英文",
    "翻译成英语",
    "翻译为英文",
    "翻译为英语",
    "译成英文",
    "译成英语",
    "译为英文",
    "译为英语",
    "翻成英文",
    "翻成英语",
    "用英文",
    "用英语",
    "英文意思",
    "英语意思",
    "在英文中",
    "在英语中",
    "英文怎么说",
    "英语怎么说",
    "in english",
    "into english",
    "english equivalent",
    "english translation",
    "standard english",
    "mean in english",
    "say it in english",
]
CHRF_ORDERS = 6
CHRF_BETA = 2.0
#: Characters scored together, each of which takes some 150 bytes meanwhile; a longer pair is scored alone.
CHRF_CHARS = 1 << 15


def has_any(text: Column, phrases: list[str]) -> Column:
    return text.rlike("|".join(phrases))


def target_language(prompt: Column, reference: Column) -> Column:
    """yi, zh, en or unknown. Another task in the prompt comes before any language, then the order of the tests is that of the rules."""
    text = normalize(prompt)
    # Normal forms leave Yi syllables alone and make none.
    yi_answer = reference.rlike(YI_SYLLABLE)
    return (
        F.when(has_any(text, OTHER_TASKS), "unknown")
        .when(has_any(text, ZH_PHRASES), "zh")
        .when(has_any(text, YI_PHRASES), "yi")
        .when(has_any(squeeze(nfc_casefold(prompt)), EN_PHRASES), "en")
        .when(text.rlike(YI_SYLLABLE) & ~yi_answer, "zh")
        .when(yi_answer, "yi")
        .otherwise("unknown")
    )


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def contained(reference: Column, hypothesis: Column) -> Column:
    """Whether a reference that is not empty stands in the hypothesis."""
    return (reference != "") & F.contains(hypothesis, reference)


def thinking_span(text: Column) -> Column:
    """Text before the first closing tag and after the last opening tag before that; null without a closing tag. Tags in any case."""
    before = F.element_at(F.split(text, "(?i)</think>", 2), 1)
    parts = F.split(before, "(?i)<think>")
    return F.when(text.rlike("(?i)</think>"), strip(F.element_at(parts, -1)))


def smoke_reasons(response: Column, expected: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(is_blank(response), "empty"),
            F.when(F.contains(response, F.lit(REPLACEMENT)), "unicode_replacement_character"),
            F.when(~F.contains(casefold(response), casefold(expected)), "expected_text_missing"),
        )
    )


def gram_scores(references: list[str], hypotheses: list[str], orders: int = CHRF_ORDERS, beta: float = CHRF_BETA) -> np.ndarray:
    """`chrf2` of pairs of texts, all together: n-grams are numbered order by order, from the number of the gram before and its next character."""
    n_rows, weight = len(references), beta * beta
    texts = [*references, *hypotheses]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(2 * n_rows), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    letters, code = np.unique(chars, return_inverse=True)
    letter, row = code.astype(np.int64), text % max(1, n_rows)
    gram, total, used = letter, np.zeros(n_rows), np.zeros(n_rows)
    for n in range(1, orders + 1):
        at = np.flatnonzero(left >= n)
        if n > 1:
            numbers = gram[at] * len(letters) + letter[at + n - 1]
            gram = np.zeros(len(chars), np.int64)
            gram[at] = np.unique(numbers, return_inverse=True)[1]
        # A gram of a row, and how often either text has it.
        key = row[at] * (len(chars) + 1) + gram[at]
        kinds, place = np.unique(key, return_inverse=True)
        other = text[at] >= n_rows
        both = np.minimum(np.bincount(place[~other], minlength=len(kinds)), np.bincount(place[other], minlength=len(kinds)))
        matched = np.bincount(kinds // (len(chars) + 1), both, minlength=n_rows)
        r, h = sizes[:n_rows] - n + 1, sizes[n_rows:] - n + 1
        some = (r > 0) & (h > 0)
        total[some] += ((1 + weight) * matched[some]) / (weight * r[some] + h[some])
        used += some
    return 100.0 * total / np.maximum(used, 1)


@F.pandas_udf(DoubleType())
def chrf2_column(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
    """`chrf2` of each row where it lies: n-grams of long texts are many more bytes than the texts, so none are shuffled. Null if either text is."""
    out = np.full(len(references), np.nan)
    known = np.flatnonzero((references.notna() & hypotheses.notna()).to_numpy())
    begin, size = 0, 0
    for k, i in enumerate(known.tolist(), 1):
        size += len(references.iloc[i]) + len(hypotheses.iloc[i])
        if size > CHRF_CHARS or k == len(known):
            some = known[begin:k]
            out[some] = gram_scores(references.iloc[some].tolist(), hypotheses.iloc[some].tolist())
            begin, size = k, 0
    return pd.Series(out).astype(object).where(pd.Series(out).notna(), None)


def character_grams(rows: DataFrame, keys: list[str], text: str, orders: int) -> DataFrame:
    """(keys, n, gram) for every run of 1 to `orders` characters."""
    length = F.length(text)
    order = rows.select(*keys, text, F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("n")).where(F.col("n") <= length)
    place = order.select(*keys, text, "n", F.explode(F.sequence(F.lit(1), length - F.col("n") + 1)).alias("at"))
    return place.select(*keys, "n", F.substring(F.col(text), F.col("at"), F.col("n")).alias("gram"))


def chrf2(rows: DataFrame, keys: list[str], reference: str, hypothesis: str, orders: int = CHRF_ORDERS, beta: float = CHRF_BETA) -> DataFrame:
    """(keys, chrf2) of each row of `rows`, whose `keys` name it.

    Mean over orders of the F-score of clipped n-gram matches, times 100. Orders in which either text has no
    n-gram are left out; without any order the score is 0.
    """
    own = character_grams(rows, keys, reference, orders).withColumn("r", F.lit(1)).withColumn("h", F.lit(0))
    other = character_grams(rows, keys, hypothesis, orders).withColumn("r", F.lit(0)).withColumn("h", F.lit(1))
    grams = own.unionByName(other).groupBy(*keys, "n", "gram").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    by_order = grams.groupBy(*keys, "n").agg(F.sum(F.least("r", "h")).alias("both"), F.sum("r").alias("r"), F.sum("h").alias("h")).where("r > 0 and h > 0")
    weight = beta * beta
    # (1 + b) P R / (b P + R) with P = both / h and R = both / r.
    score = F.when(F.col("both") > 0, (1 + weight) * F.col("both") / (weight * F.col("r") + F.col("h"))).otherwise(0.0)
    found = by_order.groupBy(*keys).agg((F.avg(score) * 100).alias("chrf2"))
    return rows.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("chrf2", F.lit(0.0)).alias("chrf2"))
