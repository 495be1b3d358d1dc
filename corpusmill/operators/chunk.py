"""Lossless cutting of texts into pieces of a bounded number of tokens."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import or_empty


def character_chunks(text: Column, most: int) -> Column:
    """Chunks of `most` characters, the last one shorter; an empty text has none."""
    n = F.ceil(F.length(text) / most).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * most + 1, F.lit(most)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def longest_prefix(count: Callable[[str], int], text: str, most: int) -> int:
    """Characters of a prefix of at most `most` tokens: doubled until it is too long, then bisected. Counts are taken as growing with the prefix."""
    low, high = 0, min(len(text), most)
    while high < len(text) and count(text[:high]) <= most:
        low, high = high, min(len(text), 2 * high)
    if count(text[:high]) <= most:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if count(text[:mid]) <= most else (low, mid)
    return low


def cut_text(count: Callable[[str], int], text: str, most: int) -> list[str] | None:
    """Chunks that join to `text`; None if one character alone has more than `most` tokens."""
    out = []
    while text:
        n = longest_prefix(count, text, most)
        if not n:
            return None
        out.append(text[:n])
        text = text[n:]
    return out


def token_chunks(encode: Callable[[str], list[int]], most: int) -> Callable[[Column], Column]:
    """Chunks by a plug-in tokenizer; null where a character alone is over the bound."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_text(lambda x: len(encode(x)), t, most))

    return chunks


def chunked(records: DataFrame, most: int = 2048, key: str = "doc_id", cut: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per chunk with all columns of its record, `text` cut and `derived_chunk` set; records that cannot be cut with `error`)."""
    if most < 2:
        raise ValueError("a chunk must have room for 2 tokens")
    own = records.withColumn("chunks", cut(or_empty(F.col("text"))) if cut else character_chunks(or_empty(F.col("text")), most))
    error = F.when(or_empty(F.col("text")) == "", "text_empty").when(F.col("chunks").isNull(), "character_over_bound")
    marked = own.withColumn("error", error)
    rows = marked.where("error is null").select(*records.columns, F.size("chunks").alias("chunk_count"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    derived = F.struct(F.col(key).alias("source_line"), F.col("chunk_index").alias("chunk_index"), F.col("chunk_count").alias("chunk_count"))
    names = [F.col("chunk").alias("text") if c == "text" else F.col(c) for c in records.columns]
    return rows.select(*names, derived.alias("derived_chunk")), marked.where("error is not null").select(*records.columns, "error")


def chunk_manifest(records: DataFrame, chunks: DataFrame, tokens: Callable[[Column], Column] = F.length) -> DataFrame:
    """One row of totals; `conserved` says that no character was lost. Records without text are not counted."""
    n = F.length("text").cast("long")
    before = records.where("text <> ''").agg(F.count("*").alias("records"), F.coalesce(F.sum(n), F.lit(0)).alias("input_characters"))
    after = chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if((F.col("derived_chunk.chunk_index") == 0) & (F.col("derived_chunk.chunk_count") > 1)).alias("split_records"),
        F.coalesce(F.sum(n), F.lit(0)).alias("output_characters"),
        F.coalesce(F.sum(tokens(F.col("text")).cast("long")), F.lit(0)).alias("tokens"),
        F.coalesce(F.max(tokens(F.col("text")).cast("long")), F.lit(0)).alias("max_chunk_tokens"),
    )
    return before.crossJoin(after).withColumn("conserved", F.col("input_characters") == F.col("output_characters"))


def require_conserved(manifest: DataFrame) -> DataFrame:
    """`manifest`, or an error at run time."""
    return manifest.where(F.assert_true(F.col("conserved"), F.lit("chunks do not hold all characters")).isNull())
