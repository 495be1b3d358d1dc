"""Queries of the subpackage's operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import hmm, ivfpq, mixing, multi_index, packing, pages, phrases, prefix_trie, rank_bpe, simhash, templates, tokenfile, toxicity
from corpusmill.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balanced_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest(table(spark, sf_dir, "embeddings"))


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return rank_bpe.digests(rank_bpe.decoded(rank_bpe.encoded(table(spark, sf_dir, "documents"), path), path))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_token_planes": op3_token_planes,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_hmm": op6_hmm,
    "op7_multi_index": op7_multi_index,
    "op8_page_text": op8_page_text,
    "op9_ivfpq": op9_ivfpq,
    "op10_templates": op10_templates,
    "op11_rank_bpe": op11_rank_bpe,
    "op12_phrases": op12_phrases,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op7_multi_index": multi_index.oracle(),
    "op10_templates": templates.oracle(),
    "op12_phrases": phrases.oracle(),
    "op13_prefix_trie": prefix_trie.oracle(),
}
