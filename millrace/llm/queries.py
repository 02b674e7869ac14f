"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, fill_middle, language, lexical, line_dedup, mixing, pieces, pii, quality, simhash, substring_dedup, token_counts, token_files


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, distance=3)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), kind="bpe")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files.token_files(docs, path, vocabulary=49_408, end_id=1, with_ids=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), kind="bpe")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=13, with_text=False)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "benchmark")), k=10)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_language": op11_language,
    "op12_lexical_search": op12_lexical_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
    "op13_fill_in_middle": fill_middle.ORACLE_SQL,
}
