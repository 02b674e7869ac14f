"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, tokens. Each stage takes the last one's documents.

A row is a document, whatever its id: stages join by a number of the row, as ids may be null or repeated. Columns that
a stage needs for itself have names that begin with an underscore; columns of the documents that do so too are called otherwise within
a stage. All other columns go through as they are, maps and variants among them.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, pieces, quality, simhash
from millrace.llm.scratch import ROW_HASH, ROW_KEY, aside, materialize, numbered, row_hash


def columns(docs: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def own_names(stage):
    """A stage over documents whose columns have none of the reserved names, and their own names again behind it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, back = aside(docs)
        return stage(spark, docs, sf_dir).withColumnsRenamed(back)

    return run


@own_names
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns as they are.

    A null or empty text fails. Null and repeated ids are judged row by row. An empty table gives no rows.
    """
    # rows that are equal in all columns are judged alike, so 128 bits of hash name a row and no copy of the texts is kept
    rows = docs.withColumns({ROW_KEY: row_hash(docs), ROW_HASH: row_hash(docs, 7)})
    kept = quality.judge(rows, ROW_KEY, along=(ROW_HASH,)).filter("kept").select(F.col("doc_id").alias(ROW_KEY), ROW_HASH)
    return rows.join(kept, [ROW_KEY, ROW_HASH], "left_semi").select(columns(docs))


@own_names
def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier ones; n_chars follows, other columns stay.

    Earlier is by doc_id; rows of one id stand in the order of a hash of their columns, each for itself. Rows without an
    id lose nothing. A null text stays null, with n_chars null. An empty table gives no rows.
    """
    rows = numbered(docs.filter("doc_id IS NOT NULL").orderBy("doc_id", row_hash(docs)), "line-rows")
    new = line_dedup.dedup_lines(rows, ROW_KEY).select(F.col("doc_id").alias(ROW_KEY), F.col("text").alias("_new_text"))
    rows = rows.drop("text").join(new, ROW_KEY).withColumnRenamed("_new_text", "text").select(columns(docs)).unionByName(docs.filter("doc_id IS NULL"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(columns(docs))


@own_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: 5-word shingles, Jaccard similarity of 0.8 or more.

    Of rows of one id in a group the one with the smallest hash of its columns stays. Rows without an id stay; null, empty
    and blank texts are copies of each other. Columns stay as they are. An empty table gives no rows.
    """
    rows = numbered(docs, "near-rows")
    named = rows.filter("doc_id IS NOT NULL")
    places = named.select(ROW_KEY, F.struct("doc_id", ROW_HASH, ROW_KEY).alias("_at"))
    groups = simhash.similar_documents(named, ROW_KEY).select(F.col("doc_id").alias(ROW_KEY), F.col("component_id").alias("_group"))
    first = groups.join(places, ROW_KEY).groupBy("_group").agg(F.min("_at").alias("_at")).select(F.col(f"_at.{ROW_KEY}").alias(ROW_KEY))
    return named.join(first, ROW_KEY, "left_semi").unionByName(rows.filter("doc_id IS NULL")).select(columns(docs))


@own_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; a document of which only some blocks are drawn is cut to these.

    Null and repeated ids are rows like others, a null source is a source. Null and empty texts are never taken. n_chars
    follows a cut text, other columns stay. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document under the SentencePiece model, with the text that they decode to; a row for each row.

    A null text counts as empty and has no ids. Columns other than doc_id and text are not read.
    """
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), kind="bpe")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", remove_lines),
    ("simhash near-dedup", near_duplicates),
    ("mix sources", mix_sources),
    ("sentencepiece", encode),
]

#: Shingle similarity, expectation-maximisation and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
