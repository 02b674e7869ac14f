"""Null and repeated ids in every stage of the pipeline: each row is a document."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A = "one line of a text with quite enough words for all of the rules"
B = "another passage that has nothing in common beside it and says other things"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(documents):
    """Ids null, repeated and unique, a third each."""
    return documents.withColumn("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE doc_id END"))


def test_quality_rules(spark, documents, odd):
    texts = lambda df: Counter(r["text"] for r in corpus_pipeline.quality_rules(spark, df, "").select("text").collect())
    assert texts(odd) == texts(documents)


def test_line_dedup(spark):
    rows = [(None, A), (None, A), (5, A), (5, A), (6, A), (6, B)]
    assert rows_of(corpus_pipeline.remove_lines(spark, table(spark, rows), "")) == Counter([(None, A), (None, A), (5, A), (5, ""), (6, ""), (6, B)])


def test_near_duplicates(spark):
    rows = [(None, A), (None, A), (5, A), (5, A), (6, A), (5, B), (6, B)]
    assert rows_of(corpus_pipeline.near_duplicates(spark, table(spark, rows), "")) == Counter([(None, A), (None, A), (5, A), (5, B)])


def test_mix(spark, odd):
    for docs in (odd, table(spark, [(5, A), (5, A), (None, B), (None, B)])):
        taken = Counter()
        for r in mixing.taken_words(docs).collect():
            taken[r["doc_id"]] += r["taken"]
        got = Counter()
        for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
            got[r["doc_id"]] += len(brute.words(r["text"]))
        assert +got == +taken and got[None] > 0


def test_sentencepiece(spark, odd):
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.encode(spark, odd, "")) == ids(odd)


def test_columns_of_any_name_and_type(spark):
    """Columns called like those a stage makes for itself, and maps and variants, go through every stage as they are."""
    more = ("_row_key", "_row_hash", "_new_text", "_at", "_group", "_slice", "_of_row", "x_at", "dot.ted", "line", "key", "first", "size", "rep", "fp", "n", "h1")
    docs = table(spark, [(1, A), (2, A + " twice over"), (3, B), (None, B), (3, B)])
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(more)}).withColumns({"map": F.expr("map('a', doc_id, 'b', 2L)"), "maps": F.expr("array(map(1, map('x', 2)))"), "variant": F.expr("parse_json('{\"k\": 1}')")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.select(*("`" + c.replace("`", "``") + "`" for c in more), "map", F.col("maps")[0][1]["x"].alias("inner"), F.expr("variant_get(variant, '$.k', 'int')").alias("k")).collect()
        assert rows and all(tuple(r)[: len(more)] == tuple(range(len(more))) and r["map"]["b"] == 2 and r["inner"] == 2 and r["k"] == 1 for r in rows), name
    assert corpus_pipeline.encode(spark, docs, "").count() == 5
