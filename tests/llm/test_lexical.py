"""Ranked search against a plain version that scores every document for every item."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from millrace.llm import lexical, queries
from tests.llm.test_contracts import AWKWARD, SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)]"""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    documents, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, counts, n in held:
            m = 100 - 75 + 75 * n * documents // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms(text) if counts[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


def tables(spark, docs, items):
    one = spark.createDataFrame([(i, t, 1, "x", [1]) for i, t in docs], "doc_id long, text string, n int, term string, terms array<int>").repartition(3)
    return one, spark.createDataFrame([(i, t, 2, "y") for i, t in items], "item_id long, text string, item int, key string")


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block_terms", [500_000, 40])
def test_random_texts(spark, block_terms):
    """Few words, many ties, frequent and rare terms, repeated terms of items and copies of documents."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), 59)] for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)]
    assert rows(lexical.search(*tables(spark, docs, items), block_terms=block_terms)) == plain(docs, items)
    assert rows(lexical.search(*tables(spark, docs, items), k=3, block_terms=block_terms)) == plain(docs, items, 3)


def test_awkward_rows(spark):
    """Nulls, empty, long and repeated texts; items and documents that repeat or lack an id; terms beyond ASCII."""
    docs = AWKWARD + [(None, "one two"), (7, "one naïve"), (7, "one naïve"), (50, "z 漢字仮名 z"), (51, "ONE-one_one one9 one9")]
    items = [(1, None), (2, ""), (3, "one"), (3, "ONE two!"), (None, "漢字仮名 naïve"), (5, "nowhere"), (6, " ".join(t or "" for _, t in AWKWARD[:16])), (7, "alpha alpha beta"), (8, "a" * 70_000)]
    assert rows(lexical.search(*tables(spark, docs, items))) == plain(docs, items)
    some, none = tables(spark, docs, items)
    assert lexical.search(some.filter("false"), none).count() == 0
    assert lexical.search(some, none.filter("false")).count() == 0
    assert lexical.search(some.filter("doc_id = 2"), none).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_BYTES", 7)
    text = "Alpha beta, gamma-delta " * 20 + "x" * 40 + "..é"
    assert [t.decode() for part in lexical.term_lists(text.encode()) for t in part] == terms(text)


def test_lengths_beyond_64_bits():
    n, times = np.array([3_000_000_000, 10], np.int64), np.array([5, 1], np.int64)
    want = [10**9 * t // (1000 * t + 8 * (25 + 75 * c * 10**11 // 10**14)) for c, t in zip(map(int, n), map(int, times))]
    assert lexical.parts(n, times, 10**11, 10**14).tolist() == want


def test_candidates_are_few(spark):
    """With a threshold from stored parts, terms that stand everywhere bring up no candidates of their own."""
    bounds = lexical.Bounds(np.zeros(3, np.int64), np.arange(3), np.array([9000, 200, 100]), np.array([9000, 200, 100]) * 10**6, {0: 4 * 10**9})
    assert int(np.argmax(bounds.suffix[0] < bounds.least[0])) == 1


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(queries.QUERIES["op12_lexical_search"](spark, SF)) == sorted(map(repr, duck.execute(queries.ORACLE_SQL["op12_lexical_search"]).fetchall()))
