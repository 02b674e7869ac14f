"""Fill-in-the-middle against a plain version by regular expression, and round trips."""

import hashlib
import random
import re

import duckdb
import pytest

from millrace.llm import fill_middle, queries
from tests.llm.test_contracts import AWKWARD, SF, by_id

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
MARKS = [(101, "has <P> in it"), (102, "<S>"), (103, "a<M"), (104, "ends with <"), (105, "<<S" * 9), (106, "P>a b<"), (107, "<M>x"), (108, "é" * 50), (109, "😀a😀"), (110, "\n\r\t")]


def plain(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_awkward_rows(spark):
    rows = [(k * 1000 + i, t) for k in range(12) for i, t in AWKWARD[:16] + AWKWARD[18:] + MARKS] + AWKWARD[16:18]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, output string").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    assert by_id(made, "n", "form", "prefix_chars", "middle_chars", "output") == {i: plain(i, t) for i, t in rows}
    back = by_id(made.select("doc_id", fill_middle.restored(made["output"], made["form"]).alias("text")), "text")
    assert back == {i: (t or "",) for i, t in rows}
    assert {"plain", "psm", "spm"} == {r["form"] for r in made.select("form").collect()}


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "one two three"), (7, "a b c d e"), (7, "a b c d e"), (7, None)], "doc_id long, text string")
    rows = sorted(map(repr, fill_middle.fill_in_middle(docs).collect()))
    assert len(rows) == 4 and rows[1] == rows[2]
    assert fill_middle.fill_in_middle(docs.filter("false")).count() == 0


def test_places_of_ranked_bits():
    rng = random.Random(3)
    for width in [*range(1, 20), 64, 65, 1000]:
        mask = rng.getrandbits(width)
        places = [p for p in range(width) if mask >> (width - 1 - p) & 1]
        assert [fill_middle.ranked_place(mask, width, k) for k in range(len(places) + 2)] == [*places, width, width]


@pytest.mark.parametrize("rate, spm_rate", [(0, 0), (100, 0), (100, 100)])
def test_rates(spark, rate, spm_rate):
    docs = spark.createDataFrame([(i, f"word {i}, and more") for i in range(40)], "key long, body string")
    forms = {r["form"] for r in fill_middle.fill_in_middle(docs, "key", "body", rate, spm_rate).collect()}
    assert forms == {"plain" if not rate else "spm" if spm_rate else "psm"}


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(queries.ORACLE_SQL["op13_fill_in_middle"])
    names = [d[0] for d in want.description]
    got = [tuple(r[c] for c in names) for r in queries.QUERIES["op13_fill_in_middle"](spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))
