"""Every query of the core library against its SQL in DuckDB, and rules that the others' rows must keep."""

import decimal
from collections import Counter

import duckdb
import pytest

from millrace import all_queries as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    """Values that both engines write alike."""
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return tuple(map(plain, value.values())) if isinstance(value, dict) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs_again_alike(spark, name):
    first = sorted(map(repr, queries.QUERIES[name](spark, SF).collect()))
    assert first and first == sorted(map(repr, queries.QUERIES[name](spark, SF).collect()))


def test_shuffled_draws_cover_each_row_alike(spark):
    rows = queries.QUERIES["concat_shuffled_plan"](spark, SF).collect()
    times = Counter((r["source"], r["row_index"]) for r in rows)
    assert max(times.values()) - min(times.values()) <= 1


def test_packs_hold_their_capacity(spark):
    rows = queries.QUERIES["greedy_packs"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault((r["window"], r["round"], r["pack_index"]), []).append(r["tokens"])
    assert max(sum(v) for k, v in by.items() if k[1] is not None) <= 32_768
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all((r["status"] == "oversize") == (r["tokens"] > 32_768) == (r["round"] is None) for r in rows)
