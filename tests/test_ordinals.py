"""Rows by place: the same rows as a scan gives, from the files of their parts only."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import ordinals


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "b").when(F.col("id") % 5 == 1, "2024").when(F.col("id") % 1000 == 2, None).otherwise("a/x =é").alias("name"), F.floor(F.col("id") / 5).alias("row_index"), F.col("id").alias("value"), F.array("id").alias("more"))
    rows = rows.filter("id % 5 < 3 OR id % 5 IS NULL")
    found = ordinals.OrdinalIndex(spark, str(tmp_path_factory.mktemp("index")), ["name"], 100)
    found.write(rows)
    return found, rows.cache()


def files(df):
    """How many files the scan of a plan without shuffles read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_slices_read_their_parts(index, spark):
    found, rows = index
    for name, start, stop, parts in (("b", 250, 420, 3), ("2024", 0, 100, 1), ("a/x =é", 99, 101, 2), ("none", 0, 50, 0), (None, 0, 1000, 5)):
        got = found.slice({"name": name}, start, stop)
        want = rows.filter(F.col("name").eqNullSafe(name) & F.col("row_index").between(start, stop - 1))
        assert sorted(tuple(r) for r in got.select("row_index", "value").collect()) == sorted(tuple(r) for r in want.select("row_index", "value").collect())
        assert files(got) <= parts


def test_lookups(index, spark):
    found, rows = index
    places = [("b", 3), ("b", 3), ("2024", 999), ("b", 77777), ("none", 1)]
    wanted = spark.createDataFrame(places, "name string, row_index long")
    got = sorted((r["name"], r["row_index"], r["value"], r["more"][0]) for r in found.lookup(wanted).collect())
    assert got == [("2024", 999, 4996, 4996), ("b", 3, 15, 15), ("b", 3, 15, 15)]
    plan = found.lookup(wanted)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_part" in plan.split("PartitionFilters")[1][:300]


def test_many_places_are_joined(index, spark, monkeypatch):
    found, rows = index
    monkeypatch.setattr(ordinals, "NAMED", 3)
    wanted = rows.filter("name = 'b'").select("name", "row_index")
    assert found.lookup(wanted).count() == 1000
    assert {r["name"]: r["n"] for r in found.sizes().collect()} == {r["name"]: r["count"] for r in rows.groupBy("name").count().collect()}
    with pytest.raises(ValueError):
        ordinals.OrdinalIndex(spark, "x", ["name"], 0)
