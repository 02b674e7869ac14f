"""Values at exact ranks against sorted lists: ties, skew, nulls, few and many values, several passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import selection
from millrace.plans import sampling
from millrace.sources.scratch import Rounds


@pytest.fixture(params=[65_536, 50])
def small(request, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", request.param)
    monkeypatch.setattr(selection, "GRID", 20 if request.param == 50 else 1000)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(1)
    made = {
        "wide": [float(x) for x in np.exp(rng.normal(0, 40, 3000))], "ties": [float(x) for x in rng.integers(0, 4, 3000)], "one": [7.0], "same": [2.0] * 800,
        "edge": [1.0] * 40 + [5.0] * 2500 + [9.0] * 3, "negative": [float(x) for x in rng.normal(-5, 1, 700)], "pair": [3.0, 1.0], "heavy": [0.0] * 1500 + [float(x) for x in rng.random(1500)],
    }
    return made | {None: [1.5, 2.5, 3.5]}


def frame(spark, groups):
    rows = [(g, v, i) for g, vs in groups.items() for i, v in enumerate(vs)] + [("one", None, 9), ("nulls", None, 0)]
    return spark.createDataFrame(rows, "g string, v double, i long").repartition(5)


def test_ranks(spark, groups, small):
    ranks = lambda n: [n * 0, n - 1, n / 2, n * 9 / 10, n, n * 0 - 1]
    got = {(r["g"], r["which"]): (r["rank"], r["n"], r["value"], r["below"]) for r in selection.at_ranks(frame(spark, groups), ["g"], "v", ranks, Rounds(spark, "test")).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(vs)
        for which, rank in enumerate((0, len(vs) - 1, len(vs) // 2, len(vs) * 9 // 10)):
            want[g, which] = (rank, len(vs), vs[rank], sum(v < vs[rank] for v in vs))
    assert got == want


def test_percentiles(spark, groups, small):
    got = {r["g"]: (r["a"], r["b"]) for r in selection.percentiles(frame(spark, groups), ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(tuple(np.percentile(vs, [50, 95])), rel=1e-9), g


def test_quartiles(spark, groups, small):
    docs = frame(spark, groups).filter("v IS NOT NULL")
    got = {(r["g"], r["i"]): r["quartile"] for r in sampling.quartiles(docs, "v", "i", "g").collect()}
    want = {}
    for g, vs in groups.items():
        for place, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(vs))):
            want[g, i] = min(3, 4 * place // len(vs))
    assert got == want


def test_tasks_stay_even(spark):
    """Two groups of many rows: what a task sorts is bounded, the counts are partial sums."""
    rows = spark.range(300_000).selectExpr("id % 2 AS g", "pmod(xxhash64(id), 1000003) / 7.0D AS v")
    out = selection.percentiles(rows, ["g"], "v", {"m": 0.5})
    want = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {r["g"]: r["m"] for r in out.collect()} == pytest.approx(want)
