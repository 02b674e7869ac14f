"""Connected components against a union-find, and the rounds that paths take."""

import numpy as np
import pytest

from millrace.llm import components
from tests.llm import brute


def found(spark, links, nodes):
    rows = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {n: n for n in nodes} | {r["node"]: r["component"] for r in rows}


@pytest.mark.parametrize("order", ["ascending", "descending", "random"])
def test_a_path_of_ten_thousand_nodes(spark, monkeypatch, order):
    n = 10_000
    names = {"ascending": np.arange(n), "descending": np.arange(n)[::-1], "random": np.random.default_rng(0).permutation(n)}[order].tolist()
    rounds = []
    step = components.small_star
    monkeypatch.setattr(components, "small_star", lambda edges: rounds.append(1) or step(edges))
    assert found(spark, list(zip(names, names[1:])), range(n)) == dict.fromkeys(range(n), 0)
    assert len(rounds) <= 20


def test_random_graphs(spark):
    rng = np.random.default_rng(1)
    for n, m in ((60, 40), (200, 190), (50, 300)):
        links = rng.integers(0, n, (m, 2)).tolist()
        assert found(spark, links, range(n)) == brute.smallest_reachable(range(n), links)


def test_null_ends_and_no_links(spark):
    assert found(spark, [(None, 3), (4, None), (5, 5), (7, 6)], [6, 7]) == {6: 6, 7: 6}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
