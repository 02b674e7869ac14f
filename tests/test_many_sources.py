"""Block sizes of many sources: the same as a scan of all sizes, in little time."""

import time

import numpy as np
import pytest

from millrace.plans import mixing


def scan(weights):
    shares = np.array(weights) / max(weights)
    shares = shares / shares.sum()
    return min(mixing.remainders(np.arange(len(weights), mixing.BLOCK_MOST + 1), shares), key=lambda x: x[:3])


def test_same_as_a_scan():
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 20):
        for _ in range(4):
            weights = [float(w) for w in rng.lognormal(0, 1.2, n)]
            want = scan(weights)
            if want[0] > mixing.WORST_ERROR:
                with pytest.raises(ValueError):
                    mixing.ticket_quotas(weights)
            else:
                assert mixing.ticket_quotas(weights) == want[3]


def test_a_thousand_sources():
    rng = np.random.default_rng(1)
    weights = [float(w) for w in rng.uniform(0.9, 1.1, 1000)]
    began = time.time()
    quotas = mixing.ticket_quotas(weights)
    assert time.time() - began < 2
    shares = np.array(weights) / sum(weights)
    assert np.abs(np.array(quotas) / sum(quotas) / shares - 1).max() <= mixing.WORST_ERROR
    with pytest.raises(ValueError, match="too small"):
        mixing.ticket_quotas([float(w) for w in rng.lognormal(0, 3, 1000)])
