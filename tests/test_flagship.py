"""The flagship query, and samples by quota, against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from math import sqrt

import pytest

from millrace import queries
from millrace.plans import packing

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def test_flagship(spark):
    """Documents that are not labelled bad, each text once, dealt by quotas in spread order, packed by windows of 64 draws."""
    bad = {r["doc_id"] for r in rows_of(spark, "labels") if r["quality"] == 0}
    first = {}
    for r in sorted(rows_of(spark, "documents"), key=lambda r: r["doc_id"]):
        if r["doc_id"] not in bad:
            first.setdefault(r["text"], r)
    by = defaultdict(list)
    for r in sorted(first.values(), key=lambda r: r["doc_id"]):
        by[r["source"]].append(max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
    names, total = sorted(by), len(first)
    exact = [round(len(by[n]) / total * 512, 9) for n in names]
    quota = [int(x) for x in exact]
    for i in sorted(range(len(names)), key=lambda i: (-(exact[i] - int(exact[i])), i))[: 512 - sum(quota)]:
        quota[i] += 1
    tickets = sorted(((2 * k + 1) / (2 * quota[i]), i, k) for i in range(len(names)) for k in range(quota[i]))
    windows = defaultdict(dict)
    for d in range(total):
        _, i, k = tickets[d % 512]
        windows[d // 64][d] = by[names[i]][(d // 512 * quota[i] + k) % len(by[names[i]])]
    want = {}
    for w, size in windows.items():
        packs, over = Counter(), 0
        for d, turn, pack, _ in packing.packed_rounds(size, 2, queries.CAPACITY):
            over += turn is None
            if turn is not None:
                packs[turn, pack] += size[d]
        padded = len(packs) * max(packs.values(), default=0)
        want[w] = (len(packs), len(size) - over, sum(packs.values()), padded, over, pytest.approx(1 - sum(packs.values()) / padded if padded else 0.0))
    got = {r["window"]: tuple(r[c] for c in ("packs", "segments", "tokens", "padded_tokens", "oversize", "padding")) for r in queries.flagship(spark, SF).collect()}
    assert got == want


def lowest(ids, seed, stratum, n):
    return set(sorted(ids, key=lambda i: (hashlib.sha256(f"{seed}:{stratum}:{i}".encode()).hexdigest(), i))[:n])


def shared(target, weight, room):
    """``target`` by weight, none above its room; what does not fit goes round again, rests to the largest."""
    got, left = dict.fromkeys(weight, 0), min(target, sum(room.values()))
    while left > 0:
        live = {k: w for k, w in weight.items() if got[k] < room[k]}
        share = {k: left * w / sum(live.values()) for k, w in live.items()}
        whole = {k: min(int(x + 1e-9), room[k] - got[k]) for k, x in share.items()}
        if not any(whole.values()):
            whole = dict.fromkeys(sorted(live, key=lambda k: (-(share[k] - int(share[k] + 1e-9)), k))[:left], 1)
        for k, n in whole.items():
            got[k], left = got[k] + n, left - n
    return got


def test_sample_by_square_roots(spark):
    by = defaultdict(list)
    for r in rows_of(spark, "documents"):
        by[r["lang"]].append(r["doc_id"])
    got = shared(120, {k: sqrt(len(v)) for k, v in by.items()}, {k: len(v) for k, v in by.items()})
    want = {i for k, ids in by.items() for i in lowest(ids, "sqrt", k, got[k])}
    assert {r["doc_id"] for r in queries.QUERIES["sqrt_quota_sample"](spark, SF).collect()} == want


def test_sample_with_a_capped_class(spark):
    """All bad documents, and as many good ones as are 0.4 of the whole: one of each language, then by number."""
    quality = {r["doc_id"]: r["quality"] for r in rows_of(spark, "labels")}
    docs = [r for r in rows_of(spark, "documents") if r["doc_id"] in quality]
    by = defaultdict(list)
    for r in docs:
        if quality[r["doc_id"]] == 1:
            by[r["lang"]].append(r["doc_id"])
    limit = int(0.4 / 0.6 * sum(quality[r["doc_id"]] != 1 for r in docs))
    one = {k: 1 for k in sorted(by)[:limit]}
    more = shared(limit - len(one), {k: len(v) for k, v in by.items()}, {k: len(v) - one.get(k, 0) for k, v in by.items()})
    want = {i for k, ids in by.items() for i in lowest(ids, "cap", k, one.get(k, 0) + more[k])} | {r["doc_id"] for r in docs if quality[r["doc_id"]] != 1}
    assert {r["doc_id"] for r in queries.QUERIES["class_cap_sample"](spark, SF).collect()} == want


def test_a_window_of_oversize_draws(spark):
    rows = spark.createDataFrame([(0, 1, 5), (0, 2, 99), (1, 3, 99)], "window long, draw_id long, tokens long")
    stats = packing.pack_stats(packing.greedy_packs(rows, "window", 2, 10), ["window", "round", "pack_index"], ["window"])
    got = {r["window"]: (r["packs"], r["segments"], r["tokens"], r["padded_tokens"], r["oversize"], r["padding"]) for r in stats.collect()}
    assert got == {0: (1, 1, 5, 5, 1, 0.0), 1: (0, 0, 0, 0, 1, 0.0)}
