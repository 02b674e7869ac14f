"""Joins, matching and suppression of boxes in crowded images, against plain loops, and one image of 100,000 boxes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import boxes as B

SHAPE = "image long, idx long, label string, x1 double, y1 double, x2 double, y2 double"


def made(rng, images, n, spread, labels=("a", "b", "")):
    out = []
    for m in range(images):
        for i in range(n):
            x, y = rng.integers(-20, spread, 2)
            side = 2 ** rng.integers(0, 8) if i % 9 else spread
            w, h = rng.integers(0, side + 1, 2)
            out.append((m, i, labels[int(rng.integers(len(labels)))], float(x), float(y), float(x + w), float(y + h)))
    return out


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    inter = max(w, 0.0) * max(h, 0.0)
    union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter
    return inter / union if union > 0 else 0.0


def crosses(a, b):
    return a[3] < b[5] and b[3] < a[5] and a[4] < b[6] and b[4] < a[6]


@pytest.fixture(params=[(4, 4), (128, 512)])
def crowd(request, monkeypatch):
    monkeypatch.setattr(B, "CROWD", request.param[0])
    monkeypatch.setattr(B, "CROWD_PAIRS", request.param[1])


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(3)
    left, right = made(rng, 3, 40, 120), made(rng, 3, 50, 120)
    return left, right, spark.createDataFrame(left, SHAPE).cache(), spark.createDataFrame(right, SHAPE).cache()


def test_joins(two, crowd):
    left, right, a, b = two
    pairs = [(x, y) for x in left for y in right if x[0] == y[0]]
    want = sorted((x[0], x[1], y[1]) for x, y in pairs if crosses(x, y) and iou(x, y) >= 0.2 and (x[2] == y[2] or "" in (x[2], y[2])))
    assert want and sorted((r["image"], r["a_idx"], r["b_idx"]) for r in B.candidates(a, b, 0.2).collect()) == want
    inside = sorted((x[0], x[1], y[1]) for x, y in pairs if y[3] >= x[3] and y[4] >= x[4] and y[5] <= x[5] and y[6] <= x[6])
    assert inside and sorted(tuple(r) for r in B.contained(b, a).collect()) == inside
    n = {(x[0], x[1]): sum(crosses(x, y) for y in right if y[0] == x[0] and y[1] != x[1]) for x in left}
    assert {(r["image"], r["idx"]): r["n"] for r in B.distractors(b, a).collect()} == n


def test_matching(two, crowd):
    left, right, a, b = two
    want = []
    pairs = sorted((-iou(x, y), x[1], y[1], x[0]) for x in left for y in right if x[0] == y[0] and crosses(x, y) and iou(x, y) >= 0.1 and (x[2] == y[2] or "" in (x[2], y[2])))
    seen_a, seen_b = set(), set()
    for k, i, j, m in pairs:
        if (m, i) not in seen_a and (m, j) not in seen_b:
            seen_a.add((m, i))
            seen_b.add((m, j))
            want.append((m, i, j))
    got = B.matched(B.candidates(a, b, 0.1))
    assert sorted((r["image"], r["a_idx"], r["b_idx"]) for r in got.collect()) == sorted(want)


def test_one_side_empty(two, crowd, spark):
    a = two[2].filter("x2 > x1 AND y2 > y1")
    none = a.filter("image <> 1")
    rows = {r["image"]: r for r in B.detection(a, none).collect()}
    assert rows[1]["n_target"] == 0 and rows[1]["f1"] == rows[1]["mean_iou"] == rows[1]["reward"] == 0.0
    assert rows[0]["f1"] == rows[2]["f1"] == 1.0
    assert B.detection(none.filter("false"), none.filter("false")).count() == 0


def test_suppression(two, crowd, spark):
    left, *_ = two
    rows = left + [(5, 0, "a", 0.0, 0.0, 9.0, 9.0)] * 9 + [(6, i, "a", float(i), 0.0, float(i + 10), 10.0) for i in range(60)]
    want = []
    for m in sorted({r[0] for r in rows}):
        kept = []
        for x in sorted(r for r in rows if r[0] == m):
            if not any(k[2] == x[2] and iou(k, x) >= 0.3 for k in kept):
                kept.append(x)
        want += kept
    assert sorted(tuple(r) for r in B.suppressed(spark.createDataFrame(rows, SHAPE), 0.3).collect()) == sorted(want)
    with pytest.raises(ValueError):
        B.suppressed(spark.createDataFrame(rows, SHAPE), 0.0)


def test_an_image_of_100_000_boxes(spark):
    """Boxes on a lattice, each predicted with a shift; the product of the two sides would be 10^10 pairs."""
    side = 316
    n = side * side
    i = F.col("id")
    x, y = (i % side) * 20.0, F.floor(i / side) * 20.0
    boxes = spark.range(n).select(F.lit(0).cast("long").alias("image"), i.alias("idx"), F.lit("a").alias("label"), x.alias("x1"), y.alias("y1"), (x + 16.0).alias("x2"), (y + 16.0).alias("y2"))
    moved = boxes.withColumns({"x1": F.col("x1") + F.col("idx") % 3, "x2": F.col("x2") + F.col("idx") % 3})
    began = time.time()
    row = B.detection(moved, boxes, 0.5).first()
    assert (row["n_pred"], row["n_match"], row["f1"]) == (n, n, 1.0)
    doubled = boxes.unionByName(moved.withColumn("idx", F.col("idx") + n))
    assert B.suppressed(doubled, 0.5).agg(F.count("*"), F.max("idx")).first()[:] == (n, n - 1)
    assert time.time() - began < 300
