"""What a query works out stays within its rows: a text is judged once, an expression is not written out again at each use."""

import math
import random
import re

from pyspark.sql import functions as F

from millrace import all_queries as queries
from millrace.functions import geometry as G
from millrace.functions import polylines as P
from millrace.operators import annotations as A
from millrace.operators import attributes as T
from millrace.streaming import draws

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def judged_once(spark, name, keys):
    """Rows are brought together by text before anything is read from it, and that in few places."""
    lines = plan(queries.QUERIES[name](spark, SF)).splitlines()
    alike = next(k for k, line in enumerate(lines) if re.search(r"Aggregate \[" + ", ".join(rf"{key}#\d+" for key in keys) + r"\], ", line))
    below = "".join(lines[alike + 1 :])
    assert "from_json" not in below and "get_json_object" not in below
    assert "".join(lines).count("from_json(") <= 5


def test_first_valid_attempt_judges_each_text_once(spark):
    judged_once(spark, "first_valid_attempt", ["parameters", "source"])


def test_parsed_reads_a_text_once(spark):
    rows = spark.createDataFrame([('{"a":1,"b":"x","c":true,"z":[1]}',), ('{"c":"true"}',), ("[1]",), ("no",), (None,)], "t string")
    out = rows.select(T.parsed(F.col("t"), "a", "b", "c", booleans=("c",)).alias("p"))
    text = out._jdf.queryExecution().analyzed().toString()
    assert text.count("from_json(") == 1 and text.count("json_object_keys(") == 1
    assert [(r["p"]["a"], r["p"]["b"], r["p"]["c"], r["p"]["all"], r["p"]["there"]) for r in out.collect()] == [
        ("1", "x", "true", ["a", "b", "c", "z"], True), (None, None, None, ["c"], True), (None, None, None, [], False), (None, None, None, [], False), (None, None, None, [], False)]


def test_line_contract_judges_each_text_once(spark):
    judged_once(spark, "line_contract", ["parameters", "source"])


def test_line_macros_judges_each_text_once(spark):
    judged_once(spark, "line_macros", ["parameters"])


def test_line_strata_judges_each_text_once(spark):
    judged_once(spark, "line_strata", ["parameters"])


def test_shape_contract_judges_each_text_once(spark):
    judged_once(spark, "shape_contract", ["parameters"])


def test_shape_strata_judges_each_text_once(spark):
    judged_once(spark, "shape_strata", ["parameters"])


def test_padded_canvases_halve_together(spark):
    assert "aggregate(" not in plan(queries.QUERIES["padded_canvases"](spark, SF))


def test_aligned_size_is_the_best_candidate(spark):
    rows = spark.createDataFrame([(w, h) for w in (1, 33, 200, 640, 1999) for h in (2, 47, 480, 3000)] + [(0, 5), (None, 5)], "w long, h long")
    size = F.col("size")
    rows = rows.select("w", "h", G.aligned_size(F.col("w"), F.col("h"), 400_000, 300_000, 500_000, upscale=40.0).alias("size"))
    got = {(r["w"], r["h"]): r["size"] for r in rows.collect()}
    assert got[0, 5] is None and got[None, 5] is None
    plain = rows.filter("w > 0").select("w", "h", G.aligned_candidates(F.col("w"), F.col("h"), 400_000, 300_000, 500_000, upscale=40.0).alias("all"))
    for r in plain.collect():
        error = lambda w, h: abs(math.log(w * h / 400_000)) + abs(math.log(w / h / (r["w"] / r["h"])))  # noqa: B023, E731
        best = min((error(*c) for c in r["all"]), default=None)
        size = got[r["w"], r["h"]]
        assert (size is None) == (best is None)
        assert size is None or (abs(error(size["width"], size["height"]) - best) < 1e-12 and size["allowed"] == len(set(r["all"])))


def test_crops_of_a_batch_equal_those_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    side = lambda: rng.randint(0, 500) + rng.choice([0.0, 0.5])
    boxes = [(image, k, "A", x, y, x + rng.randint(0, 90), y + rng.randint(1, 90)) for image in range(60) for k in range(rng.choice([1, 2, 3, 7, 30])) for x, y in [(side(), side())]]
    boxes += [(90, 0, "A", None, 1.0, 5.0, 6.0), (90, 1, "A", 1.0, 1.0, 50.0, 60.0), (91, 0, "A", 3.0, 3.0, float("nan"), 9.0), (91, 1, "A", 3.0, 3.0, 7.0, 9.0)]
    rows = A.instances_of(spark.createDataFrame(boxes, "image long, idx long, label string, x1 double, y1 double, x2 double, y2 double"))
    start = lambda b: A.crop((b["x1"] - 10, b["y1"] - 10, b["x1"] + 150, b["y1"] + 120))
    plain = F.filter(F.transform("boxes", lambda b: A.evaluated(start(b), F.col("boxes"), 640, 480)), lambda c: c.isNotNull())
    for block in (A.BLOCK, 40):
        monkeypatch.setattr(A, "BLOCK", block)
        got = rows.select("image", A.evaluated_crops(start, F.col("boxes"), 640, 480).alias("a"), plain.alias("b")).collect()
        assert all(repr(r["a"]) == repr(r["b"]) for r in got) and sum(len(r["a"]) for r in got) > 50


def test_point_rows_parse_a_line_once(spark):
    rows = spark.createDataFrame([("[[1,2],[3,4]]",), ("[[[1,2],[3,4]],[[1,2]]]",), ("[[1,2]]",), ("no",), (None,)], "line string")
    for kind, parsed, fits in (("point_arrow", 1, [True, False, False, False, False]), ("point_line", 2, [True, True, False, False, False])):
        out = A.point_rows(rows, kind, F.col("line"), 640, 480, "?")
        assert out._jdf.queryExecution().analyzed().toString().count("from_json(") == parsed
        assert [(r["target_text"] is not None, r["error"] is None) for r in out.collect()] == [(f, f) for f in fits]


def test_points_are_resampled_once(spark):
    rows = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 4D), named_struct('x', 6D, 'y', 8D)) AS s")
    out = rows.select(P.without_repeats(P.resampled(F.col("s"), 3)).alias("s"))
    assert out._jdf.queryExecution().analyzed().toString().count("sequence(0, 2") == 1
    assert [tuple(p) for p in out.first()["s"]] == [(0.0, 0.0), (3.0, 4.0), (6.0, 8.0)]


def test_simplified_lines_keep_nulls(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 2D, 'y', 0D)), array(named_struct('x', 5D, 'y', 5D)))), (2, NULL), (3, array()) AS t(k, line)")
    out = {r["k"]: r["s"] and [[tuple(p) for p in s] for s in r["s"]] for r in rows.select("k", P.simplified(F.col("line").cast(P.LINE)).alias("s")).collect()}
    assert out == {1: [[(0.0, 0.0), (2.0, 0.0)], [(5.0, 5.0)]], 2: None, 3: []}


def test_audits_read_texts_once(spark):
    assert "regexp_count" not in plan(queries.QUERIES["audit_report"](spark, SF))


def test_catalogue_rows_parse_lines_once(spark):
    assert "try_parse_json" not in plan(queries.QUERIES["catalogue_rows"](spark, SF)) and "schema_of_variant" not in plan(queries.QUERIES["catalogue_rows"](spark, SF))


def test_context_views_are_short(spark):
    assert len(plan(queries.QUERIES["context_views"](spark, SF))) < 60_000


def test_streamed_documents_are_not_broadcast(spark, monkeypatch):
    seen = []
    planned = draws.planned
    monkeypatch.setattr(draws, "planned", lambda rows, *a, **k: seen.append(rows) or planned(rows, *a, **k))
    assert queries.QUERIES["streamed_microbatches"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert "strategy=merge" in seen[0]._jdf.queryExecution().analyzed().toString()


def test_levels_are_gathered_as_bits(spark):
    for name in ("iou_best_match", "crop_distractors"):
        assert "collect_set" not in plan(queries.QUERIES[name](spark, SF))


def test_points_are_worked_out_by_row(spark, tmp_path):
    """Lines are not gathered: what tells points apart are columns and windows, with the rows that whole lines give."""
    for name in ("crop_coordinates", "pixel_lines"):
        text = plan(queries.QUERIES[name](spark, SF))
        assert "lambda" not in text and "collect_list" not in text
    rng = random.Random(3)
    some = lambda *values: rng.choice([*values, None])
    rows = [(order, rng.choice([k, 1]), some(1, 2, -7, 40_000, rng.randint(0, 900)), some(3, -9, rng.randint(0, 900))) for order in range(400) for k in range(rng.choice([1, 2, 2, 3, 5]))]
    rows += [(None, 1, 10, 20), (None, 2, 30, 50), (900, 1, 5, 6), (900, 2, 5, 6), (901, 1, 5, 6), (901, 2, 9, 6), (901, 3, 5, 6)]
    rows += [(902, k, 7 * k, k) for k in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    each = spark.read.parquet(f"{tmp_path}/lineitem.parquet").selectExpr("l_orderkey AS image", "struct(l_linenumber, l_partkey, l_suppkey) AS i", "double((l_partkey * 37) % 700) AS x", "double((l_suppkey * 53) % 500) AS y")
    each = each.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    line, moved = (F.array(F.transform("p", f)) for f in (lambda p: P.point(p["x"], p["y"]), lambda p: P.point(p["x"] * 0.7 + 0.3, p["y"] * 0.5 + 0.3)))
    placed, codes = P.to_image(line, F.lit(40), F.lit(20), 300, 200, 640, 480), P.to_codes(line, F.lit(40), F.lit(20), F.lit(300), F.lit(200))
    lines = each.select("image", F.size("p").alias("n"), placed.alias("placed"), codes.alias("codes"), P.to_pixels(moved, 450, 240).alias("pixels")).collect()
    total = lambda points, k: math.fsum(p[k] for p in points)
    apart = [r for r in lines if r["placed"] and len(r["placed"][0]) == r["n"] == len(set(r["placed"][0]))]
    want = {"crop_coordinates": [(r["image"], round(total(r["placed"][0], "x"), 4), round(total(r["placed"][0], "y"), 4), total(r["codes"][0], "x"), total(r["codes"][0], "y")) for r in apart],
            "pixel_lines": [(r["image"], total(r["pixels"][0], "x"), total(r["pixels"][0], "y"), len(r["pixels"][0])) for r in lines if r["pixels"]]}
    for name, expected in want.items():
        assert 10 < len(expected) < len(lines)
        assert sorted(map(repr, (tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, expected))
