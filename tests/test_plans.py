"""Mixing, packing, sampling, JSON repair and sources on small cases worked out by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry, json_text, polylines, prompts
from millrace.operators import annotations, sequences
from millrace.plans import mixing, packing, sampling, transforms
from millrace.sources import records, registry
from millrace.streaming import draws


def test_ticket_quotas():
    one, three = mixing.ticket_quotas([1.0, 3.0])
    assert three == 3 * one
    weights = [0.0002, 1.0, 0.6180339887]
    quotas = mixing.ticket_quotas(weights)
    assert sum(quotas) == 8091
    assert all(abs(q / sum(quotas) / (w / sum(weights)) - 1) < 0.05 for q, w in zip(quotas, weights))
    with pytest.raises(ValueError):
        mixing.ticket_quotas([1e-9, 1.0])


def test_permutations():
    for size in (1, 2, 7, 64, 1000):
        out = mixing.feistel(np.arange(size, dtype=np.uint64), size, np.full(size, 9, np.uint64))
        assert sorted(out.tolist()) == list(range(size))
        a, b = mixing.affine(size, 5)
        assert sorted((a * i + b) % size for i in range(size)) == list(range(size))


def test_concat_plan_covers_every_row(spark):
    sizes = spark.createDataFrame([("a", 3, 1.0), ("b", 2, 1.0), ("none", 0, 1.0), ("off", 4, 0.0)], "source string, size long, weight double")
    sources = mixing.active_sources(sizes)
    for seed in (None, 1):
        rows = mixing.concat_draws(spark, sources, 5, seed).collect()
        assert sorted((r["source"], r["row_index"]) for r in rows) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_shuffled_draws_keep_the_weights(spark):
    rows = mixing.shuffled_draws(spark, ["a", "b"], [10, 10], [1.0, 3.0], 2000, 7).collect()
    share = sum(r["source"] == "b" for r in rows) / len(rows)
    assert abs(share - 0.75) < 0.01
    first = [r["row_index"] for r in sorted(rows, key=lambda r: r["draw_id"]) if r["source"] == "a"][:10]
    assert sorted(first) == list(range(10))


def test_best_fit():
    assert packing.best_fit([0, 1, 2, 3, 4, 5], [8, 1, 1, 1, 1, 2], 2, 8, 0) == [[0], [5, 1, 2, 3, 4]]
    assert packing.best_fit([0, 1, 2], [6, 6, 6], 2, 10, 0) == [[0], [1]]
    with pytest.raises(ValueError, match="draw 0"):
        packing.best_fit([0, 1], [9, 1], 2, 8, 0)


def test_length_order(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([3, 8, 2, 8, 1, 5])], "window long, draw_id long, tokens long")
    out = packing.length_order(rows, "window").orderBy("position").collect()
    assert [r["tokens"] for r in out] == [8, 8, 5, 3, 2, 1] and [r["draw_id"] for r in out[:2]] == [1, 3]


def test_planner_goes_on_where_it_stopped():
    draws = [(i, 1 + i * 37 % 90) for i in range(200)]
    plan = packing.Planner(4, 6, 400, 24, 3)
    whole, _, _ = plan.run(draws, final=True)
    rows, buffer, step = plan.run(draws[:77], final=False)
    more, _, _ = plan.run(draws[77:], final=True, buffer=buffer, step=step)
    assert rows + more == whole
    for key in {(s, r) for s, r, *_ in whole}:
        mine = [t for s, r, _, _, t in whole if (s, r) == key]
        assert len(mine) <= 6 and len(mine) * max(mine) <= 400


def test_planned_stream(spark, tmp_path):
    """Two micro-batches of files of draws give the same microbatches as one run over all of them."""
    rows = [(s, i, 1 + (i * 29 + s) % 60) for s in range(2) for i in range(60)]
    schema = "stream long, draw_id long, tokens long"
    plan = packing.Planner(2, 4, 200, 12)
    log = draws.PlanLog(spark, str(tmp_path / "plan"))
    for part in (range(0, 30), range(30, 60)):
        spark.createDataFrame([d for d in rows if d[1] in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log.start(draws.planned(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "stream", plan), availableNow=True).awaitTermination(120)
    got = sorted(tuple(r) for r in log.planned().select("stream", "microstep", "rank", "slot", "draw_id", "tokens").collect())
    want = sorted((s, *x) for s in range(2) for x in plan.run([(i, t) for k, i, t in rows if k == s], final=False)[0])
    assert got == want


def test_quotas():
    assert sampling.waterfill_quotas({"a": 1, "b": 10, "c": 10}, 12) == {"a": 1, "b": 6, "c": 5}
    assert sum(sampling.sqrt_quotas({"a": 100, "b": 4, "c": 1}, 20).values()) == 20
    rare = sampling.rare_whole_quotas({"a": 3, "b": 100, "c": 400}, 33, 5)
    assert rare["a"] == 3 and rare["b"] + rare["c"] == 30 and rare["c"] == 2 * rare["b"]


def test_json_repair(spark):
    """(text, canonical value, partial): strict, fenced, embedded, cut off; strings keep what looks like a comma to drop."""
    cases = [
        ('```json\n{"b": 1, "a": [1, 2]}\n```', '{"a":[1,2],"b":1}', False), ('so: {"a": 1} end', '{"a":1}', False), ('{"a": [1, 2', '{"a":[1,2]}', True), ('[{"a": "x', '[{"a":"x"}]', True),
        ('{"a": "x, ]y", "b": [1,', '{"a":"x, ]y","b":[1]}', True), ('{"a": {"b": 1}, "c": tru', '{"a":{"b":1}}', True), ('{"a":1.50,"a":2}', '{"a":2}', False), ("[", "[]", True), ('{"a": NaN}', "{}", True),
        ("no json here", None, False), (None, None, False), ("", None, False), ('{"q": "\\', '{"q":"\\\\"}', True),
    ]
    rows = json_text.decode(spark.createDataFrame(list(enumerate(t for t, _, _ in cases)), "i int, t string"), F.col("t"), "d").orderBy("i").collect()
    assert [(r["d"]["parsed"], r["d"]["partial"]) for r in rows] == [(w, p) for _, w, p in cases]
    assert [r["d"]["valid"] for r in rows] == [w is not None for _, w, _ in cases]
    row = spark.createDataFrame([('{"k ": " v ", "n": [" a", "b "," "], "e":""}',)], "t string").select(json_text.comparable(json_text.canonical(F.col("t"))).alias("c")).first()
    assert row["c"] == '{"e":"","k ":"v","n":["a","b",""]}'


def test_prompts(spark):
    parts = prompts.compile_prompt("plain text", {})
    assert spark.range(1).select(prompts.render(parts).alias("x")).first()["x"] == "plain text"


def test_polylines(spark):
    line = [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    keep = polylines.simplify(np.array(line), 0.1)
    assert [p for p, k in zip(line, keep) if k] == [(0.0, 0.0), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    rows = spark.createDataFrame([("[[0,0],[10,0]]",), ("[[0,0],[3,4],[3,4],[9,12]]",), ("[[[1,1],[2,2]],[[5,5],[6,6]]]",), ("[[[1,1]]]",), ("{}",)], "t string").withColumn("line", polylines.from_json(F.col("t")))
    got = rows.select(F.size("line").alias("n"), polylines.resampled(F.col("line")[0], 4).alias("s"), polylines.repeats(F.col("line")).alias("r")).collect()
    assert [r["n"] for r in got[:3]] == [1, 1, 2] and [r["s"] is None for r in got] == [False, False, False, True, True]
    assert [(p["x"], p["y"]) for p in got[1]["s"]] == [(0, 0), (3, 4), (6, 8), (9, 12)] and got[1]["r"] == 1
    raw = spark.createDataFrame([(1, "[[[0,0],[0,0],[10,0],[20,1],[30,0]],[[5,2000]]]"), (2, "[[[7,7],[7,7]]]")], "i int, t string").withColumn("line", polylines.from_json(F.col("t")))
    raw = raw.withColumn("line", F.coalesce("line", F.array(F.array(polylines.point(F.lit(7), F.lit(7)), polylines.point(F.lit(7), F.lit(7))))))
    done = {r["i"]: r for r in polylines.cleaned(raw, "line", F.lit(False), tuple(F.lit(float(v)) for v in (10, 20, 300, 90))).collect()}
    assert [(p["x"], p["y"]) for p in done[2]["line"][0]] == [(10.0, 55.0), (300.0, 55.0)] and done[2]["from_box"] and done[2]["repeated_points"] == 1


def test_crops(spark):
    """Crops of an image by a plain version: widened until they cut nothing, judged, thinned out."""
    rng = np.random.default_rng(3)
    images = {}
    for image in range(30):
        boxes = []
        for i in range(int(rng.integers(1, 7))):
            x, y = float(rng.integers(0, 500)), float(rng.integers(0, 380))
            boxes.append((i, "a", x, y, x + float(rng.integers(10, 120)), y + float(rng.integers(10, 90))))
        images[image] = boxes
    start = lambda b: (max(b[2] - 10, 0.0), max(b[3] - 10, 0.0), min(b[2] + 150, 640.0), min(b[3] + 120, 480.0))

    def plain(boxes):
        found = []
        for b in boxes:
            c = start(b)
            for _ in range(8):
                for _, _, x1, y1, x2, y2 in boxes:
                    meets = x1 < c[2] and c[0] < x2 and y1 < c[3] and c[1] < y2
                    if meets and not (x1 >= c[0] and y1 >= c[1] and x2 <= c[2] and y2 <= c[3]):
                        c = (max(0.0, min(c[0], float(np.floor(x1)))), max(0.0, min(c[1], float(np.floor(y1)))), min(640.0, max(c[2], float(np.ceil(x2)))), min(480.0, max(c[3], float(np.ceil(y2)))))
            inside = [k for k, _, x1, y1, x2, y2 in boxes if x1 >= c[0] and y1 >= c[1] and x2 <= c[2] and y2 <= c[3]]
            cut = [k for k, _, x1, y1, x2, y2 in boxes if k not in inside and x1 < c[2] and c[0] < x2 and y1 < c[3] and c[1] < y2]
            if inside and not cut and (c[2] - c[0]) * (c[3] - c[1]) / (640 * 480) <= 0.92:
                found.append((-len(inside), -sum((b[4] - b[2]) * (b[5] - b[3]) for b in boxes if b[0] in inside), c, inside))
        taken = []
        for f in sorted(found):
            def iou(a, b):
                inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                area = lambda r: max(1, (r[2] - r[0]) * (r[3] - r[1]))
                return inter / (area(a) + area(b) - inter)
            if len(taken) < 3 and all(t[3] != f[3] and iou(t[2], f[2]) <= 0.85 for t in taken):
                taken.append(f)
        return [(f[2], f[3]) for f in taken]

    df = spark.createDataFrame([(m, *b) for m, bs in images.items() for b in bs], "image long, idx long, label string, x1 double, y1 double, x2 double, y2 double")
    rows = annotations.instances_of(df)
    begin = lambda b: annotations.crop((F.greatest(b["x1"] - 10, F.lit(0.0)), F.greatest(b["y1"] - 10, F.lit(0.0)), F.least(b["x1"] + 150, F.lit(640.0)), F.least(b["y1"] + 120, F.lit(480.0))))
    rows = rows.select("image", annotations.selected_crops(F.transform("boxes", lambda b: annotations.evaluated(begin(b), F.col("boxes"), 640, 480)), 3).alias("c")).collect()
    got = {r["image"]: [(tuple(c["crop"]), list(c["inside"])) for c in r["c"]] for r in rows}
    assert got == {m: plain(bs) for m, bs in images.items()}


def test_rounds_of_packs():
    size = {0: 5, 1: 9, 2: 9, 3: 9, 4: 1, 5: 11}
    out = packing.packed_rounds(size, 2, 10)
    assert sorted(d for d, *_ in out) == sorted(size) and (5, None, None, None) in out
    loads = {}
    for d, r, p, _ in out:
        loads[r, p] = loads.get((r, p), 0) + size[d]
    assert max(v for k, v in loads.items() if k[0] is not None) <= 10


def test_ranks_of_packs_by_all_ways():
    from itertools import product

    rng = np.random.default_rng(6)
    for _ in range(60):
        loads = {k: int(v) for k, v in enumerate(rng.integers(1, 10, 6))}
        most = int(rng.integers(10, 20))
        ways = any(all(ranks.count(r) == 2 and sum(loads[k] for k in range(6) if ranks[k] == r) <= most for r in range(3)) for ranks in product(range(3), repeat=6))
        got = packing.assign_ranks(loads, 3, 2, most)
        assert (got is not None) == ways
        if got:
            assert sorted(sum(got, [])) == list(range(6)) and all(len(r) == 2 and sum(loads[k] for k in r) <= most for r in got)
    assert packing.assign_ranks({0: 3, 1: 3, 2: 3}, 2, 2, 6) is None and packing.assign_ranks({0: 3, 1: 3, 2: 3}, 2, 2, 6, partial=True) == [[0, 2], [1]]


def test_full_partition_and_bounds():
    assert packing.full_partition([(0, 5), (1, 9), (2, 5), (3, 9)], 2, 2, 18) == [[0, 1], [2, 3]]
    assert packing.full_partition([(0, 5), (1, 9), (2, 5), (3, 5), (4, 5)], 2, 2, 10) == [[0, 2], [3, 4]]
    assert packing.full_partition([(0, 5), (1, 9), (2, 9), (3, 9)], 2, 2, 10) is None
    assert packing.pack_count_bounds("fixed", 4) == (4, 4) and packing.pack_count_bounds("token_budget", 4) == (1, 4)
    assert packing.batch_contract("fixed", 2, 4, 3, 100)["draws_per_step"] == 24
    for bad in (("fixed", 2, 4, 3, 100, "none", "greedy"), ("token_budget", 2, 4, 3, 100), ("odd", 2, 4, 3, 100)):
        with pytest.raises(ValueError):
            packing.batch_contract(*bad)


def test_length_microbatches():
    draws = [(i, (i * 7) % 10 + 1) for i in range(14)]
    out = packing.length_microbatches(draws, 2, 2, 8)
    assert sorted(d for b in out for d, _ in b) == list(range(14)) and all(len(b) == 4 for b in out[:-1])
    assert 0 in [d for d, _ in out[0]]
    steps, skew = packing.balanced_frame([[3, 1], [5, 4], [1, 1]], 1)
    assert all(sorted(s) == [0, 1] for s in steps) and skew < 0.1


def test_epoch_steps():
    assert sampling.epoch_steps(24, 2, 3) == 4
    for bad in ((25, 2, 3, True), (20, 2, 3), (23, 2, 3, False, True)):
        with pytest.raises(ValueError):
            sampling.epoch_steps(*bad)


def test_two_levels_and_pilot():
    counts = {("a", "x"): 10, ("a", "y"): 30, ("b", "z"): 5, ("c", "w"): 100}
    got = sampling.two_level_quotas(counts, 45, {"a": 1.0, "c": 1.0}, {"b"})
    assert got == {("b", "z"): 5, ("a", "x"): 5, ("a", "y"): 15, ("c", "w"): 20}
    with pytest.raises(ValueError):
        sampling.two_level_quotas(counts, 4, {"a": 1.0}, {"b"})
    assert sampling.pilot_quotas({"line": 3, "arrow": 50}, 20, "line", "arrow") == {"line": 3, "arrow": 17}


def test_bands(spark):
    rows = spark.createDataFrame([(0, i, ["a", "b"] if i % 2 else ["a"]) for i in range(20)], "part long, id long, bands array<string>")
    got = {r["id"]: r["band"] for r in sampling.balanced_bands(rows, "part", "id", "bands", "s").collect()}
    used, want = {"a": 0, "b": 0}, {}
    digest = lambda *x: hashlib.sha256(":".join(map(str, ("s", *x))).encode()).hexdigest()
    for i in sorted(range(20), key=digest):
        want[i] = min(["a", "b"] if i % 2 else ["a"], key=lambda b: (used[b], digest(i, b)))
        used[want[i]] += 1
    assert got == want and used["b"] >= 7


def test_prompt_schema():
    assert prompts.schema({"a": {"type": "enum", "values": ["x"]}}) == {"a": {"type": "enum", "values": ["x"]}}
    for bad in ({"1a": {"type": "string"}}, {"a": {"type": "text"}}, {"a": {"type": "enum"}}, {"a": {"type": "enum", "values": ["x", "x"]}}, {"a": {"type": "string", "required": False}}, {"a": {"type": "string", "values": ["x"]}}, {"a": {"type": "string", "more": 1}}):
        with pytest.raises(ValueError):
            prompts.schema(bad)


def test_message_parts(spark):
    lines = ['{"messages": [{"role": " USER ", "content": "hi"}, {"content": {"type": "image"}}, {"role": "assistant", "content": [{"type": "text", "text": " a"}, [["b"], {"text": 3}], 7, {"x": 1}]}]}', '{"conversation": []}', '{"a": 1}', '{"messages": "no"}']
    rows = spark.createDataFrame([(x,) for x in lines], "value string").withColumn("m", records.messages_of(F.col("value")))
    got = [r["m"] for r in rows.collect()]
    assert [(m["role"], [(p["type"], p["text"]) for p in m["content"]]) for m in got[0]] == [
        ("user", [("text", "hi")]), ("user", [("image", None)]), ("assistant", [("text", " a"), ("text", "b"), ("text", "3"), ("text", "7"), ("text", '{"x":1}')])]
    assert got[1] == [] and got[2] is None and got[3] is None
    text = rows.limit(1).select(records.text_of(F.element_at("m", -1)["content"]).alias("t"), records.placeholders(F.col("m")).alias("n")).first()
    assert text["t"] == 'ab37{"x":1}' and text["n"] == 1


def test_image_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (70_000).to_bytes(4, "big") + b"\x08\x02")
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["path"][-5:]: (r["width"], r["height"]) for r in records.image_sizes(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.png": (640, 70_000), "b.png": (None, None)}


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"image_path": "x.png", "target_text": "t", "sample_id": "1"}\n\n  \n{"image": "y.png", "image_path": "z"}\nnot json\n[1]\n')
    rows = records.sft_fields(records.json_lines(spark, [str(path)]))
    assert {r["line_no"]: r["error"] for r in rows.collect()} == {1: None, 4: "more than one image field", 5: "not a JSON object", 6: "not a JSON object"}
    with pytest.raises(ValueError, match="3 bad lines: L4"):
        records.check_lines(rows, F.col("error"))


def test_json_lines_of_many_blocks(spark, tmp_path):
    """Line numbers and file numbers where files of one name are read in small blocks."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k, folder in enumerate(("b", "a")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "train.jsonl").write_text("".join(f'{{"n": {i}, "pad": "{"x" * (i % 37)}"}}\n' + ("\n" if i % 5 == 0 else "") for i in range(300)))
    lines = (tmp_path / "a" / "train.jsonl").read_text().split("\n")
    want = {i + 1: x for i, x in enumerate(lines) if x}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = records.json_lines(spark, [str(tmp_path / "b" / "train.jsonl"), str(tmp_path / "a")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k, folder in enumerate(("b", "a")):
        mine = [r for r in rows if f"/{folder}/" in r["path"]]
        assert {r["line_no"]: r["value"] for r in mine} == want and {r["file_no"] for r in mine} == {k} and all(r["ok"] for r in mine)


def test_catalogue(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"target_text": "x", "image": "i"}\n')
    entries = {"a": {"reader": "json_lines", "train": [str(tmp_path / "a.jsonl")]}, "b": {"reader": "json_lines", "train": ["missing"], "weight": 0.0}, "c": {"reader": "json_lines", "train": ["missing"], "enabled": False}}
    rows = registry.open_split(spark, registry.catalogue(entries), "train").collect()
    assert [r["dataset_name"] for r in rows] == ["a"]
    assert registry.open_split(spark, registry.catalogue(entries), "val") is None
    with pytest.raises(ValueError):
        registry.catalogue([{"name": "a", "reader": "x"}, {"name": "a", "reader": "x"}])
    with pytest.raises(KeyError, match="unknown reader"):
        registry.READERS.get("nothing")
    assert registry.READERS.has("jsonl_sft") and not registry.READERS.has("nothing")
    (tmp_path / "list.json").write_text('{"a": {"reader": "json_lines", "train": ["a.jsonl"]}, "b": {"reader": "json_lines", "train": ["/x"]}}')
    found = registry.read_catalogue(spark, str(tmp_path / "list.json"), ["b", "a"])
    assert [s.name for s in found] == ["b", "a"] and found[1].train == [str(tmp_path / "a.jsonl")] and found[0].train == ["/x"]
    with pytest.raises(ValueError, match="inline"):
        registry.read_catalogue(spark, str(tmp_path / "list.json"), None, [found[0]])
    with pytest.raises(ValueError, match="not in the catalogue"):
        registry.read_catalogue(spark, str(tmp_path / "list.json"), ["c"])


def test_splits(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    registry.check_splits(ids(1, 2), ids(3), ids(1, 2, 3, 4), "id")
    for train, val, message in ((ids(1, 1), ids(2), "repeats"), (ids(1), ids(1), "overlap"), (ids(9), ids(1), "not there")):
        with pytest.raises(ValueError, match=message):
            registry.check_splits(train, val, ids(1, 2, 3), "id")
    with pytest.raises(ValueError):
        registry.check_unique(ids(1, 1), "id")


def test_merges(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), (None, 1, "x"), (None, 2, "y")], "key string, at long, v string")
    assert sorted(r["v"] for r in records.last_write(rows.filter("key IS NOT NULL"), ["key"], "at").collect()) == ["c"]
    assert sorted(r["v"] for r in records.keep_first(rows, ["key"], ["at"], optional="key").collect()) == ["a", "x", "y"]


def test_gaps_and_repeats(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 5, None), ("a", 6, None), ("b", 1, "x")], "k string, step long, v string")
    assert [tuple(r) for r in sequences.gaps(rows, "k", "step").collect()] == [("a", 2, 5)]
    assert sorted((r["k"], r["step"]) for r in sequences.without_repeats(rows, "k", ["step"], "v").collect()) == [("a", 1), ("a", 5), ("b", 1)]


def test_completions_targets_and_arrays(spark):
    rows = spark.createDataFrame([(" plain ",), ('"text "',), ('{"role":"a","content":[{"type":"text","text":" x "},{"type":"image"},"y"]}',), ('[{"role":"a","content":"p"},{"role":"b","content":{"text":"q"}}]',)], "t string")
    assert [r[0] for r in rows.select(json_text.completion_text(F.col("t"))).collect()] == ["plain", "text", "xy", "pq"]
    texts = spark.createDataFrame([('```json\n[{"a":1}, 2, {"b":[3]}]\n```',), ('so [{"a":1}] it is',), ('{"a":1}',), ("none",)], "t string")
    assert [r[0] for r in texts.select(json_text.objects_of(F.col("t"))).collect()] == [['{"a":1}', '{"b":[3]}'], ['{"a":1}'], None, None]
    raw = spark.createDataFrame([('{"a": 1}',), ("x",), (None,)], "t string")
    assert [tuple(r["g"]) for r in json_text.target_of(raw, F.col("t"), "g", "json_object").collect()] == [('{"a":1}', True, None), (None, False, "json_decode_error"), (None, False, "no target text")]
    assert [tuple(r["g"]) for r in json_text.target_of(raw, F.col("t"), "g").collect()] == [('{"a": 1}', True, None), ("x", True, None), (None, False, "no target text")]


def test_transforms_and_hooks(spark):
    rows = spark.createDataFrame([(0, ["i"], "t"), (1, ["i"], "t"), (2, ["i"], None), (3, ["i"], None), (4, ["j"], " ")], "row_index long, image_paths array<string>, target_text string")
    assert sorted(r["row_index"] for r in transforms.applied(rows, [{"name": "dedup_image_target"}]).collect()) == [0, 2, 3, 4]
    assert sorted(r["row_index"] for r in transforms.applied(rows, [{"name": "dedup_image_target"}, {"name": "drop_empty_target"}]).collect()) == [0]
    step = [{"name": "prompt_variant", "prompts": ["a", "b"], "draw": "row_index"}]
    once = transforms.applied(rows, step, transforms.ONLINE, planning=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, transforms.applied(rows, step, transforms.ONLINE).collect()))
    with pytest.raises(ValueError, match="planning"):
        transforms.applied(rows, [{"name": "shuffle_options", "column": "image_paths"}], transforms.ONLINE, planning=True)
    hooks = transforms.Hooks()
    hooks.on("before", lambda df: df.filter("row_index > 1"))
    hooks.on("before", lambda df: None)
    assert hooks.intercept("before", rows).count() == 3 and hooks.intercept("after", rows).count() == 5
    v = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    kl = v.select(transforms.objective("forward_kl", F.col("a"), F.col("b"), 2.0).alias("x")).first()["x"]
    p = np.exp(np.array([2.0, 1.0]) / 2) / np.exp(np.array([2.0, 1.0]) / 2).sum()
    assert abs(kl - 4 * float((p * (np.log(p) - np.log(p[::-1]))).sum())) < 1e-9


def test_planner_fills_all_ranks_or_says_so():
    plan = packing.Planner(2, 2, 18, 4, cardinality="fixed")
    ranks, left = plan.plan([(0, 5), (1, 9), (2, 5), (3, 9)], 0)
    assert sorted(len(r) for r in ranks) == [2, 2] and not left
    with pytest.raises(ValueError, match="filled"):
        packing.Planner(2, 2, 10, 4, cardinality="fixed").plan([(0, 5), (1, 9), (2, 9), (3, 9)], 0)
    state = plan.save([(4, 7)], 3, 12)
    assert plan.load(state) == ([(4, 7)], 3)
    with pytest.raises(ValueError, match="another kind"):
        packing.Planner(2, 2, 19, 4).load(state)
    with pytest.raises(ValueError, match="add up"):
        plan.load(state | {"emitted": 11})


def test_padded_canvas(spark):
    """The scale is the largest at which the canvas keeps its budget."""
    pads = (0.1, 0.0, 0.25, 0.3)
    rows = [(640, 480), (3000, 100), (50, 40), (2000, 2000)]
    df = spark.createDataFrame(rows, "w long, h long").select("w", "h", geometry.padded_canvas(F.col("w"), F.col("h"), tuple(F.lit(v) for v in pads), 300_000).alias("c"))

    def canvas(w, h, s):
        return tuple(int(np.ceil(v * s * (a + b + 1.0) / 32)) * 32 for v, a, b in ((w, pads[0], pads[2]), (h, pads[1], pads[3])))

    for r in df.collect():
        w, h, c = r["w"], r["h"], r["c"]
        assert (c["width"], c["height"]) == canvas(w, h, c["scale"]) and c["width"] * c["height"] <= 300_000
        if c["scale"] < 1:
            bigger = canvas(w, h, c["scale"] + 1e-9)
            assert bigger[0] * bigger[1] > 300_000


def test_json_lines_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None)], "n long, t string")
    records.write_json_lines(rows, str(tmp_path / "out"))
    records.write_json_lines(rows.filter("n = 1"), str(tmp_path / "out"))
    read = records.json_lines(spark, [str(tmp_path / "out")])
    assert [r["value"] for r in read.collect()] == ['{"n":1,"t":"a\\nb"}']


def test_ranked_packs_and_length_batches(spark):
    rows = spark.createDataFrame([(0, p, t) for p, t in enumerate([5, 5, 4, 4, 3, 3])] + [(1, p, 9) for p in range(3)], "step long, pack_index long, tokens long")
    got = {}
    for r in packing.ranked_packs(rows, "step", 3, 2, 8).collect():
        got.setdefault(r["step"], {}).setdefault(r["rank"], []).append(r["tokens"])
    assert {k: sum(v) for k, v in got[0].items()} == {0: 8, 1: 8, 2: 8} and list(got[1]) == [None]
    draws = spark.createDataFrame([(0, i, (i * 7) % 10 + 1) for i in range(14)], "stream long, draw_id long, tokens long")
    batches = packing.length_batches(draws, "stream", 2, 2, 8).collect()
    assert sorted(r["draw_id"] for r in batches) == list(range(14)) and max(r["slot"] for r in batches) == 3
