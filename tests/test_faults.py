"""Inputs that once gave wrong rows."""

import json

from pyspark.sql import functions as F

from millrace.functions import json_text
from millrace.operators import attributes
from millrace.sources import records


def test_file_numbers_of_nested_paths(spark, tmp_path):
    """A path that is the end of another one, a folder and a file in it, names with blanks and signs."""
    outer = tmp_path / "X" / "b" / "X" / "a"
    inner = tmp_path / "X" / "a"
    for folder, text in ((inner, '{"k": 1}'), (outer, '{"k": 2}')):
        folder.mkdir(parents=True)
        (folder / "t.jsonl").write_text(text + "\n")
    (inner / "u +%20é.jsonl").write_text('{"k": 3}\n')
    paths = [str(inner / "t.jsonl"), str(outer / "t.jsonl"), str(inner / "u +%20é.jsonl")]
    got = {r["value"]: r["file_no"] for r in records.json_lines(spark, paths).collect()}
    assert got == {'{"k": 1}': 0, '{"k": 2}': 1, '{"k": 3}': 2}
    folders = [str(outer), str(inner)]
    got = {r["value"]: r["file_no"] for r in records.json_lines(spark, folders).collect()}
    assert got == {'{"k": 1}': 1, '{"k": 2}': 0, '{"k": 3}': 1}


LINE = {"line_type": "straight", "line_style": "path", "is_single": True, "points": [[[1, 2], [3, 4]]], "begin_arrow": "none", "end_arrow": "none", "dash_style": "solid", "fill_color": "#00ff00"}


def test_contracts_look_at_types(spark):
    cases = [
        (LINE, []), (LINE | {"is_single": "true"}, ["is_single:invalid"]), (LINE | {"fill_color": "#00ff00\n"}, ["fill_color:invalid"]), (LINE | {"is_single": 1}, ["is_single:invalid"]),
        (LINE | {"is_single": None}, ["is_single:invalid"]), (LINE | {"is_single": False}, ["is_single:false_requires_multiple_segments"]),
        (LINE | {"line_style": "shape", "has_border": "false"}, ["shape:has_border_required"]), (LINE | {"line_style": "shape", "has_border": False}, []),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, p string")
    got = {r["i"]: list(r["e"]) for r in rows.select("i", attributes.line_errors(F.col("p"), F.lit("line")).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}
    shape = spark.createDataFrame([("#12AB34\n",), ("#12AB34",)], "c string").select(attributes.weak_color(F.col("c")).alias("w"), attributes.not_color(F.col("c")).alias("n"))
    assert [tuple(r) for r in shape.collect()] == [("#12AB34", True), ("#12AB34", False)]


def test_numbers_beyond_doubles_are_not_json(spark):
    cases = [('{"a":1e400}', None), ('{"a":-1E+999}', None), ('{"a":"Infinity"}', '{"a":"Infinity"}'), ('{"a":"Infinity","b":1e400}', None), ('{"a":1e300}', '{"a":1.0E300}'), ('{"e100":"-Infinity"}', '{"e100":"-Infinity"}'), ("[" + "9" * 400 + "]", None)]
    got = [r["c"] for r in spark.createDataFrame(list(enumerate(t for t, _ in cases)), "i int, t string").orderBy("i").select(json_text.canonical(F.col("t")).alias("c")).collect()]
    assert [g is None for g in got] == [w is None for _, w in cases] and got[2] == cases[2][1] and got[5] == cases[5][1]
    row = json_text.decode(spark.createDataFrame([('{"a":1e400}',)], "t string"), F.col("t"), "d").first()["d"]
    assert row["partial"] and row["parsed"] == "{}"  # as with NaN, what stands before it is kept


def test_content_of_any_depth(spark):
    def plain(content):
        if isinstance(content, list):
            return [p for x in content for p in plain(x)]
        if isinstance(content, dict) and content.get("type") == "image":
            return [("image", None)]
        if isinstance(content, dict) and ("text" in content or content.get("type") == "text"):
            return [("text", content.get("text") or "")]
        return [("text", content if isinstance(content, str) else "" if content is None else json.dumps(content, separators=(",", ":")))]

    deep = "x [ \\ \" ]]"
    for k in range(40):
        deep = [deep, {"type": "image"}, f"[{k}"] if k % 2 else [deep]
    cases = ["text", ["a", ["b", [["c", {"type": "image"}], {"text": "d"}]]], deep, [], [[]], [[[], "x"]], {"type": "text", "text": "["}, {"k": [1, [2]]}, [{"k": [1, [2]]}, [[3]]]]
    rows = spark.createDataFrame([(i, json.dumps({"messages": [{"role": "user", "content": c}]})) for i, c in enumerate(cases)], "i int, row string")
    got = {r["i"]: [tuple(p) for p in r["m"][0]["content"]] for r in rows.select("i", records.messages_of(F.col("row")).alias("m")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == plain(c), (i, got[i])
