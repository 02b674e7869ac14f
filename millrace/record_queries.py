"""Queries over records: JSON lines built from the tables and read back, decoded output, attributes; each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import json_text
from .operators import attributes as T
from .plans import sampling
from .queries import CLEAN_TURNS, id_bin, query, table
from .sources import records
from .sources.ordinals import OrdinalIndex
from .sources.scratch import shared_folder

STRIPPED = "regexp_replace({x}, '^[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g')"


def conversation_lines(spark, sf_dir):
    """A JSON line per conversation: its messages under one of three names, contents plain, as an object or in lists, an image where the id is divisible by 3."""
    content = lambda t: F.when(t["turn"] % 3 == 0, F.to_json(F.struct(F.struct(F.lit("text").alias("type"), t["text"].alias("text")).alias("v")))).when(
        t["turn"] % 3 == 1, F.to_json(F.struct(F.array(F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text")))).alias("v")))).otherwise(F.to_json(F.struct(t["text"].alias("v"))))
    bare = lambda t: F.regexp_extract(content(t), r'(?s)^\{"v":(.*)\}$', 1)
    message = lambda t: F.concat(F.lit('{"role":'), F.to_json(F.struct(F.upper(t["role"]).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.upper(t["role"]).alias("v")))) - 6), F.lit(',"content":'), bare(t), F.lit("}"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    image = F.col("conv_id") % 3 == 0
    each = F.concat(F.when(image, '{"role":"user","content":[{"type":"image"}]},').otherwise(""), F.array_join(F.transform("turns", message), ","))
    name = F.when(F.col("conv_id") % 2 == 0, "messages").when(F.col("conv_id") % 5 == 0, "conversation").otherwise("conversations")
    value = F.concat(F.lit('{"'), name, F.lit('":['), each, F.lit("]"), F.when(image, F.concat(F.lit(',"image":"img/'), F.col("conv_id").cast("string"), F.lit('.png"'))).otherwise(F.when(F.col("conv_id") % 7 == 0, ',"images":[]').otherwise("")), F.lit(',"topic":"t'), (F.col("conv_id") % 4).cast("string"), F.lit('"}'))
    return rows.select(F.lit("file:/data/all.jsonl").alias("path"), F.lit(0).alias("file_no"), F.col("conv_id").alias("line_no"), value.alias("value"), F.lit(True).alias("ok"), "conv_id")


BUILT = f"""{CLEAN_TURNS},
built AS (SELECT conv_id, last_text, last, (SELECT arg_max(role, turn) FROM turns t WHERE t.conv_id = e.conv_id) AS last_role, conv_id % 3 = 0 AS image, conv_id % 3 <> 0 AND conv_id % 7 = 0 AS empty FROM ends e)"""


@query(f"""WITH {BUILT}
SELECT conv_id, CASE WHEN empty THEN 'images must be a list of paths' WHEN NOT image THEN 'no image path' WHEN last_role <> 'assistant' THEN 'no target' END AS error,
CASE WHEN last_role = 'assistant' THEN last_text END AS target_text, (SELECT count(*) FROM turns t WHERE t.conv_id = b.conv_id) - (last_role = 'assistant')::INT + image::INT AS n_messages,
CASE WHEN image THEN '/data/img/' || conv_id || '.png' ELSE '' END AS image_path, 't' || conv_id % 4 AS topic, CASE WHEN image THEN conv_id::VARCHAR ELSE 'row-' || conv_id END AS sample_id FROM built b""")
def jsonl_sft_records(spark, sf_dir):
    rows = records.sft_fields(conversation_lines(spark, sf_dir))
    sample = records.sample_id(F.col("sample_id"), F.col("image_paths"), F.col("conv_id"))
    return rows.select("conv_id", "error", "target_text", F.size("messages").cast("long").alias("n_messages"), F.coalesce(F.get("image_paths", 0), F.lit("")).alias("image_path"), F.col("extra")["topic"].alias("topic"), sample.alias("sample_id"))


@query(f"""WITH {BUILT}, t AS (SELECT conv_id, max((text <> '')::INT) AS said FROM turns GROUP BY conv_id)
SELECT conv_id, CASE WHEN empty THEN 'images must be a list of paths' WHEN said = 0 THEN 'messages without text' END AS ppo_error,
CASE WHEN empty THEN 'images must be a list of paths' WHEN NOT image THEN 'no image path' WHEN last_role = 'assistant' THEN 'ends with an assistant target' END AS opd_error FROM built JOIN t USING (conv_id)""")
def jsonl_prompt_records(spark, sf_dir):
    lines = conversation_lines(spark, sf_dir)
    once = records.prompt_fields(lines).select(*lines.columns, F.col("error").alias("ppo_error"))
    return records.distillation_fields(once).select("conv_id", "ppo_error", F.col("error").alias("opd_error"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'c' || event_id END AS chosen_text, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS rejected_text,
CASE WHEN event_id % 5 = 0 THEN 'more than one image field' WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'no chosen or rejected text' END AS error FROM events""")
def jsonl_dpo_records(spark, sf_dir):
    e = F.col("event_id")
    pieces = [F.concat(F.lit('{"image_path":"/a/'), e.cast("string"), F.lit('.png"')), F.when(e % 5 == 0, ',"image":"b.png"').otherwise(""),
              F.when(e % 3 == 0, "").when(e % 2 == 0, F.concat(F.lit(',"chosen":"c'), e.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit(',"chosen_text":"c'), e.cast("string"), F.lit('"'))),
              F.when(e % 4 == 0, "").otherwise(F.concat(F.lit(',"rejected":"'), F.col("event_type"), F.lit('"'))), F.lit("}")]
    lines = table(spark, sf_dir, "events").select(F.lit("/x/y.jsonl").alias("path"), F.concat(*pieces).alias("value"), F.lit(True).alias("ok"), "event_id")
    return records.pair_fields(lines).select("event_id", "chosen_text", "rejected_text", "error")


@query("""SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS prediction FROM events WHERE event_type <> 'view' GROUP BY user_id""")
def latest_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("prediction"))
    return records.latest_predictions(rows, "user_id", "event_id")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS value, CASE WHEN event_id % 2 = 1 THEN 'field ''a.b'' not found' END AS error FROM events""")
def dotted_fields(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(F.when(e % 2 == 0, '{"a":{"b":').otherwise('{"a":{"c":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    value, error = json_text.field(text, "a.b")
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"), error.alias("error"))


WHOLE = """whole AS (SELECT event_id, event_type, '{"items": [1, 2], "v": ' || props || ', "s": " ' || event_type || ' "}' AS whole FROM events)"""
CANON = "'{\"items\":[1,2],\"s\":\" ' || event_type || ' \",\"v\":' || props || '}'"


def cut_json(spark, sf_dir):
    """(event_id, event_type, whole, cut): JSON, and the same cut off within its first element where the id is divisible by 3, in a code fence where by 4."""
    whole = F.concat(F.lit('{"items": [1, 2], "v": '), "props", F.lit(', "s": " '), "event_type", F.lit(' "}'))
    e = F.col("event_id")
    cut = F.when(e % 3 == 0, F.substring(whole, F.lit(1), F.lit(15))).when(e % 4 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(e % 5 == 0, F.concat(F.lit("Here: "), whole, F.lit(" as asked"))).when(e % 7 == 0, F.lit("no value")).otherwise(whole)
    return table(spark, sf_dir, "events").select("event_id", "event_type", whole.alias("whole"), cut.alias("cut"))


@query("""SELECT event_type AS dataset, count(*) AS n, round(avg((event_id % 3 <> 0 AND (event_id % 7 <> 0 OR event_id % 4 = 0 OR event_id % 5 = 0))::INT), 9) AS parse_success, round(avg((event_id % 3 = 0)::INT), 9) AS parse_partial_rate,
round(avg((event_id % 3 <> 0 AND (event_id % 7 <> 0 OR event_id % 4 = 0 OR event_id % 5 = 0))::INT), 9) AS exact_match FROM events GROUP BY event_type""")
def decoded_scores(spark, sf_dir):
    """Strict, fenced, embedded, cut off and missing JSON against the whole, whose strings are stripped before they are compared."""
    rows = json_text.decode(cut_json(spark, sf_dir), F.col("cut"), "d")
    target = json_text.comparable(json_text.canonical(F.replace("whole", F.concat(F.lit('" '), "event_type", F.lit(' "')), F.concat(F.lit('"'), "event_type", F.lit('"')))))
    rows = rows.select(F.col("event_type").alias("dataset"), "d.valid", "d.partial", json_text.comparable(F.col("d.parsed")).alias("parsed"), target.alias("target"))
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 9)
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), mean(F.col("valid") & ~F.col("partial")).alias("parse_success"), mean(F.col("valid") & F.col("partial")).alias("parse_partial_rate"), mean(F.col("valid") & (F.col("parsed") == F.col("target"))).alias("exact_match"))


@query("""SELECT codec, CASE codec WHEN 'text' THEN event_id % 3 IS NOT NULL WHEN 'json_list' THEN false ELSE event_id % 3 = 0 OR event_id % 7 <> 0 OR event_id % 4 = 0 OR event_id % 5 = 0 END AS valid,
CASE WHEN codec <> 'text' AND event_id % 3 <> 0 AND event_id % 7 = 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0 THEN 'json_decode_error' WHEN codec = 'json_list' THEN 'json_type_error' END AS error_type, count(*) AS n
FROM events, (VALUES ('text'), ('json_any'), ('json_object'), ('json_list')) c(codec) GROUP BY ALL""")
def codec_results(spark, sf_dir):
    kinds = ("text", "json_any", "json_object", "json_list")
    rows = json_text.decode_each(cut_json(spark, sf_dir), F.col("cut"), {k: k for k in kinds})
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("codec"), F.col(f"{k}.valid").alias("valid"), F.col(f"{k}.error_type").alias("error_type")) for k in kinds)))
    return rows.select(each.alias("x")).groupBy("x.codec", "x.valid", "x.error_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- attributes, built as JSON from the order lines

SHAPES = """shapes AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'other' WHEN l_partkey % 5 = 1 THEN 'callout' WHEN l_partkey % 5 = 2 THEN 'blob' ELSE 'oval' END AS kind,
l_linenumber % 2 = 0 AS style, l_suppkey % 3 = 0 AS color, l_suppkey % 4 = 0 AS fill, l_linenumber % 3 = 0 AS points FROM lineitem)"""


def shape_parameters(spark, sf_dir):
    """(l_orderkey, l_linenumber, parameters): JSON of a shape; some break the contract."""
    kind = F.when(F.col("l_partkey") % 5 == 0, "other").when(F.col("l_partkey") % 5 == 1, "callout").when(F.col("l_partkey") % 5 == 2, "blob").otherwise("oval")
    border = F.concat(F.lit('"border":{"type":"uniform","style":"'), F.when(F.col("l_linenumber") % 2 == 0, "solid").otherwise("wavy"), F.lit('","color":"'), F.when(F.col("l_suppkey") % 3 == 0, "#12ab9F").otherwise("red"), F.lit('"}'))
    fill = F.when(F.col("l_suppkey") % 4 == 0, '"fill":{"type":"linear_gradient","colors":["#000000","#zz0000"],"direction":"up"}').otherwise('"fill":{"type":"none","color":"#ffffff"}')
    rest = F.when(F.col("l_linenumber") % 3 == 0, ',"points":[],"bbox":[1,2,3,4]').otherwise("")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit('{"shape_type":"'), kind, F.lit('",'), border, F.lit(","), fill, F.lit(',"effect":{"type":"glow"}'), rest, F.lit("}")).alias("parameters"))


@query(f"""WITH {SHAPES}, codes AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_filter([
CASE WHEN points THEN 'parameters:forbidden_geometry:bbox,points' END, CASE WHEN kind = 'blob' THEN 'shape_type:invalid' END, CASE WHEN kind = 'other' THEN 'other:must_only_contain_shape_type' END,
CASE WHEN kind IN ('oval', 'callout') AND points THEN 'parameters:unexpected_fields:bbox,points' END, CASE WHEN kind IN ('oval', 'callout') AND NOT style THEN 'border.style:invalid' END,
CASE WHEN kind IN ('oval', 'callout') AND NOT color THEN 'border.color:invalid_hex_color' END, CASE WHEN kind IN ('oval', 'callout') AND fill THEN 'fill.colors[1]:invalid_hex_color' END,
CASE WHEN kind IN ('oval', 'callout') AND fill THEN 'fill.direction:invalid_linear' END, CASE WHEN kind IN ('oval', 'callout') AND NOT fill THEN 'fill:unexpected_fields:color' END, CASE WHEN kind = 'callout' THEN 'callout.body_type:invalid' END], lambda x: x IS NOT NULL)) AS code FROM shapes)
SELECT code, count(*) AS n FROM codes GROUP BY code""")
def shape_contract(spark, sf_dir):
    rows = T.alike(shape_parameters(spark, sf_dir), "parameters")
    return rows.select(F.explode(T.shape_errors(F.col("parameters"))).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))


@query(f"""WITH {SHAPES} SELECT kind || '|uniform:' || CASE WHEN style THEN 'solid' ELSE 'wavy' END || '|' || CASE WHEN fill THEN 'linear_gradient' ELSE 'none' END || '|glow|round0|splits0' AS stratum, count(*) AS n FROM shapes GROUP BY ALL""")
def shape_strata(spark, sf_dir):
    return T.alike(shape_parameters(spark, sf_dir), "parameters").groupBy(T.shape_stratum(F.col("parameters")).alias("stratum")).agg(F.sum("n").alias("n"))


LINES = """line_rows AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS arrow, l_linenumber % 3 AS m, l_partkey % 4 AS p FROM lineitem)"""


def line_parameters(spark, sf_dir):
    """(l_orderkey, at, source, parameters): JSON of a line, by place; some break the contract."""
    m, p = F.col("l_linenumber") % 3, F.col("l_partkey") % 4
    points = F.when(p == 0, "[[[1,2],[3,4]]]").when(p == 1, "[[[5,6]]]").when(p == 2, "[[[1,1],[1,1],[7,2000]]]").otherwise("[]")
    single = F.when(m == 0, "true").otherwise("false")
    text = F.concat(F.lit('{"line_type":"straight","line_style":"'), F.when(m == 1, "shape").otherwise("path"), F.lit('","is_single":'), single, F.lit(',"points":'), points, F.lit(',"begin_arrow":"'), F.when(m == 2, "round").otherwise("none"),
                    F.lit('","end_arrow":"none","dash_style":"solid","fill_color":"#00ff00"'), F.when(m == 2, ',"has_border":true,"border_style":"dash"').otherwise(""), F.lit("}"))
    at = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("at"), F.when(F.col("l_suppkey") % 2 == 0, "arrow").otherwise("line").alias("source"), text.alias("parameters"))


@query(f"""WITH {LINES}, codes AS (SELECT unnest(list_filter([
CASE WHEN p = 1 THEN 'points[0]:must_have_at_least_two_points' END, CASE WHEN p = 2 THEN 'points[0]:must_have_two_distinct_points' END, CASE WHEN p = 2 THEN 'points[0][2]:invalid' END, CASE WHEN p = 3 THEN 'points:must_be_nonempty_segment_list' END,
CASE WHEN m = 0 AND p = 3 THEN 'is_single:true_requires_exactly_one_segment' END, CASE WHEN m <> 0 THEN 'is_single:false_requires_multiple_segments' END, CASE WHEN m = 2 THEN 'begin_arrow:invalid' END, CASE WHEN m = 2 THEN 'path:border_fields_not_allowed' END,
CASE WHEN m = 1 THEN 'shape:has_border_required' END, CASE WHEN arrow AND m <> 2 THEN 'source_prior:arrow_requires_at_least_one_head' END], lambda x: x IS NOT NULL)) AS code FROM line_rows)
SELECT code, count(*) AS n FROM codes GROUP BY code""")
def line_contract(spark, sf_dir):
    rows = T.alike(line_parameters(spark, sf_dir), "parameters", "source")
    return rows.select(F.explode(T.line_errors(F.col("parameters"), F.col("source"))).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber % 3 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS attempt_index FROM lineitem)
SELECT l_orderkey, min(attempt_index) AS attempt_index, CASE WHEN arg_min(l_suppkey, attempt_index) % 2 = 0 AND arg_min(m, attempt_index) = 2 THEN 'circle' ELSE 'none' END AS begin_arrow, 7 AS n_attributes
FROM (SELECT * FROM a WHERE m <> 1) GROUP BY l_orderkey""")
def first_valid_attempt(spark, sf_dir):
    """The first of an order's lines whose attributes keep the contract once they are in normal form."""
    rows = line_parameters(spark, sf_dir)
    texts = T.alike(rows, "parameters", "source").select("parameters", "source", T.normal_line(F.col("parameters"), F.col("source")).alias("attributes"))
    texts = texts.withColumn("valid", F.size(T.attribute_errors(F.col("attributes"))) == 0)
    rows = rows.join(texts, ["parameters", "source"], "left").select("l_orderkey", "at", "attributes", "valid")
    best = T.first_valid(rows, ["l_orderkey"], "at", F.col("valid"))
    return best.select("l_orderkey", "attempt_index", F.col("attributes")["begin_arrow"].alias("begin_arrow"), (F.size("attributes") + 1).alias("n_attributes"))


@query(f"""WITH {LINES} SELECT 'straight|' || CASE WHEN m = 1 THEN 'shape' ELSE 'path' END || '|segments' || CASE WHEN p = 3 THEN 0 ELSE 1 END || '|solid|' || CASE WHEN m = 2 THEN 'round' ELSE 'none' END || '|none|missing|missing|-' AS stratum, count(*) AS n FROM line_rows GROUP BY ALL""")
def line_strata(spark, sf_dir):
    return T.alike(line_parameters(spark, sf_dir), "parameters").groupBy(T.line_stratum(F.col("parameters")).alias("stratum")).agg(F.sum("n").alias("n"))


@query("""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events) JOIN (VALUES ('click', 3), ('click', 3), ('view', 7)) w(event_type, i) USING (event_type, i)""")
def row_lookup(spark, sf_dir):
    """Rows by dataset and place, as often as they are asked for, from a table that is written in parts of 4,096 places."""
    rows = sampling.ordinals(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], id_bin("event_id"), ["event_id"], "row_index")
    index = OrdinalIndex(spark, f"{shared_folder(spark)}/millrace-ordinals-{uuid.uuid4().hex}", ["event_type"], 4096)
    index.write(rows)
    wanted = spark.createDataFrame([("click", 3), ("click", 3), ("view", 7)], "event_type string, row_index long")
    return index.lookup(wanted).select("event_type", "event_id")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'regular_hexagon' WHEN 1 THEN 'oval' WHEN 2 THEN 'other' ELSE 'arrow_pentagon' END AS shape, CASE WHEN p_partkey % 2 = 0 THEN 'dash_dot' ELSE 'unknown' END AS style, p_partkey % 3 = 0 AS shown,
CASE p_partkey % 3 WHEN 0 THEN '#' || printf('%02X', p_partkey % 256) || '00FF' WHEN 1 THEN '#ABCDEF' ELSE '#000000' END AS color, CASE p_partkey % 3 WHEN 1 THEN 'unknown' WHEN 2 THEN 'none' ELSE 'unknown' END AS weak FROM part""")
def normal_attributes(spark, sf_dir):
    k = F.col("p_partkey")
    shape = F.when(k % 4 == 0, " Hexagon ").when(k % 4 == 1, "circle").when(k % 4 == 2, "squiggle").otherwise("Right-Arrow")
    color = F.when(k % 3 == 0, F.concat(F.lit("rgb("), (k % 256).cast("string"), F.lit(", 0,999)"))).when(k % 3 == 1, "abcdef").otherwise("None")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.shape_name(shape).alias("shape"), T.choice(F.when(k % 2 == 0, "Dash-Dot").otherwise("zigzag"), ("solid", "dash_dot")).alias("style"), T.truth(F.when(k % 3 == 0, " YES").otherwise("0")).alias("shown"),
        T.hex_color(color).alias("color"), T.weak_color(color).alias("weak"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'points' WHEN event_id % 3 = 0 THEN 'reconstruction' ELSE 'axis' END AS source, CASE WHEN event_id % 2 = 0 THEN 'p' WHEN event_id % 3 = 0 THEN 'r' ELSE 'a' END AS value, event_id % 2 <> 0 AND event_id % 3 <> 0 AS fallback,
CASE WHEN event_type = 'view' THEN 'source_prior' WHEN event_id % 5 = 0 THEN 'crop' WHEN event_id % 7 = 0 THEN 'full' ELSE 'dataset_prior' END AS head_source, CASE WHEN event_type = 'view' THEN 'none' WHEN event_id % 5 = 0 THEN 'line' WHEN event_id % 7 = 0 THEN 'tee' ELSE 'none' END AS begin_arrow,
CASE WHEN event_type = 'view' THEN 'none' WHEN event_id % 5 = 0 THEN 'none' WHEN event_id % 7 = 0 THEN 'tee' ELSE 'stealth' END AS end_arrow FROM events""")
def fused_sources(spark, sf_dir):
    e = F.col("event_id")
    rows = T.fused(table(spark, sf_dir, "events").select("event_id", "event_type"), [("points", e % 2 == 0, F.lit("p")), ("reconstruction", e % 3 == 0, F.lit("r"))], ("axis", F.lit("a")))
    kind = F.when(F.col("event_type") == "view", "line").otherwise("arrow")
    return T.arrow_heads(rows, kind, [("crop", e % 5 == 0, F.lit("line"), F.lit("none")), ("full", e % 7 == 0, F.lit("tee"), F.lit("tee"))]).drop("event_type")


@query("""SELECT event_id, unnest(range(4)) AS slot, CASE WHEN unnest(range(4)) = event_id % 3 THEN 'a' || event_id WHEN unnest(range(4)) = 3 THEN 'b' END AS value FROM events""")
def realigned_batches(spark, sf_dir):
    e = F.col("event_id").cast("string")
    items = F.concat(F.lit('[{"index":3,"v":"b"},{"index":9,"v":"x"},{"v":"y"},{"index":'), (F.col("event_id") % 3).cast("string"), F.lit(',"v":"a'), e, F.lit('"}]'))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(T.aligned_batch(items, F.lit(4))).alias("slot", "item"))
    return rows.select("event_id", F.col("slot").cast("long").alias("slot"), F.get_json_object("item", "$.v").alias("value"))
