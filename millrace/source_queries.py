"""Queries through a catalogue of written JSON lines, chat completions and target adapters, each beside its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .functions import json_text, prompts
from .plans import transforms
from .queries import query, table
from .sources import records, registry
from .sources.scratch import Rounds, shared_folder

BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'others' END AS dataset_name, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS dataset_no, doc_id, source, md5(text) AS text_md5, length(text) AS n_chars
FROM documents WHERE regexp_replace(text, '^{BLANKS}', '') <> '' AND source <> 'src3'""")
def catalogue_rows(spark, sf_dir):
    """Documents written as JSON lines of two datasets, found through a catalogue, read back, checked and passed through a transform and a hook."""
    folder = f"{shared_folder(spark)}/millrace-catalogue-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("target_text"))
    for name, part in (("english", "lang = 'en'"), ("others", "lang <> 'en'"), ("unused", "lang = 'de'")):
        records.write_json_lines(docs.filter(part), f"{folder}/{name}")
    entries = [{"name": n, "reader": "json_lines", "train": [n], "enabled": n != "unused"} for n in ("english", "others", "unused")]
    spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.text(f"{folder}/list")
    sources = registry.read_catalogue(spark, f"{folder}/list")
    opened = Rounds(spark, "catalogue").table("lines", registry.open_split(spark, sources, "train"))  # the checks read it again
    lines = records.check_lines(opened, F.when(~F.col("ok"), "not an object"))
    rows = lines.select("dataset_name", "dataset_no", *(records.text_field(f).alias(f) for f in ("doc_id", "source", "target_text")))
    hooks = transforms.Hooks()
    hooks.on("opened", lambda df: df.filter("source <> 'src3'"))
    rows = transforms.applied(hooks.intercept("opened", registry.check_unique(rows, "doc_id")), [{"name": "drop_empty_target"}])
    return rows.select("dataset_name", "dataset_no", F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5("target_text").alias("text_md5"), F.char_length("target_text").cast("long").alias("n_chars"))


@query(f"""SELECT conv_id, turn, md5(regexp_replace(coalesce(text, ''), '^{BLANKS}|{BLANKS}$', '', 'g')) AS text_md5, 2 AS n_objects, md5(coalesce(text, '')) AS second_md5, NOT regexp_matches(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]') AS blank FROM conversations""")
def parsed_completions(spark, sf_dir):
    """Turns as chat completions of four shapes, and as the second object of an array that stands within other text."""
    text = F.coalesce("text", F.lit(""))
    written = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    said = written(text)
    k = F.col("turn") % 4
    completion = F.when(k == 0, said).when(k == 1, F.concat(F.lit('{"role":"assistant","content":'), said, F.lit("}"))).when(k == 2, F.concat(F.lit('[{"content":'), said, F.lit("}]"))).otherwise(
        F.concat(F.lit('{"content":[{"type":"text","text":'), said, F.lit("}]}")))
    listed = F.concat(F.lit('Here you are:\n```json\n[{"a":[1,{"b":"]"}]}, 7, {"text":'), said, F.lit("}]\n```"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), json_text.completion_text(completion).alias("c"), json_text.objects_of(listed).alias("o"))
    return rows.select("conv_id", "turn", F.md5("c").alias("text_md5"), F.size("o").alias("n_objects"), F.md5(F.get_json_object(F.get("o", F.lit(1)), "$.text")).alias("second_md5"), prompts.blank(F.col("text")).alias("blank"))


@query("""SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, 'field ''more.k'' not found' AS more_error, event_type AS kind FROM events""")
def adapted_targets(spark, sf_dir):
    """Targets by adapters: a path into the properties, one that is not there, and the text of a column."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    rows = json_text.TARGETS.create("field", rows, "k", path="k", column="props", codec="json_any")
    rows = json_text.TARGETS.create("field", rows, "more", path="more.k", column="props")
    rows = json_text.TARGETS.create("target_text", rows, "kind", column="event_type", codec="text")
    return rows.select("event_id", "k.value", "more.error", F.col("kind.value").alias("kind")).toDF("event_id", "k", "more_error", "kind")
