"""Training records from JSON lines and from conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .registry import READERS

FIRST_ERRORS = 20
PART = "struct<type:string,text:string>"


def json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_no, line_no, value, ok): the non-blank lines of files, with 1-based line numbers; file_no is the place of its path in ``paths``.

    Files are read in blocks, however large they are. A line's number is its place in its block, which the ids of a
    task's rows give, and the lines of the blocks before, of which only counts are looked at.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    scheme = lambda text: F.regexp_replace(text, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    found = scheme(F.concat(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.lit("/")))
    file_no = F.lit(None).cast("int")
    # whole paths, the longest that holds the file, of equal ones the first; a path may be that of a folder
    for k, given in sorted(enumerate(whole_paths(spark, paths)), key=lambda x: (len(x[1]), -x[0])):
        file_no = F.when(found.startswith(scheme(F.lit(given + "/"))), k).otherwise(file_no)
    rows = lines.join(blocks, ["path", "block"]).select("path", F.coalesce(file_no, F.lit(0)).alias("file_no"), (F.col("id") + F.col("shift")).alias("line_no"), strip(F.col("value")).alias("value"))
    rows = rows.filter(F.col("value") != "")
    kind = F.expr("schema_of_variant(try_parse_json(value))")
    return rows.withColumn("ok", F.coalesce(kind.startswith("OBJECT"), F.lit(False)))


def whole_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths with their file system and from its root, as the files that Spark reads are named."""
    out = []
    for given in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(given)
        out.append(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/"))
    return out


@READERS.register("json_lines")
def read_json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return json_lines(spark, paths)


def check_lines(lines: DataFrame, error: Column) -> DataFrame:
    """The lines without an error; raises with the number of bad lines and the first of them if there are any."""
    bad = lines.withColumn("error", error).filter("error IS NOT NULL")
    total = bad.count()
    if total:
        first = bad.orderBy("file_no", "line_no").limit(FIRST_ERRORS).collect()
        raise ValueError(f"{total} bad lines: " + "; ".join(f"L{r['line_no']}: {r['error']}" for r in first))
    return lines


def text_field(*names: str, row: str = "value") -> Column:
    """The first of some fields of a JSON line that is there."""
    return F.coalesce(*(F.get_json_object(row, f"$.{n}") for n in names))


def list_depth(content: Column) -> Column:
    """How many lists stand within one another at most in a variant, from its brackets outside of strings."""
    brackets = F.regexp_replace(F.to_json(content), r'"(?:[^"\\]|\\.)*+"|[^\[\]]', "")

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def parts_of(content: Column) -> Column:
    """A message's content, a variant, as an array of struct(type, text): text stands for itself, objects by their type,
    lists are flattened, however deep; anything else is written out as text."""
    part = lambda k, text: F.array(F.struct(F.lit(k).alias("type"), text.cast("string").alias("text")))
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))

    def single(v: Column) -> Column:
        written = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        named, held = F.try_variant_get(v, "$.type", "string"), F.try_variant_get(v, "$.text", "variant")
        inner = F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(held, "$", "string")).otherwise(F.to_json(held))
        of_object = F.when(named == "image", part("image", F.lit(None))).when(held.isNotNull() | (named == "text"), part("text", F.coalesce(inner, F.lit("")))).otherwise(part("text", written))
        return F.when(v.isNull(), part("text", F.lit(""))).when(F.schema_of_variant(v).startswith("OBJECT"), of_object).otherwise(part("text", written))

    items = F.try_variant_get(content, "$", "array<variant>")
    opened = lambda acc, _: F.flatten(F.transform(acc, lambda v: F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))
    deeper = F.when(list_depth(content) > 1, F.aggregate(F.sequence(F.lit(2), list_depth(content)), items, opened)).otherwise(items)
    return F.when(is_list(content), F.flatten(F.transform(deeper, single))).otherwise(single(content))


def messages_of(row: Column) -> Column:
    """The messages of a JSON line, from messages, conversation or conversations: array of struct(role, content: array of
    parts); null without. Roles are stripped and in lower case, user where there is none."""
    raw = F.coalesce(*(F.try_variant_get(F.try_parse_json(row), f"$.{k}", "array<variant>") for k in ("messages", "conversation", "conversations")))
    role = lambda m: F.lower(strip(F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("user"))))
    return F.transform(raw, lambda m: F.struct(role(m).alias("role"), parts_of(F.try_variant_get(m, "$.content", "variant")).alias("content")))


def text_of(content: Column) -> Column:
    """The text parts of a content, joined and stripped."""
    return strip(F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), ""))


def placeholders(messages: Column) -> Column:
    """How many image parts the messages have."""
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.size(F.filter(m["content"], lambda p: p["type"] == "image")))


def images_of(row: Column, folder: Column) -> tuple[Column, Column]:
    """(image_paths, error) of a JSON line: exactly one of image_path, image and images may be there; relative paths are taken from ``folder``."""
    get = lambda k: F.get_json_object(row, f"$.{k}")
    several, single = F.from_json(get("images"), "array<string>"), F.coalesce(get("image_path"), get("image"))
    number = sum((get(k).isNotNull().cast("int") for k in ("image_path", "image", "images")), F.lit(0))
    nested = F.coalesce(F.ltrim(single).rlike(r"^[\[{]"), F.lit(False))
    raw = F.coalesce(several, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))
    blank = F.exists(raw, lambda p: F.coalesce(strip(p), F.lit("")) == "")
    resolved = F.transform(raw, lambda p: F.when(strip(p).rlike("^(/|[a-z0-9]+:/)"), strip(p)).otherwise(F.concat(folder, F.lit("/"), strip(p))))
    error = (
        F.when(number > 1, "more than one image field").when(get("images").isNotNull() & (F.coalesce(F.size(several), F.lit(0)) < 1), "images must be a list of paths")
        .when(nested, "one path expected").when(blank, "blank image path")
    )
    return resolved, error


USED = ("image_path", "image", "images", "messages", "conversation", "conversations", "dataset_name", "sample_id", "system_prompt", "user_prompt")


def record_base(lines: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """``lines`` with what all records have: image_paths, messages, prompts, sample_id, source_dataset_name and extra, the JSON of all other fields."""
    row, folder = F.col("value"), F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "/[^/]*$", "")
    paths, error = images_of(row, folder)
    fields = F.from_json(row, "map<string,string>")
    extra = F.map_filter(fields, lambda k, v: ~k.isin(*USED, *used) & v.isNotNull())
    source = F.nullif(strip(F.coalesce(text_field("dataset_name"), F.lit(""))), F.lit(""))
    malformed = F.coalesce(*(F.get_json_object(row, f"$.{k}") for k in ("messages", "conversation", "conversations"))).isNotNull() & messages_of(row).isNull()
    rows = lines.select(
        "*", paths.alias("image_paths"), messages_of(row).alias("messages"), F.coalesce(text_field("system_prompt"), F.lit("")).alias("system_prompt"),
        F.nullif(F.coalesce(text_field("sample_id"), F.lit("")), F.lit("")).alias("sample_id"), source.alias("source_dataset_name"), extra.alias("extra"),
        F.when(~F.col("ok"), "not a JSON object").when(error.isNotNull(), error).when(malformed, "messages must be a list of objects").alias("_error"),
    )
    return rows


def with_error(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """Adds error: the first rule of the base, then of ``rules`` that fails, then that of the number of images in the messages."""
    error = F.col("_error")
    counted = F.coalesce((F.size("messages") > 0) & (placeholders(F.col("messages")) != F.size("image_paths")), F.lit(False))
    for fails, message in (*rules, (counted, "image placeholders do not match the image paths")):
        error = F.when(error.isNull() & F.coalesce(fails, F.lit(False)), message).otherwise(error)
    return rows.withColumn("error", error).drop("_error")


def sft_fields(lines: DataFrame) -> DataFrame:
    """Columns of supervised records. The target is target_text, else the text of a last message of the assistant, which then leaves the prompt."""
    rows = record_base(lines, ("target_text", "prompt_args"))
    last = F.try_element_at("messages", F.lit(-1))
    from_last = text_field("target_text").isNull() & (last["role"] == "assistant")
    args = text_field("prompt_args")
    rows = rows.withColumns({"target_text": F.when(F.coalesce(from_last, F.lit(False)), text_of(last["content"])).otherwise(text_field("target_text")), "user_prompt": F.coalesce(text_field("user_prompt"), F.lit("")), "prompt_args": args})
    rows = rows.withColumn("messages", F.when(F.coalesce(from_last, F.lit(False)), F.slice("messages", 1, F.size("messages") - 1)).otherwise(F.col("messages")))
    keys = F.json_object_keys(args)
    return with_error(rows, (F.size("image_paths") == 0, "no image path"), (F.col("target_text").isNull(), "no target"), (args.isNotNull() & keys.isNull(), "prompt_args must be an object"),
                      ((F.size("messages") > 0) & (F.size(keys) > 0), "messages and prompt_args together"))


def pair_fields(lines: DataFrame) -> DataFrame:
    """Columns of preference records: chosen_text and rejected_text, both needed."""
    rows = record_base(lines, ("chosen_text", "chosen", "rejected_text", "rejected"))
    rows = rows.withColumns({"chosen_text": text_field("chosen_text", "chosen"), "rejected_text": text_field("rejected_text", "rejected"), "user_prompt": F.coalesce(text_field("user_prompt"), F.lit(""))})
    return with_error(rows, (F.size("image_paths") == 0, "no image path"), (F.col("chosen_text").isNull() | F.col("rejected_text").isNull(), "no chosen or rejected text"))


def prompt_fields(lines: DataFrame) -> DataFrame:
    """Columns of prompt records: messages with text, or a prompt; images may be missing."""
    rows = record_base(lines, ("prompt",)).withColumn("user_prompt", F.coalesce(text_field("user_prompt", "prompt"), F.lit("")))
    silent = F.col("messages").isNotNull() & ~F.exists("messages", lambda m: text_of(m["content"]) != "")
    return with_error(rows, (F.col("messages").isNull() & (strip(F.col("user_prompt")) == ""), "no prompt"), (silent, "messages without text"))


def distillation_fields(lines: DataFrame) -> DataFrame:
    """Columns of prompt records with images for distillation: the messages must not end with the assistant."""
    rows = record_base(lines, ("prompt",)).withColumn("user_prompt", F.coalesce(text_field("user_prompt", "prompt"), F.lit("")))
    last = F.try_element_at("messages", F.lit(-1))
    none = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    return with_error(rows, (F.size("image_paths") == 0, "no image path"), (last["role"] == "assistant", "ends with an assistant target"), (none & (strip(F.col("user_prompt")) == ""), "no prompt"))


BUILDERS = {"sft": sft_fields, "dpo": pair_fields, "ppo": prompt_fields, "opd": distillation_fields}


def build_records(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Records of a kind from JSON lines; raises with the number of bad lines and the first of them if there are any."""
    rows = BUILDERS[kind](json_lines(spark, paths))
    return check_lines(rows, F.col("error")).drop("ok", "error")


for _kind in BUILDERS:
    READERS.register(f"jsonl_{_kind}")(lambda spark, paths, kind=_kind: build_records(spark, paths, kind))


def sample_id(given: Column, image_paths: Column, row: Column) -> Column:
    """The id given, else the stem of the first image, else row-{number}."""
    stem = F.regexp_extract(F.get(image_paths, 0), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(stem, F.lit("")), F.concat(F.lit("row-"), row.cast("string")))


def conversation_records(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, split into prompt and target.

    Roles are trimmed and lower-cased, user where missing. A last turn of the assistant with text is the target, and
    the turns before it the prompt; a conversation that ends otherwise is prompt only.
    """
    role = F.lower(strip(F.coalesce("role", F.lit("user"))))
    turn = F.struct("turn", F.when(role == "", "user").otherwise(role).alias("role"), strip(F.coalesce("text", F.lit(""))).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    last = F.element_at("turns", -1)
    rows = rows.withColumn("has_target", (last["role"] == "assistant") & (last["text"] != ""))
    rows = rows.withColumn("prompt_turns", F.when(F.col("has_target"), F.slice("turns", 1, F.size("turns") - 1)).otherwise(F.col("turns")))
    line = lambda t: F.concat(t["role"], F.lit(": "), t["text"])
    return rows.select(
        "conv_id", "has_target", F.size("turns").cast("long").alias("n_turns"), F.size("prompt_turns").cast("long").alias("n_prompt_turns"),
        F.coalesce(F.try_element_at(F.filter("turns", lambda t: t["role"] == "system"), F.lit(1))["text"], F.lit("")).alias("system_prompt"),
        F.array_join(F.transform("prompt_turns", line), "\n").alias("prompt"), F.when(F.col("has_target"), last["text"]).alias("target_text"),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list[str], optional: str | None = None) -> DataFrame:
    """Of rows with equal keys the one that comes first; rows where ``optional`` is null are all kept."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    if optional:
        whole, rest = rows.filter(F.col(optional).isNull()), rows.filter(F.col(optional).isNotNull())
        return rest.withColumn("_first", first).filter("_first").drop("_first").unionByName(whole)
    return rows.withColumn("_first", first).filter("_first").drop("_first")


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one written last, by aggregation: partial results before the shuffle, whatever the skew."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_last"))
    return best.select(*keys, "_last.*").select(rows.columns)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Write through Spark's committer: readers see all files of the job or none."""
    rows.write.mode("overwrite").json(path)


def latest_predictions(lines: DataFrame, id_col: str, order: str) -> DataFrame:
    """Of results appended in order the last of each id that has a prediction."""
    return last_write(lines.filter("prediction IS NOT NULL"), [id_col], order)


def rows_at(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows at some places, (dataset_name, row_index) for instance, as often as these are asked for."""
    return wanted.join(rows, keys)


def image_sizes(files: DataFrame) -> DataFrame:
    """(path, width, height) of PNG files read as binaryFile, from their headers alone; null for other files."""
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    side = lambda at: F.when(png, F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long"))
    return files.select("path", side(17).alias("width"), side(21).alias("height"))


def sharded_by_id(rows: DataFrame, id_col: str) -> DataFrame:
    """Adds shard, the first byte of the id's SHA-256 in hex, to partition files by."""
    return rows.withColumn("shard", F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 2))
