"""JSON from model output: strict where Spark can parse it, repaired in Python only where it cannot.

A value is held as canonical text: what Spark writes for its variant, with sorted keys, no spaces and plain numbers.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..sources.registry import Registry
from .text import SPACES, strip

#: Strings, left open or whole, with what closes them; brackets; commas; anything else up to one of these.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:(")|(\\)?\Z)|[{\[]|[}\]]|,|[^"{}\[\],]+', re.S)
#: Codecs by name, and what the canonical form of their values begins with.
KINDS = {"json_any": "", "json_object": "{", "json_list": "["}


def strip_fence(text: Column) -> Column:
    """Without the lines of a Markdown code fence around it."""
    return F.when(strip(text).startswith("```"), strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[^\n]*(\n|$)", ""), r"((^|\n)[^\S\n]*```[^\n]*)+$", ""))).otherwise(strip(text))


def fragment(text: Column) -> Column:
    """From the first brace or bracket on; all of it where there is none."""
    bare = strip_fence(text)
    return strip(F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)[{\[].*$", 0), F.lit("")), bare))


def completions(text: str):
    """``text`` completed in one pass: whole, and as far as an element of an open structure ended.

    Brackets that close nothing and commas before a closing one are left out; open strings and structures are closed.
    """
    out, closers, comma, safe = [], [], "", (0, [])
    for token in TOKEN.finditer(text):
        piece = token[0]
        if piece == ",":
            out += [comma] if comma else []
            comma = piece
            safe = (len(out), closers[:]) if closers else safe
        elif piece in "}]":
            if closers and closers[-1] == piece:
                comma = ""
                out.append(closers.pop())
                safe = (len(out), closers[:])
        elif not piece.isspace():
            if piece in "{[":
                closers.append("}" if piece == "{" else "]")
            elif piece[0] == '"' and not token[1]:
                piece += ("\\" if token[2] else "") + '"'
            out += [comma, piece] if comma else [piece]
            comma = ""
    yield "".join([*out, *reversed(closers)])
    if safe[0]:
        yield "".join([*out[: safe[0]], *reversed(safe[1])])


def no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def repair(text: str) -> tuple[str | None, bool]:
    """(JSON text, repaired): the first value of ``text``, of its completions, or an empty structure; None if it is none of these."""
    decoder = json.JSONDecoder(parse_constant=no_constant)
    rungs = [text, *completions(text), {"{": "{}", "[": "[]"}.get(text[:1], "")]
    for k, rung in enumerate(rungs):
        try:
            found, _ = decoder.raw_decode(rung)
            return json.dumps(found, ensure_ascii=False, allow_nan=False), k > 0
        except (ValueError, RecursionError):
            continue
    return None, False


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("partial", BooleanType())]))
def repaired(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(t) if t else (None, False) for t in texts], columns=["json", "partial"])


def canonical(text: Column) -> Column:
    """The canonical form of JSON text; null for what is not JSON, NaN and Infinity among it, and numbers too large for a double."""
    found = F.to_json(F.try_parse_json(text))
    # Spark writes a number that overflows as a string, which is told from one that stood there by their count
    endless = F.lit('"-?Infinity"')
    large = text.rlike(r"[eE]\+?0*[1-9][0-9]{2}|[0-9]{309}") & (F.regexp_count(found, endless) > F.regexp_count(text, endless))
    return F.when(F.coalesce(large, F.lit(False)), F.lit(None)).otherwise(found)


CODECS = Registry("codec")


@CODECS.register("text")
def text_codec(rows, text: Column, name: str):
    """Any text, stripped."""
    null = F.lit(None).cast("string")
    return rows.withColumn(name, F.struct(strip(F.coalesce(text, F.lit(""))).alias("parsed"), F.lit(True).alias("valid"), F.lit(False).alias("partial"), null.alias("error_type")))


def json_steps(rows, text: Column):
    """``rows`` with _parsed and _partial: the first JSON value of a text, without a code fence and what stands before it, and whether it was repaired. Only what Spark cannot parse goes through Python."""
    rows = rows.withColumn("_fragment", fragment(F.coalesce(text, F.lit("")))).withColumn("_strict", canonical(F.col("_fragment")))
    rows = rows.withColumn("_fixed", repaired(F.when(F.col("_strict").isNull(), F.col("_fragment")))).withColumn("_parsed", F.coalesce("_strict", canonical(F.col("_fixed.json"))))
    return rows.withColumn("_partial", F.col("_strict").isNull() & F.coalesce("_fixed.partial", F.lit(False)) & F.col("_parsed").isNotNull()).drop("_fragment", "_strict", "_fixed")


def json_result(starts: str) -> Column:
    """What a codec of values that begin with ``starts`` makes of ``json_steps``: a value of another kind is a json_type_error."""
    parsed = F.col("_parsed")
    fits = parsed.startswith(starts)
    error = F.when(parsed.isNull(), "json_decode_error").when(~fits, "json_type_error")
    return F.struct(F.when(fits, parsed).alias("parsed"), F.coalesce(fits, F.lit(False)).alias("valid"), F.col("_partial").alias("partial"), error.alias("error_type"))


def json_codec(starts: str):
    return lambda rows, text, name: json_steps(rows, text).withColumn(name, json_result(starts)).drop("_parsed", "_partial")


for _name, _starts in KINDS.items():
    CODECS.register(_name)(json_codec(_starts))


def decode_each(rows, text: Column, names: dict[str, str]):
    """``rows`` with a result column for each name, by its codec; codecs of JSON look at one decoding of the text."""
    rows = json_steps(rows, text) if set(names.values()) & set(KINDS) else rows
    for name, kind in names.items():
        rows = rows.withColumn(name, json_result(KINDS[kind])) if kind in KINDS else decode(rows, text, name, kind)
    return rows.drop("_parsed", "_partial")


def decode(rows, text: Column, name: str, kind: str = "json_any"):
    """``rows`` with a column ``name``: struct (parsed, valid, partial, error_type), by the codec ``kind``, one of CODECS: text, json_any,
    json_object, json_list, or one that was registered, a function of rows, text and name."""
    return CODECS.get(kind)(rows, text, name)


def comparable(json_text: Column) -> Column:
    """Canonical JSON with the strings among its values stripped, keys as they are: equal values are equal texts."""
    blank = rf"(?:{SPACES}|\\[nrtf]|\\u00(?:0[bB]|1[c-fC-F]))"
    token = r'(?:[^"\\]|\\.)'
    return F.regexp_replace(json_text, rf'(?s)\G((?:"{token}*+":|[^"]++)*+)"{blank}*+({token}*?){blank}*"', '$1"$2"')


def field(json_text: Column, path: str) -> tuple[Column, Column]:
    """(value, error) of a dotted path into a JSON object: a string's text, other values as JSON; an error names a path that is not there."""
    value = F.try_variant_get(F.try_parse_json(json_text), "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return text, F.when(value.isNull(), F.lit(f"field {path!r} not found"))


def objects_of(text: Column) -> Column:
    """The objects of the first JSON array in a text, as JSON; null where there is none. Code fences and what stands about the array are let pass."""
    bare = strip_fence(text)
    whole = F.coalesce(canonical(bare), canonical(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit(""))))
    return F.when(whole.startswith("["), F.filter(F.from_json(whole, "array<string>"), lambda x: F.json_object_keys(x).isNotNull()))


def completion_text(text: Column, depth: int = 3) -> Column:
    """The text of a chat completion in JSON: a string, an object with content or text, or a list of these, joined and stripped; other text is itself."""
    def of(v: Column, left: int) -> Column:
        kind = F.schema_of_variant(v)
        get = lambda p: F.try_variant_get(v, p, "variant")
        plain = F.when(kind == "STRING", strip(F.variant_get(v, "$", "string"))).when(kind == "VOID", "").otherwise(F.to_json(v))
        if not left:
            return plain
        inner = F.when(get("$.text").isNotNull(), of(get("$.text"), 0)).when(get("$.content").isNotNull(), of(get("$.content"), left - 1)).otherwise("")
        listed = strip(F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: of(x, left - 1)), ""))
        return F.when(kind.startswith("OBJECT"), inner).when(kind.startswith("ARRAY"), listed).otherwise(plain)

    value = F.try_parse_json(text)
    return F.when(value.isNull(), strip(text)).otherwise(of(value, depth))


TARGETS = Registry("target adapter")


@TARGETS.register("target_text")
def text_target(rows, name: str, column: str = "target_text", codec: str | None = None):
    """A text as it is, or decoded, where one that does not decode is an error."""
    return target_of(rows, F.col(column), name, codec)


@TARGETS.register("field")
def field_target(rows, name: str, path: str, column: str = "extra", codec: str | None = None):
    """A dotted path into a JSON object, as it is or decoded."""
    text, missing = field(F.col(column), path)
    rows = target_of(rows, text, name, codec)
    t = F.col(name)
    return rows.withColumn(name, F.struct(t["value"].alias("value"), t["valid"].alias("valid"), F.coalesce(missing, t["error"]).alias("error")))


def target_of(rows, text: Column, name: str, codec: str | None = None):
    """``rows`` with a target struct(value, valid, error) from a text: as it is, or decoded, where a text that does not decode is an error."""
    if codec is None:
        return rows.withColumn(name, F.struct(text.alias("value"), text.isNotNull().alias("valid"), F.when(text.isNull(), "no target text").alias("error")))
    rows = decode(rows, text, "_target", codec)
    d = F.col("_target")
    error = F.when(text.isNull(), "no target text").otherwise(d["error_type"])
    return rows.withColumn(name, F.struct(F.when(text.isNotNull(), d["parsed"]).alias("value"), (text.isNotNull() & d["valid"]).alias("valid"), error.alias("error"))).drop("_target")
