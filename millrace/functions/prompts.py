"""Prompt templates: {{ name }} and {{ name | json }}, compiled to a column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_TYPES = ("string", "enum")
HOLE = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*(?:\|\s*(\w+)\s*)?\}\}")


def compile_prompt(template: str, arguments: dict[str, str]) -> list[tuple[str, str]]:
    """Parts of a template: ("text", literal), ("value", name) or ("json", name). All else is literal.

    Only declared arguments may be used, and without the json filter only those that are text.
    """
    parts, at, used = [], 0, set()
    for m in HOLE.finditer(template):
        name, how = m[1], m[2]
        if name not in arguments:
            raise ValueError(f"{name} is not declared")
        if how not in (None, "json"):
            raise ValueError(f"unknown filter {how}")
        if how is None and arguments[name] not in TEXT_TYPES:
            raise ValueError(f"{name} is {arguments[name]}: use the json filter")
        parts += [("text", template[at : m.start()])] if m.start() > at else []
        parts.append(("json" if how else "value", name))
        used.add(name)
        at = m.end()
    if missing := set(arguments) - used:
        raise ValueError(f"declared and not used: {', '.join(sorted(missing))}")
    return [*parts, *([("text", template[at:])] if at < len(template) else [])]


def json_value(value: Column) -> Column:
    """A value as JSON: what to_json writes for it as a field."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)


def render(parts: list[tuple[str, str]]) -> Column:
    return F.concat(*(F.lit(x) if kind == "text" else F.col(x).cast("string") if kind == "value" else json_value(F.col(x)) for kind, x in parts))


TYPES = ("string", "integer", "number", "boolean", "enum", "array", "object")
NAME = re.compile(r"[A-Za-z_]\w*")


def different_texts(values) -> bool:
    return isinstance(values, list) and bool(values) and all(isinstance(v, str) for v in values) and len(set(values)) == len(values)


#: What each key of an argument may be, given the whole of its specification, and what is said where it is not. ABSENT stands for a key that is not there.
ABSENT = object()
KEY_RULES = {
    "values": (lambda v, spec: different_texts(v) if spec.get("type") == "enum" else v is ABSENT, "an enum has different texts as values, other types have none"),
    "type": (lambda v, spec: v in TYPES, f"the type is one of {', '.join(TYPES)}"),
    "required": (lambda v, spec: v is True or v is ABSENT, "arguments are always required"),
}


def schema_faults(payload: dict) -> list[str]:
    """All that is wrong with a prompt schema."""
    found = [f"bad argument name {n!r}" for n in payload if not (isinstance(n, str) and NAME.fullmatch(n))]
    for name, spec in payload.items():
        if not isinstance(spec, dict):
            found.append(f"{name}: a specification is a mapping")
            continue
        found += [f"{name}: unknown key {k!r}" for k in sorted(map(str, spec.keys() - KEY_RULES.keys()))]
        found += [f"{name}: {says}" for key, (fits, says) in KEY_RULES.items() if not fits(spec.get(key, ABSENT), spec)]
    return found


def schema(payload: dict | None) -> dict[str, dict]:
    """A checked prompt schema {name: {"type", "values"}}; raises with all that is wrong: names, types and keys that are not known, optional
    arguments, enums without values or with repeated ones, values of other types."""
    given = {} if payload is None else payload
    if not isinstance(given, dict):
        raise ValueError("a prompt schema is a mapping")
    if faults := schema_faults(given):
        raise ValueError("; ".join(faults))
    return {name: {k: list(v) if k == "values" else v for k, v in sorted(spec.items()) if k != "required"} for name, spec in given.items()}


def argument_errors(names: Column, arguments: dict[str, dict]) -> Column:
    """Why the names of a record's arguments do not fit a schema, else null: those that are missing, then those too many."""
    declared = F.array(*map(F.lit, arguments)) if arguments else F.array().cast("array<string>")
    missing, extra = F.array_sort(F.array_except(declared, names)), F.array_sort(F.array_except(names, declared))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))).when(F.size(extra) > 0, F.concat(F.lit("unexpected: "), F.array_join(extra, ",")))


def audit(template: str, arguments: dict[str, dict], values: Column, rendered: Column) -> Column:
    """struct of SHA-256 sums: of the template, the schema, both together, the record's arguments (canonical JSON) and the rendered text."""
    import hashlib
    import json

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shape = json.dumps(arguments, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    fixed = {"template_sha256": digest(template), "schema_sha256": digest(shape), "program_sha256": digest(f"{template}\n{shape}")}
    return F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), F.sha2(values, 256).alias("args_sha256"), F.sha2(rendered, 256).alias("rendered_sha256"))


def blank(rendered: Column) -> Column:
    """Whether a rendered prompt has nothing in it."""
    return ~F.coalesce(rendered.rlike(r"\S"), F.lit(False))
