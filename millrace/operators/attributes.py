"""Attributes of shapes and lines, held as JSON text: contracts as lists of error codes, normal forms, strata and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values of the contracts.
SHAPES = ("rectangle", "oval", "triangle", "trapezoid", "parallelogram", "diamond", "step", "regular_pentagon", "regular_hexagon", "arrow_pentagon", "other_polygon", "callout", "other")
GEOMETRY = ("bbox", "bbox_2d", "points", "corners", "body_corners", "body_bbox", "tail")
SHAPE_ALIASES = {
    "rect": "rectangle", "rounded_rectangle": "rectangle", "rounded_rect": "rectangle", "circle": "oval", "ellipse": "oval", "hexagon": "regular_hexagon", "pentagon": "regular_pentagon",
    "arrow": "arrow_pentagon", "right_arrow": "arrow_pentagon", "polygon": "other_polygon", "speech_bubble": "callout", "bubble": "callout", "caption": "callout",
}
ARROWS = ("none", "line", "stealth", "triangle", "pointy", "tee", "circle")
LINEAR = ("bottom_to_top", "bottom_left_to_top_right", "left_to_right", "top_left_to_bottom_right")
HEX = r"^#[0-9A-Fa-f]{6}\z"


def value(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, f"$.{path}")


def bound(parsed: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is looked at."""
    return F.transform(F.array(parsed), body)[0]


def parsed(payload: Column, *fields: str, booleans: tuple[str, ...] = ()) -> Column:
    """Fields of a JSON object as texts, in a struct, with all (its sorted keys) and there (whether it is an object).

    Of ``booleans`` the text is only there if the value is true or false, and not a string that says so.
    """
    def read(text: Column) -> Column:
        held, names = F.from_json(text, ", ".join(f"{f} string" for f in fields)), F.json_object_keys(text)
        return F.struct(held.alias("held"), names.alias("names"), *([F.try_parse_json(text).alias("variant")] if booleans else []))

    def fields_of(x: Column) -> Column:
        kind = lambda f: F.schema_of_variant(F.try_variant_get(x["variant"], f"$.{f}", "variant"))
        text = lambda f: F.when(kind(f) == "BOOLEAN", x["held"][f]) if f in booleans else x["held"][f]
        return F.struct(*(text(f).alias(f) for f in fields), F.sort_array(F.coalesce(x["names"], F.array().cast("array<string>"))).alias("all"), x["names"].isNotNull().alias("there"))

    return bound(bound(payload, read), fields_of)


def values(payload: Column, *paths: str, body) -> Column:
    """``body`` of a struct of what stands at some paths of a JSON object, by the path's name, each looked up once."""
    return bound(bound(payload, lambda text: F.struct(*(value(text, p).alias(p.replace(".", "_")) for p in paths))), body)


def keys(payload: Column) -> Column:
    """The sorted keys of a JSON object; empty for anything else."""
    return F.sort_array(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")))


def is_object(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))


def absent(text: Column, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(text.isin(*allowed), F.lit(False))


def not_color(text: Column) -> Column:
    return ~F.coalesce(text.rlike(HEX), F.lit(False))


def extra_keys(held: Column, allowed: Column, field: str) -> Column:
    extra = F.array_except(held, allowed)
    return F.when(F.size(extra) > 0, F.concat(F.lit(f"{field}:unexpected_fields:"), F.array_join(extra, ",")))


def names(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def codes(*each: Column) -> Column:
    """The codes that are not null."""
    return F.filter(F.array(*each), lambda c: c.isNotNull())


def alike(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, n): what stands in some columns, once, and in how many rows. What a text says is then worked out once for all rows that hold it."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def border_errors(border: Column) -> Column:
    def check(x: Column) -> Column:
        kind, there = x["type"], x["there"]
        known, uniform = ~absent(kind, ("none", "uniform", "complex")), kind == "uniform"
        allowed = F.when(known & uniform, names("type", "style", "color")).otherwise(names("type"))
        return codes(
            F.when(~there, "border:missing_or_not_object"), F.when(there & ~known, "border.type:invalid"),
            F.when(there & uniform & absent(x["style"], ("solid", "dash", "dot")), "border.style:invalid"), F.when(there & uniform & not_color(x["color"]), "border.color:invalid_hex_color"),
            F.when(there, extra_keys(x["all"], allowed, "border")),
        )

    return bound(parsed(border, "type", "style", "color"), check)


def fill_errors(fill: Column) -> Column:
    def check(y: Column) -> Column:
        x, colors = y["x"], y["colors"]
        kind, direction, there = x["type"], x["direction"], x["there"]
        gradient = F.coalesce(kind.isin("linear_gradient", "radial_gradient"), F.lit(False))
        two = F.coalesce(F.size(colors) == 2, F.lit(False))
        allowed = F.when(kind == "solid", names("type", "color")).when(gradient, names("type", "colors", "direction")).otherwise(names("type"))
        return codes(
            F.when(~there, "fill:missing_or_not_object"), F.when(there & absent(kind, ("none", "solid", "linear_gradient", "radial_gradient", "complex")), "fill.type:invalid"),
            F.when(there & (kind == "solid") & not_color(x["color"]), "fill.color:invalid_hex_color"), F.when(there & gradient & ~two, "fill.colors:requires_two_colors"),
            *(F.when(there & gradient & two & not_color(F.get(colors, k)), f"fill.colors[{k}]:invalid_hex_color") for k in (0, 1)),
            F.when(there & (kind == "linear_gradient") & absent(direction, LINEAR), "fill.direction:invalid_linear"),
            F.when(there & (kind == "radial_gradient") & absent(direction, ("center_to_edge",)), "fill.direction:invalid_radial"), F.when(there, extra_keys(x["all"], allowed, "fill")),
        )

    return bound(bound(parsed(fill, "type", "color", "colors", "direction"), lambda x: F.struct(x.alias("x"), F.from_json(x["colors"], "array<string>").alias("colors"))), check)


def effect_errors(effect: Column) -> Column:
    return bound(parsed(effect, "type"), lambda x: codes(F.when(~x["there"] | absent(x["type"], ("none", "shadow", "glow")), "effect:invalid"), F.when(x["there"], extra_keys(x["all"], names("type"), "effect"))))


def shape_errors(parameters: Column) -> Column:
    """The error codes of a shape's attributes, none of them for those that keep the contract."""
    def check(x: Column) -> Column:
        kind = x["shape_type"]
        callout, known = kind == "callout", ~absent(kind, SHAPES)
        full = known & (kind != "other")
        forbidden = F.array_sort(F.array_intersect(x["all"], names(*GEOMETRY)))
        allowed = F.when(callout, names("shape_type", "border", "fill", "effect", "body_type")).otherwise(names("shape_type", "border", "fill", "effect"))
        first = codes(
            F.when(F.size(forbidden) > 0, F.concat(F.lit("parameters:forbidden_geometry:"), F.array_join(forbidden, ","))), F.when(~known, "shape_type:invalid"),
            F.when((kind == "other") & (F.size(x["all"]) != 1), "other:must_only_contain_shape_type"), F.when(full, extra_keys(x["all"], allowed, "parameters")),
        )
        inner = F.concat(border_errors(x["border"]), fill_errors(x["fill"]), effect_errors(x["effect"]), codes(F.when(callout & absent(x["body_type"], ("rectangle", "oval")), "callout.body_type:invalid")))
        return F.when(~x["there"], names("parameters:missing_or_not_object")).when(full, F.concat(first, inner)).otherwise(first)

    return bound(parsed(parameters, "shape_type", "border", "fill", "effect", "body_type"), check)


def segment_errors(points: Column) -> Column:
    """The error codes of segments [[[x, y], ..], ..] of whole codes 0 to 999."""
    good = lambda p: F.coalesce((F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & (v == F.floor(v)) & v.between(0, 999)), F.lit(False))

    def of_segment(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("points["), i.cast("string"), F.lit("]"))
        few = F.size(s) < 2
        places = F.size(F.array_distinct(F.filter(s, good)))
        bad = F.filter(F.transform(s, lambda p, j: F.when(~good(p), F.concat(at, F.lit("["), j.cast("string"), F.lit("]:invalid")))), lambda c: c.isNotNull())
        return F.when(few, F.array(F.concat(at, F.lit(":must_have_at_least_two_points")))).otherwise(
            F.concat(F.filter(F.array(F.when(places < 2, F.concat(at, F.lit(":must_have_two_distinct_points")))), lambda c: c.isNotNull()), bad)
        )

    def check(line: Column) -> Column:
        return F.when(F.coalesce(F.size(line), F.lit(0)) < 1, names("points:must_be_nonempty_segment_list")).otherwise(F.flatten(F.transform(line, of_segment)))

    return bound(F.from_json(points, "array<array<array<double>>>"), check)


# Fixed values of the contract.
LINE_FIELDS = ("line_type", "line_style", "is_single", "points", "begin_arrow", "end_arrow", "dash_style", "fill_color", "corner_style", "has_border", "border_style", "border_color")


def line_errors(parameters: Column, source: Column) -> Column:
    """The error codes of a line's attributes and points; an arrow needs a head."""
    required, border = LINE_FIELDS[:8], LINE_FIELDS[9:]
    boolean = lambda c: F.coalesce(c.isin("true", "false"), F.lit(False))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"parameters:{label}="), F.array_join(c, ",")))

    def check(y: Column) -> Column:
        x, n = y["x"], y["n"]
        has = lambda k: F.array_contains(x["all"], k)
        missing, extra = F.array_except(F.array_sort(names(*required)), x["all"]), F.array_except(x["all"], names(*LINE_FIELDS))
        single, style, bordered = x["is_single"], x["line_style"], x["has_border"]
        shape = style == "shape"
        two = lambda pair: F.coalesce((F.size(pair) == 2) & F.forall(pair, lambda c: F.coalesce(c.rlike(HEX), F.lit(False))), F.lit(False))
        no_fill = not_color(x["fill_color"]) & ~bound(F.from_json(x["fill_color"], "array<string>"), two)
        head = codes(
            listed("missing", missing), listed("extra", extra), F.when(absent(x["line_type"], ("straight", "curved")), "line_type:invalid"), F.when(absent(style, ("path", "shape")), "line_style:invalid"),
            F.when(~boolean(single), "is_single:invalid"),
        )
        tail = codes(
            F.when((single == "true") & (n >= 0) & (n != 1), "is_single:true_requires_exactly_one_segment"), F.when((single == "false") & (n >= 0) & (n <= 1), "is_single:false_requires_multiple_segments"),
            *(F.when(absent(x[k], ARROWS), f"{k}:invalid") for k in ("begin_arrow", "end_arrow")), F.when(absent(x["dash_style"], ("solid", "dash")), "dash_style:invalid"), F.when(no_fill, "fill_color:invalid"),
            F.when(has("corner_style") & absent(x["corner_style"], ("sharp", "round")), "corner_style:invalid"), F.when((style == "path") & (has(border[0]) | has(border[1]) | has(border[2])), "path:border_fields_not_allowed"),
            F.when(shape & ~boolean(bordered), "shape:has_border_required"), F.when(shape & (bordered == "true") & absent(x["border_style"], ("solid", "dash")), "border_style:invalid"),
            F.when(shape & (bordered == "true") & not_color(x["border_color"]), "border_color:invalid"), F.when(shape & (bordered == "false") & (has(border[1]) | has(border[2])), "shape:no_border_must_omit_border_fields"),
            F.when((source == "arrow") & (x["begin_arrow"] == "none") & (x["end_arrow"] == "none"), "source_prior:arrow_requires_at_least_one_head"),
        )
        return F.when(x["there"], F.concat(head, segment_errors(x["points"]), tail)).otherwise(names("root:expected_line_with_parameters"))

    counted = lambda x: F.struct(x.alias("x"), F.coalesce(F.size(F.from_json(x["points"], "array<string>")), F.lit(-1)).alias("n"))
    return bound(bound(parsed(parameters, *LINE_FIELDS, booleans=("is_single", "has_border")), counted), check)


def choice(text: Column, allowed: tuple[str, ...], default: str = "unknown") -> Column:
    """One of a set of names, written in any case with spaces or dashes; else the default."""
    name = F.translate(F.lower(strip(F.coalesce(text, F.lit("")))), "- ", "__")
    return F.when(name.isin(*allowed), name).otherwise(default)


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin("1", "true", "yes", "y"), F.lit(False))


def weak_color(text: Column) -> Column:
    """A hex colour in capitals, none or unknown."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(F.lower(bare).isin("none", "unknown"), F.lower(bare)).when(bare.rlike(HEX), F.upper(bare)).otherwise("unknown")


def hex_color(text: Column, default: str = "#000000") -> Column:
    """A colour as #RRGGBB, from that with or without the sign or from rgb(r, g, b); else the default."""
    bare = strip(F.coalesce(text, F.lit("")))
    rgb = r"^rgb\((\d{1,3}),\s*(\d{1,3}),\s*(\d{1,3})\)$"
    parts = F.transform(F.array(*(F.regexp_extract(bare, rgb, k) for k in (1, 2, 3))), lambda p: F.lpad(F.hex(F.least(F.lit(255), p.cast("int"))), 2, "0"))
    return F.when(bare.rlike("^#?[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), F.upper(F.regexp_replace(bare, "#", "")))).when(bare.rlike(rgb), F.concat(F.lit("#"), F.array_join(parts, ""))).otherwise(default)


def shape_name(text: Column, aliases: dict[str, str] = SHAPE_ALIASES, allowed: tuple[str, ...] = SHAPES, default: str = "other") -> Column:
    """A shape's name as the contract has it, through its aliases."""
    name = F.translate(F.lower(strip(F.coalesce(text, F.lit("")))), "- ", "__")
    known = F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[name], name)
    return F.when(known.isin(*allowed), known).otherwise(default)


def aligned_batch(items: Column, size: Column) -> Column:
    """The items of a JSON array by their index: an array of ``size``, null where none has that index; of several the last."""
    each = F.from_json(items, "array<string>")
    found = lambda i: F.element_at(F.filter(each, lambda x: F.get_json_object(x, "$.index").cast("int") == i), -1)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(F.exists(each, lambda x: F.coalesce(F.get_json_object(x, "$.index").cast("int") == i, F.lit(False))), found(i)))


def normal_line(payload: Column, source: Column) -> Column:
    """The attributes of a line as a map: those that count, round heads as circles, no border fields where there is no border, no heads on a line without arrows."""
    wanted = tuple(f for f in LINE_FIELDS if f not in ("is_single", "points"))
    inner = lambda x: F.when((x["type"] == "line") & is_object(x["parameters"]), x["parameters"])
    text = bound(payload, lambda whole: F.coalesce(bound(parsed(whole, "type", "parameters"), inner), whole))

    def normal(x: Column) -> Column:
        style, bordered = x["line_style"], x["has_border"]

        def field(k: str) -> Column:
            v = x[k]
            if k in ("begin_arrow", "end_arrow"):
                v = F.when(source == "line", "none").when(v == "round", "circle").otherwise(v)
            if k in ("has_border", "border_style", "border_color"):
                v = F.when(style == "path", None).otherwise(v)
            if k in ("border_style", "border_color"):
                v = F.when((style == "shape") & (bordered == "false"), None).otherwise(v)
            return F.struct(F.lit(k).alias("key"), v.alias("value"))

        return F.map_from_entries(F.filter(F.array(*map(field, wanted)), lambda e: e["value"].isNotNull()))

    return bound(parsed(text, *wanted), normal)


def attribute_errors(attributes: Column) -> Column:
    """The error codes of a map of a line's attributes, its points aside."""
    get = lambda k: attributes[k]
    shape, bordered = get("line_style") == "shape", get("has_border")
    return codes(
        *(F.when(absent(get(k), a), f"{k}:invalid") for k, a in (("line_type", ("straight", "curved")), ("line_style", ("path", "shape")), ("begin_arrow", ARROWS), ("end_arrow", ARROWS), ("dash_style", ("solid", "dash")))),
        F.when(not_color(get("fill_color")), "fill_color:invalid"), F.when(get("corner_style").isNotNull() & absent(get("corner_style"), ("sharp", "round")), "corner_style:invalid"),
        F.when(shape & absent(bordered, ("true", "false")), "shape:has_border_required"), F.when(shape & (bordered == "true") & absent(get("border_style"), ("solid", "dash")), "border_style:invalid"),
        F.when(shape & (bordered == "true") & not_color(get("border_color")), "border_color:invalid"),
    )


def first_valid(attempts: DataFrame, keys: list[str], order: str, valid: Column) -> DataFrame:
    """Of each key's attempts the first that is valid, with ``attempt_index``, its place among all."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = attempts.withColumn("attempt_index", place.cast("long")).filter(valid)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), "attempt_index").alias("_b"))
    return best.select(*keys, "_b.*")


def fill_signature(fill: Column) -> Column:
    """A fill's type; of several regions their number and types."""
    kinds = lambda regions: F.transform(regions, lambda r: F.when(is_object(r), F.coalesce(F.get_json_object(r, "$.type"), F.lit("missing"))).otherwise("invalid"))
    several = lambda regions: F.concat(F.lit("regions"), F.size(regions).cast("string"), F.lit(":"), F.array_join(kinds(regions), "+"))
    return bound(fill, lambda f: F.when(is_object(f), F.coalesce(value(f, "type"), F.lit("missing"))).when(F.ltrim(f).startswith("["), bound(F.from_json(f, "array<string>"), several)).otherwise("missing"))


def border_signature(border: Column) -> Column:
    return bound(border, lambda b: F.when(is_object(b), F.concat_ws(":", F.coalesce(value(b, "type"), F.lit("missing")), F.coalesce(value(b, "style"), F.lit("-")))).otherwise("missing"))


def shape_stratum(parameters: Column) -> Column:
    """type|border|fill|effect|rounded corners|splits."""
    items = lambda text: F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    or_missing = lambda c: F.coalesce(c, F.lit("missing"))

    def join(x: Column) -> Column:
        rounded = F.size(F.filter(items(F.coalesce(x["corners"], x["body_corners"])), lambda c: F.coalesce(F.get_json_object(c, "$.type") == "round", F.lit(False))))
        return F.concat_ws("|", or_missing(x["shape_type"]), border_signature(x["border"]), fill_signature(x["fill"]), or_missing(x["effect_type"]),
                           F.concat(F.lit("round"), rounded.cast("string")), F.concat(F.lit("splits"), F.size(items(x["splits"])).cast("string")))

    return values(parameters, "shape_type", "border", "fill", "effect.type", "corners", "body_corners", "splits", body=join)


def line_stratum(parameters: Column) -> Column:
    """line type|style|segments|dash|begin|end|fill|border|corners."""
    or_else = lambda c, other="missing": F.coalesce(c, F.lit(other))
    names = ("line_type", "line_style", "dash_style", "begin_arrow", "end_arrow")
    join = lambda x: F.concat_ws("|", *(or_else(x[k]) for k in names[:2]), F.concat(F.lit("segments"), listed(x["points"]).cast("string")), *(or_else(x[k]) for k in names[2:]),
                                 fill_signature(x["fill"]), border_signature(x["border"]), or_else(x["corner_style"], "-"))
    return values(parameters, *names, "points", "fill", "border", "corner_style", body=join)


def listed(text: Column) -> Column:
    """How many items a JSON list has; 0 for anything else."""
    return F.coalesce(F.size(F.from_json(text, "array<string>")), F.lit(0))


def line_macro(parameters: Column) -> Column:
    """The rough class of a line: curved or straight, a path or a shape, a straight path of one segment or several."""
    def macro(text: Column) -> Column:
        single = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.is_single", "variant"))
        several = ((single == "BOOLEAN") & (value(text, "is_single") == "false")) | (listed(value(text, "points")) > 1)

        def name(x: Column) -> Column:
            curved, shape = x["line_type"] == "curved", x["line_style"] == "shape"
            return F.when(curved & shape, "curved_shape").when(curved, "curved_path").when(shape, "straight_shape").when(F.coalesce(several, F.lit(False)), "straight_path_multi").otherwise("straight_path_single")

        classes = F.struct(*(F.coalesce(value(text, k), F.lit("")).alias(k) for k in ("line_type", "line_style")))
        return bound(classes, name)

    return bound(parameters, macro)


def line_group(parameters: Column) -> Column:
    """What lines of a macro class are told apart by: heads|dash|segments, four at most|fill|border|corners."""
    def join(x: Column) -> Column:
        or_missing = lambda k: F.coalesce(x[k], F.lit("missing"))
        fill = F.when(F.ltrim(x["fill_color"]).startswith("["), "gradient").otherwise("solid")
        border = F.coalesce(F.initcap(F.when(x["has_border"].isin("true", "false"), x["has_border"])), or_missing("has_border"))
        return F.concat_ws("|", *(or_missing(k) for k in ("begin_arrow", "end_arrow", "dash_style")), F.least(listed(x["points"]), F.lit(4)).cast("string"), F.coalesce(fill, F.lit("solid")), border, or_missing("corner_style"))

    return values(parameters, "begin_arrow", "end_arrow", "dash_style", "points", "fill_color", "has_border", "corner_style", body=join)


def fused(rows: DataFrame, sources: list[tuple[str, Column, Column]], default: tuple[str, Column]) -> DataFrame:
    """Adds value and source from the first of (name, fits, value) that fits, the default where none does, and fallback, whether that was so."""
    v, s = default[1], F.lit(default[0])
    none = F.lit(True)
    for name, fits, found in reversed(sources):
        fits = F.coalesce(fits, F.lit(False))
        v, s, none = F.when(fits, found).otherwise(v), F.when(fits, name).otherwise(s), none & ~fits
    return rows.withColumns({"value": v, "source": s, "fallback": none})


def arrow_heads(rows: DataFrame, source: Column, recoveries: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Adds begin_arrow, end_arrow and head_source: none on a line; on an arrow those of the first recovery (name, fits, begin, end), else a stealth end."""
    begin, end, name = F.lit("none"), F.lit("stealth"), F.lit("dataset_prior")
    for n, fits, b, e in reversed(recoveries):
        fits = F.coalesce(fits, F.lit(False))
        begin, end, name = F.when(fits, b).otherwise(begin), F.when(fits, e).otherwise(end), F.when(fits, n).otherwise(name)
    line = source == "line"
    return rows.withColumns({"begin_arrow": F.when(line, "none").otherwise(begin), "end_arrow": F.when(line, "none").otherwise(end), "head_source": F.when(line, "source_prior").otherwise(name)})
