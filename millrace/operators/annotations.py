"""Instances, crops and tasks from annotated images. Boxes are rows (image, idx, label, x1, y1, x2, y2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .boxes import SIDES, box

CROP = "struct<x1:double,y1:double,x2:double,y2:double>"
PASSES = 8  # how often a crop is widened at most
MOST_AREA = 0.92  # of the image, that a crop may have
MOST_IOU = 0.85  # of two crops that are both taken
BLOCK = 1 << 20  # crops times boxes that are looked at together
EVALUATED = f"array<struct<crop:{CROP},inside:array<bigint>,area:double>>"


def mapped_labels(label: Column, names: dict[str, str]) -> Column:
    """The label that each raw one stands for; null for those that do not count."""
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[label] if names else F.lit(None).cast("string")


def raw_instances(raw: Column) -> Column:
    """The instances of a JSON annotation as an array of struct(idx, label, bbox): from instances by label, else from layout by type."""
    item = "array<struct<label:string,type:string,bbox:array<double>>>"
    found = F.coalesce(F.from_json(F.get_json_object(raw, "$.instances"), item), F.from_json(F.get_json_object(raw, "$.layout"), item), F.array().cast(item))
    named = F.get_json_object(raw, "$.instances").isNotNull()
    return F.transform(found, lambda x, i: F.struct(i.cast("long").alias("idx"), F.when(named, x["label"]).otherwise(x["type"]).alias("label"), x["bbox"].alias("bbox")))


def extract_instances(rows: DataFrame, raw: str, names: dict[str, str], width, height) -> DataFrame:
    """``rows`` exploded to (.., idx, label, x1, y1, x2, y2): instances of labels that count, with boxes cleaned; others and boxes without area go."""
    each = rows.select(*[c for c in rows.columns if c != raw], F.explode(raw_instances(F.col(raw))).alias("_x"))
    sides = G.clean(tuple(F.get(F.col("_x.bbox"), k) for k in range(4)), width, height)
    each = each.select("*", F.col("_x.idx").alias("idx"), mapped_labels(F.col("_x.label"), names).alias("label"), (F.size("_x.bbox") == 4).alias("_four"), *(v.alias(s) for v, s in zip(sides, SIDES)))
    return each.filter("label IS NOT NULL AND _four AND x1 IS NOT NULL").drop("_x", "_four")


def covered_layers(layers: Column, required: list[str]) -> Column:
    """Whether an image was annotated for all required layers; one that does not name its layers was."""
    return layers.isNull() | (F.size(F.array_except(F.array(*map(F.lit, required)), layers)) == 0)


def drop_reason(label: Column, sides: G.Box, names: dict[str, str], width, height) -> Column:
    """Why a layout item is dropped, else null: its label, its box, or that it is the background."""
    target = mapped_labels(label, names)
    clean = G.clipped(sides, width, height)
    return (
        F.when(label.isNull(), "non_object").when(target.isNull(), "unsupported_label")
        .when(~G.lit_all(clean[2] > clean[0], clean[3] > clean[1]), "invalid_bbox").when(G.is_background(target, clean, width, height), "background")
    )


def tasks(boxes: DataFrame, kind: str, label: str, least_area: float, stem: Column, done: Column) -> DataFrame:
    """(task_id, image, idx, area) for boxes of a label that are large enough and not done; the id is {stem}__{kind}_{idx:04d}."""
    rows = boxes.filter((F.col("label") == label) & ~done).withColumn("area", G.area(box())).filter(F.col("area") >= least_area)
    return rows.select(F.format_string(f"%s__{kind}_%04d", stem, F.col("idx")).alias("task_id"), "image", "idx", "area")


def instances_of(boxes: DataFrame) -> DataFrame:
    """(image, boxes): the boxes of each image in order of idx; an image is what one annotator sees, so an array holds it."""
    return boxes.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("idx", "label", *(F.col(s).cast("double").alias(s) for s in SIDES)))).alias("boxes"))


def sides_of(s: Column) -> G.Box:
    return tuple(s[k] for k in SIDES)


def crop(sides: G.Box) -> Column:
    return F.struct(*(v.cast("double").alias(s) for v, s in zip(sides, SIDES)))


def expanded(start: Column, boxes: Column, width: int, height: int) -> Column:
    """A crop widened until it cuts no box: box after box, in PASSES passes at most."""
    def widen(at: Column, b: Column) -> Column:
        cut = G.crosses(sides_of(b), sides_of(at)) & ~G.inside(sides_of(b), sides_of(at))
        low = lambda k: F.greatest(F.lit(0.0), F.least(at[k], F.floor(b[k]).cast("double")))
        high = lambda k, limit: F.least(F.lit(float(limit)), F.greatest(at[k], F.ceil(b[k]).cast("double")))
        return F.when(cut, crop((low("x1"), low("y1"), high("x2", width), high("y2", height)))).otherwise(at)

    # a pass that changes nothing leaves the crop as it is, so all passes can be gone through
    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), start, lambda at, _: F.aggregate(boxes, at, widen))


def evaluated(start: Column, boxes: Column, width: int, height: int) -> Column:
    """struct(crop, inside, area) of a crop widened about what it cuts; null if it is too large, still cuts a box or holds none."""
    def judge(at: Column) -> Column:
        whole = F.filter(boxes, lambda b: G.inside(sides_of(b), sides_of(at)))
        cut = F.exists(boxes, lambda b: G.crosses(sides_of(b), sides_of(at)) & ~G.inside(sides_of(b), sides_of(at)))
        large = (at["x2"] - at["x1"]) * (at["y2"] - at["y1"]) / float(width * height) > MOST_AREA
        total = F.aggregate(whole, F.lit(0.0), lambda a, b: a + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
        found = F.struct(at.alias("crop"), F.array_sort(F.transform(whole, lambda b: b["idx"])).alias("inside"), total.alias("area"))
        return F.when(~large & ~cut & (F.size(whole) > 0), found)

    return F.transform(F.array(expanded(start, boxes, width, height)), judge)[0]


def judged(at: np.ndarray, sides: np.ndarray, idx: np.ndarray, width: int, height: int):
    """What ``evaluated`` says of crops (images, crops, 4) and boxes (images, boxes, 4), numbered (images, boxes): which crops are found, their sides
    once widened, the boxes in them in order of number, and their area."""
    cuts = lambda b, c: (b[..., 0] < c[..., 2]) & (c[..., 0] < b[..., 2]) & (b[..., 1] < c[..., 3]) & (c[..., 1] < b[..., 3])
    holds = lambda b, c: (b[..., 0] >= c[..., 0]) & (b[..., 1] >= c[..., 1]) & (b[..., 2] <= c[..., 2]) & (b[..., 3] <= c[..., 3])
    low, high, ends = np.floor(sides[..., :2]) + 0.0, np.ceil(sides[..., 2:]) + 0.0, np.array([float(width), float(height)])
    at = at.copy()
    for _ in range(PASSES):
        before = at.copy()
        for k in range(sides.shape[1]):
            b = sides[:, k, None]
            cut = (cuts(b, at) & ~holds(b, at))[..., None]
            wide = np.concatenate([np.maximum(0.0, np.minimum(at[..., :2], low[:, k, None])), np.minimum(ends, np.maximum(at[..., 2:], high[:, k, None]))], axis=-1)
            at = np.where(cut, wide, at)
        if np.array_equal(before, at):
            break
    inside = holds(sides[:, None], at[:, :, None])
    fine = ~(cuts(sides[:, None], at[:, :, None]) & ~inside).any(-1) & inside.any(-1) & ((at[..., 2] - at[..., 0]) * (at[..., 3] - at[..., 1]) / float(width * height) <= MOST_AREA)
    area = np.zeros(fine.shape)
    for k in range(sides.shape[1]):
        area += np.where(inside[..., k], ((sides[:, k, 2] - sides[:, k, 0]) * (sides[:, k, 3] - sides[:, k, 1]))[:, None], 0.0)
    order = np.argsort(idx, axis=1, kind="stable")
    return fine, at, np.take_along_axis(inside, order[:, None], axis=2), np.take_along_axis(idx, order, 1), area


def evaluated_crops(start, boxes: Column, width: int, height: int) -> Column:
    """Array of what ``evaluated`` says of the crop start(b) of each box b, without nulls. Images with the same number of boxes are looked at together,
    BLOCK pairs of crop and box at a time; those with a side or number that is missing or not finite one by one."""

    @F.arrow_udf(EVALUATED)
    def together(starts: pa.Array, held: pa.Array) -> pa.Array:
        n = held.value_lengths().fill_null(0).to_numpy().astype("int64")
        first = np.cumsum(n) - n
        columns = lambda rows: np.stack([rows.field(s).to_numpy(zero_copy_only=False) for s in SIDES], axis=-1)
        flat = held.flatten()
        at, sides, idx = columns(starts.flatten()), columns(flat), flat.field("idx").to_numpy(zero_copy_only=False)
        found = []
        for size in np.unique(n[n > 0]):
            images = np.flatnonzero(n == size)
            per = max(1, BLOCK // (int(size) * int(size)))
            for part in (images[k : k + per] for k in range(0, len(images), per)):
                rows = first[part][:, None] + np.arange(size)
                step = max(1, BLOCK // (len(part) * int(size)))
                for c in range(0, int(size), step):
                    fine, crop, inside, numbers, area = judged(at[rows[:, c : c + step]], sides[rows], idx[rows], width, height)
                    i, j = np.nonzero(fine)
                    hits = inside[i, j]
                    found.append((part[i], c + j, crop[i, j], area[i, j], hits.sum(1), np.broadcast_to(numbers[i], hits.shape)[hits]))
        if not found:
            return pa.array([[] for _ in n], pa.list_(pa.struct([("crop", pa.struct([(s, pa.float64()) for s in SIDES])), ("inside", pa.list_(pa.int64())), ("area", pa.float64())])))
        image, place, crop, area, counts, numbers = (np.concatenate(v) for v in zip(*found))
        ends = lambda lengths: pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32"))
        rows = pa.StructArray.from_arrays([pa.StructArray.from_arrays([pa.array(crop[:, k]) for k in range(4)], list(SIDES)), pa.ListArray.from_arrays(ends(counts), pa.array(numbers.astype("int64"))), pa.array(area)], ["crop", "inside", "area"])
        return pa.ListArray.from_arrays(ends(np.bincount(image, minlength=len(n))), rows.take(pa.array(np.lexsort((place, image)))))

    finite = lambda v: v.isNotNull() & (F.abs(v) < float("inf"))
    whole = F.forall(boxes, lambda b: G.lit_all(b["idx"].isNotNull(), *(finite(b[s]) for s in SIDES)))
    some = F.when(F.coalesce(whole, F.lit(False)), boxes).otherwise(F.slice(boxes, 1, 0))
    singly = F.filter(F.transform(boxes, lambda b: evaluated(start(b), boxes, width, height)), lambda c: c.isNotNull())
    return F.when(whole, together(F.transform(some, start), some)).otherwise(singly)


def selected_crops(candidates: Column, most: int) -> Column:
    """The best of evaluated crops: by number of boxes, then their area, then place; none with the boxes of one taken
    before, or that overlaps it by more than MOST_IOU."""
    key = lambda c: F.struct((-F.size(c["inside"])).alias("n"), (-c["area"]).alias("a"), c["crop"].alias("crop"), c["inside"].alias("inside"))
    ranked = F.array_sort(F.transform(F.filter(candidates, lambda c: c.isNotNull()), key))
    alike = lambda taken, c: F.exists(taken, lambda t: (t["inside"] == c["inside"]) | (G.crop_iou(sides_of(t["crop"]), sides_of(c["crop"])) > MOST_IOU))
    taken = lambda r: F.aggregate(r, F.slice(r, 1, 0), lambda taken, c: F.when((F.size(taken) >= most) | alike(taken, c), taken).otherwise(F.concat(taken, F.array(c))))
    return F.transform(F.array(ranked), taken)[0]


def row_major(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Adds position: rows as high as half the median box of the image (8 codes at least), by centre, then by code and box."""
    codes = {f"_q{s}": G.quantise(F.col(s), n) for s, n in zip(SIDES, (width, height, width, height))}
    rows = boxes.withColumns(codes)
    whole = Window.partitionBy("image")
    bucket = F.greatest(F.lit(8.0), F.bround(F.median(F.greatest(F.col("_qy2") - F.col("_qy1"), F.lit(1))).over(whole) * 0.5))
    rows = rows.withColumn("bucket", F.floor((F.col("_qy1") + F.col("_qy2")) / 2.0 / bucket).cast("long"))
    by = whole.orderBy("bucket", "_qx1", "_qy1", "_qy2", "_qx2", "y1", "x1", "y2", "x2", "label", "idx")
    return rows.withColumn("position", (F.row_number().over(by) - 1).cast("long")).drop(*codes)


def merged(base: DataFrame, results: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``base`` with each result's prediction where keys and label agree: (.., prediction, outcome).

    outcome is merged, kept (no result), or, for results without a row of that label, skipped.
    """
    news = results.select(*keys, F.col(label).alias("_label"), "prediction")
    fits = F.col("_label").isNotNull() & F.col(label).eqNullSafe(F.col("_label"))
    rows = base.join(news, keys, "full")
    outcome = F.when(F.col(label).isNull() | (F.col("_label").isNotNull() & ~fits), "skipped").when(fits & F.col("prediction").isNotNull(), "merged").otherwise("kept")
    return rows.withColumn("outcome", outcome).withColumn("prediction", F.when(F.col("outcome") == "merged", F.col("prediction"))).drop("_label")


def finalised(targets: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many targets have a result, none, a failed one, or one of another label; ready if all are there and right."""
    both = targets.join(results.select(*keys, F.col("label").alias("_label"), "status"), keys, "left")
    missing, failed = F.col("status").isNull(), F.col("status") != "success"
    drift = ~missing & ~F.col("label").eqNullSafe(F.col("_label"))
    return both.agg(
        F.count("*").alias("targets"), F.count_if(missing).alias("missing"), F.count_if(failed).alias("failed"), F.count_if(drift).alias("drifted"),
        (F.count_if(missing | F.coalesce(failed, F.lit(False)) | drift) == 0).alias("ready"),
    )


def training_rows(ordered: DataFrame, width: int, height: int, sort_policy: str, prompt: str) -> DataFrame:
    """(image, user_prompt, target_text, extra): a training record for each image of ordered boxes (.., position): its target
    is JSON of label and quantised box in that order; extra says how it was sorted and what the target holds."""
    q = [G.quantise(F.col(s), n) for s, n in zip(SIDES, (width, height, width, height))]
    x, y = G.grown(q[0], q[2]), G.grown(q[1], q[3])
    item = F.struct("position", F.struct("label", F.array(x[0], y[0], x[1], y[1]).alias("bbox_2d")).alias("item"))
    rows = ordered.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("items"))
    target = F.to_json(F.transform("items", lambda i: i["item"]))
    extra = F.to_json(F.struct(F.lit(sort_policy).alias("sort_policy"), F.lit("label,bbox_2d").alias("target_policy"), F.size("items").alias("n")))
    return rows.select("image", F.lit(prompt).alias("user_prompt"), target.alias("target_text"), extra.alias("extra"))


def point_rows(rows: DataFrame, kind: str, line: Column, width: int, height: int, prompt: str, single: Column | None = None) -> DataFrame:
    """``rows`` as training records of points: adds user_prompt, target_text, extra and error.

    ``line`` is JSON of points [[x, y], ..], or of segments of them. An arrow's target is its keypoints from tail to head; a line's are its
    segments of two points or more, and whether it is a single one, by ``single`` or else by their number. Codes are quantised
    coordinates. The target is null where the error says why.
    """
    policies = {"point_arrow": ("full_ordered_linestrip", "keypoints_2d", "arrow_tail_to_head"), "point_line": ("line_points_segments", "parameters.points", "source_linestrip_segment_order")}
    if kind not in policies:
        raise ValueError(f"unknown kind of points {kind!r}")
    number = lambda x: F.coalesce(x, F.lit(float("nan")))
    code = lambda p: F.array(G.quantise(p[0], width), G.quantise(p[1], height))
    good = lambda p: (F.size(p) == 2) & ~F.exists(p, lambda x: F.isnan(number(x)))
    nested = lambda text: F.regexp_replace(text, r"\s", "").startswith("[[[")
    bound = lambda value, body: F.transform(F.array(value), body)[0]
    # each text is parsed once, and what it holds is null where it does not fit
    if kind == "point_arrow":
        held = bound(line, lambda text: F.when(~nested(text), F.from_json(text, "array<array<double>>")))
        target = bound(held, lambda points: F.when((F.size(points) >= 2) & F.forall(points, good), F.to_json(F.struct(F.transform(points, code).alias("keypoints_2d")))))
        error = "an arrow has two points or more"
    else:
        segments = bound(line, lambda text: F.when(nested(text), F.from_json(text, "array<array<array<double>>>")).otherwise(F.array(F.from_json(text, "array<array<double>>"))))
        alone = lambda held: F.size(held) == 1 if single is None else F.coalesce(single, F.size(held) == 1)
        written = lambda held: F.to_json(F.struct(F.lit("line").alias("type"), F.struct(alone(held).alias("is_single"), F.transform(held, lambda s: F.transform(s, code)).alias("points")).alias("parameters")))
        target = bound(F.filter(segments, lambda s: (F.size(s) >= 2) & F.forall(s, good)), lambda held: F.when(F.size(held) > 0, written(held)))
        error = "a line has a segment of two points or more"
    policy = F.struct(*(F.lit(v).alias(k) for k, v in zip(("type", "coordinate_space", "order"), policies[kind])))
    extra = F.to_json(F.struct(policy.alias("target_policy"), F.lit(width).alias("image_width"), F.lit(height).alias("image_height")))
    return rows.withColumns({"user_prompt": F.lit(prompt), "target_text": target, "extra": extra}).withColumn("error", F.when(F.col("target_text").isNull(), error))
