"""Joins and orders of labelled boxes by image. Each table holds (image, idx, label, x1, y1, x2, y2).

Boxes meet by cells of a grid, so a crowded image is many small groups. What is greedy within an image goes by folding over its
boxes where they are few, and in rounds over all crowded images at once, each round a few joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import Rounds

SIDES = ("x1", "y1", "x2", "y2")
ROW_BUCKET = 20
CROWD = 128  # boxes of an image that are gone through as one array, and meet as one group; what is above goes by cells and rounds, with the same result
CROWD_PAIRS = 512  # the same for pairs of boxes


def box(prefix: str = "") -> G.Box:
    return tuple(F.col(prefix + s) for s in SIDES)


def renamed(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select("image", *(F.col(c).alias(prefix + c) for c in ("idx", "label", *SIDES)))


def cells(own: bool, coarser: bool) -> Column:
    """Cells (way, level, cx, cy) of a box: at its own level, at the coarser ones that its image has, or both.

    A level has cells of sides of a power of two; a box stands at the first whose cells are no smaller than it, so it touches
    four of its own cells at most, and of coarser ones.
    """
    wanted = F.filter("_levels", lambda m: (F.lit(own) & (m == F.col("_level"))) | (F.lit(coarser) & (m > F.col("_level"))))

    def touched(m: Column) -> Column:
        side = F.pow(F.lit(2.0), m.cast("double"))
        span = lambda low, high: F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))
        return F.flatten(F.transform(span("x1", "x2"), lambda x: F.transform(span("y1", "y2"), lambda y: F.struct(m.alias("level"), x.alias("cx"), y.alias("cy")))))

    return F.flatten(F.transform(wanted, touched))


def level() -> Column:
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0))
    return F.least(F.ceil(F.log2(side)), F.lit(62)).cast("int")


def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes of an image, as columns a_ and b_, that overlap or touch; of images of few boxes all pairs.

    In a crowded image the larger box of a pair stands in the cells of its own level, and the other looks there: left boxes among
    right ones of their level and below, right ones among left ones below. A pair that meets in several cells counts
    in the one with the lower corner of what it shares.
    """
    crowded = left.select("image", level().alias("level")).unionAll(right.select("image", level().alias("level"))).groupBy("image").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, level)")).alias("levels"))
    there = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda m: F.call_function("getbit", F.col("levels"), m) == 1)  # the levels as bits, which are spread out for crowded images only
    crowded = crowded.filter(F.col("n") > CROWD).select("image", there.alias("_levels"))
    alone = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))

    def dealt(boxes: DataFrame, prefix: str, ways: tuple[tuple[bool, bool], tuple[bool, bool]]) -> DataFrame:
        rows = boxes.select("image", "idx", "label", *SIDES, level().alias("_level")).join(crowded, "image", "left")
        found = F.concat(*(F.transform(cells(*w), lambda c: F.struct(F.lit(k).alias("way"), c["level"].alias("level"), c["cx"].alias("cx"), c["cy"].alias("cy"))) for k, w in enumerate(ways)))
        single = F.transform(alone, lambda c: F.struct(F.lit(0).alias("way"), c["level"].alias("level"), c["cx"].alias("cx"), c["cy"].alias("cy")))
        rows = rows.withColumn("_cell", F.explode(F.when(F.col("_levels").isNull(), single).otherwise(found)))
        return rows.select("image", *(F.col(f"_cell.{k}").alias(f"_{k}") for k in ("way", "level", "cx", "cy")), *(F.col(c).alias(prefix + c) for c in ("idx", "label", *SIDES)))

    pairs = dealt(left, "a_", ((True, False), (False, True))).join(dealt(right, "b_", ((True, True), (True, False))), ["image", "_way", "_level", "_cx", "_cy"])
    side = F.pow(F.lit(2.0), F.col("_level").cast("double"))
    corner = (F.floor(F.greatest("a_x1", "b_x1") / side) == F.col("_cx")) & (F.floor(F.greatest("a_y1", "b_y1") / side) == F.col("_cy"))
    return pairs.filter((F.col("_level") < 0) | corner).drop("_way", "_level", "_cx", "_cy")


def candidates(left: DataFrame, right: DataFrame, threshold: float, wildcard: bool = True) -> DataFrame:
    """Pairs of boxes of an image that overlap, with IoU >= threshold and compatible labels; an empty label fits any."""
    fits = F.col("a_label") == F.col("b_label")
    if wildcard:
        fits = fits | (F.col("a_label") == "") | (F.col("b_label") == "")
    pairs = meeting(left, right).filter(fits & G.crosses(box("a_"), box("b_")))
    return pairs.withColumn("iou", G.iou(box("a_"), box("b_"))).filter(F.col("iou") >= threshold)


def best_match(selections: DataFrame, boxes: DataFrame, threshold: float) -> DataFrame:
    """Each selection's box: that of its own index if it overlaps enough, else the best of its label.

    status is matched, none (nothing reaches the threshold) or tie (two equally good ones, neither of its index).
    """
    pairs = candidates(selections, boxes, threshold, wildcard=False)
    own = (F.col("a_idx") == F.col("b_idx")).cast("int")
    by = Window.partitionBy("image", "a_idx")
    pairs = pairs.withColumn("own", own).withColumn("r", F.row_number().over(by.orderBy(F.desc("own"), F.desc("iou"), "b_idx"))).withColumn("next", F.lead("iou").over(by.orderBy(F.desc("own"), F.desc("iou"), "b_idx")))
    best = pairs.filter("r = 1").select("image", F.col("a_idx").alias("idx"), "b_idx", "iou", F.when((F.col("own") == 0) & (F.col("next") == F.col("iou")), "tie").otherwise("matched").alias("found"))
    return selections.select("image", "idx").join(best, ["image", "idx"], "left").select("image", "idx", "b_idx", "iou", F.coalesce("found", F.lit("none")).alias("status"))


def distractors(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """(image, idx, n): how many other boxes each crop of a box overlaps."""
    pairs = meeting(crops, boxes).filter((F.col("a_idx") != F.col("b_idx")) & G.crosses(box("a_"), box("b_")))
    counts = pairs.groupBy("image", F.col("a_idx").alias("idx")).agg(F.count("*").alias("n"))
    return crops.select("image", "idx").join(counts, ["image", "idx"], "left").select("image", "idx", F.coalesce("n", F.lit(0)).alias("n"))


def canonical_order(boxes: DataFrame) -> DataFrame:
    """Distinct boxes of an image by row of 20 units, then x, y, larger area first; adds position."""
    first = boxes.groupBy("image", "label", *SIDES).agg(F.min("idx").alias("idx"))
    key = [F.floor(F.col("y1") / ROW_BUCKET), "x1", "y1", -G.area(box()), "x2", "y2", "label"]
    return first.select("image", "idx", "label", *SIDES, (F.row_number().over(Window.partitionBy("image").orderBy(*key)) - 1).cast("long").alias("position"))


def folded_matches(pairs: DataFrame) -> DataFrame:
    """``matched`` for images of few pairs: one array an image."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "a_idx", "b_idx")))
    start = F.array().cast("array<struct<k:double,a_idx:bigint,b_idx:bigint>>")
    free = lambda acc, x: ~F.exists(acc, lambda m: (m["a_idx"] == x["a_idx"]) | (m["b_idx"] == x["b_idx"]))
    taken = F.aggregate("pairs", start, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    rows = pairs.groupBy("image").agg(ordered.alias("pairs")).select("image", F.explode(taken).alias("m"))
    return rows.select("image", "m.a_idx", "m.b_idx", (-F.col("m.k")).alias("iou"))


def matched(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of candidate pairs, greedily from the highest IoU (ties by a_idx, b_idx), image by image.

    In crowded images a pair that comes before all others of its two boxes is taken, whatever else there is: so all such
    pairs are taken at once, their boxes go, and the next round looks at what is left. That ends as the walk in order does.
    """
    tables = Rounds(pairs.sparkSession, "matches")
    every = tables.table("pairs", pairs.select("image", F.col("a_idx").cast("long").alias("a_idx"), F.col("b_idx").cast("long").alias("b_idx"), "iou"))
    crowded = every.groupBy("image").count().filter(F.col("count") > CROWD_PAIRS).select("image")
    found = folded_matches(every.join(crowded, "image", "left_anti"))
    left = tables.table("left", every.join(crowded, "image", "left_semi"))
    kept = ["pairs"]
    while not left.isEmpty():
        place = F.min(F.struct((-F.col("iou")).alias("k"), "a_idx", "b_idx")).alias("m")
        first_a, first_b = (left.groupBy("image", side).agg(place).select("image", "m.*") for side in ("a_idx", "b_idx"))
        kept.append(f"taken-{len(kept)}")
        taken = tables.table(kept[-1], first_a.join(first_b.drop("k"), ["image", "a_idx", "b_idx"]).select("image", "a_idx", "b_idx", (-F.col("k")).alias("iou")))
        left = tables.table("left", left.join(taken.select("image", "a_idx"), ["image", "a_idx"], "left_anti").join(taken.select("image", "b_idx"), ["image", "b_idx"], "left_anti").select(every.columns))
        found = found.unionByName(taken)
    tables.close(*kept)
    return found


def detection(predictions: DataFrame, targets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per image: predictions, targets, matches, f1, mean IoU of matches and the reward (IoU sum over the larger count).

    Both empty count as right; one empty as wrong.
    """
    pairs = candidates(predictions, targets, threshold)
    hits = matched(pairs).groupBy("image").agg(F.count("*").alias("n_match"), F.sum(F.round("iou", 12)).alias("iou_sum"))
    sizes = predictions.groupBy("image").agg(F.count("*").alias("n_pred")).join(targets.groupBy("image").agg(F.count("*").alias("n_target")), "image", "full").join(hits, "image", "left").na.fill(0)
    total = F.col("n_pred") + F.col("n_target")
    return sizes.select(
        "image", "n_pred", "n_target", "n_match",
        F.when(total == 0, 1.0).otherwise(2.0 * F.col("n_match") / total).alias("f1"),
        F.when(total == 0, 1.0).when(F.col("n_match") > 0, F.col("iou_sum") / F.col("n_match")).otherwise(0.0).alias("mean_iou"),
        F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("iou_sum") / F.greatest("n_pred", "n_target"))).alias("reward"),
    )


def folded_suppression(boxes: DataFrame, threshold: float) -> DataFrame:
    """``suppressed`` for images of few boxes: one array an image."""
    each = F.array_sort(F.collect_list(F.struct("idx", "label", *SIDES)))
    fields = lambda s: tuple(s[k] for k in SIDES)
    hidden = lambda kept, x: F.exists(kept, lambda k: (k["label"] == x["label"]) & (G.iou(fields(k), fields(x)) >= threshold))
    rows = boxes.groupBy("image").agg(each.alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, x: F.when(hidden(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("image", F.explode(kept).alias("b")).select("image", "b.*").select(boxes.columns)


def suppressed(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes of each image left after same-label suppression: in order of idx, what overlaps one kept before goes.

    In crowded images a box that no earlier one still overlaps is kept, whatever comes later: all such boxes are kept at
    once, what they overlap goes, and the next round looks at the overlaps that are left. ``threshold`` is above 0.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less would have every box hide all others of its label")
    crowded = boxes.groupBy("image").count().filter(F.col("count") > CROWD).select("image")
    tables = Rounds(boxes.sparkSession, "suppression")
    many = tables.table("boxes", boxes.join(crowded, "image", "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    few = folded_suppression(boxes.join(crowded, "image", "left_anti"), threshold)
    order = ["idx", "label", *SIDES]
    if many.isEmpty():
        tables.close()
        return few
    # pairs of rows of one label that overlap enough, the earlier one first
    rows = many.withColumn("idx", F.col("_row"))
    pairs = candidates(rows, rows, threshold, wildcard=False).filter("a_idx <> b_idx").select("image", "a_idx", "b_idx")
    places = many.select("image", F.col("_row"), F.struct(*order, "_row").alias("_at"))
    pairs = pairs.join(places.select("image", F.col("_row").alias("a_idx"), F.col("_at").alias("_a")), ["image", "a_idx"]).join(places.select("image", F.col("_row").alias("b_idx"), F.col("_at").alias("_b")), ["image", "b_idx"])
    edges = tables.table("edges", pairs.filter("_a < _b").select("image", "a_idx", "b_idx"))
    gone = tables.table("gone-0", edges.select("image", F.col("b_idx").alias("_row")).filter("false"))
    kept, n = ["boxes"], 0
    hidden = gone
    while not edges.isEmpty():
        n += 1
        blocked = edges.select("image", F.col("b_idx").alias("a_idx")).distinct()
        new = edges.join(blocked, ["image", "a_idx"], "left_anti").select("image", F.col("b_idx").alias("_row")).distinct()
        kept.append(f"gone-{n}")
        new = tables.table(kept[-1], new)
        hidden = hidden.unionByName(new)
        for side in ("a_idx", "b_idx"):
            edges = edges.join(new.withColumnRenamed("_row", side), ["image", side], "left_anti")
        edges = tables.table("edges", edges.select("image", "a_idx", "b_idx"))
    tables.close(*kept, "gone-0")
    return few.unionByName(many.join(hidden, ["image", "_row"], "left_anti").select(boxes.columns))


def contained(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """(image, crop_idx, idx): boxes that lie inside a crop of their image, edges included."""
    pairs = meeting(crops, boxes).filter(G.inside(box("b_"), box("a_")))
    return pairs.select("image", F.col("a_idx").alias("crop_idx"), F.col("b_idx").alias("idx"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Adds position: by y1, then x1, label and index."""
    return boxes.withColumn("position", (F.row_number().over(Window.partitionBy("image").orderBy("y1", "x1", "label", "idx")) - 1).cast("long"))


def area_order(boxes: DataFrame) -> DataFrame:
    """Adds bucket (whole part of the binary logarithm of the area) and position: large buckets first, then y1, x1, y2, x2, label."""
    rows = boxes.withColumn("bucket", F.floor(F.log2(F.greatest(G.area(box()), F.lit(1.0)))).cast("long"))
    by = Window.partitionBy("image").orderBy(F.desc("bucket"), "y1", "x1", "y2", "x2", "label", "idx")
    return rows.withColumn("position", (F.row_number().over(by) - 1).cast("long"))
