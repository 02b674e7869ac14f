"""Scores of predictions, weighted losses, and telemetry of training steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.registry import Registry
from ..sources.scratch import Rounds
from .selection import alike, percentiles

METRICS = Registry("metric")


@METRICS.register("parse_success")
def parse_success() -> Column:
    return F.avg((F.col("valid") & ~F.col("partial")).cast("double"))


@METRICS.register("parse_partial_rate")
def parse_partial_rate() -> Column:
    return F.avg((F.col("valid") & F.col("partial")).cast("double"))


@METRICS.register("exact_match")
def exact_match() -> Column:
    """Partial predictions may match; the reward of the same name gives them nothing."""
    return F.avg(F.coalesce((F.col("valid") & (F.col("parsed") == F.col("target"))).cast("double"), F.lit(0.0)))


def codec_result() -> tuple[Column, Column, Column]:
    """What rewards and row metrics read: valid, partial and parsed, the last in comparable form as the target is."""
    return F.coalesce(F.col("valid"), F.lit(False)), F.coalesce(F.col("partial"), F.lit(False)), F.col("parsed")


def subattr_fields(parsed: Column, target: Column, fields: list[str]) -> Column:
    """1 if all of some fields of two JSON objects are there and equal, else 0."""
    alike = [F.coalesce(F.get_json_object(parsed, f"$.{f}") == F.get_json_object(target, f"$.{f}"), F.lit(False)) for f in fields]
    return reduce(lambda a, b: a & b, alike).cast("double")


SPACES = {"codes": 999.0, **dict.fromkeys(("normalized", "normalized_1000", "bbox_2d", "keypoints_2d", "points_2d", "points", "bins", "quantized"), 1000.0)}


def keypoint_share(points: Column, targets: Column, threshold: float, space: str = "normalized_1000", width: Column | None = None, height: Column | None = None) -> Column:
    """The share of points within ``threshold`` times the space's scale of their targets; 0 for other numbers of points, 1 for none at all.

    The scale of an image is its longer side, or without its size that of what all points span.
    """
    if space == "image":
        both = F.concat(points, targets)
        span = lambda axis: F.array_max(F.transform(both, axis)) - F.array_min(F.transform(both, axis))
        known = (width is not None and height is not None)
        w, h = (F.coalesce(width, span(lambda p: p["x"])), F.coalesce(height, span(lambda p: p["y"]))) if known else (span(lambda p: p["x"]), span(lambda p: p["y"]))
        scale = F.greatest(F.when(w > 0, w).otherwise(1.0), F.when(h > 0, h).otherwise(1.0))
    else:
        scale = F.lit(SPACES[space])
    near = F.filter(F.zip_with(points, targets, lambda a, b: F.pow(a["x"] - b["x"], 2.0) + F.pow(a["y"] - b["y"], 2.0)), lambda d: d <= F.pow(scale * threshold, 2.0))
    return F.when(points.isNull() | targets.isNull() | (F.size(points) != F.size(targets)), 0.0).when(F.size(points) == 0, 1.0).otherwise(F.size(near) / F.size(targets))


REWARDS = Registry("reward")


@REWARDS.register("parse_success")
def reward_parse_success() -> Column:
    valid, partial, _ = codec_result()
    return (valid & ~partial).cast("double")


@REWARDS.register("exact_match")
def reward_exact() -> Column:
    valid, partial, parsed = codec_result()
    return F.coalesce((valid & ~partial & (parsed == F.col("target"))).cast("double"), F.lit(0.0))


@REWARDS.register("subattr_fields")
def reward_fields(fields: tuple[str, ...] = ("stroke_pattern", "geometry_style")) -> Column:
    valid, _, parsed = codec_result()
    return F.when(valid, subattr_fields(parsed, F.col("target"), list(fields))).otherwise(0.0)


def reward_columns(wanted: list[dict]) -> dict[str, Column]:
    """Columns of some rewards by name, each with its parameters: [{"name": .., "weight": .., ..}]; total is their weighted sum."""
    made = {w["name"]: REWARDS.create(w["name"], **{k: v for k, v in w.items() if k not in ("name", "weight")}) for w in wanted}
    return made | {"total": reduce(lambda a, b: a + b, (made[w["name"]] * float(w.get("weight", 1.0)) for w in wanted))}


def result_summary(results: DataFrame, prediction: str, kind: str, id_col: str, order: str) -> DataFrame:
    """(field, value, n): records, failed ones, ids whose last prediction is there, and how often each kind was predicted."""
    failed = F.col(prediction).isNull()
    each = results.groupBy(F.when(failed, "parse_failed").otherwise(F.coalesce(kind, F.lit("unknown"))).alias("value")).agg(F.count("*").alias("n")).select(F.lit("distribution").alias("field"), "value", "n")
    totals = results.agg(F.count("*").alias("records"), F.count_if(failed).alias("parse_failed"), F.count_distinct(F.when(~failed, F.col(id_col))).alias("unique_success"))
    return totals.select(F.explode(F.array(*(F.struct(F.lit("total").alias("field"), F.lit(k).alias("value"), F.col(k).alias("n")) for k in totals.columns))).alias("x")).select("x.*").unionByName(each)


def scan_summary(boxes: DataFrame, targets: list[str]) -> DataFrame:
    """(field, value, n): images, images with a target, targets, and how often each label stands."""
    wanted = F.col("label").isin(*targets)
    totals = boxes.agg(F.count_distinct("image").alias("images"), F.count_distinct(F.when(wanted, F.col("image"))).alias("target_images"), F.count_if(wanted).alias("target_instances"))
    each = boxes.groupBy(F.col("label").alias("value")).agg(F.count("*").alias("n")).select(F.lit("label").alias("field"), "value", "n")
    return totals.select(F.explode(F.array(*(F.struct(F.lit("total").alias("field"), F.lit(k).alias("value"), F.col(k).alias("n")) for k in totals.columns))).alias("x")).select("x.*").unionByName(each)


def final_loss(rows: DataFrame, weights: DataFrame, loss: str, tokens: str) -> DataFrame:
    """One row: the datasets' token means of a loss, weighed by dataset; only those that are there count."""
    each = token_mean(rows, ["dataset"], loss, tokens).select("dataset", F.col("loss").alias("score"))
    return weighted_score(each, weights).select(F.col("final_score").alias("final_loss"), "datasets")


@METRICS.register("reward_exact_match")
def reward_exact_match() -> Column:
    return F.avg(F.coalesce((F.col("valid") & ~F.col("partial") & (F.col("parsed") == F.col("target"))).cast("double"), F.lit(0.0)))


def dataset_scores(samples: DataFrame, value: Column, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(dataset, n, score): the mean of a metric put on a range, 0 for none."""
    span = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return samples.groupBy("dataset").agg(F.count("*").alias("n"), F.coalesce(span, F.lit(0.0)).alias("score"))


def dataset_metrics(samples: DataFrame, metrics: dict[str, Column], ranges: dict[str, tuple[float, float]], primary: str) -> DataFrame:
    """(dataset, n, each metric, score): several metrics of each dataset, 0 for none, and the primary one put on its range, which is 0 to 1 where ``ranges`` has none."""
    if primary not in metrics:
        raise ValueError(f"{primary!r} is none of {', '.join(metrics)}")
    low, high = ranges.get(primary, (0.0, 1.0))
    if not high > low:
        raise ValueError("a range ends above its begin")
    out = samples.groupBy("dataset").agg(F.count("*").alias("n"), *(F.coalesce(c, F.lit(0.0)).alias(m) for m, c in metrics.items()))
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(primary) - low) / (high - low))))


def weighted_score(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the mean of the scores by the weights of the datasets that are there; 0 for none."""
    both = scores.join(weights, "dataset")
    return both.agg(F.coalesce(F.sum(F.col("score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("final_score"), F.count("*").alias("datasets"))


def token_mean(rows: DataFrame, keys: list[str], loss: str, weight: str) -> DataFrame:
    """Per key the sum of loss times weight over the sum of weights; 0 without weight."""
    return rows.groupBy(*keys).agg(F.sum(weight).alias("weight"), F.coalesce(F.sum(F.col(loss) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)).alias("loss"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def efficiency(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per key over frames (step, tokens, padded, seconds): sums, rates, spread of lengths and exact quantiles of step times."""
    n, t, s = F.count("*"), F.sum("tokens"), F.sum("seconds")
    squares = F.sum(F.col("tokens") * F.col("tokens"))
    steps = frames.groupBy(*keys, "step").agg(F.count("*").alias("n"))  # told apart in a shuffle, so that no task holds a key's steps
    steps = steps.groupBy(*keys).agg((F.max("step") - F.min("step") + 1 == F.count("*")).alias("contiguous"))
    sums = frames.groupBy(*keys).agg(
        n.alias("frames"), t.alias("tokens"), ratio(F.sum("padded") - t, F.sum("padded")).alias("padding"), ratio(t, s).alias("tokens_per_second"), ratio(t, n).alias("mean_length"),
        F.sqrt(F.greatest(F.lit(0.0), ratio(squares, n) - ratio(t, n) * ratio(t, n))).alias("std_length"),
    )
    spread = percentiles(frames, keys, "seconds", {"p50_seconds": 0.5, "p95_seconds": 0.95})
    out = alike(alike(sums, steps, keys), spread, keys, how="left")
    return out.select(*keys, "frames", "tokens", "contiguous", "padding", "tokens_per_second", "mean_length", "std_length", "p50_seconds", "p95_seconds")


def slowest_ranks(frames: DataFrame) -> DataFrame:
    """Per step: all ranks' tokens, and the times of the slowest rank (ties: the lowest)."""
    slow = frames.groupBy("step").agg(F.sum("tokens").alias("tokens"), F.max(F.struct("seconds", (-F.col("rank")).alias("r"))).alias("m"), F.count("*").alias("ranks"))
    return slow.select("step", "ranks", "tokens", (-F.col("m.r")).cast("long").alias("slowest_rank"), F.col("m.seconds").alias("seconds"))


def compared(runs: DataFrame, key: str, baseline: str, figures: list[str]) -> DataFrame:
    """Each run's figures against those of one run."""
    base = runs.filter(F.col(key) == baseline).select(*(F.col(f).alias(f"base_{f}") for f in figures))
    # the baseline is one row, whatever the number of its name's runs
    both = runs.crossJoin(base.limit(1))
    return both.select(key, *figures, *(ratio(F.col(f), F.col(f"base_{f}")).alias(f"{f}_ratio") for f in figures))


def rolling_rate(rows: DataFrame, key: str, at: str, value: str, width: int = 20) -> DataFrame:
    """Adds rate: the change of ``value`` over that of ``at`` (in seconds) within the last ``width`` observations; 0 unless positive.

    A row whose value is that of the row before is no new observation, and has the rate of the last one.
    """
    along = Window.partitionBy(key).orderBy(at, value)
    rows = rows.withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(along)) | F.lag(F.lit(True)).over(along).isNull())
    w = Window.partitionBy(key, "_new").orderBy(at, value).rowsBetween(-(width - 1), 0)
    dv, dt = F.col(value) - F.first(value).over(w), F.col(at) - F.first(at).over(w)
    rows = rows.withColumn("_rate", F.when(F.col("_new"), F.when((dt > 0) & (dv > 0), dv / dt).otherwise(0.0)))
    return rows.withColumn("rate", F.last("_rate", True).over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_rate")


def span_union(spans: DataFrame, key: str) -> DataFrame:
    """Intervals (start, end) of each key, merged where they touch."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.col("start") - 1)).cast("int"))
    island = F.sum("new").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("island")


def first_error(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, else null."""
    return reduce(lambda c, kv: c.when(kv[1], kv[0]), list(rules.items())[1:], F.when(next(iter(rules.values())), next(iter(rules))))


def error_audit(rows: DataFrame, id_col: str, rules: dict[str, Column], examples: int = 20) -> DataFrame:
    """(code, n, ids): per error code how many rows have it and the first of them."""
    codes = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda c: c.isNotNull())
    hit = rows.select(id_col, F.explode(codes).alias("code"))
    counts = hit.groupBy("code").agg(F.count("*").alias("n"))
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(id_col))).filter(F.col("r") <= examples)
    first = first.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), ",").alias("ids"))
    return counts.join(first, "code")


def audit_report(rows: DataFrame, id_col: str, fatal: dict[str, Column], issues: Column, counted: Column, examples: int = 20) -> DataFrame:
    """(section, code, value, n, ids): a dataset's audit.

    Section rows has how many there are, are structurally valid and are not; fatal and issue how many rows have each code, with
    the first ids of each; a fatal row has its first code only, and no issues. distribution splits what ``counted`` says of
    valid rows, as prefix:value, at the first colon. ``issues`` and ``counted`` are arrays of text.
    """
    none = F.lit(None).cast("string")
    code = first_error(fatal)
    ids = rows.select(F.col(id_col).alias("_id"), code.alias("_fatal"), F.when(code.isNull(), issues).alias("_issues"), F.when(code.isNull(), counted).alias("_counted"))
    ids = Rounds(rows.sparkSession, "audit").table("ids", ids)  # without the rows' texts, which are read once
    whole = ids.agg(F.count("*").alias("source_rows"), F.count_if(F.col("_fatal").isNull()).alias("valid_rows"), F.count("_fatal").alias("fatal_rows"))
    totals = whole.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in whole.columns))).alias("x")).select(F.lit("rows").alias("section"), "x.code", none.alias("value"), "x.n", none.alias("ids"))

    def section(name: str, hit: DataFrame) -> DataFrame:
        counts = hit.groupBy("code").agg(F.count("*").alias("n"))
        first = hit.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("_id"))).filter(F.col("r") <= examples)
        first = first.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_id")), lambda x: x.cast("string")), ",").alias("ids"))
        return counts.join(first, "code").select(F.lit(name).alias("section"), "code", none.alias("value"), "n", "ids")

    found = ids.select(F.explode("_counted").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    at = F.instr("x", ":")
    split = found.select(F.lit("distribution").alias("section"), F.when(at > 0, F.substring("x", F.lit(1), at - 1)).otherwise(F.col("x")).alias("code"), F.when(at > 0, F.substring("x", at + 1, F.char_length("x"))).alias("value"), "n", none.alias("ids"))
    return totals.unionByName(section("fatal", ids.filter("_fatal IS NOT NULL").select("_id", F.col("_fatal").alias("code")))).unionByName(section("issue", ids.select("_id", F.explode("_issues").alias("code")))).unionByName(split)


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): value counts of several columns in one pass."""
    sets = rows.select(*(F.col(c).cast("string").alias(c) for c in columns)).groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    k = len(columns)
    name = reduce(lambda c, i: c.when(F.col("g") == (1 << k) - 1 - (1 << (k - 1 - i)), columns[i]), range(1, k), F.when(F.col("g") == (1 << k) - 1 - (1 << (k - 1)), columns[0]))
    value = reduce(lambda c, i: c.when(F.col("g") == (1 << k) - 1 - (1 << (k - 1 - i)), F.col(columns[i])), range(1, k), F.when(F.col("g") == (1 << k) - 1 - (1 << (k - 1)), F.col(columns[0])))
    return sets.select(name.alias("field"), value.alias("value"), "n")
