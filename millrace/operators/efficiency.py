"""Efficiency of training runs from frames: one row for each rank and optimiser step, with counts and seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Rounds
from .metrics import ratio
from .selection import alike, percentiles

#: The columns of a frame beside its keys, rank and step. device_seconds and supervision_mass may be null.
COUNTS = ("segments", "packs", "useful_tokens", "materialized_tokens", "supervised_tokens", "length_sum", "length_square_sum", "vision_patches", "supervision_microbatches", "vision_microbatches", "microbatches")
TIMES = ("acquire_seconds", "prepare_seconds", "step_seconds", "optimizer_seconds", "device_seconds")


def critical_seconds() -> Column:
    """Seconds that a frame takes: waiting and preparing, and what the device measured or else the step and the optimiser."""
    compute = F.coalesce("device_seconds", F.col("step_seconds") + F.col("optimizer_seconds"))
    return F.col("acquire_seconds") + F.col("prepare_seconds") + compute


def frame_errors() -> Column:
    """What is wrong with a frame, or null."""
    negative = lambda cols: F.exists(F.array(*(F.col(c).cast("double") for c in cols)), lambda v: (v < 0) | F.isnan(v) | (v == float("inf")))
    return (
        F.when(F.col("step") <= 0, "step").when(negative(COUNTS), "negative count").when((F.col("segments") <= 0) | (F.col("packs") <= 0) | (F.col("microbatches") <= 0), "empty")
        .when(F.col("useful_tokens") > F.col("materialized_tokens"), "more useful than materialized tokens").when(F.col("supervised_tokens") > F.col("useful_tokens"), "more supervised than useful tokens")
        .when(F.greatest("supervision_microbatches", "vision_microbatches") > F.col("microbatches"), "more covered than all microbatches")
        .when(F.coalesce(negative([c for c in TIMES if c != "device_seconds"]), F.lit(True)) | F.coalesce(negative(["device_seconds"]), F.lit(False)), "seconds")
    )


def one_rank(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of all ranks as one rank's: counts and mass summed over the ranks of a step, all seconds those of its slowest rank (ties: the lowest).

    Adds ranks, how many a step has.
    """
    slow = F.max(F.struct(critical_seconds().alias("critical"), (-F.col("rank")).alias("order"), *(F.col(t) for t in TIMES), "update_applied")).alias("_slow")
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "supervision_mass")]
    rows = frames.groupBy(*keys, "step").agg(F.count("*").alias("ranks"), slow, *sums)
    return rows.select(*keys, "step", "ranks", *COUNTS, "supervision_mass", *(F.col(f"_slow.{t}").alias(t) for t in TIMES), (-F.col("_slow.order")).alias("slowest_rank"), F.col("_slow.update_applied").alias("update_applied"))


def totals(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, of frames of one rank: the span of steps, whether it has no gaps, sums, exact median and 95th percentile of the seconds, and ratios.

    A ratio with nothing below the line is 0. Seconds of a device count where there are any; device_steps says in how many steps.
    """
    rows = frames.withColumn("critical_seconds", critical_seconds())
    sums = rows.groupBy(*keys).agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("steps"), *(F.sum(c).alias(c) for c in COUNTS), F.coalesce(F.sum("supervision_mass"), F.lit(0.0)).alias("supervision_mass"),
        F.count_if("update_applied").alias("update_applied_steps"), *(F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in TIMES), F.count("device_seconds").alias("device_steps"), F.sum("critical_seconds").alias("critical_seconds"),
    )
    steps = rows.groupBy(*keys, "step").agg(F.count("*").alias("n")).groupBy(*keys).agg((F.count_if(F.col("n") > 1) == 0).alias("single"))
    spread = percentiles(rows, keys, "critical_seconds", {"p50_seconds": 0.5, "p95_seconds": 0.95})
    out = alike(alike(sums, steps, keys), spread, keys, how="left").withColumn("contiguous", F.col("single") & (F.col("last_step") - F.col("first_step") + 1 == F.col("steps"))).drop("single")
    c = F.col
    mean = ratio(c("length_sum"), c("segments"))
    ratios = {
        "padding_fraction": ratio(c("materialized_tokens") - c("useful_tokens"), c("materialized_tokens")), "supervision_fraction": ratio(c("supervised_tokens"), c("useful_tokens")), "segments_per_pack": ratio(c("segments"), c("packs")),
        "useful_tokens_per_second": ratio(c("useful_tokens"), c("critical_seconds")), "segments_per_second": ratio(c("segments"), c("critical_seconds")), "vision_patches_per_second": ratio(c("vision_patches"), c("critical_seconds")),
        "supervised_tokens_per_second": ratio(c("supervised_tokens"), c("critical_seconds")), "acquire_fraction": ratio(c("acquire_seconds"), c("critical_seconds")), "prepare_fraction": ratio(c("prepare_seconds"), c("critical_seconds")),
        "mean_length": mean, "std_length": F.sqrt(F.greatest(ratio(c("length_square_sum"), c("segments")) - mean * mean, F.lit(0.0))),
        "supervision_coverage": ratio(c("supervision_microbatches"), c("microbatches")), "vision_coverage": ratio(c("vision_microbatches"), c("microbatches")),
    }
    return out.select("*", *(v.alias(k) for k, v in ratios.items()))


def rank_times(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: least, mean and most seconds of all ranks, their skew (most less least over the mean), and whether all ranks have the same steps."""
    each = frames.groupBy(*keys, "rank").agg(F.sum(critical_seconds()).alias("seconds"), F.count("*").alias("n"))
    held = frames.groupBy(*keys, "step").agg(F.count_distinct("rank").alias("ranks"))
    ranks = each.groupBy(*keys).agg(F.count("*").alias("world"), F.min("seconds").alias("rank_min_seconds"), F.avg("seconds").alias("rank_mean_seconds"), F.max("seconds").alias("rank_max_seconds"))
    steps = held.groupBy(*keys).agg(F.min("ranks").alias("least"))
    both = alike(ranks, steps, keys)
    return both.select(*keys, "world", "rank_min_seconds", "rank_mean_seconds", "rank_max_seconds", ratio(F.col("rank_max_seconds") - F.col("rank_min_seconds"), F.col("rank_mean_seconds")).alias("rank_skew"), (F.col("least") == F.col("world")).alias("ranks_agree"))


def summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ``totals`` over ``one_rank``, which is written once and looked at several times, beside ``rank_times``."""
    steps = Rounds(frames.sparkSession, "efficiency").table("steps", one_rank(frames, keys))
    return alike(totals(steps, keys), rank_times(frames, keys), keys)
