"""Metrics as states that can be added up: over rows, micro-batches, ranks and files, in any order, batch or streaming.

A metric's state is a few sums. What is computed at the end has the sums of all parts below and above the line, so a mean over parts of
unlike sizes is the mean over all their samples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.registry import Registry

STATES = Registry("metric state")


@dataclass(frozen=True)
class Metric:
    """Sums of columns over samples, and what they come to. Without samples the metric is 0."""

    parts: dict[str, Column]
    value: Callable[..., Column]

    def compute(self, sums: dict[str, Column]) -> Column:
        return self.value(*(sums[p] for p in self.parts))


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.when(bottom > 0, top / bottom), F.lit(0.0))


def mean_of(value: Column) -> Metric:
    return Metric({"sum": value, "n": F.lit(1.0)}, ratio)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


@STATES.register("parse_success")
def parse_success() -> Metric:
    return mean_of(flag(F.col("valid") & ~F.col("partial")))


@STATES.register("parse_partial_rate")
def parse_partial_rate() -> Metric:
    return mean_of(flag(F.col("valid") & F.col("partial")))


@STATES.register("exact_match")
def exact_match() -> Metric:
    return mean_of(flag(F.col("valid") & (F.col("parsed") == F.col("target"))))


@STATES.register("mean")
def mean(column: str = "score") -> Metric:
    """The mean of a column of scores of samples, such as an F1 or a share of keypoints; a null score is 0."""
    return mean_of(F.coalesce(F.col(column).cast("double"), F.lit(0.0)))


@STATES.register("weighted_mean")
def weighted_mean(column: str = "loss", weight: str = "tokens") -> Metric:
    """The sum of a column times its weight over the sum of weights; a null in either is left out."""
    both = F.col(column).isNotNull() & F.col(weight).isNotNull()
    return Metric({"sum": F.when(both, F.col(column).cast("double") * F.col(weight)), "weight": F.when(both, F.col(weight).cast("double"))}, ratio)


class Metrics:
    """Some metrics by name, each of STATES with its parameters: {"loss": ("weighted_mean", {"column": "loss"})}."""

    def __init__(self, wanted: dict[str, tuple[str, dict]]):
        self.metrics = {name: STATES.create(kind, **options) for name, (kind, options) in wanted.items()}

    def columns(self) -> list[str]:
        return [f"{m}__{p}" for m, metric in self.metrics.items() for p in metric.parts]

    def update(self, rows: DataFrame, *keys: str) -> DataFrame:
        """(keys, sums): the state of the samples of each key."""
        sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{m}__{p}") for m, metric in self.metrics.items() for p, c in metric.parts.items()]
        return rows.groupBy(*keys).agg(*sums)

    def merge(self, states: DataFrame, *keys: str) -> DataFrame:
        """States of several parts added up to those of fewer keys."""
        return states.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in self.columns()))

    def compute(self, states: DataFrame) -> DataFrame:
        """(keys, a column for each metric)"""
        keys = [c for c in states.columns if c not in self.columns()]
        return states.select(*keys, *(metric.compute({p: F.col(f"{m}__{p}") for p in metric.parts}).alias(m) for m, metric in self.metrics.items()))

    def empty(self, spark: SparkSession, keys: str) -> DataFrame:
        """No samples: a state to begin with, whose keys have the types of the DDL ``keys``."""
        return spark.createDataFrame([], ", ".join([keys, *(f"{c} double" for c in self.columns())]))


class StateLog:
    """States of the micro-batches of a stream, each in a folder of its own that a repeated batch replaces."""

    def __init__(self, metrics: Metrics, path: str, *keys: str):
        self.metrics, self.path, self.keys = metrics, path.rstrip("/"), keys

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.metrics.update(batch, *self.keys).write.mode("overwrite").parquet(f"{self.path}/states/batch={batch_id}")

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        return rows.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(self.write).trigger(**trigger).start()

    def result(self, spark: SparkSession, *keys: str) -> DataFrame:
        """The metrics of all samples so far, by all keys or some of them."""
        return self.metrics.compute(self.metrics.merge(spark.read.parquet(f"{self.path}/states"), *keys))


def step_parts(rows: DataFrame, step: str, parts: list[str], loss: str, weight: str) -> DataFrame:
    """(step, parts, numerator, denominator, share): what each part (a rank's microbatch) adds to the loss of its step.

    The denominator is the weight of all parts of the step, on all ranks, so that the shares of a step sum to its mean whatever the sizes of
    its parts; 0 for a step without weight.
    """
    both = F.col(loss).isNotNull() & F.col(weight).isNotNull()
    each = rows.groupBy(step, *parts).agg(F.coalesce(F.sum(F.when(both, F.col(loss) * F.col(weight))), F.lit(0.0)).alias("numerator"), F.coalesce(F.sum(F.when(both, F.col(weight))), F.lit(0)).cast("double").alias("own"))
    whole = each.groupBy(step).agg(F.sum("own").alias("denominator"))
    return each.join(whole, step).select(step, *parts, "numerator", "denominator", ratio(F.col("numerator"), F.col("denominator")).alias("share"))
