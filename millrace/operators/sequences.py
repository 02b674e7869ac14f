"""Runs, occurrences and gaps along an order, and audits of one table against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_repeats(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before within the key; nulls are equal to each other."""
    along = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(along) == 1
    return rows.withColumn("_new", first | ~F.col(value).eqNullSafe(F.lag(value).over(along))).filter("_new").drop("_new")


def occurrences(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds occurrence: how many rows of the key stand before."""
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def gaps(rows: DataFrame, key: str, step: str) -> DataFrame:
    """(key, after, before): where the numbers of a key are not contiguous; repeats are no gaps."""
    following = F.lead(step).over(Window.partitionBy(key).orderBy(step))
    pairs = rows.select(key, F.col(step).alias("after"), following.alias("before"))
    return pairs.filter(F.col("before") - F.col("after") > 1)


def output_audit(before: DataFrame, after: DataFrame, group: str, keys: list[str], fields: list[str], target: str, invariants: dict[str, Column] | None = None) -> DataFrame:
    """Per group: whether both tables have it, rows before and after, and rows outside the target that have changed; with
    ``invariants`` also n_broken and broken, the targets that break one of these conditions on the row after, and the names of those broken.

    ``target`` is a boolean column of ``before``: rows that were to be changed. Only the hashes of the fields are joined.
    """
    digest = F.xxhash64(*fields)
    names = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in (invariants or {}).items())), lambda x: x.isNotNull()) if invariants else F.array().cast("array<string>")
    old = before.select(*keys, F.col(target).alias("_target"), digest.alias("_old"), F.lit(1).alias("_b"))
    new = after.select(*keys, digest.alias("_new"), F.lit(1).alias("_a"), names.alias("_broken"))
    both = old.join(new, keys, "full_outer")
    on_target = F.coalesce("_target", F.lit(False))
    broken = on_target & (F.coalesce(F.size("_broken"), F.lit(0)) > 0)
    out = both.groupBy(group).agg(
        F.count("_b").alias("n_before"), F.count("_a").alias("n_after"), F.count_if(~on_target & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("n_changed_outside"),
        F.count_if(broken).alias("n_broken"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(broken, F.col("_broken")))))), ",").alias("broken"),
    )
    ok = (F.col("n_before") == F.col("n_after")) & (F.col("n_changed_outside") == 0) & (F.col("n_broken") == 0)
    return out.withColumn("ok", ok) if invariants else out.withColumn("ok", ok).drop("n_broken", "broken")
