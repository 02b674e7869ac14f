"""Values at exact ranks of groups of any size: quantile sketches narrow the range, counts keep it exact, a bounded rest is sorted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Rounds

SMALL = 65_536  # values that are sorted as one array
GRID = 1000  # parts that a range is cut into at a time
ACCURACY = 20_000  # of the sketch: a rank is off by 1/20 of a part at most


def names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def alike(left: DataFrame, right: DataFrame, keys: list[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows whose keys (columns ``keys`` of both) are equal, nulls too; the right side's keys go."""
    other = right
    for k in keys:
        other = other.withColumnRenamed(k, f"{k}r")
    on = F.lit(True) if more is None else more
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}r"))
    return left.join(other, on, how).drop(*(f"{k}r" for k in keys))


def narrowed(grid: Column, rank: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds at or between which the value of a rank (of ``n`` from ``low`` to ``high``) lies, by a grid of their quantiles."""
    part = F.floor(rank * F.lit(float(GRID)) / n).cast("int")
    return F.when(part < 2, low).otherwise(F.get(grid, part - 2)), F.when(part + 2 > GRID - 2, high).otherwise(F.get(grid, part + 2))


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]], tables: Rounds) -> DataFrame:
    """(keys, which, rank, n, value, below): the values at some ranks (from 0, in ascending order) of each group's n values, and how many are less.

    ``ranks`` makes the ranks of n; those below 0 or from n on give no row, null values are left out. Each pass counts
    what lies below, at and between two bounds of each rank, by partial sums, and a sketch of what is between gives the next
    bounds, some hundred times closer. A rank that falls on copies of a bound is found; where SMALL values are left between, these
    are sorted. No task holds more of a group.
    """
    k = names(keys)
    values = rows.select(*(F.col(c).alias(n) for c, n in zip(keys, k)), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    sketch = lambda v: F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], F.lit(ACCURACY)).alias("_grid")
    first = values.groupBy(*k).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), sketch(F.col("_v")))
    wanted = F.filter(F.array(*(F.struct(F.lit(i).alias("which"), r.cast("long").alias("rank")) for i, r in enumerate(ranks(F.col("_n"))))), lambda x: (x["rank"] >= 0) & (x["rank"] < F.col("_n")))
    whole = F.col("_n") <= SMALL
    low, high = narrowed(F.col("_grid"), F.col("rank"), F.col("_n"), F.col("_low"), F.col("_high"))
    state = first.withColumn("_w", F.explode(wanted)).select(*first.columns, "_w.which", "_w.rank")
    state = state.select(*k, "_n", "which", "rank", whole.alias("_whole"), F.when(~whole, low).alias("_low"), F.when(~whole, high).alias("_high"))
    state = tables.table("bounds-0", state)
    done = state.filter("_whole").withColumns({"_below": F.lit(0).cast("long"), "_at": F.lit(0).cast("long"), "_between": F.col("_n")})
    open_, step = state.filter("NOT _whole"), 0
    place = F.col("rank") - F.col("_below")
    while not open_.isEmpty():
        step += 1
        met = alike(values, open_.select(*k, "_low", "_high").distinct(), k, F.col("_v") <= F.col("_high"))
        between = (F.col("_v") > F.col("_low")) & (F.col("_v") < F.col("_high"))
        counts = met.groupBy(*k, "_low", "_high").agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(F.col("_v") == F.col("_low")).alias("_at"), F.count_if(between).alias("_between"), F.count("*").alias("_upto"), sketch(F.when(between, F.col("_v"))))
        same = (F.col("_low") == F.col("_lowr")) & (F.col("_high") == F.col("_highr"))
        state = alike(open_, counts.withColumnsRenamed({"_low": "_lowr", "_high": "_highr"}), k, same).drop("_lowr", "_highr")
        checked = F.when((place >= 0) & (F.col("rank") < F.col("_upto")), F.col("_below")).otherwise(F.raise_error(F.lit("a rank left its bounds")).cast("long"))
        state = tables.table(f"bounds-{step}", state.withColumn("_below", checked).drop("_upto"))
        ends = (F.col("_between") <= SMALL) | (place < F.col("_at")) | (place >= F.col("_at") + F.col("_between"))
        done = done.unionByName(state.filter(ends).drop("_grid"))
        low, high = narrowed(F.col("_grid"), place - F.col("_at"), F.col("_between"), F.col("_low"), F.col("_high"))
        open_ = state.filter(~ends).select(*k, "_n", "which", "rank", "_whole", low.alias("_low"), high.alias("_high"))
    inner = place - F.col("_at")
    sort = (inner >= 0) & (inner < F.col("_between"))
    spans = done.filter(sort).select(*k, "_low", "_high").distinct()
    inside = F.col("_low").isNull() | ((F.col("_v") > F.col("_low")) & (F.col("_v") < F.col("_high")))
    sets = alike(values, spans, k, inside).groupBy(*k, "_low", "_high").agg(F.array_sort(F.collect_list("_v")).alias("_values"))
    same = F.col("_low").eqNullSafe(F.col("_lowr")) & F.col("_high").eqNullSafe(F.col("_highr"))
    found = alike(done, sets.withColumnsRenamed({"_low": "_lowr", "_high": "_highr"}), k, same, "left").drop("_lowr", "_highr")
    found = found.withColumn("value", F.when(inner < 0, F.col("_low")).when(sort, F.get("_values", inner.cast("int"))).otherwise(F.col("_high")))
    less = F.when(inner < 0, F.lit(0)).when(sort, F.col("_at") + F.array_position("_values", F.col("value")) - 1).otherwise(F.col("_at") + F.col("_between"))
    return found.select(*(F.col(n).alias(c) for c, n in zip(keys, k)), "which", "rank", F.col("_n").alias("n"), "value", (F.col("_below") + less).alias("below"))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): percentiles of each group, between two values in proportion; exact."""
    tables = Rounds(rows.sparkSession, "percentiles")
    place = lambda p, n: F.lit(float(p)) * (n - 1)
    ranks = lambda n: [r for p in shares.values() for r in (F.floor(place(p, n)), F.ceil(place(p, n)))]
    found = at_ranks(rows, keys, value, ranks, tables)
    out = []
    for i, (name, p) in enumerate(shares.items()):
        low, high = (F.max(F.when(F.col("which") == 2 * i + side, F.col("value"))) for side in (0, 1))
        rest = F.max(place(p, F.col("n")) - F.floor(place(p, F.col("n"))))
        out.append((low + (high - low) * rest).alias(name))
    return found.groupBy(*keys).agg(*out)


def edges(rows: DataFrame, keys: list[str], value: str, id_col: str, parts: int) -> DataFrame:
    """(keys, edges): for each group the (value, id) at which each of ``parts`` parts but the first begins, in order of value, then id.

    Part b begins at row ceil(b n / parts) of n. Ids may be of any type that has a sketch; a group's are told apart by them.
    """
    tables = Rounds(rows.sparkSession, "edges")
    begins = lambda n: [F.ceil(n * b / F.lit(float(parts))) for b in range(1, parts)]
    at = tables.table("values", at_ranks(rows, keys, value, begins, tables).withColumnsRenamed(dict(zip(keys, names(keys)))))
    k = names(keys)
    own = rows.select(*(F.col(c).alias(n) for c, n in zip(keys, k)), F.col(value).alias("_value"), F.col(id_col).alias("_id"))
    wanted = at.select(*k, F.col("which").alias("_part"), F.col("value").alias("_at"), (F.col("rank") - F.col("below")).alias("_place"))
    ties = alike(own, wanted, k, F.col("_value") == F.col("_at"))
    # of the rows of that value the one at the rest of the rank, by id
    ids = at_ranks(ties, [*k, "_at", "_part", "_place"], "_id", lambda n: [F.col(f"_k{len(k) + 2}")], Rounds(rows.sparkSession, "edge-ids"))
    each = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("value"), F.col("value").alias("id")))).alias("edges")
    return ids.groupBy(*k).agg(each).select(*(F.col(n).alias(c) for c, n in zip(keys, k)), "edges")
