"""Batches and packed sequences under a token capacity. What is greedy runs per window of draws, so windows run side by side."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .planner import Planner, assign_ranks, balanced_frame, balanced_frames, full_partition, pack_count_bounds, planned_microbatches, ranked_packs

__all__ = ["Planner", "assign_ranks", "balanced_frame", "balanced_frames", "full_partition", "pack_count_bounds", "planned_microbatches", "ranked_packs"]


def length_order(rows: DataFrame, window: str, tokens: str = "tokens", order: str = "draw_id") -> DataFrame:
    """Adds position: within a window the longest first, ties by draw."""
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy(window).orderBy(F.col(tokens).desc(), order)) - 1).cast("long"))


def best_fit(draws: list[int], lengths: list[int], packs: int, capacity: int, required: int, feasible: Callable[[list[list[int]]], bool] | None = None) -> list[list[int]]:
    """Draws dealt to ``packs`` packs: the required draw opens the first, the longest others open the rest; each next
    longest goes where it leaves the least room, ties to the lower pack; what fits nowhere is left out.

    ``feasible`` may rule out packs as they would stand, for budgets that lengths do not show: a draw that would break it
    opens no pack and joins none. Raises where the packs cannot all be opened.
    """
    size = dict(zip(draws, lengths))
    for d in draws:
        if size[d] > capacity:
            raise ValueError(f"draw {d} has {size[d]} tokens, more than the capacity of {capacity}")
    if required not in size or len(size) < max(packs, len(draws)):
        raise ValueError("the draws must be distinct, hold the required one, and be as many as the packs")
    allowed = feasible or (lambda filled: True)
    filled, waiting = [[required]], []
    if not allowed(filled):
        raise ValueError(f"draw {required} alone breaks the budgets")
    for d in sorted((d for d in size if d != required), key=lambda d: (-size[d], d)):
        opens = len(filled) < packs and allowed([*filled, [d]])
        (filled if opens else waiting).append([d] if opens else d)
    if len(filled) < packs:
        raise ValueError("not every pack can be opened within the budgets")
    room = [capacity - size[p[0]] for p in filled]
    for d in waiting:
        for _, i in sorted((room[i] - size[d], i) for i in range(packs) if room[i] >= size[d]):
            if allowed([p + [d] if k == i else p for k, p in enumerate(filled)]):
                filled[i].append(d)
                room[i] -= size[d]
                break
    return filled


def packed_rounds(size: dict[int, int], packs: int, capacity: int) -> list[tuple]:
    """(draw, round, pack, segment) of all draws: what fits nowhere in a round is left for the next. A draw over the capacity has None for all three."""
    left = {d: n for d, n in size.items() if n <= capacity}
    out, turn = [(d, None, None, None) for d in size if d not in left], 0
    while left:
        found = best_fit(list(left), list(left.values()), min(packs, len(left)), capacity, min(left))
        out += [(d, turn, p, s) for p, ds in enumerate(found) for s, d in enumerate(ds)]
        left = {d: n for d, n in left.items() if d not in {x for ds in found for x in ds}}
        turn += 1
    return out


def greedy_packs(rows: DataFrame, window: str, packs: int, capacity: int) -> DataFrame:
    """(window, draw_id, tokens, round, pack_index, segment_index, status): best-fit packing of each window, round after round, until no draw is left.

    ``rows`` holds (window, draw_id, tokens); a window holds a bounded number of draws, the lowest one left is the required of a
    round. A draw that no pack can hold comes out with the status oversize and without a pack; all others are packed.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("draw_id")
        size = dict(zip(frame["draw_id"].tolist(), frame["tokens"].tolist()))
        out = [(frame[window].iloc[0], d, size[d], r, p, s, "oversize" if p is None else "packed") for d, r, p, s in packed_rounds(size, packs, capacity)]
        out = pd.DataFrame(out, columns=[window, "draw_id", "tokens", "round", "pack_index", "segment_index", "status"])
        return out.astype({c: "Int64" for c in ("round", "pack_index", "segment_index")})

    return rows.select(window, "draw_id", "tokens").groupBy(window).applyInPandas(pack, f"{window} long, draw_id long, tokens long, round long, pack_index long, segment_index long, status string")


def varlen_offsets(segments: DataFrame, pack: list[str], order: str) -> DataFrame:
    """Adds start, stop and pack_length: where each segment lies in its pack."""
    along = Window.partitionBy(*pack).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum("tokens").over(along)
    return segments.select("*", (stop - F.col("tokens")).cast("long").alias("start"), stop.cast("long").alias("stop"), F.sum("tokens").over(Window.partitionBy(*pack)).cast("long").alias("pack_length"))


def pack_stats(segments: DataFrame, pack: list[str], keys: list[str], status: str = "status") -> DataFrame:
    """Per key: packs, segments, tokens, padded tokens (packs times the longest) and the waste between them; draws that no pack can hold, by their own count."""
    held = F.col(status) == "packed" if status in segments.columns else F.lit(True)
    lengths = segments.groupBy(*keys, *[p for p in pack if p not in keys], held.alias("_held")).agg(F.sum("tokens").alias("n"), F.count("*").alias("k"))
    among = lambda c: F.when(F.col("_held"), F.col(c))
    packs = F.count_if("_held")
    out = lengths.groupBy(*keys).agg(
        packs.alias("packs"), F.coalesce(F.sum(among("k")), F.lit(0)).alias("segments"), F.coalesce(F.sum(among("n")), F.lit(0)).alias("tokens"), F.coalesce(packs * F.max(among("n")), F.lit(0)).alias("padded_tokens"),
        F.coalesce(F.sum(F.when(~F.col("_held"), F.col("k"))), F.lit(0)).alias("oversize"))
    return out.withColumn("padding", F.when(F.col("padded_tokens") > 0, 1 - F.col("tokens") / F.col("padded_tokens")).otherwise(0.0))


def rank_skew(rows: DataFrame, step: str, rank: str, load: str) -> DataFrame:
    """Per step: max over ranks of |load - mean| / mean, zero for no load."""
    sums = rows.groupBy(step, rank).agg(F.sum(load).alias("n"))
    stats = sums.groupBy(step).agg(F.count("*").alias("ranks"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))
    mean = F.col("total") / F.col("ranks")
    return stats.withColumn("skew", F.when(F.col("total") > 0, F.greatest(F.col("most") - mean, mean - F.col("least")) / mean).otherwise(0.0))


def batch_contract(cardinality: str, local_batch: int, world: int, accumulation: int, capacity: int, grouping: str = "none", packing: str = "none", layout: str = "padded") -> dict:
    """Pack counts of a local, a global and an optimiser step, tokens of a rank, and what a run of steps draws; raises for fields that do not go together."""
    legal = {("none", "none", "padded"), ("length", "none", "padded"), ("bounded_cost", "none", "padded"), ("length", "greedy", "varlen")}
    if (grouping, packing, layout) not in legal:
        raise ValueError(f"{grouping} grouping, {packing} packing and {layout} layout do not go together")
    if cardinality == "token_budget" and grouping != "bounded_cost":
        raise ValueError("a token budget needs bounded_cost grouping")
    low, high = pack_count_bounds(cardinality, local_batch)
    return {"local": (low, high), "global": (low * world, high * world), "step": (low * world * accumulation, high * world * accumulation),
            "local_tokens": capacity * (high if packing == "greedy" else 1), "draws_per_step": high * world * accumulation if (low, packing) == (high, "none") else None}


def length_microbatches(draws: list[tuple[int, int]], world: int, local: int, buffer_size: int) -> list[list[tuple[int, int]]]:
    """Global microbatches of draws of like length: of the buffer, longest first, the stretch that holds the oldest draw."""
    size, buffer, at, out = world * local, [], 0, []
    while True:
        take = draws[at : at + buffer_size - len(buffer)]
        buffer, at = buffer + take, at + len(take)
        if len(buffer) < size:
            return out + ([sorted(buffer, key=lambda e: (-e[1], e[0]))] if buffer else [])
        ordered = sorted(buffer, key=lambda e: (-e[1], e[0]))
        place = ordered.index(min(buffer))
        start = min(place // size * size, len(ordered) - size)
        out.append(ordered[start : start + size])
        gone = {d for d, _ in out[-1]}
        buffer = [e for e in buffer if e[0] not in gone]


def padded(rows: DataFrame, batch: list[str], column: str, value: int, left: bool = False) -> DataFrame:
    """``column``, an array, filled to the longest of its batch, at the right or at the left."""
    most = F.max(F.size(column)).over(Window.partitionBy(*batch))
    fill = F.array_repeat(F.lit(value).cast("long"), (most - F.size(column)).cast("int"))
    return rows.withColumn(column, F.concat(fill, F.col(column)) if left else F.concat(F.col(column), fill))


def truncated(target: Column, prefix: Column, most: int, end_id: int) -> Column:
    """Target ids cut to what a prefix leaves of ``most``; the end id is added where the whole target and it fit, never to one that is cut."""
    budget = F.lit(most) - prefix
    wants = F.when(F.size(target) == 0, True).otherwise(F.element_at(target, -1) != end_id)
    fits = F.size(target) + wants.cast("int") <= budget
    whole = F.when(wants, F.concat(target, F.array(F.lit(end_id).cast("long")))).otherwise(target)
    return F.when(budget <= 0, F.array().cast("array<bigint>")).when(fits, whole).otherwise(F.slice(target, 1, F.greatest(budget, F.lit(1))))


def prefix_kept(prefix: Column, most: int, supervised: bool = True) -> Column:
    """How many tokens of a prefix stay: all that fit, less one for the target where there is supervision."""
    return F.when(prefix < most, prefix).otherwise(most - 1 if supervised else most)


def prefix_places(tokens: Column, widths: Column, spans: Column, special: list[int], protected: Column, limit: Column) -> Column:
    """struct(kept, error): which places of a processed prefix stay where it is cut to ``limit``, so that the chat's structure does.

    A rendered token takes ``widths`` places, more than one where it stands for a medium. Only tokens inside the template's ``spans`` (start,
    stop) go, the first of them first: none that is special, that stands for a medium, or whose place lies in a ``protected`` stretch.
    The error says that too few can go; kept is null then. A prefix within the limit stays whole.
    """
    start = F.aggregate(widths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, w: F.struct((a["at"] + w).cast("int").alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))
    total = F.aggregate(widths, F.lit(0), lambda a, w: a + w.cast("int"))
    whole = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["stop"] - 1))))

    def of(places: Column) -> Column:
        place = lambda i: F.get(places["all"], i)
        guarded = lambda p: F.exists(protected, lambda s: (p < s["stop"]) & (p + 1 > s["start"]))
        free = F.filter(inside, lambda i: ~F.get(tokens, i).isin(*special) & (F.get(widths, i) == 1) & ~guarded(place(i)))
        gone = total - limit
        kept = F.array_except(whole, F.transform(F.slice(free, 1, F.greatest(gone, F.lit(0))), place))
        short = F.size(free) < gone
        return F.struct(F.when(gone <= 0, whole).when(~short, kept).alias("kept"), F.when((gone > 0) & short, "too few tokens can go").alias("error"))

    return F.transform(F.array(start), of)[0]


def loss_weights(strategy: str, prefix: Column, target: Column, spans: Column, prefix_scale: float = 1.0, target_scale: float = 1.0) -> Column:
    """A weight per token: the target's scale on the target; on the prefix its scale on all of it, on none of it (last_round), or on the assistant's ``spans`` (default)."""
    def weight(i: Column) -> Column:
        inside = F.lit(strategy == "all") if strategy != "default" else F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"]))
        return F.when(i >= prefix, float(target_scale)).when(inside, float(prefix_scale)).otherwise(0.0)

    return F.when(prefix + target > 0, F.transform(F.sequence(F.lit(0), prefix + target - 1), weight)).otherwise(F.array().cast("array<double>"))


def pair_rows(pairs: DataFrame, id_col: str) -> DataFrame:
    """(id, side, row, text): preference records as one batch, all chosen rows and then all rejected ones."""
    both = F.array(F.struct(F.lit("chosen").alias("side"), F.lit(0).alias("s"), F.col("chosen_text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.lit(1).alias("s"), F.col("rejected_text").alias("text")))
    return pairs.select(id_col, F.explode(both).alias("x")).select(id_col, "x.side", F.col("x.s").alias("part"), "x.text")


def sample_cost(text_tokens: Column, target_tokens: Column, width: Column, height: Column, patch: int = 14, merge: int = 2) -> Column:
    """struct(llm_tokens, supervised_tokens, vision_patches, exact): what a sample costs, its image in merged patches among the tokens."""
    patches = F.coalesce((F.floor(width / patch) * F.floor(height / patch)).cast("long"), F.lit(0).cast("long"))
    return F.struct((text_tokens + target_tokens + F.floor(patches / (merge * merge))).cast("long").alias("llm_tokens"), target_tokens.cast("long").alias("supervised_tokens"), patches.alias("vision_patches"), F.lit(True).alias("exact"))


def cost_error(draw: Column, cost: Column, most_tokens: int, most_patches: int, least_packs: int = 1) -> Column:
    """Why a draw cannot be planned, naming it, else null: an estimate, no tokens, more supervision than tokens, or over a budget."""
    name = F.concat(F.lit("draw "), draw.cast("string"), F.lit(": "))
    return (
        F.when(~cost["exact"], F.concat(name, F.lit("cost is not exact"))).when(cost["llm_tokens"] <= 0, F.concat(name, F.lit("no tokens")))
        .when(cost["supervised_tokens"] > cost["llm_tokens"], F.concat(name, F.lit("more supervised than all tokens")))
        .when(cost["llm_tokens"] * least_packs > most_tokens, F.concat(name, F.lit("over the token budget"))).when(cost["vision_patches"] > most_patches, F.concat(name, F.lit("over the patch budget")))
    )


def batch_stats(rows: DataFrame, keys: list[str], ids: str, labels: str, ignore: int = -100) -> DataFrame:
    """Per batch of unpadded sequences: rows, useful_tokens, materialized_tokens (all as long as the longest), supervised_tokens (labels but the first that count), and sums of lengths and their squares."""
    n = F.size(ids).cast("long")
    counted = F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != ignore)).cast("long")
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(n).alias("useful_tokens"), (F.count("*") * F.max(n)).alias("materialized_tokens"), F.sum(counted).alias("supervised_tokens"), F.sum(n * n).alias("square_sum"))


def check_layout(segments: DataFrame, pack: list[str], most: int) -> DataFrame:
    """(pack, error) of packs whose segments overlap or leave gaps, do not start at 0, or go beyond ``most``."""
    by = Window.partitionBy(*pack).orderBy("start")
    rows = segments.withColumn("_before", F.lag("stop").over(by))
    error = F.when(F.coalesce("_before", F.lit(0)) != F.col("start"), "not contiguous").when(F.col("stop") <= F.col("start"), "empty segment").when(F.col("stop") > most, "over the capacity")
    return rows.withColumn("error", error).filter("error IS NOT NULL").groupBy(*pack).agg(F.min("error").alias("error"))


def length_batches(rows: DataFrame, stream: str, world: int, local: int, buffer_size: int) -> DataFrame:
    """(stream, microstep, slot, draw_id, tokens): global microbatches of draws of like length, stream by stream; see ``planned_microbatches`` on the length of streams."""

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("draw_id")
        found = length_microbatches(list(zip(frame["draw_id"].tolist(), frame["tokens"].tolist())), world, local, buffer_size)
        out = [(frame[stream].iloc[0], k, i, d, t) for k, batch in enumerate(found) for i, (d, t) in enumerate(batch)]
        return pd.DataFrame(out, columns=[stream, "microstep", "slot", "draw_id", "tokens"])

    return rows.select(stream, "draw_id", "tokens").groupBy(stream).applyInPandas(plan, f"{stream} long, microstep long, slot long, draw_id long, tokens long")
