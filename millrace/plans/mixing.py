"""Deterministic draws from a mixture of sources: what a draw number stands for never depends on how many are drawn."""

from __future__ import annotations

import hashlib
import json
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the schedule: splitmix64, salts, block sizes.
INCREMENT, MULTIPLY_1, MULTIPLY_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
TRANSFORM_SALT, CYCLE_SALT, BLOCK_SALT, SHUFFLE_SALT, OFFSET_SALT = 0xA0761D6478BD642F, 0x9E3779B185EBCA87, 0xCA5A826395121157, 0xD2B74407B1CE6E93, 0xD1B54A32D192ED03
BLOCK_TARGET, BLOCK_MOST, WORST_ERROR = 4096, 16384, 0.05
PHASE_BLOCKS, RANKS = 256, 64
FEISTEL_ROUNDS = 6
U64 = (1 << 64) - 1


def splitmix(values: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit integers, wrapping."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(INCREMENT)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLY_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLY_2)
        return x ^ (x >> np.uint64(31))


def splitmix1(value: int) -> int:
    return int(splitmix(np.array([value & U64], np.uint64))[0])


def feistel(positions: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size) at many positions, each with its seed: a Feistel network, walked until inside."""
    if size <= 1:
        return np.zeros(len(positions), np.uint64)
    half = np.uint64((max(2, (size - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    value, todo = positions.astype(np.uint64).copy(), np.arange(len(positions))
    while len(todo):
        left, right, key = value[todo] >> half, value[todo] & mask, seeds[todo]
        for r in range(FEISTEL_ROUNDS):
            turn = np.uint64((r * INCREMENT) & U64)
            left, right = right, left ^ (splitmix(key ^ turn ^ right) & mask)
        value[todo] = (left << half) | right
        todo = todo[value[todo] >= np.uint64(size)]
    return value


def affine(size: int, seed: int) -> tuple[int, int]:
    """(a, b) of the permutation i -> (a i + b) mod size."""
    if size <= 1:
        return 1, 0
    a = splitmix1(seed) % size | 1
    while gcd(a, size) != 1:
        a = (a + 2) % size or 1
    return a, splitmix1(seed ^ OFFSET_SALT) % size



def ticket_quotas(weights: list[float]) -> list[int]:
    """Integer quotas of a block that keep each source's share within 5 %.

    Weights that are ratios of small integers give the exact block, multiplied towards BLOCK_TARGET tickets. Others give
    the block size up to BLOCK_MOST with the least worst relative error, then the least total error, then the smallest. Sizes at which
    some source cannot be within the error are left out at once; the others are tried in the order of what they can do at best.
    """
    top = max(weights)
    scaled = [w / top for w in weights]
    ratios = [Fraction(w).limit_denominator(BLOCK_MOST) for w in scaled]
    if all(r > 0 and abs(float(r) - w) <= 1e-12 * w for r, w in zip(ratios, scaled)):
        common = lcm(*(r.denominator for r in ratios))
        exact = [int(r * common) for r in ratios]
        exact = [x // gcd(*exact) for x in exact]
        if sum(exact) <= BLOCK_MOST:
            return [x * max(1, BLOCK_TARGET // sum(exact)) for x in exact]
    shares = np.array(scaled) / sum(scaled)
    sizes = fitting_sizes(shares)
    bound = np.concatenate([least_errors(sizes[k : k + 1024], shares) for k in range(0, len(sizes), 1024)]) if len(sizes) else np.zeros(0)
    order = np.argsort(bound, kind="stable")
    best = None
    for k in range(0, len(order), 16):
        some = order[k : k + 16]
        if best is not None and bound[some[0]] > best[0]:
            break  # no size from here on can do as well
        found = min(remainders(sizes[some], shares), key=lambda x: x[:3])
        best = found if best is None or found[:3] < best[:3] else best
    if best is None or best[0] > WORST_ERROR:
        raise ValueError("a source's weight is too small to be kept within 5 % by a block")
    return best[3]


def fitting_sizes(shares: np.ndarray) -> np.ndarray:
    """Block sizes at which each source by itself has some quota within WORST_ERROR of its share.

    A quota q is within it for sizes from q / (p (1 + e)) to q / (p (1 - e)). The stretches of a share, without what they have in common,
    are counted in an array of differences; all quotas of all shares together are about BLOCK_MOST.
    """
    change = np.zeros(BLOCK_MOST + 2, np.int64)
    for p, sources in zip(*np.unique(shares, return_counts=True)):
        q = np.arange(1, int(BLOCK_MOST * p * (1 + WORST_ERROR)) + 2)
        low = np.ceil(q / (p * (1 + WORST_ERROR)) - 1e-9).astype(np.int64)
        high = np.minimum(np.floor(q / (p * (1 - WORST_ERROR)) + 1e-9).astype(np.int64), BLOCK_MOST)
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        some = low <= high
        np.add.at(change, low[some], sources)
        np.add.at(change, high[some] + 1, -sources)
    held = np.cumsum(change)[: BLOCK_MOST + 1] == len(shares)
    held[: len(shares)] = False
    return np.flatnonzero(held)


def least_errors(sizes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For each block size the worst relative error that it has at least, every source taking the better of its two whole quotas."""
    exact = sizes[:, None] * shares
    low = np.floor(exact)
    below = np.where(low > 0, exact - low, np.inf)
    return (np.minimum(below, low + 1 - exact) / exact).max(axis=1) - 1e-12


def remainders(sizes: np.ndarray, shares: np.ndarray) -> list[tuple[float, float, int, list[int]]]:
    """(worst relative error, total error, size, quotas) of each block size, quotas by largest remainders."""
    exact = sizes[:, None] * shares
    quotas = np.floor(exact)
    order = np.argsort(-(exact - quotas), axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    quotas += rank < (sizes - quotas.sum(axis=1))[:, None]
    error = np.where(quotas > 0, np.abs(quotas / sizes[:, None] / shares - 1), np.inf).max(axis=1)
    total = np.abs(quotas / sizes[:, None] - shares).sum(axis=1)
    return [(float(e), float(t), int(n), q.astype(int).tolist()) for e, t, n, q in zip(error, total, sizes, quotas)]


def shuffled_block(quotas: list[int], seed: int) -> list[int]:
    """The shuffled block: a chain of splitmix64 values picks each exchange, from the last place down."""
    block = [i for i, q in enumerate(quotas) for _ in range(q)]
    state = splitmix1(seed ^ SHUFFLE_SALT)
    for top in range(len(block) - 1, 0, -1):
        state = splitmix1(state)
        other = state % (top + 1)
        block[top], block[other] = block[other], block[top]
    return block


def rotation_step(size: int) -> int:
    """The least step that is coprime with the block, and with it coprime with all numbers of ranks up to RANKS."""
    ranks = lcm(*range(1, RANKS + 1))
    return next(s for s in range(1, 1 << 62) if gcd(s, size) == 1 and gcd(size + s, ranks) == 1) if size > 1 else 0


def fingerprint(**parts) -> str:
    """What a plan depends on, as a SHA-256."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def active_sources(sizes: DataFrame) -> DataFrame:
    """(source, size, weight) with rows and a positive weight, as (index, source, size, share, first, end).

    Sources are in order of name; share is the weight over all weights, first and end are the rows before, and through.
    """
    rows = sizes.filter((F.col("size") > 0) & (F.col("weight") > 0))
    everything, upto = Window.partitionBy(), Window.orderBy("source")
    return rows.select(
        (F.row_number().over(upto) - 1).cast("long").alias("index"), "source", F.col("size").cast("long").alias("size"), (F.col("weight") / F.sum("weight").over(everything)).alias("share"),
        (F.sum("size").over(upto) - F.col("size")).cast("long").alias("first"), F.sum("size").over(upto).cast("long").alias("end"),
    )


def largest_remainders(shares: DataFrame, seats: int, share: str = "share", order: str = "index") -> DataFrame:
    """Adds ``quota``: the shares of ``seats`` by Hamilton's method. One row per source, so one task is enough."""
    exact = F.round(F.col(share) * seats, 9)
    rank = F.row_number().over(Window.orderBy((exact - F.floor(exact)).desc(), order))
    left = F.lit(seats) - F.sum(F.floor(exact)).over(Window.partitionBy())
    return shares.withColumn("quota", (F.floor(exact) + F.when(rank <= left, 1).otherwise(0)).cast("long"))


STRETCHES = 4096  # of the positions of all sources, about


def concat_draws(spark: SparkSession, sources: DataFrame, draws: int, seed: int | None = None) -> DataFrame:
    """(draw_id, source, row_index): sources one after another, over and over; with a seed each cycle is permuted."""
    total = sources.agg(F.max("end")).first()[0] or 0
    rows = spark.range(draws if total else 0).select(F.col("id").alias("draw_id"), F.floor(F.col("id") / max(total, 1)).alias("cycle"), (F.col("id") % max(total, 1)).alias("position"))
    if seed is not None:
        cycles = [(c, *affine(total, splitmix1(seed ^ c))) for c in range(-(-draws // max(total, 1)))]
        keys = spark.createDataFrame(cycles, "cycle long, a long, b long")  # a row for each pass over the data
        wide = F.col("a").cast("decimal(19,0)") * F.col("position").cast("decimal(19,0)") + F.col("b")
        rows = rows.join(keys, "cycle").withColumn("position", (wide % total).cast("long"))
    # a source stands in each stretch of positions that it reaches into, so a draw meets the sources of its own stretch only
    stretch = max(1, total // STRETCHES)
    at = sources.select("source", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / stretch), F.floor((F.col("end") - 1) / stretch))).alias("stretch"))
    rows = rows.withColumn("stretch", F.floor(F.col("position") / stretch)).join(at, "stretch")
    return rows.filter((F.col("position") >= F.col("first")) & (F.col("position") < F.col("end"))).select("draw_id", "source", (F.col("position") - F.col("first")).alias("row_index"))


def spread(rows: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(draw_id, source, row_index) of draws, a stream of them too, in low-discrepancy order; a source's rows come in order, over and over.

    ``sources`` has quota. The block of tickets is a small table; each draw is arithmetic on it.
    """
    tickets = sources.filter("quota > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)))
    place = F.row_number().over(Window.orderBy((2 * F.col("k") + 1) / (2 * F.col("quota")), "index")) - 1
    tickets = tickets.select(place.cast("long").alias("ticket"), "source", "size", "quota", "k")
    rows = rows.select("draw_id", F.floor(F.col("draw_id") / block).alias("block_id"), (F.col("draw_id") % block).alias("ticket"))
    occurrence = F.col("block_id") * F.col("quota") + F.col("k")
    return rows.join(F.broadcast(tickets), "ticket").select("draw_id", "source", (occurrence % F.col("size")).alias("row_index"))  # BLOCK_MOST tickets at most


def finite_plan(spark: SparkSession, length: int, cycle: int = 0) -> DataFrame:
    """(draw_id, position, plan_cycle): one round of a plan of ``length`` draws; the draws of the rounds are numbered through."""
    if length < 0 or cycle < 0:
        raise ValueError("a plan's length and the number of a round are 0 at least")
    return spark.range(cycle * length, (cycle + 1) * length).select(F.col("id").alias("draw_id"), (F.col("id") - cycle * length).alias("position"), F.lit(cycle).alias("plan_cycle"))


def schedule_fingerprint(sources: list[tuple[str, int, float]], strategy: str, shuffle: bool, seed: int) -> str:
    """What tells one stream of draws from another: sources with their sizes and weights, strategy, order and seed; not how many draws are taken.

    Sources count in the order of their names, and only those that can be drawn. A weighted strategy has its block's quotas in it.
    """
    live = sorted((name, size, float(weight)) for name, size, weight in sources if size > 0 and weight > 0)
    quotas = ticket_quotas([w for _, _, w in live]) if strategy == "weighted" and live else None
    constants = [BLOCK_TARGET, BLOCK_MOST, WORST_ERROR, PHASE_BLOCKS, RANKS, FEISTEL_ROUNDS, INCREMENT, MULTIPLY_1, MULTIPLY_2, SHUFFLE_SALT, BLOCK_SALT, CYCLE_SALT, TRANSFORM_SALT, OFFSET_SALT]
    return fingerprint(sources=live, strategy=strategy, shuffle=shuffle, seed=seed, quotas=quotas, constants=constants)


def plan_fingerprint(schedule: str, length: int) -> str:
    """A schedule cut to a number of draws."""
    return fingerprint(schedule=schedule, length=length)


def spread_draws(spark: SparkSession, sources: DataFrame, draws: int, block: int) -> DataFrame:
    """The first ``draws`` draws of ``spread``."""
    return spread(spark.range(draws).select(F.col("id").alias("draw_id")), sources, block)


def shuffled_draws(spark: SparkSession, names: list[str], sizes: list[int], weights: list[float], draws: int, seed: int) -> DataFrame:
    """(draw_id, source, row_index): shuffled, rotated blocks; a source's rows all come before one comes again.

    Each draw is computed from its number alone, so any stretch of the stream can be made anywhere.
    """
    quotas = ticket_quotas(weights)
    block = np.array(shuffled_block(quotas, seed))
    n, step = len(block), rotation_step(len(block))
    # rank[i]: how many tickets of its source stand before ticket i
    rank = np.zeros(n, np.int64)
    for i in range(len(quotas)):
        rank[block == i] = np.arange((block == i).sum())
    # tickets by source and place: how many of a source stand before a place is a difference of two positions in this list
    listed = np.sort(block.astype(np.int64) * n + np.arange(n))
    opens = np.concatenate([[0], np.cumsum(quotas)])
    keys = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") for x in names], np.uint64)
    quota, size = np.array(quotas), np.array(sizes)

    def run(frames):
        for frame in frames:
            draw = frame["draw_id"].to_numpy()
            block_id, offset = draw // n, draw % n
            group = (block_id // PHASE_BLOCKS).astype(np.uint64)
            phase = splitmix(np.uint64((seed ^ BLOCK_SALT) & U64) ^ group) % np.uint64(n)
            turn = (phase.astype(np.int64) - step * (block_id % PHASE_BLOCKS)) % n if n > 1 else np.zeros(len(draw), np.int64)
            ticket = (offset + turn) % n
            src = block[ticket]
            passed = np.searchsorted(listed, src.astype(np.int64) * n + turn) - opens[src]
            local = np.where(ticket >= turn, rank[ticket] - passed, quota[src] - passed + rank[ticket])
            seen = block_id * quota[src] + local
            cycle, position = seen // size[src], seen % size[src]
            with np.errstate(over="ignore"):
                key = splitmix(np.uint64(seed & U64) ^ keys[src] ^ (cycle.astype(np.uint64) * np.uint64(CYCLE_SALT)))
            row = np.zeros(len(draw), np.int64)
            for i in np.unique(src):
                pick = src == i
                row[pick] = feistel(position[pick], int(size[i]), key[pick]).astype(np.int64)
            yield pd.DataFrame({"draw_id": draw, "source": np.array(names, object)[src], "row_index": row})

    return spark.range(draws).toDF("draw_id").mapInPandas(run, "draw_id long, source string, row_index long")


@F.pandas_udf(StringType())
def transform_seed(draws: pd.Series, seeds: pd.Series) -> pd.Series:
    """The seed of a draw's random transforms, splitmix64(seed ^ draw ^ salt), as a decimal string."""
    mixed = splitmix(seeds.to_numpy().astype(np.uint64) ^ draws.to_numpy().astype(np.uint64) ^ np.uint64(TRANSFORM_SALT))
    return pd.Series(mixed.astype(str))


def rank_shard(draws: DataFrame, world_size: int, order: str = "draw_id", drop_last: bool = False, total: int | None = None, weighted: bool = False, shuffled: bool = False) -> DataFrame:
    """Adds rank and step: rank r takes draws r, r + world_size, ...; an incomplete last step can be dropped. A weighted and shuffled schedule has a bound on ranks."""
    check_world_size(world_size, weighted, shuffled)
    rows = draws.withColumns({"rank": (F.col(order) % world_size).cast("long"), "step": F.floor(F.col(order) / world_size).cast("long")})
    return rows.filter(F.col(order) < total // world_size * world_size) if drop_last else rows


def check_world_size(world_size: int, weighted: bool, shuffled: bool) -> None:
    if weighted and shuffled and not 1 <= world_size <= RANKS:
        raise ValueError(f"a shuffled weighted schedule is balanced for up to {RANKS} ranks")


def grouped_repeats(draws: DataFrame, chunk: int, repeats: int, mini: int, order: str = "draw_id") -> DataFrame:
    """Each chunk of draws goes out ``repeats`` times in order, each draw ``mini`` times in a row; adds position."""
    rows = draws.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long")))).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mini - 1).cast("long"))))
    base = F.floor(F.col(order) / chunk) * (chunk * repeats * mini) + F.col("r") * (chunk * mini) + (F.col(order) % chunk) * mini + F.col("m")
    return rows.withColumn("position", base.cast("long")).drop("r", "m")
