"""Microbatches of draws under a token cap and budgets of other resources: a bounded buffer, ranks, frames of steps.

An entry is (draw_id, tokens, resource, ...), its resources in the order of their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import fingerprint, splitmix1

Entry = tuple[int, ...]
NODES = 100_000  # placements that the search for full groups looks at


def pack_count_bounds(cardinality: str, local_batch: int) -> tuple[int, int]:
    """How many packs a rank may have: exactly so many, or from one on under a token budget."""
    if local_batch <= 0:
        raise ValueError("the local batch must be positive")
    if cardinality not in ("fixed", "token_budget"):
        raise ValueError(f"unknown cardinality {cardinality!r}")
    return (local_batch if cardinality == "fixed" else 1), local_batch


class Planner:
    """One stream of microbatches: a bounded buffer of draws, of which the oldest is always in the next microbatch.

    The ranks' first draws are the oldest and those nearest to its cost. The others are tried from the heaviest (ties by
    a hash of seed, draw and step, the largest first) and go to the rank whose load stays lowest, then that with the least
    padding, the fewest draws, the lowest number. A rank pays for its longest draw in each place, which must stay within the
    token cap, and for the sum of each other resource, within its budget. Costs are compared as shares of cap and budgets.
    What is left waits in the buffer. State is (buffer, step) only, so a stream can stop and go on anywhere.
    """

    def __init__(self, world_size: int, local_limit: int, max_tokens: int, buffer_size: int, seed: int = 0, cardinality: str = "token_budget", budgets: dict[str, int] | None = None):
        self.least, _ = pack_count_bounds(cardinality, local_limit)
        if buffer_size < world_size * self.least:
            raise ValueError("the buffer cannot hold the draws that all ranks need")
        if max_tokens <= 0 or any(v <= 0 for v in (budgets or {}).values()):
            raise ValueError("the token cap and all budgets must be positive")
        self.world_size, self.local_limit, self.max_tokens, self.buffer_size, self.seed, self.cardinality = world_size, local_limit, max_tokens, buffer_size, seed, cardinality
        self.budgets = dict(sorted((budgets or {}).items()))
        self.caps = tuple(self.budgets.values())

    def fingerprint(self) -> str:
        """A hash of all that a plan depends on but the draws; a state is good for a planner of the same one only."""
        return fingerprint(**{k: getattr(self, k) for k in ("world_size", "local_limit", "max_tokens", "buffer_size", "seed", "cardinality", "budgets")})

    def save(self, buffer: list[Entry], step: int, emitted: int) -> dict:
        """A state to go on from: emitted and buffered draws add up to the next draw."""
        return {"fingerprint": self.fingerprint(), "buffer": [list(e) for e in buffer], "step": step, "emitted": emitted, "next_draw": emitted + len(buffer)}

    def load(self, state: dict) -> tuple[list[Entry], int]:
        """(buffer, step) of a state; raises if it is another planner's, or if draws are missing."""
        if state["fingerprint"] != self.fingerprint():
            raise ValueError("the state was written by a planner of another kind")
        if state["emitted"] + len(state["buffer"]) != state["next_draw"] or len(state["buffer"]) > self.buffer_size:
            raise ValueError("emitted and buffered draws do not add up to the next draw")
        return [tuple(e) for e in state["buffer"]], state["step"]

    def error(self, entry: Entry) -> str | None:
        """Why a draw can be in no microbatch."""
        if len(entry) != 2 + len(self.caps):
            return f"draw {entry[0]} has {len(entry) - 2} resources, not {len(self.caps)}"
        if entry[1] * self.least > self.max_tokens:
            return f"draw {entry[0]} has {entry[1]} tokens, more than a rank may hold ({self.max_tokens // self.least})"
        for (name, cap), value in zip(self.budgets.items(), entry[2:]):
            if value > cap:
                return f"draw {entry[0]} has {value} of {name}, more than a rank may hold ({cap})"
        return None

    def shares(self, tokens: int, resources: Iterable[int]) -> float:
        return tokens / self.max_tokens + sum(v / cap for v, cap in zip(resources, self.caps))

    def distance(self, a: Entry, b: Entry) -> float:
        return self.shares(abs(a[1] - b[1]), (abs(x - y) for x, y in zip(a[2:], b[2:])))

    def plan(self, buffer: list[Entry], step: int) -> tuple[list[list[Entry]], list[Entry]]:
        """(entries of each rank, what stays): ``buffer`` is in the order of draws."""
        oldest = buffer[0]
        near = heapq.nsmallest(self.world_size - 1, buffer[1:], key=lambda e: (self.distance(oldest, e), e[0]))
        ranks = [[e] for e in (oldest, *near)]
        longest, useful, sums = [r[0][1] for r in ranks], [r[0][1] for r in ranks], [list(r[0][2:]) for r in ranks]
        taken = {e[0] for r in ranks for e in r}
        rest = sorted((e for e in buffer if e[0] not in taken), key=lambda e: (self.shares(e[1], e[2:]), splitmix1(self.seed ^ e[0] ^ step)), reverse=True)
        for e in rest:
            best = None
            for i, r in enumerate(ranks):
                padded = max(longest[i], e[1]) * (len(r) + 1)
                held = [x + y for x, y in zip(sums[i], e[2:])]
                if len(r) < self.local_limit and padded <= self.max_tokens and all(x <= cap for x, cap in zip(held, self.caps)):
                    score = (self.shares(padded, held), (padded - useful[i] - e[1]) / self.max_tokens, len(r) + 1, i)
                    best = score if best is None else min(best, score)
            if best is not None:
                i = best[-1]
                ranks[i].append(e)
                longest[i], useful[i], sums[i] = max(longest[i], e[1]), useful[i] + e[1], [x + y for x, y in zip(sums[i], e[2:])]
                taken.add(e[0])
        if any(len(r) < self.local_limit for r in ranks):
            full = self.filled(buffer)
            if full is not None:
                by = {e[0]: e for e in buffer}
                ranks, taken = [[by[d] for d in group] for group in full], {d for group in full for d in group}
        return [sorted(r) for r in ranks], [e for e in buffer if e[0] not in taken]

    def filled(self, buffer: list[Entry]) -> list[list[int]] | None:
        """Full groups for all ranks where the quick way leaves some short; without any a fixed cardinality is an error, a token budget goes on with what it has."""
        found = None
        if len(buffer) >= self.world_size * self.local_limit:
            try:
                found = full_partition(buffer, self.world_size, self.local_limit, self.max_tokens, self.caps)
            except RuntimeError:
                if self.cardinality == "fixed":
                    raise
        if found is None and self.cardinality == "fixed":
            raise ValueError("not every rank can be filled within the token cap and the budgets")
        return found

    def run(self, draws: list[Entry], final: bool, buffer: list | None = None, step: int = 0):
        """Microbatches of a stretch of draws: (rows, buffer, step), a row being (step, rank, slot, draw_id, tokens, resource, ...); at the end
        of the stream the buffer is used up, and the last microbatch may leave ranks short."""
        for entry in draws:
            if (error := self.error(entry)) is not None:
                raise ValueError(error)
        buffer, rows, at = list(buffer or []), [], 0
        while True:
            need = self.buffer_size - len(buffer)
            buffer += draws[at : at + need]
            at = min(at + need, len(draws))
            if not buffer or (not final and len(buffer) < self.buffer_size):
                return rows, buffer, step
            try:
                ranks, buffer = self.plan(buffer, step)
            except ValueError:
                if not final or at < len(draws) or len(buffer) >= self.world_size * self.local_limit:
                    raise
                ranks, buffer = self.last(buffer)
            rows += [(step, r, i, *e) for r, members in enumerate(ranks) for i, e in enumerate(members)]
            step += 1

    def last(self, buffer: list[Entry]) -> tuple[list[list[Entry]], list[Entry]]:
        """The end of a stream of fixed cardinality: fewer draws than all ranks take, dealt out as they fit."""
        ranks: list[list[Entry]] = [[] for _ in range(self.world_size)]
        left = []
        for e in buffer:
            fitting = [i for i, r in enumerate(ranks) if len(r) < self.local_limit and self.fits([*r, e])]
            if fitting:
                ranks[min(fitting, key=lambda i: (len(ranks[i]), i))].append(e)
            else:
                left.append(e)
        return ranks, left

    def fits(self, entries: list[Entry]) -> bool:
        sums = [sum(v) for v in zip(*(e[2:] for e in entries))]
        return len(entries) * max(e[1] for e in entries) <= self.max_tokens and all(x <= cap for x, cap in zip(sums, self.caps))


def full_partition(buffer: list[Entry], world: int, local: int, most: int, caps: tuple[int, ...] = (), nodes: int | None = NODES) -> list[list[int]] | None:
    """Groups of exactly ``local`` draws for all ranks, the oldest draw among them, each padded to its longest within ``most`` and
    summing to ``caps`` at most; None if there are none. Of all such partitions, each with its groups in the order of their
    lowest draw, the one that comes first in the order of draws.

    A group keeps the token cap exactly if each of its draws does in ``local`` places, so without other resources the draws that
    do, in order, are the answer. With some, places are filled one after another: a place takes the next draw that leaves the
    group's least possible rest within the budgets, and steps back where none does. Draws of equal resources can stand for
    each other, so where one of them fails in a place the others need no trial. Raises after ``nodes`` trials, if given.
    """
    usable = sorted(e for e in buffer if e[1] * local <= most and all(v <= cap for v, cap in zip(e[2:], caps)))
    need = world * local
    if len(usable) < need or usable[0][0] != min(e[0] for e in buffer):
        return None
    if not caps:
        return [[e[0] for e in usable[k : k + local]] for k in range(0, need, local)]
    cost = [e[2:] for e in usable]
    # least[m]: what m draws have of each resource at least
    least = [[0] * len(caps)]
    for column in zip(*(sorted(c[r] for c in cost)[:local] for r in range(len(caps)))):
        least.append([a + b for a, b in zip(least[-1], column)])
    chosen: list[int] = []
    tried: list[set[tuple[int, ...]]] = [set()]
    at = [0]
    free = [True] * len(usable)
    trials = 0
    while len(chosen) < need:
        k = len(chosen)
        slot = k % local
        members = chosen[k - slot :]
        sums = [sum(cost[i][r] for i in members) for r in range(len(caps))]
        # draws behind a group's first that all groups from it on take, or behind a later place of it that this group takes
        behind = need - k - 1 if slot == 0 else local - slot - 1
        spare = sum(free[at[k] :]) - behind - 1
        place = None
        for i in range(at[k], len(usable) if k else 1):
            if spare < 0:
                break
            if not free[i]:
                continue
            spare -= 1
            if cost[i] in tried[k]:
                continue
            trials += 1
            if nodes is not None and trials > nodes:
                raise RuntimeError(f"no full groups among {nodes} trials")
            tried[k].add(cost[i])
            if all(s + c + rest <= cap for s, c, rest, cap in zip(sums, cost[i], least[local - slot - 1], caps)):
                place = i
                break
        if place is None:
            at.pop()
            tried.pop()
            if not chosen:
                return None
            free[chosen.pop()] = True
            continue
        at[k] = place + 1
        free[place] = False
        chosen.append(place)
        # the next place looks behind this draw, the next group behind this group's first
        at.append((chosen[k - slot] if slot == local - 1 else place) + 1)
        tried.append(set())
    return [[usable[i][0] for i in chosen[k : k + local]] for k in range(0, need, local)]


def assign_ranks(loads: dict[int, int | tuple[int, ...]], world: int, local: int, most: int | tuple[int, ...], partial: bool = False) -> list[list[int]] | None:
    """Packs dealt to ranks, the heaviest first to the rank with the fewest tokens, stepping back where a cap is broken; None if it cannot be done.

    A pack's load is its tokens, or tokens and other resources; ``most`` has a cap for each, and loads are compared as
    shares of them. A rank takes ``local`` packs, fewer where ``partial``.
    """
    caps = most if isinstance(most, tuple) else (most,)
    cost = {p: v if isinstance(v, tuple) else (v,) for p, v in loads.items()}
    order = sorted(cost, key=lambda p: (-sum(v / cap for v, cap in zip(cost[p], caps)), p))
    if len(order) > world * local or (not partial and len(order) < world * local):
        return None
    held = [(0,) * len(caps) for _ in range(world)]
    ranks: list[list[int]] = [[] for _ in range(world)]

    def options(pack: int) -> list[int]:
        """Ranks that can take a pack, the best last; of ranks that are alike the first."""
        alike: dict[tuple, int] = {}
        for r in sorted(range(world), key=lambda r: (held[r][0], len(ranks[r]), r)):
            if len(ranks[r]) < local and all(a + b <= cap for a, b, cap in zip(held[r], cost[pack], caps)):
                alike.setdefault((len(ranks[r]), held[r]), r)
        return list(alike.values())[::-1]

    open_ranks: list[list[int]] = []
    placed: list[int] = []
    while len(placed) < len(order):
        k = len(placed)
        if len(open_ranks) == k:
            open_ranks.append(options(order[k]))
        if open_ranks[k]:
            r = open_ranks[k].pop()
            ranks[r].append(order[k])
            held[r] = tuple(a + b for a, b in zip(held[r], cost[order[k]]))
            placed.append(r)
            continue
        open_ranks.pop()
        if not placed:
            return None
        r = placed.pop()
        held[r] = tuple(a - b for a, b in zip(held[r], cost[ranks[r].pop()]))
    return ranks


def balanced_frame(steps: list[list[float]], seed: int, first_step: int = 0, firsts: list[list[int]] | None = None) -> tuple[list[list[int]], float]:
    """(for each step which batch each rank takes, skew): the heaviest batch (ties: the one with the lowest draw, of ``firsts``) goes to the rank with the least so far, ties by a hash."""
    world = len(steps[0]) if steps else 0
    total, out = [0.0] * world, []
    for k, loads in enumerate(steps):
        ranks = sorted(range(world), key=lambda r: (total[r], splitmix1(seed ^ (first_step + k) ^ r)))
        batches = sorted(range(world), key=lambda b: (-loads[b], firsts[k][b] if firsts else b))
        taken = [0] * world
        for b, r in zip(batches, ranks):
            taken[r] = b
            total[r] += loads[b]
        out.append(taken)
    mean = sum(total) / max(world, 1)
    return out, max((abs(t - mean) / mean for t in total), default=0.0) if mean > 0 else 0.0


def planned_microbatches(rows: DataFrame, stream: str, planner: Planner, oversize: bool = False) -> DataFrame:
    """(stream, microstep, rank, slot, draw_id, tokens, and a column for each budget): each stream of draws planned by itself.

    ``rows`` holds (stream, draw_id, tokens, and the budgets' resources by name). A stream is sequential by nature; rows of one
    are gone through in order of draw, in one task that holds them: have streams of bounded length. Every draw is in one
    microbatch; the last of a stream may be partly filled. A draw that breaks the cap or a budget by itself is an error, or, with
    ``oversize``, a row without microstep, rank and slot whose column error says why, and the others are planned without it.
    """
    names = list(planner.budgets)
    columns = ["microstep", "rank", "slot", "draw_id", "tokens", *names]

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("draw_id")
        draws = list(zip(*(frame[c].tolist() for c in ("draw_id", "tokens", *names))))
        errors = [planner.error(e) if oversize else None for e in draws]
        found, _, _ = planner.run([e for e, error in zip(draws, errors) if error is None], final=True)
        found = [(*row, None) for row in found] + [(None, None, None, *e, error) for e, error in zip(draws, errors) if error is not None]
        out = pd.DataFrame(found, columns=[*columns, "error"]).astype(dict.fromkeys(columns, "Int64"))
        out.insert(0, stream, frame[stream].iloc[0])
        return out if oversize else out.drop(columns="error")

    shape = ", ".join(f"{c} long" for c in (stream, *columns)) + (", error string" if oversize else "")
    return rows.select(stream, "draw_id", "tokens", *names).groupBy(stream).applyInPandas(plan, shape)


def ranked_packs(rows: DataFrame, step: str, world: int, local: int, most: int, budgets: dict[str, int] | None = None) -> DataFrame:
    """(step, pack_index, tokens, resources, rank): the packs of each step dealt to ranks; rank is null for a step that cannot be dealt within the caps."""
    names, caps = list(budgets or {}), (most, *(budgets or {}).values())

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        loads = dict(zip(frame["pack_index"].tolist(), zip(*(frame[c].tolist() for c in ("tokens", *names)))))
        found = assign_ranks(loads, world, local, caps, partial=True)
        rank = {p: r for r, packs in enumerate(found or []) for p in packs}
        return frame.assign(rank=frame["pack_index"].map(rank)).astype({"rank": "Int64"})

    shape = ", ".join(f"{c} long" for c in (step, "pack_index", "tokens", *names, "rank"))
    return rows.select(step, "pack_index", "tokens", *names).groupBy(step).applyInPandas(deal, shape)


def balanced_frames(planned: DataFrame, stream: str, planner: Planner, frame: int) -> DataFrame:
    """Planned microbatches with their batches dealt anew to ranks, so that over each ``frame`` microsteps all ranks carry alike; adds skew, of the frame.

    Loads are sums over a rank's batch and come from a shuffle; a group is a frame of one stream, with a row for each step and rank.
    Draws that are in no microbatch stay as they are.
    """
    names = list(planner.budgets)
    load = F.max("tokens") * F.count("*") / float(planner.max_tokens)
    for name, cap in planner.budgets.items():
        load = load + F.sum(name) / float(cap)
    batches = planned.filter("microstep IS NOT NULL").groupBy(stream, "microstep", "rank").agg(load.alias("load"), F.min("draw_id").alias("first")).withColumn("frame", F.floor(F.col("microstep") / frame))
    world, seed = planner.world_size, planner.seed

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        steps = sorted(set(group["microstep"]))
        loads = {s: [0.0] * world for s in steps}
        firsts = {s: [1 << 62] * world for s in steps}
        for s, r, x, d in zip(*(group[c].tolist() for c in ("microstep", "rank", "load", "first"))):
            loads[s][r], firsts[s][r] = x, d
        taken, skew = balanced_frame([loads[s] for s in steps], seed, steps[0], [firsts[s] for s in steps])
        out = [(group[stream].iloc[0], s, b, r, skew) for s, batches in zip(steps, taken) for r, b in enumerate(batches)]
        return pd.DataFrame(out, columns=[stream, "microstep", "rank", "new_rank", "skew"])

    dealt = batches.groupBy(stream, "frame").applyInPandas(deal, f"{stream} long, microstep long, rank long, new_rank long, skew double")
    rows = planned.join(dealt, [stream, "microstep", "rank"], "left")
    return rows.select(stream, "microstep", F.col("new_rank").alias("rank"), *[c for c in planned.columns if c not in (stream, "microstep", "rank")], "skew")
