"""Every draw of a stream is in a microbatch, whatever the stream's length; token caps and budgets of other resources."""

import random
from itertools import combinations, product

import pytest

from millrace import queries
from millrace.plans import packing
from millrace.plans.mixing import splitmix1

SF = "/root/testdata/sf0.001"


def test_ends_of_streams():
    plan = packing.Planner(4, 4, 400, 8, 3)
    for n in range(20):
        rows, buffer, _ = plan.run([(i, 1 + i * 37 % 90) for i in range(n)], final=True)
        assert sorted(d for *_, d, _ in rows) == list(range(n)) and buffer == []


def test_planned_microbatches_hold_all_documents(spark):
    want = [r[0] for r in queries.table(spark, SF, "documents").select("doc_id").collect()]
    assert sorted(r["draw_id"] for r in queries.planned_microbatches(spark, SF).collect()) == sorted(want)


def first_partition(buffer, world, local, most, caps):
    """All ways to fill the ranks, in order: the first, or None."""
    def fits(group):
        return local * max(e[1] for e in group) <= most and all(sum(e[2 + r] for e in group) <= cap for r, cap in enumerate(caps))

    def ways(left, groups):
        if len(groups) == world:
            yield groups
            return
        for group in combinations(left, local):
            if (groups or group[0] == left[0]) and (not groups or group[0] > groups[-1][0]) and fits(group):
                yield from ways([e for e in left if e not in group], [*groups, group])

    found = next(ways(sorted(buffer), []), None)
    return found and [[e[0] for e in g] for g in found]


def test_full_groups_by_all_ways():
    rng = random.Random(4)
    some = 0
    for case in range(150):
        caps = ((12, 9), (9,), ())[case % 3]
        buffer = [(d, rng.randint(1, 9), *(rng.randint(0, 6) for _ in caps)) for d in range(8)]
        world, local, most = (2, 3, rng.randint(12, 27)) if case % 2 else (3, 2, rng.randint(10, 18))
        want = first_partition(buffer, world, local, most, caps)
        assert packing.full_partition(buffer, world, local, most, caps) == want, (buffer, world, local, most, caps)
        some += want is not None
    assert 20 < some < 140


def test_full_groups_of_large_buffers():
    """One short draw, many long ones and some short ones: the short ones fit, and are found at once."""
    buffer = [(0, 1)] + [(d, 100) for d in range(1, 200)] + [(d, 1) for d in range(200, 216)]
    assert packing.full_partition(buffer, 4, 4, 40) == [[0, 200, 201, 202], [203, 204, 205, 206], [207, 208, 209, 210], [211, 212, 213, 214]]
    heavy = [(d, 1, 9) for d in range(60)] + [(d, 1, 1) for d in range(60, 75)]
    assert packing.full_partition(heavy, 4, 4, 40, (12,)) == [[0, 60, 61, 62], [1, 63, 64, 65], [2, 66, 67, 68], [3, 69, 70, 71]]
    with pytest.raises(RuntimeError, match="trials"):
        packing.full_partition([(d, 1, 50 + 7 * d % 13) for d in range(40)], 4, 4, 40, (203,), nodes=50)


def by_the_rules(planner, buffer, step):
    """One microbatch by the stated rules, written out with lists."""
    share = lambda e: e[1] / planner.max_tokens + sum(v / c for v, c in zip(e[2:], planner.caps))
    apart = lambda e: abs(e[1] - buffer[0][1]) / planner.max_tokens + sum(abs(v - w) / c for v, w, c in zip(e[2:], buffer[0][2:], planner.caps))
    ranks = [[e] for e in [buffer[0], *sorted(buffer[1:], key=lambda e: (apart(e), e[0]))[: planner.world_size - 1]]]
    rest = [e for e in buffer if [e] not in ranks]
    for e in sorted(rest, key=lambda e: (-share(e), -splitmix1(planner.seed ^ e[0] ^ step))):
        choices = []
        for i, r in enumerate(ranks):
            new = [*r, e]
            padded = len(new) * max(x[1] for x in new)
            if len(new) <= planner.local_limit and planner.fits(new):
                choices.append((padded / planner.max_tokens + sum(sum(x[2 + k] for x in new) / c for k, c in enumerate(planner.caps)), (padded - sum(x[1] for x in new)) / planner.max_tokens, len(new), i))
        if choices:
            ranks[min(choices)[-1]].append(e)
    return [sorted(r) for r in ranks]


def test_microbatches_keep_cap_and_budgets():
    rng = random.Random(8)
    draws = [(d, rng.randint(1, 60), rng.choice([0, 0, rng.randint(1, 40)]), rng.randint(0, 5)) for d in range(400)]
    plan = packing.Planner(4, 4, 200, 24, 5, budgets={"patches": 90, "images": 12})
    assert list(plan.budgets) == ["images", "patches"]
    draws = [(d, t, images, patches) for d, t, patches, images in draws]
    rows, _, steps = plan.run(draws, final=True)
    assert sorted(r[3:] for r in rows) == draws
    for key in {r[:2] for r in rows}:
        mine = [r[3:] for r in rows if r[:2] == key]
        assert plan.fits(mine) and len(mine) <= 4
    buffer, at = [], 0
    for step in range(steps):
        take = 24 - len(buffer)
        buffer, at = buffer + draws[at : at + take], at + take
        ranks, left = plan.plan(buffer, step)
        quick = by_the_rules(plan, buffer, step)
        assert ranks == quick or all(len(r) == 4 for r in ranks)
        assert [e[3:] for e in sorted(rows) if e[0] == step] == [e for r in ranks for e in r]
        buffer = left
    for bad in ((0, 201, 0, 0), (0, 1, 13, 0), (0, 1, 0, 91), (0, 1)):
        with pytest.raises(ValueError, match="draw 0"):
            plan.run([bad], final=True)
    state = plan.save([(4, 7, 1, 2)], 3, 12)
    assert plan.load(state) == ([(4, 7, 1, 2)], 3)
    with pytest.raises(ValueError, match="another kind"):
        packing.Planner(4, 4, 200, 24, 5, budgets={"patches": 91, "images": 12}).load(state)


def test_fixed_cardinality_fills_under_budgets():
    plan = packing.Planner(2, 2, 100, 8, cardinality="fixed", budgets={"patches": 10})
    draws = [(0, 5, 9), (1, 5, 9), (2, 5, 1), (3, 5, 1), (4, 5, 9), (5, 5, 1), (6, 5, 9), (7, 5, 1)]
    rows, buffer, steps = plan.run(draws, final=True)
    assert steps == 2 and not buffer and all(sum(r[5] for r in rows if r[:2] == key) == 10 for key in {r[:2] for r in rows})
    rows, buffer, steps = plan.run(draws[:3], final=True)
    assert not buffer and sorted(r[3] for r in rows) == [0, 1, 2]


def test_ranks_under_two_budgets_by_all_ways():
    rng = random.Random(2)
    some = 0
    for _ in range(80):
        loads = {k: (rng.randint(1, 9), rng.randint(0, 9)) for k in range(6)}
        caps = (rng.randint(12, 20), rng.randint(10, 18))
        ok = lambda ranks: all(ranks.count(r) == 2 and all(sum(loads[k][c] for k in range(6) if ranks[k] == r) <= caps[c] for c in (0, 1)) for r in range(3))
        ways = any(map(ok, product(range(3), repeat=6)))
        got = packing.assign_ranks(loads, 3, 2, caps)
        assert (got is not None) == ways
        assert got is None or ok([next(r for r in range(3) if k in got[r]) for k in range(6)])
        some += ways
    assert 10 < some < 80


def test_best_fit_under_a_budget():
    """A draw that breaks the budget with the longest ones opens no pack; it is left where it fits nowhere."""
    patches = {0: 5, 1: 6, 2: 1, 3: 6, 4: 0}
    feasible = lambda packs: sum(patches[d] for p in packs for d in p) <= 12
    assert packing.best_fit([0, 1, 2, 3, 4], [3, 9, 8, 7, 2], 2, 12, 0, feasible) == [[0, 2], [1, 4]]
    with pytest.raises(ValueError, match="opened"):
        packing.best_fit([0, 1, 3], [3, 9, 7], 3, 12, 0, feasible)


def test_frames_are_balanced(spark):
    plan = packing.Planner(2, 2, 100, 6, 1, budgets={"patches": 50})
    rows = spark.createDataFrame([(s, d, 5 + (d * 37 + s) % 40, d * 11 % 20) for s in range(3) for d in range(40)], "stream long, draw_id long, tokens long, patches long")
    planned = packing.planned_microbatches(rows, "stream", plan).cache()
    got = packing.balanced_frames(planned, "stream", plan, 4).collect()
    load = {}
    before = {}
    for r in planned.collect():
        before.setdefault((r["stream"], r["microstep"], r["rank"]), []).append(r)
    for r in got:
        load.setdefault((r["stream"], r["microstep"], r["rank"]), []).append(r)
    assert sorted((r["stream"], r["microstep"], r["draw_id"]) for r in got) == sorted((r["stream"], r["microstep"], r["draw_id"]) for r in planned.collect())
    of = lambda rs: len(rs) * max(r["tokens"] for r in rs) / 100 + sum(r["patches"] for r in rs) / 50
    for s in range(3):
        for f in range(1 + max(k[1] for k in load if k[0] == s) // 4):
            steps = range(4 * f, 4 * f + 4)
            sums = [sum(of(load[s, k, r]) for k in steps if (s, k, r) in load) for r in (0, 1)]
            skew = max(abs(x - sum(sums) / 2) / (sum(sums) / 2) for x in sums)
            assert {round(r["skew"], 9) for k in steps for q in (0, 1) for r in load.get((s, k, q), [])} == {round(skew, 9)}


def test_queries_under_budgets(spark):
    """Every document is in a microbatch once; caps hold; the frames keep the microbatches and only deal them anew; ranks keep both caps."""
    from millrace import planning_queries as P

    want = {r["draw_id"]: (r["tokens"], r["vision_patches"]) for r in P.costed_draws(spark, SF).collect()}
    rows = P.budgeted_microbatches(spark, SF).collect()
    assert {r["draw_id"]: (r["tokens"], r["vision_patches"]) for r in rows} == want and len(rows) == len(want)
    entries = sorted((d, *c) for d, c in want.items())
    assert sorted((r["microstep"], r["rank"], r["slot"], r["draw_id"]) for r in rows) == sorted(r[:4] for r in P.BUDGETED.run(entries, final=True)[0])
    batch = lambda rs: {k: sorted(r["draw_id"] for r in rs if (r["microstep"], r["rank"]) == k) for k in {(r["microstep"], r["rank"]) for r in rs}}
    framed = batch(P.balanced_frames(spark, SF).collect())
    before = batch(rows)
    for step in {s for s, _ in before}:
        assert sorted(v for k, v in framed.items() if k[0] == step) == sorted(v for k, v in before.items() if k[0] == step)
    held = {}
    for r in P.budgeted_ranks(spark, SF).collect():
        if r["rank"] is not None:
            t, p, n = held.get((r["step"], r["rank"]), (0, 0, 0))
            held[r["step"], r["rank"]] = (t + r["tokens"], p + r["vision_patches"], n + 1)
    assert held and all(t <= 65_536 and p <= 9_000 and n <= 3 for t, p, n in held.values())


def test_streamed_query_equals_one_run(spark):
    from millrace import planning_queries as P

    rows = P.streamed_microbatches(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    entries = sorted((r["draw_id"], r["tokens"]) for r in rows)
    assert [d for d, _ in entries] == list(range(n))
    assert sorted(tuple(r[c] for c in ("microstep", "rank", "slot", "draw_id", "tokens")) for r in rows) == sorted(queries.PLANNER.run(entries, final=True)[0])


def test_oversize_draws_are_kept_without_a_place(spark):
    plan = packing.Planner(2, 2, 100, 6, 1, budgets={"patches": 50})
    rows = spark.createDataFrame([(s, d, 101 if d == 3 else 5 + d, 51 if d == 7 else d) for s in range(2) for d in range(12)], "stream long, draw_id long, tokens long, patches long")
    planned = packing.planned_microbatches(rows, "stream", plan, oversize=True).cache()
    for got in (planned.collect(), packing.balanced_frames(planned, "stream", plan, 4).collect()):
        assert sorted((r["stream"], r["draw_id"]) for r in got) == [(s, d) for s in range(2) for d in range(12)]
        assert {(r["draw_id"], r["error"]) for r in got if r["microstep"] is None} == {(3, "draw 3 has 101 tokens, more than a rank may hold (100)"), (7, "draw 7 has 51 of patches, more than a rank may hold (50)")}
        assert all((r["microstep"] is None) == (r["rank"] is None) == (r["slot"] is None) == (r["error"] is not None) for r in got)
    want, _, _ = plan.run([(d, 5 + d, d) for d in range(12) if d not in (3, 7)], final=True)
    assert sorted(tuple(r[c] for c in ("microstep", "rank", "slot", "draw_id", "tokens", "patches")) for r in planned.filter("stream = 0 AND error IS NULL").collect()) == sorted(want)
