"""The stream of draws: killed after any micro-batch it goes on to the same microbatches, none lost, the last draws out."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.plans.planner import Planner
from millrace.streaming import draws

LENGTH, PER_BATCH, PER_STREAM = 230, 60, 100
PLAN = Planner(2, 3, 120, 12, 7, budgets={"patches": 40})


def costed(rows):
    d = F.col("draw_id")
    return rows.select(F.floor(d / PER_STREAM).alias("stream"), "draw_id", (1 + d * 37 % 40).alias("tokens"), (d * 11 % 20).alias("patches"))


def want():
    out = []
    for s in range(3):
        entries = [(d, 1 + d * 37 % 40, d * 11 % 20) for d in range(s * PER_STREAM, min(LENGTH, (s + 1) * PER_STREAM))]
        out += [(s, *r) for r in PLAN.run(entries, final=True)[0]]
    return sorted(out)


def stream(spark):
    return draws.planned(costed(draws.draws(spark, LENGTH, PER_BATCH, partitions=3)), "stream", PLAN, ends=LENGTH, per_stream=PER_STREAM)


def one_batch(log, rows):
    """One micro-batch in a query of its own; a failure in it comes out."""
    log.start(rows, availableNow=True).awaitTermination(120)


def rows_of(log):
    return sorted(tuple(r) for r in log.planned().select("stream", "microstep", "rank", "slot", "draw_id", "tokens", "patches").collect())


@pytest.mark.parametrize("killed", [0, 1, 3])
def test_restart_after_any_batch(spark, tmp_path, killed):
    """Each micro-batch is a query of its own, so every one goes on from what stands on disk; one is killed when its rows are written."""
    class Killed(draws.PlanLog):
        def write(self, batch, batch_id):
            super().write(batch, batch_id)
            if batch_id == killed and not self.died:
                self.died = True
                raise RuntimeError("killed")

    log = Killed(spark, str(tmp_path / "plan"))
    log.died = False
    for k in range(4):
        if k == killed:
            with pytest.raises(Exception, match="killed"):
                one_batch(log, stream(spark))
        one_batch(log, stream(spark))
    assert rows_of(log) == want()
    one_batch(log, stream(spark))
    assert rows_of(log) == want()


def test_one_query_for_all_batches(spark, tmp_path):
    log = draws.PlanLog(spark, str(tmp_path / "plan"))
    query = log.start(stream(spark), processingTime="0 seconds")
    began = time.time()
    while time.time() - began < 120 and sum(p["numInputRows"] for p in query.recentProgress) < LENGTH:
        time.sleep(0.5)
    query.processAllAvailable()
    query.stop()
    assert rows_of(log) == want()


def test_two_cursors(spark, tmp_path):
    """What is planned runs ahead of what is done; a restart goes on with the rest; no step back, none beyond the plan."""
    log = draws.PlanLog(spark, str(tmp_path / "plan"))
    one_batch(log, stream(spark))
    one_batch(log, stream(spark))
    at = {r["stream"]: r for r in log.cursors().collect()}
    assert at[0]["done_step"] == at[0]["done_draws"] == 0 and at[0]["planned_draws"] == 100 and at[1]["planned_draws"] < 20
    log.commit(0, 3)
    again = draws.PlanLog(spark, str(tmp_path / "plan"))
    first = [r for r in want() if r[0] == 0 and r[1] < 3]
    at = {r["stream"]: r for r in again.cursors().collect()}
    assert (at[0]["done_step"], at[0]["done_draws"], at[0]["planned_draws"]) == (3, len(first), 100)
    assert min(r["microstep"] for r in again.pending().filter("stream = 0").collect()) == 3
    assert again.pending().count() + len(first) == len(rows_of(again))
    for step, why in ((2, "lies before"), (10_000, "not planned")):
        with pytest.raises(ValueError, match=why):
            again.commit(0, step)
    with pytest.raises(ValueError, match="not planned"):
        again.commit(9, 1)
    again.commit(0, 3)
    one_batch(again, stream(spark))
    again.commit(1, 2)
    assert {r["stream"]: r["microstep"] for r in again.done().collect()} == {0: 3, 1: 2}


def test_end_by_timer(spark, tmp_path):
    """A stream whose end is not known ends when no draws have come for a while."""
    log = draws.PlanLog(spark, str(tmp_path / "plan"))
    rows = draws.planned(costed(draws.draws(spark, 50, 50)), "stream", PLAN, idle_ms=1500)
    query = log.start(rows, processingTime="500 milliseconds")
    began = time.time()
    while time.time() - began < 90:
        time.sleep(1)
        if query.recentProgress and log.exists("planned") and log.planned().count() == 50:
            break
    query.stop()
    entries = [(d, 1 + d * 37 % 40, d * 11 % 20) for d in range(50)]
    assert rows_of(log) == sorted((0, *r) for r in PLAN.run(entries, final=True)[0])


def test_reader_and_its_options(spark):
    reader = draws.DrawReader(10, 100, 40, 4)
    assert reader.initialOffset() == {"draw": 10} and reader.latestOffset() == {"draw": 50} and reader.latestOffset() == {"draw": 90} and reader.latestOffset() == {"draw": 100}
    parts = reader.partitions({"draw": 50}, {"draw": 57})
    assert [x for p in parts for (x,) in reader.read(p)] == list(range(50, 57)) and len(parts) == 4
    later = draws.DrawReader(10, 100, 40, 4)
    later.partitions({"draw": 50}, {"draw": 90})
    assert later.latestOffset() == {"draw": 100}
    assert draws.DrawReader(0, 0, 5, 2).partitions({"draw": 0}, {"draw": 0})
    for bad in ((0, 10, 0, 1), (0, 10, 1, 0), (11, 10, 1, 1)):
        with pytest.raises(ValueError):
            draws.DrawReader(*bad)


def test_a_state_of_another_planner_is_refused(spark, tmp_path):
    log = draws.PlanLog(spark, str(tmp_path / "plan"))
    one_batch(log, stream(spark))
    other = Planner(2, 3, 121, 12, 7, budgets={"patches": 40})
    rows = draws.planned(costed(draws.draws(spark, LENGTH, PER_BATCH, partitions=3)), "stream", other, ends=LENGTH, per_stream=PER_STREAM)
    with pytest.raises(Exception, match="another kind"):
        one_batch(log, rows)
