"""States of metrics over parts and streams, efficiency of small runs by hand, divergences over chunks of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import divergence as D
from millrace.operators import efficiency as E
from millrace.operators.metric_states import Metrics, StateLog, step_parts

SHAPE = "dataset string, rank long, valid boolean, partial boolean, parsed string, target string, loss double, tokens long, score double"
WANTED = {"parse_success": ("parse_success", {}), "parse_partial_rate": ("parse_partial_rate", {}), "exact_match": ("exact_match", {}), "loss": ("weighted_mean", {}), "score": ("mean", {})}


def samples(n=200):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        valid, partial = bool(rng.random() < 0.8), bool(rng.random() < 0.3)
        out.append(("abc"[i % 3], i % 4, valid, partial, None if i % 11 == 0 else str(rng.integers(3)), str(rng.integers(3)), None if i % 17 == 0 else float(rng.random()), int(rng.integers(0, 50)), float(rng.random())))
    return out


def by_hand(rows):
    out = {}
    for name in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == name]
        both = [(r[6], r[7]) for r in mine if r[6] is not None]
        mean = lambda f: sum(f(r) for r in mine) / len(mine)
        out[name] = (mean(lambda r: r[2] and not r[3]), mean(lambda r: r[2] and r[3]), mean(lambda r: bool(r[2] and r[4] == r[5] and r[4] is not None)), sum(a * b for a, b in both) / sum(b for _, b in both), mean(lambda r: r[8]))
    return out


def found(df):
    return {r["dataset"]: tuple(r[k] for k in WANTED) for r in df.collect()}


def test_states_add_up_in_any_order(spark):
    rows, metrics = samples(), Metrics(WANTED)
    want = by_hand(rows)
    whole = spark.createDataFrame(rows, SHAPE)
    assert {k: pytest.approx(v) for k, v in want.items()} == found(metrics.compute(metrics.update(whole, "dataset")))
    parts = [metrics.update(spark.createDataFrame(rows[a:b], SHAPE), "dataset", "rank") for a, b in ((150, 200), (0, 7), (7, 150))]
    states = metrics.empty(spark, "dataset string, rank long")
    for p in parts:
        states = metrics.merge(states.unionByName(p), "dataset", "rank")
    assert {k: pytest.approx(v) for k, v in want.items()} == found(metrics.compute(metrics.merge(states, "dataset")))
    one = metrics.compute(metrics.merge(states)).first()
    assert one["parse_success"] == pytest.approx(sum(r[2] and not r[3] for r in rows) / len(rows))
    none = metrics.compute(metrics.update(whole.filter("false")))
    assert none.first()[:] == (0.0,) * 5 and metrics.compute(metrics.empty(spark, "dataset string")).count() == 0


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows, metrics = samples(), Metrics(WANTED)

    class Died(StateLog):
        failed = False

        def write(self, batch, batch_id):
            super().write(batch, batch_id)
            if batch_id == 1 and not self.failed:
                self.failed = True
                raise RuntimeError("died")

    log = Died(metrics, str(tmp_path / "log"), "dataset", "rank")
    for k, (a, b) in enumerate(((0, 60), (60, 61), (61, 200))):
        spark.createDataFrame(rows[a:b], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        if k == 1:
            with pytest.raises(Exception, match="died"):
                log.start(stream, availableNow=True).awaitTermination(120)
        log.start(stream, availableNow=True).awaitTermination(120)
    assert {k: pytest.approx(v) for k, v in by_hand(rows).items()} == found(log.result(spark, "dataset"))


def test_shares_of_a_step_sum_to_its_mean(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1.0, 10), (0, 1, 0, 3.0, 1), (0, 1, 1, None, 5), (1, 0, 0, 2.0, 0), (1, 1, 0, 2.0, None)], "step long, rank long, part long, loss double, tokens long")
    got = step_parts(rows, "step", ["rank", "part"], "loss", "tokens").collect()
    first = [r for r in got if r["step"] == 0]
    assert sum(r["share"] for r in first) == pytest.approx(13 / 11) and {r["denominator"] for r in first} == {11.0} and len(first) == 3
    assert all(r["share"] == 0 for r in got if r["step"] == 1)


def frame(step, rank, acquire, device, run="r", tokens=10, **other):
    base = dict(run=run, step=step, rank=rank, segments=2, packs=1, useful_tokens=tokens, materialized_tokens=20, supervised_tokens=5, length_sum=tokens, length_square_sum=tokens * tokens // 2, vision_patches=4, supervision_microbatches=1, vision_microbatches=2, microbatches=2,
                supervision_mass=None, acquire_seconds=acquire, prepare_seconds=0.5, step_seconds=1.0, optimizer_seconds=0.25, device_seconds=device, update_applied=True)
    return base | other


FRAME = "run string, step long, rank long, " + ", ".join(f"{c} long" for c in E.COUNTS) + ", supervision_mass double, " + ", ".join(f"{t} double" for t in E.TIMES) + ", update_applied boolean"


def frames(spark, rows):
    names = [x.split()[0] for x in FRAME.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], FRAME)


def test_summary_of_two_ranks(spark):
    """Counts of both ranks, the seconds of the slower one; a tie goes to rank 0; steps of one rank only are seen."""
    rows = [frame(1, 0, 1.0, None), frame(1, 1, 2.0, None, tokens=12), frame(2, 0, 1.0, 3.0), frame(2, 1, 1.0, 3.0, update_applied=False), frame(3, 0, 0.5, None), frame(3, 1, 0.25, 0.5)]
    out = E.summary(frames(spark, rows), ["run"]).first()
    critical = [2.0 + 0.5 + 1.25, 1.0 + 0.5 + 3.0, 0.5 + 0.5 + 1.25]
    assert (out["first_step"], out["last_step"], out["steps"], out["contiguous"]) == (1, 3, 3, True)
    assert out["useful_tokens"] == 62 and out["segments"] == 12 and out["device_seconds"] == 3.0 and out["device_steps"] == 1 and out["update_applied_steps"] == 3
    assert out["critical_seconds"] == pytest.approx(sum(critical)) and out["p50_seconds"] == pytest.approx(np.median(critical)) and out["p95_seconds"] == pytest.approx(np.percentile(critical, 95))
    assert out["segments_per_pack"] == 2.0 and out["supervision_fraction"] == pytest.approx(30 / 62) and out["vision_coverage"] == 1.0 and out["supervision_coverage"] == 0.5
    each = [1.0 + 0.5 + 1.25 + 4.5 + 2.25, 3.75 + 4.5 + 1.25]
    assert out["rank_skew"] == pytest.approx((max(each) - min(each)) / (sum(each) / 2)) and out["ranks_agree"] and out["world"] == 2
    assert out["mean_length"] == pytest.approx(62 / 12) and out["std_length"] == pytest.approx(math.sqrt(max(0.0, (5 * 50 + 72) / 12 - (62 / 12) ** 2)))
    gap = E.summary(frames(spark, [frame(1, 0, 1.0, None), frame(3, 0, 1.0, None), frame(3, 1, 1.0, None)]), ["run"]).first()
    assert not gap["contiguous"] and not gap["ranks_agree"]
    assert E.summary(frames(spark, rows).filter("false"), ["run"]).count() == 0


def test_frame_errors(spark):
    nan = float("nan")
    rows = [frame(1, 0, 1.0, None), frame(0, 0, 1.0, None), frame(1, 0, 1.0, None, packs=0), frame(1, 0, 1.0, None, tokens=21), frame(1, 0, 1.0, None, supervised_tokens=11), frame(1, 0, 1.0, None, vision_microbatches=3),
            frame(1, 0, -1.0, None), frame(1, 0, 1.0, nan), frame(1, 0, 1.0, 0.0), frame(1, 0, 1.0, None, vision_patches=-1)]
    got = [r["e"] for r in frames(spark, rows).coalesce(1).select(E.frame_errors().alias("e")).collect()]
    assert got == [None, "step", "empty", "more useful than materialized tokens", "more supervised than useful tokens", "more covered than all microbatches", "seconds", "seconds", None, "negative count"]


@pytest.mark.parametrize("size", [1, 3, 8, 40])
def test_divergences_by_chunks(spark, size):
    """The same whatever the size of the chunks and their order, for logits of hundreds too."""
    rng = np.random.default_rng(5)
    positions = [(rng.normal(0, s, 24), rng.normal(0, s, 24)) for s in (0.1, 1, 30, 400)] + [(np.full(24, -700.0), np.full(24, 700.0))]
    rows = [(i, k, [float(x) for x in s[k : k + size]], [float(x) for x in t[k : k + size]]) for i, (s, t) in enumerate(positions) for k in range(0, 24, size)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame([(int(i), a, b) for i, _, a, b in rows], "i long, s array<double>, t array<double>").repartition(3)
    out = D.chunked_divergences(chunks, ["i"], "s", "t", 1.5)
    got = {r["i"]: (r["reverse_kl"], r["forward_kl"], r["jsd"]) for r in out.collect()}
    for i, (s, t) in enumerate(positions):
        p, q = (v / 1.5 - np.logaddexp.reduce(v / 1.5) for v in (s, t))
        m = np.logaddexp(p, q) - np.log(2)
        want = ((np.exp(p) * (p - q)).sum(), (np.exp(q) * (q - p)).sum(), ((np.exp(p) * (p - m)).sum() + (np.exp(q) * (q - m)).sum()) / 2)
        assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-9), i
    sums = D.objective_sums(out.withColumn("g", F.lit(1)), ["g"], "jsd", 1.5).first()
    assert sums["denominator"] == 5 and sums["loss"] == pytest.approx(sum(v[2] for v in got.values()) * 2.25 / 5)
