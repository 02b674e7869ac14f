"""A stream of draws by number, planned into microbatches by one stateful operator, with a log of what is planned and what is done.

The offset of the source is the number of the next draw, so a restart knows where it stands. The planner's buffer is Spark's
state. Two cursors are kept apart: how far microbatches are planned, which runs ahead, and how far they are done, which only moves
when the one who works them off says so.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.planner import Planner

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stretch(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class DrawReader(DataSourceStreamReader):
    """Draws ``first`` to ``length``, ``per_batch`` at a time, in ``partitions`` stretches."""

    def __init__(self, first: int, length: int, per_batch: int, partitions: int):
        if per_batch <= 0 or partitions <= 0 or not 0 <= first <= length:
            raise ValueError("per_batch and partitions must be positive, first within the length")
        self.first, self.length, self.per_batch, self.parts, self.at = first, length, per_batch, partitions, None

    def initialOffset(self) -> dict:
        return {"draw": self.first}

    def latestOffset(self) -> dict:
        self.at = min((self.first if self.at is None else self.at) + self.per_batch, self.length)
        return {"draw": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a restart asks for its last batch before anything else, and so tells where it was
        self.at = max(end["draw"], self.first if self.at is None else self.at)
        first, n = start["draw"], end["draw"] - start["draw"]
        parts = max(1, min(self.parts, n))
        cuts = [first + n * k // parts for k in range(parts + 1)]
        return [Stretch(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Stretch):
        for draw in range(partition.first, partition.end):
            yield (draw,)


class Draws(DataSource):
    """spark.readStream.format("draws").option("length", n).option("per_batch", m): one column, draw_id."""

    @classmethod
    def name(cls) -> str:
        return "draws"

    def schema(self) -> str:
        return "draw_id long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        number = lambda key, default: int(self.options.get(key, default))
        length = self.options.get("length")
        if length is None:
            raise ValueError("the option length says how many draws there are")
        return DrawReader(number("first", 0), int(length), number("per_batch", 65_536), number("partitions", 8))


def draws(spark: SparkSession, length: int, per_batch: int, first: int = 0, partitions: int = 8) -> DataFrame:
    """(draw_id): a stream of the draws from ``first`` to ``length``, ``per_batch`` in a micro-batch."""
    spark.dataSource.register(Draws)
    options = {"length": length, "per_batch": per_batch, "first": first, "partitions": partitions}
    return spark.readStream.format("draws").options(**{k: str(v) for k, v in options.items()}).load()


class PlanState(StatefulProcessor):
    """Microbatches of one stream. The state is the planner's, as JSON, checked against the planner whenever it is read.

    ``ends`` says after how many draws a stream ends: its buffer is used up in the micro-batch that brings the last of them.
    Where the end is not known, a stream that has had no draws for ``idle_ms`` ends by a timer; draws that come later
    begin with an empty buffer and the next microstep.
    """

    def __init__(self, planner: Planner, stream: str, ends: int | None, first: int, per_stream: int, idle_ms: int | None):
        self.planner, self.stream, self.ends, self.first, self.per_stream, self.idle_ms = planner, stream, ends, first, per_stream, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("plan", "saved string, seen bigint")

    def rows(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["microstep", "rank", "slot", "draw_id", "tokens", *self.planner.budgets]).astype("int64")
        out.insert(0, self.stream, key[0])
        return out

    def current(self) -> tuple[list[tuple], int, int, int]:
        """(buffer, step, emitted, last draw seen)"""
        if not self.state.exists():
            return [], 0, 0, -1
        saved, seen = self.state.get()
        plan = json.loads(saved)
        buffer, step = self.planner.load(plan)
        return buffer, step, plan["emitted"], seen

    def keep(self, buffer: list[tuple], step: int, emitted: int, seen: int) -> None:
        self.state.update((json.dumps(self.planner.save(buffer, step, emitted)), seen))

    def end_of(self, key: tuple) -> int | None:
        return None if self.ends is None else min(self.ends, self.first + (int(key[0]) + 1) * self.per_stream)

    def handleInputRows(self, key, rows, timerValues):
        buffer, step, emitted, seen = self.current()
        new = pd.concat(list(rows)).sort_values("draw_id")
        entries = list(zip(*(new[c].tolist() for c in ("draw_id", "tokens", *self.planner.budgets))))
        if entries[0][0] <= seen:
            raise ValueError(f"draw {entries[0][0]} of stream {key[0]} comes after draw {seen}")
        seen = entries[-1][0]
        found, buffer, step = self.planner.run(entries, final=self.end_of(key) == seen + 1, buffer=buffer, step=step)
        self.keep(buffer, step, emitted + len(found), seen)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        buffer, step, emitted, seen = self.current()
        found, buffer, step = self.planner.run([], final=True, buffer=buffer, step=step)
        self.keep(buffer, step, emitted + len(found), seen)
        yield self.rows(key, found)

    def close(self) -> None:
        pass


def planned(rows: DataFrame, stream: str, planner: Planner, ends: int | None = None, first: int = 0, per_stream: int = 1 << 62, idle_ms: int | None = None) -> DataFrame:
    """(stream, microstep, rank, slot, draw_id, tokens, budgets): the microbatches of a streaming DataFrame of draws, as its micro-batches come.

    ``rows`` holds (stream, draw_id, tokens, the budgets' resources); the draws of a stream come in order from one micro-batch to the
    next. Stream s has the draws from first + s * per_stream on, ``per_stream`` of them, and all end with draw ``ends``.
    """
    names = list(planner.budgets)
    shape = ", ".join(f"{c} long" for c in (stream, "microstep", "rank", "slot", "draw_id", "tokens", *names))
    state = PlanState(planner, stream, ends, first, per_stream, idle_ms)
    return rows.select(stream, "draw_id", "tokens", *names).groupBy(stream).transformWithStateInPandas(state, shape, "Append", "None" if idle_ms is None else "ProcessingTime")


class PlanLog:
    """Planned microbatches under a path, and how far each stream's are done.

    A micro-batch writes a folder of its own, so that one that is run again after a failure replaces what it wrote before.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str = "stream"):
        self.spark, self.path, self.stream = spark, path.rstrip("/"), stream

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/planned/batch={batch_id}")

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        """Begin, or go on, to plan the microbatches ``rows``; its state and offsets stand beside the log."""
        before = self.spark.conf.get(STORE, None)
        self.spark.conf.set(STORE, ROCKS)
        try:
            return rows.writeStream.option("checkpointLocation", f"{self.path}/state").outputMode("append").foreachBatch(self.write).trigger(**trigger).start()
        finally:
            self.spark.conf.unset(STORE) if before is None else self.spark.conf.set(STORE, before)

    def planned(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/planned").drop("batch")

    def done(self) -> DataFrame:
        """(stream, microstep): up to which microstep, not included, each stream is done."""
        shape = f"{self.stream} long, microstep long"
        found = self.spark.read.schema(shape).json(f"{self.path}/done") if self.exists("done") else self.spark.createDataFrame([], shape)
        return found.groupBy(self.stream).agg(F.max("microstep").alias("microstep"))

    def exists(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def cursors(self) -> DataFrame:
        """(stream, planned_step, planned_draws, done_step, done_draws): the two cursors of each stream, in microsteps and draws."""
        rows = self.planned().join(self.done().withColumnRenamed("microstep", "done_step"), self.stream, "left").na.fill({"done_step": 0})
        over = F.col("microstep") < F.col("done_step")
        return rows.groupBy(self.stream).agg((F.max("microstep") + 1).alias("planned_step"), F.count("*").alias("planned_draws"), F.max("done_step").alias("done_step"), F.count_if(over).alias("done_draws"))

    def pending(self) -> DataFrame:
        """Planned microbatches that are not done: those to go on with after a failure."""
        rows = self.planned().join(self.done().withColumnRenamed("microstep", "_done"), self.stream, "left")
        return rows.filter(F.col("microstep") >= F.coalesce("_done", F.lit(0))).drop("_done")

    def commit(self, stream: int, microstep: int) -> None:
        """Say that the microsteps of a stream before ``microstep`` are done; never backwards, never beyond what is planned."""
        at = self.cursors().filter(F.col(self.stream) == stream).first()
        if at is None or microstep > at["planned_step"]:
            raise ValueError(f"microstep {microstep} of stream {stream} is not planned")
        if microstep < at["done_step"]:
            raise ValueError(f"microstep {microstep} of stream {stream} lies before {at['done_step']}, which is done")
        self.spark.createDataFrame([(stream, microstep)], f"{self.stream} long, microstep long").write.mode("append").json(f"{self.path}/done")
