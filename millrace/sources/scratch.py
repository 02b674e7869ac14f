"""Tables that a job of several rounds writes between them, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def folder_of_one_machine(application: str) -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or folder_of_one_machine(spark.sparkContext.applicationId)).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """Tables of one job: each is written and read back, and goes once a later one of its name stands.

    A lost executor costs a reread of the last table, not the rounds before it. What a lazy result still reads has to be kept.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.paths = spark, job, {}

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/millrace-{self.job}-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        before, self.paths[name] = self.paths.get(name), path
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, *kept: str) -> None:
        """Delete all tables but those ``kept``."""
        for name in set(self.paths) - set(kept):
            remove(self.spark, self.paths.pop(name))


@contextmanager
def rounds(spark: SparkSession, job: str, *kept: str) -> Iterator[Rounds]:
    tables = Rounds(spark, job)
    try:
        yield tables
    finally:
        tables.close(*kept)
