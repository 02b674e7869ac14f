"""Rows by their place in a dataset: a table that is written once in parts of so many places each, of which a lookup reads those it needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PART = "_part"
NAMED = 1000  # parts that a lookup names one by one in its filter; beyond that they are joined


class OrdinalIndex:
    """Rows with row_index, their place within their dataset, under a path: a folder for each dataset and part.

    Datasets are named by the columns ``keys``, of which there are as many values as folders: names of sources, not ids.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], per_part: int):
        if per_part <= 0:
            raise ValueError("a part holds one row at least")
        self.spark, self.path, self.keys, self.per_part = spark, path.rstrip("/"), keys, per_part

    def write(self, numbered: DataFrame) -> None:
        """Write ``numbered`` (with row_index), each part in order in one file, and how many rows each part has."""
        rows = numbered.withColumn(PART, F.floor(F.col("row_index") / self.per_part))
        rows = rows.repartition(*self.keys, PART).sortWithinPartitions(*self.keys, PART, "row_index")
        rows.write.mode("overwrite").partitionBy(*self.keys, PART).parquet(f"{self.path}/rows")
        self.read().groupBy(*self.keys, PART).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts")

    def read(self) -> DataFrame:
        """All rows; the datasets' names are text, whatever they look like."""
        stored = self.spark.read.parquet(f"{self.path}/rows").schema
        text = [StructField(k, StringType()) for k in self.keys]
        return self.spark.read.schema(StructType([*(f for f in stored if f.name not in (*self.keys, PART)), *text, StructField(PART, LongType())])).parquet(f"{self.path}/rows")

    def parts(self, wanted: DataFrame) -> Column | None:
        """A filter that names the parts of some places, if these are few enough; Spark lists no other folders' files."""
        named = wanted.select(*self.keys, PART).distinct().limit(NAMED + 1).collect()
        if len(named) > NAMED:
            return None
        by: dict[tuple, list[int]] = {}
        for r in named:
            by.setdefault(tuple(r[k] for k in self.keys), []).append(r[PART])
        each = [reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(v) for k, v in zip(self.keys, values)), F.col(PART).isin(parts)) for values, parts in sorted(by.items(), key=repr)]
        return reduce(lambda a, b: a | b, each, F.lit(False))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows at places (keys, row_index), as often as these are asked for; a place without a row gives none."""
        wanted = wanted.select(*(F.col(k).cast("string").alias(k) for k in self.keys), "row_index").withColumn(PART, F.floor(F.col("row_index") / self.per_part))
        named, rows = self.parts(wanted), self.read()
        rows = rows if named is None else rows.filter(named)
        return wanted.join(rows, [*self.keys, PART, "row_index"]).drop(PART)

    def slice(self, dataset: dict[str, str], start: int, stop: int) -> DataFrame:
        """The rows of a dataset from place ``start`` up to ``stop``."""
        inside = F.col("row_index").between(start, stop - 1) & F.col(PART).between(start // self.per_part, (stop - 1) // self.per_part)
        return self.read().filter(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(dataset[k]) for k in self.keys), inside)).drop(PART)

    def sizes(self) -> DataFrame:
        """(keys, n): how many rows each dataset has, from the counts of the parts."""
        return self.spark.read.parquet(f"{self.path}/counts").groupBy(*self.keys).agg(F.sum("n").alias("n"))
