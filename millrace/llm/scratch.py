"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset a temporary folder will do, but only for a session that runs on one machine; on a cluster the executors
    would each write to a disk of their own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Cuts the lineage: a lost executor costs a reread of the table, not a rerun of the jobs before it. The shuffle
    files of the jobs that made the table are dropped once it stands; the session's setting for that is put back as it was.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


ROW_KEY, ROW_HASH = "_row_key", "_row_hash"


def row_hash(df: DataFrame, *seeds: int) -> Column:
    """A hash of all columns of a row. Maps and variants, which Spark does not hash, go in as JSON."""
    odd = lambda c: any(kind in df.schema[c].dataType.simpleString() for kind in ("map<", "variant"))
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    return F.xxhash64(*map(F.lit, seeds), *(F.to_json(F.struct(quoted[c])) if odd(c) else quoted[c] for c in df.columns))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with two columns of reserved names: ROW_KEY, a number of its own for each row, and ROW_HASH, of its columns.

    Columns of ``df`` that begin with an underscore have to be put ``aside``.
    """
    return materialize(df.withColumns({ROW_KEY: F.monotonically_increasing_id(), ROW_HASH: row_hash(df)}), name)


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with other names for its columns that begin with an underscore, as reserved ones do, and what to call them again."""
    taken, back = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("_"):
            name = "x" + c
            while name.lower() in taken:
                name = "x" + name
            taken.add(name.lower())
            back[name] = c
    return df.withColumnsRenamed({c: name for name, c in back.items()}), back


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
