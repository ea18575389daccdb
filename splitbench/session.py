"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none and is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of the tables made in each open scratch(), the innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that materialize() makes inside it, for results that need none of them afterwards."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        _delete(spark, made)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any longer."""
    for df in tables:
        _delete(df.sparkSession, [df._stored])


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet and read it back.

    What follows plans from a scan: plans stay small however many steps precede,
    nothing is computed twice, and a lost executor costs no earlier step.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored = path
    return stored


#: A table of fewer bytes than this for each core is looked at: it may be one row group, which one task would read alone.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if it is small and a scan would leave most of them idle; else df as it is.

    Sizes come from the plan, places from a count that reads no column; a table
    that is large enough for all cores is neither counted nor shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL:
        return df
    busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if busy < cores else df
