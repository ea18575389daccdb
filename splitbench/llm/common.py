"""What the corpus operators share: column selection, shared tables and the word rule."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these exact names, in this order.

    Other columns may repeat the names or differ from them only by case; the
    first exact match counts, then the first match in any case.
    """
    have = df.columns
    folded = [c.lower() for c in have]
    by_place = df.toDF(*[f"c{i}" for i in range(len(have))])
    places = [have.index(n) if n in have else folded.index(n.lower()) for n in names]
    return by_place.select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names)])


class Numbered:
    """A frame with its columns renamed by place, so that new columns cannot clash with its own."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"_own_{i}" for i in range(len(self.names))])

    def place(self, name: str) -> str:
        """The new name of a column: the first of this exact name, or of this name in any case."""
        folded = [c.lower() for c in self.names]
        return f"_own_{self.names.index(name) if name in self.names else folded.index(name.lower())}"

    def restore(self, df: DataFrame, *more: str) -> DataFrame:
        """The frame's own columns under their own names, and df's columns ``more``, which replace own ones."""
        return df.select(*[F.col(f"_own_{i}").alias(n) for i, n in enumerate(self.names) if n not in more], *more)


#: Rows that an Arrow batch may hold on its way to Python: texts may be long, and a worker holds a batch.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def on_path(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver found it by sys.path, and bound their batches."""
    if not 0 < int(spark.conf.get(_BATCH_CONF, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of the shared tables made so far, for drop_shared_tables().
_MADE: list[str] = []


#: Partitions for each core that a narrow table or a stage is written in at most.
FILES_A_CORE = 8


def fewer_files(df: DataFrame) -> DataFrame:
    """df in at most ``FILES_A_CORE`` partitions a core, without a shuffle.

    A scan has a task for every so many MB of text.  What comes out of it may be a
    few bytes a row, and a file for each task would be more work than its rows.
    Where executors come and go without a known limit, df stays as it is.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    cores = sc.defaultParallelism
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        cores = int(sc.getConf().get("spark.dynamicAllocation.maxExecutors", "0")) * int(sc.getConf().get("spark.executor.cores", "1"))
    return df.coalesce(FILES_A_CORE * cores) if cores else df


def shared_table(df: DataFrame, name: str, as_is: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; ``as_is`` with a file for each of its partitions.

    Later steps start from the table: they survive lost executors without
    recomputing df, and rows keep what nondeterministic steps assigned to them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if as_is else fewer_files(df)).write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared_tables(spark: SparkSession) -> int:
    """Delete every shared table made so far, once no result needs them; returns how many."""
    done, jvm, conf = 0, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


class Located(Numbered):
    """A Numbered frame whose rows also have a place: ``_file``, a hash of the file's path, and ``_row``, the number in it.

    Places are the same in every scan, however files are split among tasks, so a
    decision made on a narrow scan can be joined to a second, whole one.  A frame
    that is not a plain scan of Parquet files is written to a shared table first.
    """

    def __init__(self, df: DataFrame):
        super().__init__(df)
        try:
            rows = self._placed(df)
        except AnalysisException:
            rows = self._placed(shared_table(self.df, "rows"))
        self.df = rows.toDF(*self.df.columns, "_file", "_row")

    @staticmethod
    def _placed(df: DataFrame) -> DataFrame:
        found = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(found["file_path"]).alias("_file"), found["row_index"].alias("_row"))


#: A table of places and small values is broadcast up to this many rows (tens of MB), else joined by shuffle.
FEW_ROWS = 500_000


def broadcast_if_few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """The written table, marked for broadcast if a count shows at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus
