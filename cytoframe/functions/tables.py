"""Tables written once in the shared folder, where recomputing would cost or could differ."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets one of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file:{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Paths of the tables that this process has written and not deleted.
_live: list[str] = []


class Written:
    """A DataFrame written once as Parquet in the shared folder and read back.

    Cuts lineage without relying on any one executor's disk. drop() frees the
    files once nothing reads them any more; release() frees all that are left,
    and the end of the application does too.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/t-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        fs, p = _file_system(self.spark, self.path)
        fs.deleteOnExit(p)
        _live.append(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        fs, p = _file_system(self.spark, self.path)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)
        if self.path in _live:
            _live.remove(self.path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with the written tables."""
    path = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    _live.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read back: lineage ends, and every later pass sees the same values."""
    return Written(df).df


def release(spark: SparkSession) -> int:
    """Deletes every table that operators wrote in this process; for when their results have been read. Returns how many."""
    n = len(_live)
    while _live:
        fs, p = _file_system(spark, _live.pop())
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)
    return n


#: A key with more rows than this, and than one in HOT_KEYS of all, is hot.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def meet(rows: DataFrame, table: DataFrame, key: str, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """rows joined by key with table, which has one row for each key and in column n how many of the `total` rows have it.

    At most hot_keys keys can be hot; they are broadcast and their rows stay
    where they are. Other keys meet their rows in a join.
    """
    often = max(HOT_ROWS, total // hot_keys)
    hot, other = F.broadcast(table.where(F.col("n") > often).drop("n")), table.where(F.col("n") <= often).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(other, key))


#: Most rows of ids and numbers that are broadcast once they have been counted.
SMALL_ROWS = 300_000


def small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of few narrow columns, marked for broadcast if it has few rows; otherwise as it is, for a join by shuffle."""
    return F.broadcast(table) if table.count() <= most else table
