"""What several operators of this package share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most so many bytes may be broadcast; callers prove the bound.
BROADCAST_BYTES = 8 << 20


def ready_checkpoints(spark: SparkSession) -> None:
    """Sees to it that checkpoint() has a folder that all executors share.

    The cluster names it in spark.checkpoint.dir. Where nothing is set, a local
    session gets a temporary folder (tests); any other session is an error, since
    executors would not see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: each later read sees
    one and the same version of them, whatever executors are lost."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever store its path names."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, most_bytes_a_row: int) -> DataFrame:
    """A table that was cut(), marked for broadcast if its rows, counted, show that it
    stays below BROADCAST_BYTES; else as it is, and Spark shuffles it."""
    return F.broadcast(df) if df.count() * most_bytes_a_row <= BROADCAST_BYTES else df


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
