"""Sinks: upserts, appended history, replaced tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], update_columns: list[str] | None = None, insert_defaults: dict | None = None) -> DataFrame:
    """`target` after the updates; its columns.

    A matched row takes `update_columns` (all it brings, if not given) from the update,
    nulls too; a column that the update lacks keeps its value. An unmatched update is
    inserted; what it lacks is taken from `insert_defaults`. Keys in `updates` must be
    unique; null keys match nothing.
    """
    mine = update_columns if update_columns is not None else [c for c in updates.columns if c not in keys]
    t = target.withColumn("_old", F.lit(True)).alias("t")
    u = updates.withColumn("_new", F.lit(True)).alias("u")
    joined = t.join(u, [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys], "full_outer")
    old, new = F.col("t._old").isNotNull(), F.col("u._new").isNotNull()
    defaults = insert_defaults or {}

    def value(c: str) -> F.Column:
        kept = F.col(f"t.{c}")
        if c in keys:
            return F.coalesce(kept, F.col(f"u.{c}"))
        default = F.lit(defaults.get(c)).cast(target.schema[c].dataType)
        brought = F.col(f"u.{c}") if c in updates.columns else None
        inserted = default if brought is None else (F.coalesce(brought, default) if c in defaults else brought)
        return F.when(old & new & F.lit(c in mine and brought is not None), brought if brought is not None else kept).when(old, kept).otherwise(inserted)

    return joined.select(*[value(c).alias(c) for c in target.columns])


def replace_table(df: DataFrame, path: str, staging: str | None = None) -> None:
    """Replaces a table that `df` may be read from: writes beside it, moves the old one
    aside, then the new one in. At no time is there neither."""
    spark = df.sparkSession
    aside = staging or f"{path.rstrip('/')}__new"
    df.write.mode("overwrite").parquet(aside)
    jvm = spark.sparkContext._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path))
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}__old")
    fs.delete(old, True)
    if fs.exists(b) and not fs.rename(b, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(a, b):
        raise OSError(f"could not move {aside} to {path}; the old table is {old}")
    fs.delete(old, True)
