"""Daily figures of price points, kept up as history comes in.

A row holds a day's count, sum of cents, lowest, highest, first and last point of a product,
country and type. Such rows add up, so an analysis over weeks or months reads one row a day instead of all points.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import BucketTable
from .history import KEY, compared

SERIES = [*KEY, "price_type"]
_SUM = lambda a, b: a + F.coalesce(b, F.lit(0))
_SUMS = {"points": _SUM, "cents": _SUM, "low": F.least, "high": F.greatest, "first_at": F.least, "last_at": F.greatest}


def day_number(time: Column) -> Column:
    """Days since 1970; a day ends at midnight and midnight is its last moment, so `after one midnight, up to
    another` is a range of whole days."""
    return F.ceil(F.unix_micros(time.cast("timestamp")) / 86_400_000_000).cast("int")


def daily_figures(history: DataFrame) -> DataFrame:
    """One row a product, country, type and day. Points without a time or a price are left out."""
    rows = history.where("recorded_at is not null and price is not null").withColumns({"day": day_number(F.col("recorded_at")), "_at": F.col("recorded_at").cast("timestamp")})
    cents = F.round(F.col("price") * 100).cast("long")
    return rows.groupBy(*SERIES, "day").agg(
        F.count("*").alias("points"), F.sum(cents).alias("cents"), F.min("price").alias("low"), F.max("price").alias("high"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at")
    )


def _with_old(new: DataFrame, old: DataFrame) -> DataFrame:
    """Daily figures of a batch with those that its days have so far."""
    keys = [*SERIES, "day"]
    rows = new.join(old.select(*keys, *[F.col(c).alias(f"_{c}") for c in _SUMS]), keys, "left")
    return rows.select(*keys, *[f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in _SUMS.items()])


def daily_table(path: str, buckets: int = 64) -> BucketTable:
    """Daily figures in hash buckets by product."""
    return BucketTable(path, (*SERIES, "day"), (), buckets, by="product_id")


def add_history(table: BucketTable, history: DataFrame, batch: str) -> bool:
    """Adds a batch of points to the table's figures; whether it was new. Only days that the batch has are
    rewritten, and a batch that comes again adds nothing."""
    new = daily_figures(history)
    if table.has(history.sparkSession, batch):
        return False
    if table.exists(history.sparkSession):
        # worked out once for its buckets and its rows
        new = new.persist(StorageLevel.DISK_ONLY)
        try:
            table.append(_with_old(new, table.read(history.sparkSession, new)), batch)
        finally:
            new.unpersist()
        return True
    table.append(new, batch)
    return True


def analyze_daily(daily: DataFrame, prices: DataFrame, current: Column, since: Column, until: Column) -> DataFrame:
    """What history.analyze_prices() gives for points after one midnight and up to another."""
    days = daily.where((F.col("price_type") == "amazon") & (F.col("day") > day_number(since)) & (F.col("day") <= day_number(until)))
    mean = F.sum("cents") / (F.lit(100.0) * F.sum("points"))
    stats = days.groupBy(*KEY).agg(mean.alias("avg"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("points").alias("points"))
    return compared(stats.where("points >= 2"), prices, current)


def daily_coverage(daily: DataFrame, products: DataFrame) -> DataFrame:
    """What history.history_coverage() gives."""
    span = F.greatest(F.lit(1), F.ceil((F.unix_seconds(F.max("last_at")) - F.unix_seconds(F.min("first_at"))) / 86400))
    got = daily.groupBy(F.col("product_id").alias("id")).agg(span.cast("long").alias("days"), F.sum("points").alias("points"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return products.select("id").join(got, "id", "left").select("id", zero("days"), zero("points"))
