"""Price history: analysis, snapshots, changes, rolling figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import cents_to_price, feed_time
from ..functions.semantics import half_up
from . import blocks

KEY = ["product_id", "country"]


def recommendation(from_low: Column, from_average: Column) -> Column:
    return (
        F.when(from_low <= 5, "great_deal").when(from_average <= -10, "great_deal").when(from_average <= -5, "good_price")
        .when(from_average <= 5, "fair").otherwise("wait")
    )


def feed_recommendation(from_average: Column) -> Column:
    return F.when(from_average <= -15, "great_deal").when(from_average <= -5, "good_price").when(from_average <= 5, "fair").otherwise("wait")


def analyze_prices(history: DataFrame, prices: DataFrame, current: Column, since: Column, until: Column) -> DataFrame:
    """For each product and country with two points of type amazon or more and a current
    price: average, low, high, distance from average and low, recommendation."""
    seen = history.where((F.col("price_type") == "amazon") & (F.col("recorded_at") > since) & (F.col("recorded_at") <= until))
    # prices are whole cents: their sum is exact, so the average doesn't depend on the order
    mean = F.sum(F.round(F.col("price") * 100).cast("long")) / (F.lit(100.0) * F.count("price"))
    stats = seen.groupBy(*KEY).agg(mean.alias("avg"), F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("points")).where("points >= 2")
    return compared(stats, prices, current)


def compared(stats: DataFrame, prices: DataFrame, current: Column) -> DataFrame:
    """Average, low, high and number of points by product and country beside the current price."""
    rows = stats.join(prices.select(*KEY, current.alias("current")), KEY).where("current is not null")
    pct = lambda a, b: F.try_divide(a - b, b) * 100
    avg, low = pct(F.col("current"), F.col("avg")), pct(F.col("current"), F.col("low"))
    return rows.select(
        *KEY, "points", "current", half_up(F.col("avg"), 2).alias("average"), "low", "high",
        half_up(avg, 1).alias("pct_from_average"), half_up(low, 1).alias("pct_from_low"), recommendation(low, avg).alias("recommendation"),
    )


def analyze_feed(df: DataFrame, current: str = "current", avg90: str = "avg90") -> DataFrame:
    base = F.coalesce(avg90, current)
    return df.withColumn("recommendation", feed_recommendation(F.coalesce(F.try_divide(F.col(current) - base, base) * 100, F.lit(0.0))))


def history_coverage(history: DataFrame, products: DataFrame) -> DataFrame:
    span = F.greatest(F.lit(1), F.ceil((F.unix_seconds(F.max("recorded_at").cast("timestamp")) - F.unix_seconds(F.min("recorded_at").cast("timestamp"))) / 86400))
    got = history.groupBy(F.col("product_id").alias("id")).agg(span.cast("long").alias("days"), F.count("*").alias("points"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return products.select("id").join(got, "id", "left").select("id", zero("days"), zero("points"))


def history_stats(history: DataFrame) -> DataFrame:
    days = (F.datediff(F.max("recorded_at"), F.min("recorded_at"))).cast("long")
    return history.agg(F.count("*").alias("n_rows"), F.countDistinct("product_id").alias("products"), F.min("recorded_at").cast("date").alias("oldest"), F.max("recorded_at").cast("date").alias("newest"), days.alias("days"))


def latest_history(history: DataFrame, tie: list[str] = ("price",)) -> DataFrame:
    """The last point of each product, country and type: a partial maximum, no sort."""
    last = F.max(F.struct("recorded_at", *tie))
    out = history.groupBy(*KEY, "price_type").agg(last.alias("m"))
    return out.select(*KEY, "price_type", "m.*")


def snapshot_history(prices: DataFrame, history: DataFrame, as_of: Column, hours: int = 23) -> DataFrame:
    """New points at as_of: the main price (amazon, else new) unless its type was
    recorded within `hours`, and with it the used and the warehouse price."""
    main = F.when(F.col("amazon_price").isNotNull(), F.struct(F.lit("amazon").alias("price_type"), F.col("amazon_price").alias("price"))).otherwise(
        F.struct(F.lit("new").alias("price_type"), F.col("new_price").alias("price"))
    )
    last = history.where(F.col("recorded_at") <= as_of).groupBy(*KEY, "price_type").agg(F.max("recorded_at").alias("last"))
    due = (
        prices.withColumn("main", main).where("main.price > 0").withColumn("price_type", F.col("main.price_type")).join(last, [*KEY, "price_type"], "left")
        .where(F.col("last").isNull() | (F.col("last").cast("timestamp") < as_of - F.make_dt_interval(hours=F.lit(hours))))
    )
    extra = [(t, c) for t, c in (("used", "used_price"), ("warehouse", "warehouse_price")) if c in prices.columns]
    rows = F.array(F.col("main"), *[F.when(F.col(c) > 0, F.struct(F.lit(t).alias("price_type"), F.col(c).alias("price"))) for t, c in extra])
    return due.select(*KEY, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select(*KEY, "x.*", as_of.alias("recorded_at"))


def price_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` (key, price) whose price differs from `old`'s; first sights are none."""
    return new.join(old.select(*KEY, F.col("price").alias("old_price")), KEY).where("price <> old_price")


def price_changes_log(ticks: DataFrame, order: list[str]) -> DataFrame:
    before = F.lag("price").over(Window.partitionBy(*KEY, "price_type").orderBy(*order))
    return ticks.withColumn("old_price", before).where("price <> old_price")


def rolling_price_stats(history: DataFrame, keys: list[str] = ("product_id", "country", "price_type"), days: tuple[int, int] = (30, 90)) -> DataFrame:
    """Each point with its 30 and 90 day averages and the lowest and highest so far.

    A series is cut into stretches of twice the longer average. A window holds one stretch, of the
    one before it the days that its first points look back on, and a row of the lowest and highest of all
    earlier stretches. So a product with half of all points is spread over tasks, and each point is dealt once.
    """
    day = 86400
    t = F.unix_seconds(F.col("recorded_at").cast("timestamp"))
    length = 2 * max(days) * day
    # names of its own for all columns, so that none meets one of this function's and those not asked for are not dealt
    named, own = dict(zip(history.columns, range(len(history.columns)), strict=True)), lambda c: F.col(f"_c{named[c]}")
    by = [own(k) for k in keys]
    rows = history.withColumn("_t", t).toDF(*[f"_c{i}" for i in named.values()], "_t").withColumn("_block", blocks.time_block(F.col("_t"), length))
    price = own("price")
    ends = rows.groupBy(*by, "_block").agg(F.min(price).alias("_a"), F.max(price).alias("_b"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # before all points of its window; points without a time are a stretch before all others
    first = ends.select(*by, "_block", (F.col("_block") * length - max(days) * day - 1).alias("_t"), F.min("_a").over(earlier).alias("_low"), F.max("_b").over(earlier).alias("_high")).where("_low is not null")
    late = rows.where(F.col("_t") >= (F.col("_block") + 1) * length - max(days) * day).select(*by, price, F.col("_block") + 1, "_t")
    late = late.toDF(*[f"_c{named[c]}" for c in (*keys, "price")], "_block", "_t")
    dealt = (
        rows.withColumns({"_own": F.lit(True), "_low": price, "_high": price})
        .unionByName(late.withColumn("_own", F.lit(False)), allowMissingColumns=True).unionByName(first.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    )
    over = lambda *ends: Window.partitionBy(*by, "_block").orderBy("_t").rangeBetween(*ends)
    back, so_far = [over(-n * day, Window.currentRow) for n in days], over(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.select("*", *[F.avg(price).over(w).alias(f"_avg{i}") for i, w in enumerate(back)], F.min("_low").over(so_far).alias("_lowest"), F.max("_high").over(so_far).alias("_highest"))
    return seen.where("_own").select(*[own(c).alias(c) for c in history.columns], F.col("_avg0").alias("avg30"), F.col("_avg1").alias("avg90"), F.col("_lowest").alias("low"), F.col("_highest").alias("high"))


def chart_series(history: DataFrame, keys: list[str] = ("product_id",)) -> DataFrame:
    """x by time and y by price, each from 0 to 1 within a series of two points or more."""
    all_ = Window.partitionBy(*keys)
    t = F.unix_seconds(F.col("recorded_at").cast("timestamp"))
    scaled = lambda c: F.try_divide(c - F.min(c).over(all_), F.coalesce(F.nullif(F.max(c).over(all_) - F.min(c).over(all_), F.lit(0)), F.lit(1)))
    return history.withColumn("_n", F.count("*").over(all_)).where("_n >= 2").withColumn("x", scaled(t)).withColumn("y", scaled(F.col("price"))).drop("_n")


def explode_history(feed: DataFrame, types: dict[int, str]) -> DataFrame:
    """asin, price_type, recorded_at, price from flat (minute, cents) lists by type number."""
    lists = F.array(*[F.struct(F.lit(name).alias("price_type"), F.get("csv", F.lit(i)).alias("flat")) for i, name in types.items()])
    rows = feed.select("asin", F.explode(lists).alias("l")).where(F.size("l.flat") >= 2)
    rows = rows.select("asin", "l.price_type", "l.flat", F.explode(F.sequence(F.lit(0), F.size("l.flat") - 2, F.lit(2))).alias("i"))
    price = cents_to_price(F.get("flat", F.col("i") + 1))
    return rows.select("asin", "price_type", feed_time(F.get("flat", F.col("i"))).alias("recorded_at"), price.alias("price")).where("price is not null")
