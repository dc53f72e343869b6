"""Products and offers from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import map_availability, map_ebay_condition, map_paapi_condition
from ..functions.semantics import filled


def _stacked(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)])


def first_available(sources: list[DataFrame], key: str = "id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy("priority"))
    return _stacked(sources).withColumn("_n", place).where("_n = 1").drop("_n", "priority")


def merge_sources(sources: list[DataFrame], fields: list[str], key: str = "id") -> DataFrame:
    """One row for each key. sources, in the order of priority: key, source, price,
    last_updated and `fields`.

    Rows are folded in order: one that is newer than all before it sets the fields that
    it has; empty ones keep what there was. The best offer is the lowest price, the
    first source on ties. offers lists all, sources each once, both in order.
    """
    order = Window.partitionBy(key).orderBy("priority")
    newest = F.max("last_updated").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = _stacked(sources).withColumn("_sets", newest.isNull() | (F.col("last_updated") > newest))
    kind = dict(rows.dtypes)
    value = lambda f: filled(F.col(f)) if kind[f] == "string" else F.col(f)
    latest = [F.max_by(f, F.when(F.col("_sets") & value(f).isNotNull(), F.col("priority"))).alias(f) for f in fields]
    priced = F.when(F.col("price").isNotNull(), F.struct("price", "priority", "source"))
    return rows.groupBy(key).agg(
        *latest, F.min(priced).alias("_best"), F.array_sort(F.collect_list(F.struct("priority", "source", "price"))).alias("_all"), F.max("last_updated").alias("last_updated")
    ).select(
        key, *fields, "last_updated", F.col("_best.price").alias("best_price"), F.col("_best.source").alias("best_source"),
        F.transform("_all", lambda x: F.struct(x["source"].alias("source"), x["price"].alias("price"))).alias("offers"),
        F.array_distinct(F.transform("_all", lambda x: x["source"])).alias("sources"),
    )


def sort_unified(df: DataFrame, by: str = "price") -> DataFrame:
    key = F.coalesce("best_price", F.lit(float("inf"))).asc() if by == "price" else F.desc_nulls_last("rating")
    return df.orderBy(key, "id")


def feed_offers(feed: DataFrame) -> DataFrame:
    """An offer for each price of a feed row: amazon new, used, warehouse renewed."""
    one = lambda c, condition, merchant: F.struct(F.col(c).alias("price"), F.lit(condition).alias("condition"), F.lit(merchant).alias("merchant"))
    offers = F.filter(F.array(one("amazon_price", "new", "Amazon"), one("used_price", "used", "Amazon Marketplace"), one("warehouse_price", "renewed", "Amazon Warehouse")), lambda x: x["price"] > 0)
    return feed.select("asin", F.explode(offers).alias("o")).select("asin", "o.*")


def best_offer(offers: DataFrame) -> DataFrame:
    """asin, price, merchant of the offer that counts: the new one."""
    return offers.where("condition = 'new'").select("asin", "price", "merchant")


def ebay_products(items: DataFrame) -> DataFrame:
    return items.select(
        F.concat(F.lit("ebay-"), "item_id").alias("id"), "title", "image_url", "url", "price", "shipping_cost",
        map_ebay_condition(F.col("condition_id")).alias("condition"), F.lit("ebay").alias("source"),
    )


def paapi_products(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("asin").alias("id"), "title", "brand", "image_url", "url", "price", map_paapi_condition(F.col("condition")).alias("condition"),
        map_availability(F.col("availability")).alias("availability"), "rating", "review_count", F.lit("amazon-paapi").alias("source"),
    )


def static_products(items: DataFrame, country: str) -> DataFrame:
    return items.select(
        F.col("asin").alias("id"), "title", "brand", F.col("image").alias("image_url"), F.col("prices").getField(country).cast("double").alias("price"), F.lit("static").alias("source")
    )

