"""Joins that make and keep the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_prices(products: DataFrame, prices: DataFrame, country: str | None = None) -> DataFrame:
    p = prices if country is None else prices.where(F.col("country") == country)
    return products.join(p, products["id"] == p["product_id"]).drop("product_id")


def build_products(products: DataFrame, prices: DataFrame, price: Column) -> DataFrame:
    """Products with maps by country; only countries that have the value."""
    values = {"prices": price, "price_avg_30": F.col("price_avg_30"), "price_avg_90": F.col("price_avg_90"), "prices_last_updated": F.col("last_updated")}
    maps = [F.map_from_entries(F.collect_list(F.when(c.isNotNull(), F.struct("country", c)))).alias(f"{k}_by_country") for k, c in values.items()]
    return products.join(prices.groupBy(F.col("product_id").alias("id")).agg(*maps), "id", "left")


def localize(df: DataFrame, country: str) -> DataFrame:
    at = lambda c: F.try_element_at(c, F.lit(country.lower()))
    return df.withColumn("price", at("prices_by_country")).withColumn("last_updated", at("prices_last_updated_by_country"))


def product_detail(products: DataFrame, history: DataFrame, since: Column, max_points: int = 100) -> DataFrame:
    """Products with their last `max_points` price points in the order of time."""
    last = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("recorded_at"), F.desc("price")))
    points = history.where(F.col("recorded_at") >= since).withColumn("_n", last).where(F.col("_n") <= max_points)
    series = points.groupBy(F.col("product_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("recorded_at", "price"))).alias("price_history"))
    return products.join(series, "id", "left")


def stale_prices(products: DataFrame, prices: DataFrame, country: str, before: Column) -> DataFrame:
    p = prices.where(F.col("country") == country).select(F.col("product_id").alias("id"), "last_updated")
    return products.join(p, "id", "left").where(F.col("last_updated").isNull() | (F.col("last_updated") < before))


def split_new_existing(incoming: DataFrame, products: DataFrame) -> DataFrame:
    known = products.select("asin").distinct().withColumn("_known", F.lit(True))
    return incoming.join(known, "asin", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def catalog_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """asin, status: insert (only local), update (both), untouched (only remote)."""
    a, b = local.select("asin", F.lit(True).alias("l")), remote.select("asin", F.lit(True).alias("r"))
    status = F.when(F.col("r").isNull(), "insert").when(F.col("l").isNull(), "untouched").otherwise("update")
    return a.join(b, "asin", "full_outer").select("asin", status.alias("status"))


def remap_ids(child: DataFrame, local: DataFrame, remote: DataFrame, key: str = "product_id") -> DataFrame:
    """`child` with remote_id and status: ok, no_local_product, no_remote_product."""
    a = local.select(F.col("id").alias(key), "asin")
    b = remote.select("asin", F.col("id").alias("remote_id"))
    status = F.when(F.col("asin").isNull(), "no_local_product").when(F.col("remote_id").isNull(), "no_remote_product").otherwise("ok")
    return child.join(a, key, "left").join(b, "asin", "left").withColumn("status", status)


def match_feed(feed: DataFrame, products: DataFrame) -> DataFrame:
    return feed.join(products.select(F.col("id").alias("product_id"), "asin"), "asin")


def resolve_identifiers(feed: DataFrame, identifiers: DataFrame, products: DataFrame) -> DataFrame:
    """feed (source, external_id, country, gtin) with product_id: by identifier of the
    country, then of none, then by gtin."""
    ids = identifiers.select("source", "external_id", F.col("country").alias("_c"), F.col("product_id").alias("_p"))
    best = F.min_by("_p", F.when(F.col("_c").isNull(), 1).otherwise(0))
    hits = feed.join(ids, ["source", "external_id"]).where(F.col("_c").isNull() | (F.col("_c") == F.col("country"))).groupBy("source", "external_id", "country").agg(best.alias("by_id"))
    gtin = products.where("gtin is not null").groupBy("gtin").agg(F.min("id").alias("by_gtin"))
    same = [feed[c].eqNullSafe(hits[c]) for c in ("source", "external_id", "country")]
    return feed.join(hits, same, "left").select(feed["*"], "by_id").join(gtin, "gtin", "left").withColumn("product_id", F.coalesce("by_id", "by_gtin")).drop("by_id", "by_gtin")


def redirect_map(old_slugs: DataFrame, products: DataFrame, asin: Column) -> DataFrame:
    """old slug -> slug, for old slugs that end in a known ASIN."""
    now = products.select("asin", F.col("slug").alias("new_slug"))
    return old_slugs.withColumn("asin", asin).join(now, "asin").where("new_slug <> slug")


def category_children(categories: DataFrame, root: str) -> DataFrame:
    return categories.where((F.col("parent") == root) & ~F.coalesce("hidden", F.lit(False)))


_PATHS = """
with recursive p(slug, path) as (
  select slug, array(slug) from {roots}
  union all
  select c.slug, array_append(p.path, c.slug) from p join {children} c on c.parent = p.slug
)
select slug, path from p"""


def category_paths(categories: DataFrame) -> DataFrame:
    """slug, path (root first) of each category, at any depth up to Spark's limit of 100 levels. A category whose
    parent is not in the table is a root; categories that are their own ancestors are an error."""
    tree = categories.select("slug", "parent")
    known = tree.select(F.col("slug").alias("parent"), F.lit(True).alias("_known")).distinct()
    rooted = tree.join(F.broadcast(known), "parent", "left")
    roots, children = rooted.where("_known is null").select("slug"), rooted.where("_known").select("slug", "parent")
    paths = tree.sparkSession.sql(_PATHS, roots=roots, children=children)
    lost = F.raise_error(F.concat(F.lit("category "), tree["slug"], F.lit(" is its own ancestor")))
    return tree.join(paths.withColumnRenamed("slug", "_slug"), F.col("slug") == F.col("_slug"), "left").select("slug", F.coalesce("path", lost.cast("array<string>")).alias("path"))


def offers_or_default(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products with their offers; one of the shop's own price where there are none."""
    own = F.array(F.struct(F.lit("Amazon").alias("merchant_name"), F.col("price"), F.lit(0.0).alias("shipping_cost")))
    lists = offers.groupBy(F.col("product_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("merchant_name", "price", "shipping_cost"))).alias("offers"))
    return products.join(lists, "id", "left").withColumn("offers", F.coalesce("offers", own))
