"""Sitemap, structured data, specification tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import filled


def sitemap(site: str, products: DataFrame, categories: DataFrame, articles: DataFrame | None, languages: list[str]) -> DataFrame:
    """url, lastmod, changefreq, priority, alternates of products, categories, articles."""

    def family(df: DataFrame, folder: str, lastmod: str | None, freq: str, priority: float) -> DataFrame:
        path = F.concat(F.lit(f"/{folder}/"), "slug")
        alternates = F.create_map(*[x for c in languages for x in (F.lit(c), F.concat(F.lit(f"{site}/{c}"), path))])
        mod = F.col(lastmod).cast("date") if lastmod else F.lit(None).cast("date")
        return df.select(F.concat(F.lit(site), path).alias("url"), mod.alias("lastmod"), F.lit(freq).alias("changefreq"), F.lit(priority).alias("priority"), alternates.alias("alternates"))

    parts = [family(products, "p", "updated_at", "daily", 0.8), family(categories.where(~F.coalesce("hidden", F.lit(False))), "c", None, "daily", 0.9)]
    if articles is not None:
        parts.append(family(articles, "blog", "publish_date", "weekly", 0.6))
    return reduce(DataFrame.unionByName, parts)


def product_jsonld(rows: DataFrame, currency: str = "EUR") -> DataFrame:
    """id, jsonld; null where there is neither an offer nor a rating. Prices are in the rows' own currency, if
    they have such a column, else in the given one."""
    unit = F.coalesce("currency", F.lit(currency)) if "currency" in rows.columns else F.lit(currency)
    offer = F.when(
        F.col("n_prices") > 0,
        F.struct(F.lit("AggregateOffer").alias("@type"), F.col("low").alias("lowPrice"), F.col("high").alias("highPrice"), F.col("n_prices").alias("offerCount"), unit.alias("priceCurrency")),
    )
    rating = F.when((F.col("rating") > 0) & (F.col("review_count") > 0), F.struct(F.lit("AggregateRating").alias("@type"), F.col("rating").alias("ratingValue"), F.col("review_count").alias("reviewCount")))
    body = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("title").alias("name"), F.col("asin").alias("sku"),
        F.struct(F.lit("Brand").alias("@type"), F.col("brand").alias("name")).alias("brand"), offer.alias("offers"), rating.alias("aggregateRating"),
    )
    return rows.select("id", F.when(offer.isNotNull() | rating.isNotNull(), F.to_json(body)).alias("jsonld"))


def spec_table(products: DataFrame, core: dict[str, str], labels: DataFrame, specs: str = "specs") -> DataFrame:
    """id, place, label, value: core columns, then the spec map under translated labels
    (labels: key, label); empty values drop out, of like labels the first stays."""
    first = F.array(*[F.struct(F.lit(label).alias("key"), F.col(c).cast("string").alias("value")) for c, label in core.items()])
    rest = F.transform(F.coalesce(F.map_entries(specs), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    rows = products.select("id", F.posexplode(F.concat(first, rest)).alias("place", "e")).select("id", "place", "e.key", filled(F.trim("e.value")).alias("value")).where("value is not null")
    rows = rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    n = F.row_number().over(Window.partitionBy("id", F.lower("label")).orderBy("place"))
    return rows.withColumn("_n", n).where("_n = 1").select("id", "place", "label", "value")
